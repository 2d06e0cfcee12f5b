"""A whole run: check a table, keep the results and their metric points, look for anomalies."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecheck.operators import anomaly, ingest, results, suite
from tablecheck.operators.checks import KINDS, Rule, rule_from_dict, rule_from_registry, with_tags
from tablecheck.sources.readers import read_source


def run_from_dict(spark: SparkSession, config: Mapping[str, Any], tags: list[str] | None = None, **context) -> DataFrame:
    """From configuration to results: ``source`` is read, ``checks`` (those with a tag) are run on it."""
    rules = [rule_from_dict(check) for check in config.get("checks", ())]
    return suite.settled(read_source(spark, config["source"]), with_tags(rules, tags), **context)


def run_registered(df: DataFrame, checks: DataFrame, sources: DataFrame, source_id: int, tags: list[str] | None = None, **context) -> DataFrame:
    """The registry's active checks of one source on its table, numbered by their ids.

    Checks that ask the same are measured once, whatever their names, and each gets the answer by a join. Only the different
    questions meet the driver; their number is bounded by what people write for a source, that of the checks is not.
    """
    registered = results.rules_of_sources(checks.where(F.col("source_id") == source_id), sources)
    if tags:
        registered = registered.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    # the name is a metric's for history kinds, and part of the reason where there is nothing to ask
    by_name = F.col("assert_type").isin([k for k, kind in KINDS.items() if kind.family == "history"]) | (F.coalesce("query", F.lit("")) == "")
    registered = registered.withColumn("asked_as", F.when(by_name, F.col("name")))
    question = ["query", "assert_type", "assert_value", "asked_as"]
    asked = registered.groupBy(*question).agg(F.min("name").alias("name")).orderBy(*question).collect()
    found = suite.run(df, [rule_from_registry(row.asDict() | {"tags": ()}) for row in asked], **context)
    answer = [part for part in suite.RESULT.split(", ") if part.split()[0] not in ("check_no", "check_name")]
    rows = [(*(row[q] for q in question), *(got[part.split()[0]] for part in answer)) for row, got in zip(asked, found)]
    answers = df.sparkSession.createDataFrame(rows, ", ".join([*(f"{q} string" for q in question), *answer])).alias("a")
    numbered = _numbered(registered, "check_id").alias("c")
    same = [F.col(f"c.{q}").eqNullSafe(F.col(f"a.{q}")) for q in question]
    return numbered.join(answers, same).select("check_no", F.col("c.name").alias("check_name"), *(part.split()[0] for part in answer))


def _numbered(df: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """``check_no`` from 1 in the order of a whole number: ranks within blocks of keys, and the counts of the blocks before."""
    blocked = df.withColumn("block", F.floor(F.col(key) / block))
    before = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocked.groupBy("block").agg(F.count("*").alias("size")).select("block", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = blocked.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(key)))
    return ranked.join(starts, "block").withColumn("check_no", (F.col("before") + F.col("rank")).cast("int")).drop("block", "before", "rank")


def run_and_record(
    df: DataFrame, rules: list[Rule], store: str, run_id: str, run_at: str, tags: list[str] | None = None,
    threshold: float = 3.0, history_days: int = 30, **context,
) -> DataFrame:
    """Runs a suite and stores it under ``store``, in two tables partitioned by day and run:

    ``checks/``   one row per check; its value is also the point of the metric with its name
    ``results/``  checks and anomaly verdicts in one shape

    Returns the run's combined results as stored. Only the suite reads the table under test: history and
    anomaly verdicts come from the stored check rows. A repeated run replaces its own rows, also
    in the history.
    """
    spark = df.sparkSession
    stored = f"{store}/checks"

    def keep(rows: DataFrame, path: str) -> DataFrame:
        at = F.lit(run_at).cast("timestamp")
        stamped = rows.select("*", at.alias("run_at"), F.to_date(at).alias("run_date"), F.lit(run_id).alias("run_id"))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)
        return spark.read.parquet(path).where((F.col("run_date") == F.to_date(at)) & (F.col("run_id") == run_id))

    found = keep(suite.settled(df, with_tags(rules, tags), **context), stored)
    current = found.selectExpr("check_name AS name", "value")
    points = spark.read.parquet(stored).selectExpr("check_name AS name", "value", "run_at", "run_date")
    verdicts = anomaly.detect_all(current, points, run_at, threshold, history_days)
    return keep(ingest.combined_results(found, verdicts), f"{store}/results")
