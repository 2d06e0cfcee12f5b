"""Measures gathered on the way to a file or a stream's sink."""

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import observed, suite
from tablecheck.operators.checks import Rule
from tablecheck.session import shared_folder
from tablecheck.streaming import observed as streams, suites

RULES = [
    Rule("rows", "greater_than", 0, metric="count(*)"), Rule("filled", "completeness_ratio", 0.9, column="v"), Rule("unique", "duplicate_row", 0, column="k"),
    Rule("bad", "greater_than", 0, metric="sum(nothing)"), Rule("kinds", "equals", 2, metric="count(DISTINCT v)"), Rule("first", "equals", "a", metric="min(t)"),
    Rule("asked", "equals", 3, query="SELECT count(*) FROM source"), Rule("py", "custom_script", lambda v: v > 0, column="k"),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 2.0, "c")], "k int, v double, t string")


def written(df, path, rules):
    return observed.write_checked(df, rules, lambda d: d.write.mode("overwrite").parquet(path), lambda: df.sparkSession.read.parquet(path))


def plain(results):
    return [(r.check_no, r.check_name, r.value, r.value_text, r.passed, r.message is None) for r in results]


def test_results_are_those_of_the_suite(spark, rows):
    path = shared_folder(spark, "observed")
    assert plain(written(rows, path, RULES).orderBy("check_no").collect()) == plain(suite.run(rows, RULES))
    assert spark.read.parquet(path).count() == 3
    found = observed.Observed(rows, RULES)
    assert [r.name for _, r in found.rules] == ["rows", "filled", "first"] and len(found.others) == 5


def test_one_scan_and_no_job_of_its_own(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    rules = [Rule("n", "greater_than", 0, metric="count(*)"), Rule("m", "less_than", 1e9, metric="max(o_totalprice)")]
    plan = df.observe("m", *observed.Observed(df, rules).columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    spark.sparkContext.setJobGroup("observed-write", "")
    written(df, shared_folder(spark, "one-scan"), rules).collect()
    reads = len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed-write"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert reads <= 2  # the write, and the rows of results


def test_empty_tables_and_no_rules(spark, rows):
    found = written(rows.where("k > 9"), shared_folder(spark, "nothing"), RULES[:2]).collect()
    assert [(r.value, r.passed) for r in found] == [(0.0, False), (None, False)] or [r.value for r in found] == [0.0, 0.0]
    assert written(rows, shared_folder(spark, "no-rules"), []).collect() == []
    with pytest.raises(ValueError, match="unknown assertion"):
        observed.Observed(rows, [Rule("x", "no such kind")])


def test_a_measure_that_fails_does_not_stop_the_write(spark, rows):
    path = shared_folder(spark, "failing")
    found = written(rows, path, [RULES[0], Rule("fails", "greater_than", 0, metric="sum(1 / (k - k))")]).orderBy("check_no").collect()
    assert [(r.check_no, r.passed) for r in found] == [(1, True), (2, False)] and "ZERO" in found[1].message.upper()
    assert spark.read.parquet(path).count() == 3


def test_a_stream_goes_on_from_its_checkpoint(spark, rows):
    source, results, table, checkpoint = (shared_folder(spark, n) for n in ("arriving", "observed-results", "observed-table", "observed-checkpoint"))
    for lot in range(3):
        rows.withColumn("k", F.col("k") + 10 * lot).coalesce(1).write.mode("append").parquet(source)
        own = streams.ObservedStream(spark.readStream.schema(rows.schema).parquet(source), [RULES[0], Rule("top", "less_than", 20, metric="max(k)")], results)
        own.finish(suites.append_points(own.stream, table, checkpoint))
        own.close()
    found = spark.read.parquet(results).orderBy("batch_id", "check_no").collect()
    assert [(r.batch_id, r.value, r.passed) for r in found] == [(0, 3.0, True), (0, 3.0, True), (1, 3.0, True), (1, 13.0, True), (2, 3.0, True), (2, 23.0, False)]
    assert spark.read.parquet(table).count() == 9
    with pytest.raises(ValueError, match="unique"):
        streams.ObservedStream(spark.readStream.schema(rows.schema).parquet(source), RULES[:3], results)
