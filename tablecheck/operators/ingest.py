"""Run payloads (JSON) to runs and results, and results back to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAYLOAD = (
    "run_id STRING, source_id BIGINT, dag_id STRING, task_id STRING, run_at STRING, config STRING, mode STRING, "
    "results ARRAY<STRUCT<name: STRING, metric_name: STRING, passed: BOOLEAN, is_anomaly: BOOLEAN, "
    "value: STRING, current: STRING, expected: STRING, message: STRING>>, summary STRUCT<total: BIGINT, passed: BIGINT>"
)


def parsed(payloads: DataFrame) -> DataFrame:
    """``payload`` texts as columns; a payload without an id gets one, and a time that cannot be read is null.

    Measured values stay texts, as they were sent: a distribution is two numbers.
    """
    doc = payloads.withColumn("doc", F.from_json("payload", PAYLOAD))
    fields = doc.select(*[c for c in payloads.columns], "doc.*")
    made = F.sha2("payload", 256)
    return fields.withColumn("run_id", F.coalesce("run_id", made)).withColumn("run_at", F.try_to_timestamp("run_at"))


def run_headers(payloads: DataFrame, order: str) -> DataFrame:
    """One row per run id, from the payload written last (greatest ``order``). ``received``, where the payloads have it, is
    the time of those that name none.

    An aggregate rather than a ranking: a run id that was sent very often is combined early.
    """
    run_at = F.coalesce("run_at", F.col("received").cast("timestamp")) if "received" in payloads.columns else F.col("run_at")
    counted = parsed(payloads).select(
        "run_id", "source_id", "dag_id", "task_id", run_at.alias("run_at"), F.col(order).alias("sent"),
        F.coalesce("summary.total", F.size("results").cast("bigint"), F.lit(0)).alias("total"),
        F.coalesce("summary.passed", F.lit(0)).alias("passed"),
    )
    last = F.max_by(F.struct("source_id", "dag_id", "task_id", "run_at", "total", "passed"), "sent")
    return counted.groupBy("run_id").agg(last.alias("r")).select(
        "run_id", "r.*", (F.col("r.total") - F.col("r.passed")).alias("failed"),
        F.when(F.col("r.total") == F.col("r.passed"), "pass").otherwise("fail").alias("status"),
    )


def run_result_rows(payloads: DataFrame, order: str | None = None) -> DataFrame:
    """One row per reported result; a result without a verdict passed unless it is an anomaly.

    With ``order`` only the payload of each run that was written last counts, as for its header.
    """
    if order is not None:
        ids = payloads.withColumn("_run", F.coalesce(F.get_json_object("payload", "$.run_id"), F.sha2("payload", 256)))
        payloads = ids.groupBy("_run").agg(F.max_by("payload", order).alias("payload")).select("payload")
    each = parsed(payloads).select("run_id", "run_at", F.posexplode("results").alias("at", "r")).select("run_id", "run_at", (F.col("at") + 1).alias("check_no"), "r.*")
    return each.select(
        "run_id", "run_at", "check_no", F.coalesce("name", "metric_name", F.lit("unknown")).alias("name"),
        F.coalesce(F.col("passed"), ~F.coalesce("is_anomaly", F.lit(False))).cast("int").alias("passed"),
        F.coalesce("value", "current").alias("value_actual"), F.coalesce("value", "current").try_cast("double").alias("value"), F.coalesce("expected", F.lit("")).alias("expected"),
        F.coalesce("message", F.lit("")).alias("message"),
    )


def latest_payloads(payloads: DataFrame, order: str) -> DataFrame:
    """The stored payload of each run, parsed."""
    ids = payloads.withColumn("run_id", F.coalesce(F.get_json_object("payload", "$.run_id"), F.sha2("payload", 256)))
    last = ids.groupBy("run_id").agg(F.max_by("payload", order).alias("payload"))
    return parsed(last.drop("run_id"))


def combined_results(checks: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Check results and anomaly verdicts in one shape, duplicates kept.

    The message of a verdict starts with its detector's tag, by which listings and alerts know an anomaly.
    """
    plain = checks.selectExpr(
        "check_name AS name", "passed", "value", "expected", "CAST(NULL AS STRING) AS method",
        "CAST(NULL AS STRING) AS trend", "CAST(NULL AS DOUBLE) AS score", f"{'message' if 'message' in checks.columns else 'CAST(NULL AS STRING)'} AS message",
    )
    found = anomalies.selectExpr(
        "metric_name AS name", "NOT is_anomaly AS passed", "current AS value",
        "if(lower_bound IS NULL OR upper_bound IS NULL, '-', concat(lower_bound, ' - ', upper_bound)) AS expected",
        "method", "trend_direction AS trend", "score",
        "concat('[', method, '] trend=', coalesce(trend_direction, 'stable'), coalesce(concat(if(method = 'holt_winters', ' norm_score=', ' z='), format_number(abs(score), '0.00')), '')) AS message",
    )
    return plain.unionByName(found)


def result_rows(stored: DataFrame) -> DataFrame:
    """Stored combined results in the shape of ``results``: what listings, labels and digests read."""
    return stored.selectExpr(
        "run_id", "CAST(NULL AS INT) AS check_no", "CAST(NULL AS BIGINT) AS check_id", "name AS check_name", "CAST(passed AS INT) AS passed",
        "CAST(value AS STRING) AS value_actual", "expected", "message",
    )


def run_rows(stored: DataFrame, source_id: int | None = None, dag_id: str | None = None) -> DataFrame:
    """One header per run of stored combined results, in the shape of ``runs``."""
    counts = stored.groupBy("run_id", "run_at").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
    return counts.select(
        "run_id", F.lit(source_id).cast("bigint").alias("source_id"), F.lit(dag_id).cast("string").alias("dag_id"), "run_at", "total", "passed",
        (F.col("total") - F.col("passed")).alias("failed"), F.when(F.col("total") == F.col("passed"), "pass").otherwise("fail").alias("status"),
    )


def json_report(checks: DataFrame, run_at: str, anomalies: DataFrame | None = None, contracts: DataFrame | None = None) -> DataFrame:
    """One JSON text with a summary and all results of a suite run.

    The lists hold one entry per rule, metric or promise of the run, which the rule list bounds.
    """
    def gathered(df: DataFrame, columns: list[str], **counts: str):
        """Counts and ordered rows of one part, from one aggregation of it."""
        totals = "".join(f", count_if({condition}) AS {name}" for name, condition in counts.items())
        rows = f"array_sort(collect_list(struct({', '.join(columns)})))"
        return df.agg(F.expr(f"struct({rows} AS rows{totals}) AS part")).scalar()

    check_part = gathered(
        checks, ["check_no", "check_name", "value", "expected", "passed", "message"],
        total="true", passed="passed", failed="NOT passed",
    )
    fields = [F.lit(run_at).alias("run_at"), check_part.alias("checks")]
    if anomalies is not None:
        verdict = ["metric_name", "current", "is_anomaly", "score", "method", "lower_bound", "upper_bound", "trend_direction"]
        fields.append(gathered(anomalies, verdict, total="true", flagged="is_anomaly").alias("anomalies"))
    if contracts is not None:
        promise = ["contract", "rule", "target", "value", "passed", "detail"]
        fields.append(gathered(contracts, promise, total="true", broken="NOT passed").alias("contracts"))
    parts = checks.sparkSession.sql("SELECT 1").select(*fields)
    shape = ["run_at", "struct(checks.total, checks.passed, checks.failed) AS summary", "checks.rows AS checks"]
    if anomalies is not None:
        shape.append("struct(struct(anomalies.total, anomalies.flagged) AS summary, anomalies.rows AS anomalies) AS anomalies")
    if contracts is not None:
        shape.append("contracts.rows AS contracts")
    return parts.selectExpr(f"to_json(struct({', '.join(shape)})) AS report")
