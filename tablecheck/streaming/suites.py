"""Checks and metric points on arriving data."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablecheck.operators import suite
from tablecheck.operators.checks import Rule

AVAILABLE = {"availableNow": True}


def check_stream(
    stream: DataFrame, rules: list[Rule], results_path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE, **context
) -> StreamingQuery:
    """Runs the suite on every micro-batch and appends its results with the batch's number.

    Results are partitioned by batch and overwritten per partition, so a batch that is repeated
    after a failure replaces its own rows instead of adding them twice. ``trigger`` says when batches start:
    ``{"processingTime": "30 seconds"}`` goes on, without it what has arrived is worked off.
    """
    def check(batch: DataFrame, batch_id: int) -> None:
        found = suite.settled(batch, rules, **context).withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(results_path)

    return (
        stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def windowed_points(
    stream: DataFrame, time_column: str, name_column: str, window: str, slide: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """Metric points (count and sum of ``value``) per time window and name.

    Rows later than ``lateness`` behind the newest time are dropped; a window is given out once,
    when no row can still fall into it.
    """
    timed = stream.withColumn("_time", F.col(time_column).cast("timestamp")).withWatermark("_time", lateness)
    return timed.groupBy(F.window("_time", window, slide), F.col(name_column).alias("name")).agg(
        F.count("*").cast("double").alias("value"), F.round(F.sum("value"), 4).alias("total")
    ).select("name", F.col("window.start").alias("run_at"), "value", "total")


def append_points(points: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE) -> StreamingQuery:
    """Closed windows only, each once."""
    return (
        points.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def update_points(points: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE) -> StreamingQuery:
    """Every window that a batch has changed, open ones too, under the batch's number; ``newest_points`` reads them."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch_id", F.lit(batch_id))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return points.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def newest_points(kept: DataFrame) -> DataFrame:
    """The last state of each window and name; replaced ones are combined in each task."""
    last = F.max_by(F.struct("value", "total"), "batch_id").alias("p")
    return kept.groupBy("name", "run_at").agg(last).select("name", "run_at", "p.value", "p.total")


_POINT = "name string, run_at timestamp, value double, total double"


def _folded(spark: SparkSession, state: str) -> tuple[DataFrame, int]:
    """The newest folded state, and the batch it goes up to; a first one is empty and goes up to -1."""
    empty = spark.createDataFrame([], f"{_POINT}, batch_id bigint")
    try:
        kept = spark.read.schema(f"{_POINT}, upto bigint").parquet(state)
    except AnalysisException:
        return empty, -1
    upto = kept.agg(F.max("upto")).first()[0]
    return (empty, -1) if upto is None else (kept.where(F.col("upto") == upto).withColumnRenamed("upto", "batch_id"), upto)


def _since(spark: SparkSession, path: str, state: str) -> tuple[DataFrame, int]:
    """The folded state and all batches after it; files of earlier batches are not opened."""
    folded, upto = _folded(spark, state)
    after = spark.read.schema(f"{_POINT}, batch_id bigint").parquet(path).where(F.col("batch_id") > upto)
    return folded.select(*after.columns).unionByName(after), upto


def fold_points(spark: SparkSession, path: str, state: str) -> int:
    """Folds the batches that ``update_points`` has kept so far into one state beside them, and returns the last of them.

    Each fold reads the state before it and the batches since. A fold that is repeated replaces itself; batches that
    it holds, and older states, may be deleted, and are not read again either way.
    """
    known, upto = _since(spark, path, state)
    last = known.agg(F.max("batch_id")).first()[0]
    if last is None or last == upto:
        return upto
    newest = newest_points(known.where(F.col("batch_id") <= last)).withColumn("upto", F.lit(last).cast("bigint"))
    newest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(state)
    return last


def current_points(spark: SparkSession, path: str, state: str) -> DataFrame:
    """``newest_points`` of everything, from the last folded state and the batches since."""
    return newest_points(_since(spark, path, state)[0])
