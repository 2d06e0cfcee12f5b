"""Metric history: points ``(name, value, run_at)`` in parquet, partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

POINTS = "name string, value double, run_at timestamp"


def record(points: DataFrame, path: str, run_at: str | None = None) -> None:
    """Appends points; one time per batch unless the points bring their own."""
    stamped = points if run_at is None else points.withColumn("run_at", F.lit(run_at))
    rows = stamped.select(
        F.col("name").cast("string"), F.col("value").cast("double"), F.col("run_at").cast("timestamp")
    ).withColumn("run_date", F.to_date("run_at"))
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def since(points: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Points of the last ``days`` days. A ``run_date`` column prunes the partitions read."""
    moment = F.lit(as_of).cast("timestamp")
    start = moment - F.make_dt_interval(F.lit(days))
    recent = points.where(F.col("run_at") >= start)
    if "run_date" in points.columns:
        recent = recent.where(F.col("run_date") >= F.to_date(start))
    return recent


def before(points: DataFrame, as_of: str) -> DataFrame:
    """Leaves out the point being judged."""
    moment = F.lit(as_of).cast("timestamp")
    earlier = points.where(F.col("run_at") < moment)
    return earlier.where(F.col("run_date") <= F.to_date(moment)) if "run_date" in points.columns else earlier


def known_metrics(points: DataFrame) -> DataFrame:
    return points.select("name").distinct().orderBy("name")


def recent_values(points: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` non-null points of each metric, ``recency`` 1 for the newest.

    The rank filter lets Spark keep only ``n`` rows per metric in each task before the shuffle.
    """
    newest_first = Window.partitionBy("name").orderBy(F.col("run_at").desc(), F.col("value").desc())
    return (
        points.where("value IS NOT NULL")
        .select("name", "value", "run_at")
        .withColumn("recency", F.row_number().over(newest_first))
        .where(F.col("recency") <= n)
    )
