"""Ordered series of metric points, for any length of history.

A point's position in its series comes from counts per minute plus the rank within the
minute, so no task ever holds a whole metric. Series are then cut into chunks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 10_000


def positions(points: DataFrame) -> DataFrame:
    """``name, value, pos, n``: 0-based position by time among the metric's ``n`` non-null points.

    Points are ranked within their minute, and minutes are counted up within the metric: a task sorts a minute's points,
    or one row per minute of a metric, which for ten years are five millions.
    """
    timed = points.where("value IS NOT NULL").select("name", "value", "run_at", F.date_trunc("minute", "run_at").alias("minute"))
    metric = Window.partitionBy("name")
    before = F.sum("size").over(metric.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))
    minutes = timed.groupBy("name", "minute").agg(F.count("*").alias("size"))
    minutes = minutes.select("name", "minute", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(metric).alias("n"))
    ranked = timed.withColumn("rank", F.row_number().over(Window.partitionBy("name", "minute").orderBy("run_at", "value")))
    return ranked.join(minutes, ["name", "minute"]).select("name", "value", (F.col("before") + F.col("rank") - 1).alias("pos"), "n")


def chunks(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """``name, n, chunk, y, early, late``: ordered values of at most ``size`` points per row.

    ``early`` and ``late`` are the chunk's share of the sums over the first and the last half.
    """
    half = F.floor(F.col("n") / 2)
    return (
        positions(points)
        .withColumn("chunk", F.floor(F.col("pos") / size))
        .groupBy("name", "n", "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("points"),
            F.sum(F.when(F.col("pos") < half, F.col("value")).otherwise(0.0)).alias("early"),
            F.sum(F.when(F.col("pos") >= F.col("n") - half, F.col("value")).otherwise(0.0)).alias("late"),
        )
        .select("name", "n", "chunk", F.expr("transform(points, p -> p.value)").alias("y"), "early", "late")
    )
