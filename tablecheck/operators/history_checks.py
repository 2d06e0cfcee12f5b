"""Checks of current values against the recent history of their metrics, for all metrics at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablecheck.functions import verdicts as V
from tablecheck.functions.literals import literal, number
from tablecheck.operators.history import recent_values


def zscore_stats(history: DataFrame, points: int = 100) -> DataFrame:
    """``name, n, mean, std``: mean and population deviation of each metric's last points."""
    return recent_values(history, points).groupBy("name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def trend_stats(history: DataFrame, window: int = 7) -> DataFrame:
    """``name, n, cur, prev``: means of the newest ``window`` points and of those before them."""
    newer = F.col("recency") <= window
    return recent_values(history, 2 * window).groupBy("name").agg(
        F.count("value").alias("n"),
        F.avg(F.when(newer, F.col("value"))).alias("cur"),
        F.avg(F.when(~newer, F.col("value"))).alias("prev"),
    )


def zscore_check(current: DataFrame, history: DataFrame, max_z: float = 3.0, min_samples: int = 5) -> DataFrame:
    """Verdicts ``name, value, passed`` on current values ``(name, value)``."""
    passed = V.zscore_ok("value", "n", "mean", "std", max_z, min_samples)
    return current.join(zscore_stats(history), "name", "left").selectExpr("name", "value", f"{passed} AS passed")


def trend_check(history: DataFrame, window: int = 7, max_pct: float = 20.0, direction: str = "any") -> DataFrame:
    """Verdict on the trend of every metric."""
    passed = V.trend_ok("n", "prev", "cur", window, max_pct, direction)
    return trend_stats(history, window).withColumn("passed", F.expr(passed))


def trend_checks(history: DataFrame, cases: list[tuple[int, float, str]]) -> DataFrame:
    """Verdicts ``name, direction, max_pct, cur, passed`` of every metric for each ``(window, max_pct, direction)``.

    The history is read and ranked once, up to the longest window; shorter ones are averages of the same rows.
    """
    windows = sorted({window for window, _, _ in cases})
    at = F.col("recency")
    sums = [
        column for w in windows for column in (
            F.count(F.when(at <= 2 * w, F.col("value"))).alias(f"n{w}"), F.avg(F.when(at <= w, F.col("value"))).alias(f"cur{w}"),
            F.avg(F.when((at > w) & (at <= 2 * w), F.col("value"))).alias(f"prev{w}"),
        )
    ]
    stats = recent_values(history, 2 * windows[-1]).groupBy("name").agg(*sums)
    rows = ", ".join(
        f"struct({literal(direction)} AS direction, {number(limit)} AS max_pct, cur{w} AS cur, {V.trend_ok(f'n{w}', f'prev{w}', f'cur{w}', w, limit, direction)} AS passed)"
        for w, limit, direction in cases
    )
    return stats.selectExpr("name", f"inline(array({rows}))")


def volume_by_day(df: DataFrame, time_column: str, max_pct: float = 50.0, by: str | None = None) -> DataFrame:
    """Rows per day (and value of ``by``) against the day before that has rows."""
    keys = [by] if by else []
    days = df.groupBy(*keys, F.to_date(time_column).alias("day")).agg(F.count("*").cast("double").alias("value"))
    # one row per calendar day is left of each group, so that ordered windows stay small
    baseline = F.lag("value").over(Window.partitionBy(*keys).orderBy("day"))
    return days.withColumn("baseline", baseline).withColumn(
        "passed", F.expr(V.volume_change_ok("value", "baseline", max_pct))
    )


def distribution_by_group(
    df: DataFrame, group: str, column: str, mean: float, std: float | None, tolerance_pct: float = 10.0
) -> DataFrame:
    stats = df.groupBy(group).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    return stats.withColumn("passed", F.expr(V.distribution_ok("mean", "std", mean, std, tolerance_pct)))


def volume_check(current: DataFrame, history: DataFrame, max_pct: float = 50.0) -> DataFrame:
    """``current(name, value)`` against the newest stored point of the same metric."""
    newest = history.where("value IS NOT NULL").groupBy("name").agg(
        F.max_by("value", "run_at").alias("baseline")
    )
    return current.join(newest, "name", "left").select(
        "name", "value", "baseline",
        F.expr(V.volume_change_ok("value", "baseline", max_pct)).alias("passed"),
    )
