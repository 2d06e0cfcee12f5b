"""Anomaly detection on metric histories, all metrics in one job.

Every detector reduces a history to a forecast and a spread; a current value is anomalous when
it is more than ``threshold`` spreads away from the forecast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.literals import number
from tablecheck.operators import history, holt_winters, hw_fit, series

TINY = "1e-9D"  # stands in for a spread of zero

MODEL = ("name", "n", "forecast", "std", "direction")


def _direction(early: str, late: str, n: str) -> str:
    """Last half of the points against the first half, 5 % either way; the middle point is left out."""
    change = f"(({late}) - ({early})) / if(({early}) = 0, {TINY} * ({n} div 2), {early})"
    return f"CASE WHEN {n} < 4 THEN 'stable' WHEN {change} > 0.05D THEN 'up' WHEN {change} < -0.05D THEN 'down' ELSE 'stable' END"


def trend_direction(points: DataFrame) -> DataFrame:
    """``name, n, direction``."""
    half = F.floor(F.col("n") / 2)
    sums = series.positions(points).groupBy("name", "n").agg(
        F.sum(F.when(F.col("pos") < half, F.col("value")).otherwise(0.0)).alias("early"),
        F.sum(F.when(F.col("pos") >= F.col("n") - half, F.col("value")).otherwise(0.0)).alias("late"),
    )
    return sums.select("name", "n", F.expr(_direction("early", "late", "n")).alias("direction"))


def zscore_model(points: DataFrame) -> DataFrame:
    """Mean and sample deviation; needs no order and no arrays."""
    stats = points.where("value IS NOT NULL").groupBy("name").agg(
        F.count("value").alias("n"), F.avg("value").alias("forecast"), F.stddev_samp("value").alias("std")
    )
    return stats.withColumn("std", F.expr(f"if(n < 2 OR std = 0, {TINY}, std)"))


def _ewma_chunk(alpha: float) -> str:
    """One chunk as a function of the average it starts from.

    With ``d`` the distance of that start from the chunk's first value, the average after the
    chunk is ``p + q * d`` and the sum of squared errors ``s0 - 2 * s1 * d + s2 * d * d``.
    """
    a, b = number(alpha), number(1 - alpha)
    p, q = f"({a} * v + {b} * x.p)", f"({b} * x.q)"
    return (
        "aggregate(if(chunk = 0, slice(y, 2, size(y)), y), "
        "named_struct('p', y[0], 'q', 1D, 's0', 0D, 's1', 0D, 's2', 0D, 'm', 0L), "
        f"(x, v) -> named_struct('p', {p}, 'q', {q}, 's0', x.s0 + (v - {p}) * (v - {p}), "
        f"'s1', x.s1 + (v - {p}) * {q}, 's2', x.s2 + {q} * {q}, 'm', x.m + 1L))"
    )


_EWMA_JOIN = (
    "aggregate(slice(parts, 2, size(parts)), named_struct('e', parts[0].f.p, 'sq', parts[0].f.s0, 'm', parts[0].f.m), "
    "(x, c) -> named_struct('e', c.f.p + c.f.q * (x.e - c.first), "
    "'sq', x.sq + c.f.s0 - 2D * c.f.s1 * (x.e - c.first) + c.f.s2 * (x.e - c.first) * (x.e - c.first), 'm', x.m + c.f.m))"
)


def ewma_model(points: DataFrame, alpha: float = 0.3, chunk: int = series.CHUNK) -> DataFrame:
    """Exponentially weighted average and root mean square of its errors."""
    return _ewma(series.chunks(points, chunk), alpha)


def _ewma(chunked: DataFrame, alpha: float) -> DataFrame:
    parts = chunked.selectExpr("name", "n", "early", "late", f"struct(chunk, y[0] AS first, {_ewma_chunk(alpha)} AS f) AS part")
    joined = parts.groupBy("name", "n").agg(
        F.array_sort(F.collect_list("part")).alias("parts"), F.sum("early").alias("early"), F.sum("late").alias("late")
    )
    spread = "sqrt(greatest(r.sq, 0D) / r.m)"
    return joined.selectExpr("name", "n", "early", "late", f"{_EWMA_JOIN} AS r").selectExpr(
        "name", "n", "r.e AS forecast", f"if(r.m = 0 OR {spread} = 0, {TINY}, {spread}) AS std",
        f"{_direction('early', 'late', 'n')} AS direction",
    )


def holt_winters_model(points: DataFrame, candidates=holt_winters.GRID, chunk: int = series.CHUNK) -> DataFrame:
    """Additive trend and weekly season; of the candidate smoothing factors those with the least squared error."""
    return holt_winters.fit(series.chunks(points, chunk).where("n >= 14"), candidates, chunk).selectExpr(
        "name", "n", "forecast", f"if(std = 0, {TINY}, std) AS std", f"{_direction('early', 'late', 'n')} AS direction",
        "alpha", "beta", "gamma",
    )


def holt_winters_fitted(points: DataFrame, chunk: int = series.CHUNK) -> DataFrame:
    """Additive trend and weekly season with smoothing factors and start values of least squared error (see ``hw_fit``)."""
    return hw_fit.fit(series.chunks(points, chunk), chunk).selectExpr(
        "name", "n", "forecast", f"if(std = 0, {TINY}, std) AS std", f"{_direction('early', 'late', 'n')} AS direction",
        "alpha", "beta", "gamma", "sse",
    )


def judge(current: DataFrame, model: DataFrame, method: str, threshold: float = 3.0) -> DataFrame:
    """Current values ``(name, value)`` against a model; a metric without two points is never anomalous."""
    return _judged(current.join(model.withColumn("method", F.lit(method)), "name", "left"), threshold)


def _judged(joined: DataFrame, threshold: float) -> DataFrame:
    k = number(threshold)
    usable = "(value IS NOT NULL AND coalesce(n, 0) >= 2)"
    score = "abs(value - forecast) / std"
    return joined.selectExpr(
        "name AS metric_name", "value AS current", f"coalesce({usable} AND {score} > {k}, false) AS is_anomaly",
        f"if({usable}, round({score}, 4), 0D) AS score",
        "if(value IS NULL, 'none', coalesce(method, 'zscore')) AS method",
        f"if({usable}, round(forecast - {k} * std, 4), NULL) AS lower_bound",
        f"if({usable}, round(forecast + {k} * std, 4), NULL) AS upper_bound",
        f"if({usable}, direction, 'stable') AS trend_direction",
        "CASE WHEN value IS NULL THEN 'no current value' WHEN coalesce(n, 0) < 2 THEN 'fewer than 2 points of history' "
        f"ELSE concat('forecast=', round(forecast, 2), ', error=', round(abs(value - forecast), 2), ', threshold=', {k}) END AS message",
    )


def detect(
    current: DataFrame, points: DataFrame, threshold: float = 3.0, candidates=holt_winters.GRID, chunk: int = series.CHUNK
) -> DataFrame:
    """The detector each metric's number of points calls for: z-score below 5, weighted average
    below 14, Holt-Winters from there on.

    A series of at most one chunk is one row, and its method is chosen inside the projection. Only
    longer series, which are all for Holt-Winters, take the chunk-wise path.
    """
    chunked = series.chunks(points, max(chunk, 14))
    mean = "aggregate(y, 0D, (s, v) -> s + v) / n"
    zscore = f"struct({mean} AS forecast, sqrt(aggregate(y, 0D, (s, v) -> s + pow(v - {mean}, 2)) / greatest(n - 1, 1)) AS std)"
    average = (
        f"transform(array({_ewma_chunk(0.3)}), f -> struct(f.p AS forecast, sqrt(f.s0 / greatest(f.m, 1)) AS std))[0]"
    )
    season = f"transform(array({holt_winters.fold(candidates)}), f -> struct(f.forecast AS forecast, f.std AS std))[0]"
    direction = f"{_direction('early', 'late', 'n')} AS direction"
    method = "CASE WHEN n < 5 THEN 'zscore' WHEN n < 14 THEN 'ewma' ELSE 'holt_winters' END AS method"
    short = chunked.where(f"n <= {max(chunk, 14)}").selectExpr(
        "name", "n", method, direction, f"CASE WHEN n < 5 THEN {zscore} WHEN n < 14 THEN {average} ELSE {season} END AS m"
    )
    long = holt_winters.fit_long(chunked, candidates, max(chunk, 14)).selectExpr(
        "name", "n", method, direction, "struct(forecast, std) AS m"
    )
    model = short.unionByName(long).selectExpr(
        "name", "n", "method", "direction", "m.forecast", f"if(m.std = 0, {TINY}, m.std) AS std"
    )
    return _judged(current.join(model, "name", "left"), threshold)


def detect_all(
    current: DataFrame, points: DataFrame, as_of: str, threshold: float = 3.0, days: int = 30,
    include_current: bool = False, **options,
) -> DataFrame:
    """All non-null current values against the last ``days`` days of their metrics.

    The batch's own points, recorded at ``as_of``, are left out unless ``include_current``.
    """
    recent = history.since(points, as_of, days)
    past = recent if include_current else history.before(recent, as_of)
    return detect(current.where("value IS NOT NULL").select("name", "value"), past, threshold, **options)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.count_if("is_anomaly").alias("flagged"))
