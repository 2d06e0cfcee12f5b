"""Chunked series against plain Python over whole ones, and the detectors' branches."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.operators import anomaly as A
from tablecheck.operators import holt_winters as HW
from tablecheck.operators import hw_fit as HWF
from tablecheck.operators import series


def points(spark, values, name="m", step=3600):
    rows = [(name, None if v is None else float(v), i * step) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "name string, value double, s bigint").select(
        "name", "value", F.timestamp_seconds("s").alias("run_at"))


def noisy(n, seed=1):
    rng = random.Random(seed)
    return [1e6 + 5 * i + 50 * math.sin(2 * math.pi * i / 7) + rng.gauss(0, 10) for i in range(n)]


def plain_ewma(y, alpha=0.3):
    e, squares = y[0], []
    for v in y[1:]:
        e = alpha * v + (1 - alpha) * e
        squares.append((v - e) ** 2)
    return e, math.sqrt(sum(squares) / len(squares))


def plain_holt_winters(y, a, b, g):
    m1, m2 = sum(y[:7]) / 7, sum(y[7:14]) / 7
    level, trend, season, residuals = m1, (m2 - m1) / 7, [v - m1 for v in y[:7]], []
    for v in y[7:]:
        s = season.pop(0)
        residuals.append(v - (level + trend + s))
        new = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season.append(g * (v - new) + (1 - g) * s)
        level = new
    return level + trend + season[0], statistics.pstdev(residuals), sum(r * r for r in residuals)


def test_positions_across_hours(spark):
    df = points(spark, [3, 1, None, 2, 5], step=1800)
    rows = series.positions(df).orderBy("pos").collect()
    assert [(r.value, r.pos, r.n) for r in rows] == [(3, 0, 4), (1, 1, 4), (2, 2, 4), (5, 3, 4)]


@pytest.mark.parametrize("chunk", [5, 16, 1000])
def test_ewma_in_chunks(spark, chunk):
    y = noisy(103)
    row = A.ewma_model(points(spark, y), chunk=chunk).collect()[0]
    e, std = plain_ewma(y)
    assert row.forecast == pytest.approx(e, rel=1e-12) and row.std == pytest.approx(std, rel=1e-9)


@pytest.mark.parametrize("chunk", [14, 40, 1000])
def test_holt_winters_in_chunks(spark, chunk):
    y = noisy(107)
    candidates = ((0.3, 0.1, 0.1), (0.5, 0.3, 0.01), (0.1, 0.01, 0.3))
    row = A.holt_winters_model(points(spark, y), candidates, chunk).collect()[0]
    best = min(candidates, key=lambda c: plain_holt_winters(y, *c)[2])
    forecast, std, _ = plain_holt_winters(y, *best)
    assert (row.alpha, row.beta, row.gamma) == best
    assert row.forecast == pytest.approx(forecast, rel=1e-10) and row.std == pytest.approx(std, rel=1e-6)


def test_a_pure_season_leaves_no_residual_and_a_spike_shows(spark):
    season = [0, 5, 9, 3, -4, -8, 2]
    row = A.holt_winters_model(points(spark, [100 + season[i % 7] for i in range(42)])).collect()[0]
    assert row.forecast == pytest.approx(100, abs=1e-9) and row.std < 1e-6
    trended = A.holt_winters_model(points(spark, [100 + 2 * i + season[i % 7] for i in range(42)]))
    row = trended.collect()[0]
    assert row.forecast == pytest.approx(184, abs=3)
    expected = spark.createDataFrame([("m", 184.0)], "name string, value double")
    assert not A.judge(expected, trended, "holt_winters").collect()[0].is_anomaly
    spike = expected.withColumn("value", F.col("value") * 3)
    assert A.judge(spike, trended, "holt_winters").collect()[0].is_anomaly


def test_method_by_length_and_long_series_agree(spark):
    lengths = {"a": 1, "b": 4, "c": 5, "d": 13, "e": 14, "f": 60}
    df = None
    for name, n in lengths.items():
        part = points(spark, noisy(n, seed=n), name)
        df = part if df is None else df.unionByName(part)
    current = spark.createDataFrame([(n, 1e6) for n in lengths] + [("new", 1.0), ("none", None)], "name string, value double")
    whole = {r.metric_name: r for r in A.detect(current, df, candidates=HW.FIXED).collect()}
    cut = {r.metric_name: r for r in A.detect(current, df, candidates=HW.FIXED, chunk=14).collect()}
    assert {n: r.method for n, r in whole.items()} == {
        "a": "zscore", "b": "zscore", "c": "ewma", "d": "ewma", "e": "holt_winters", "f": "holt_winters",
        "new": "zscore", "none": "none"}
    assert not whole["a"].is_anomaly and not whole["new"].is_anomaly and not whole["none"].is_anomaly
    for name in lengths:
        assert whole[name].is_anomaly == cut[name].is_anomaly
        assert whole[name].score == pytest.approx(cut[name].score, abs=1e-3)
        assert whole[name].trend_direction == cut[name].trend_direction


def test_constant_history_flags_any_change(spark):
    current = spark.createDataFrame([("m", 101.0)], "name string, value double")
    for n in (3, 8, 20):
        found = A.detect(current, points(spark, [100] * n)).collect()[0]
        assert found.is_anomaly and found.score > 1e6
    same = spark.createDataFrame([("m", 100.0)], "name string, value double")
    assert not A.detect(same, points(spark, [100] * 8)).collect()[0].is_anomaly


@pytest.mark.parametrize("values, direction", [
    ([1, 1, 1], "stable"), ([100, 100, 110, 110], "up"), ([100, 100, 90, 90], "down"), ([100, 100, 104, 104], "stable"),
    ([0, 0, 1, 1], "up"), ([100, 100, 999, 100, 100], "stable"),
])
def test_trend_direction(spark, values, direction):
    assert A.trend_direction(points(spark, values)).collect()[0].direction == direction


def test_current_point_is_not_its_own_history(spark):
    df = points(spark, [10, 10.5, 9.5, 10, 500], step=86400)
    current = spark.createDataFrame([("m", 500.0)], "name string, value double")
    as_of = "1970-01-05 00:00:00"
    assert A.detect_all(current, df, as_of).collect()[0].is_anomaly
    assert not A.detect_all(current, df, as_of, include_current=True).collect()[0].is_anomaly


def test_positions_of_a_crowded_hour(spark):
    points = spark.range(60_000).selectExpr(
        "'m' AS name", "CAST((id * 7919) % 60000 AS DOUBLE) AS value", "timestampadd(MICROSECOND, (id * 7919) % 60000 * 50, timestamp'2024-01-01 00:59:58') AS run_at"
    )
    found = series.positions(points.unionByName(points.withColumn("name", F.lit("other")).where("value < 10")))
    assert found.where("name = 'm' AND (pos <> value OR n <> 60000)").count() == 0 and found.count() == 60_010
    assert found.where("name = 'other' AND pos = value AND n = 10").count() == 10


# --- fitted factors and start values


def generated(n, a, b, g, seed, noise=1.0):
    rng = random.Random(seed)
    level, trend, season, y = 100.0, 0.5, [3, -2, 1, 0, 4, -5, -1], []
    for _ in range(n):
        v = level + trend + season[0] + rng.gauss(0, noise)
        y.append(v)
        s = season.pop(0)
        new = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season.append(g * (v - new) + (1 - g) * s)
        level = new
    return y


def plain_residuals(y, factors, start):
    (a, b, g), level, trend, season, out = factors, start[0], start[1], list(start[2:]), []
    for v in y:
        s = season.pop(0)
        out.append(v - (level + trend + s))
        new = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season.append(g * (v - new) + (1 - g) * s)
        level = new
    return np.array(out), level + trend + season[0]


def plain_best_start(y, factors):
    """Least squares over the start, from the residuals of unit starts."""
    base, _ = plain_residuals(y, factors, [0.0] * 9)
    effects = np.stack([plain_residuals(y, factors, np.eye(9)[i])[0] - base for i in range(9)], axis=1)
    start = np.linalg.lstsq(effects, -base, rcond=1e-10)[0]
    residuals, forecast = plain_residuals(y, factors, start)
    return float(residuals @ residuals), forecast, float(residuals.std())


@pytest.mark.parametrize("n,seed", [(14, 1), (30, 2), (29, 3), (200, 4)])
def test_fit_is_never_above_the_grid_and_its_start_is_the_best(n, seed):
    y = generated(n, 0.4, 0.15, 0.25, seed)
    sse, a, b, g, forecast, spread = HWF.fit_one(np.array(y))
    own = plain_best_start(y, (a, b, g))
    assert (sse, forecast, spread) == (pytest.approx(own[0], rel=1e-6, abs=1e-6), pytest.approx(own[1], rel=1e-6), pytest.approx(own[2], rel=1e-5, abs=1e-6))
    assert all(HWF.LEAST <= f <= HWF.MOST for f in (a, b, g))
    assert all(sse <= plain_best_start(y, c)[0] + 1e-6 for c in HW.GRID)
    # nor above the grid's own fit, whose start values are those of the first two weeks, on the points that it counts
    c = min(HW.GRID, key=lambda c: plain_holt_winters(y, *c)[2])
    assert HWF.fit_one(np.array(y[7:]))[0] <= plain_holt_winters(y, *c)[2] + 1e-6 if n >= 21 else True


def test_factors_of_generated_series_are_found():
    for factors in ((0.4, 0.1, 0.3), (0.7, 0.05, 0.15)):
        y = generated(3000, *factors, seed=5)
        found = HWF.fit_one(np.array(y))
        assert np.allclose(found[1:4], factors, atol=0.05) and found[5] == pytest.approx(1.0, abs=0.05)


def test_fit_of_long_series_is_that_of_short_ones(spark):
    df = points(spark, generated(120, 0.4, 0.15, 0.25, 7), "a").unionByName(points(spark, noisy(90, 2), "b")).unionByName(points(spark, noisy(13), "short"))
    whole = {r.name: r for r in A.holt_winters_fitted(df).collect()}
    cut = {r.name: r for r in A.holt_winters_fitted(df, chunk=32).collect()}
    assert set(whole) == set(cut) == {"a", "b"}
    for name, r in whole.items():
        assert cut[name].sse == pytest.approx(r.sse, rel=1e-4) and cut[name].forecast == pytest.approx(r.forecast, rel=1e-5) and cut[name].direction == r.direction
        assert np.allclose([cut[name].alpha, cut[name].beta, cut[name].gamma], [r.alpha, r.beta, r.gamma], atol=5e-3)


def test_fit_of_constant_and_seasonal_series(spark):
    season = [0, 5, 9, 3, -4, -8, 2]
    df = points(spark, [100] * 20, "flat").unionByName(points(spark, [100 + 2 * i + season[i % 7] for i in range(42)], "line"))
    found = {r.name: r for r in A.holt_winters_fitted(df).collect()}
    assert found["flat"].forecast == pytest.approx(100) and found["line"].forecast == pytest.approx(184, abs=1e-3) and found["line"].std < 1e-3
    assert A.holt_winters_fitted(df.where("value < 0")).collect() == []
