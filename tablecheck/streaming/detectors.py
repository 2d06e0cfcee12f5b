"""Anomaly detectors on arriving points: each metric's model is kept as state, and no history is read again."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tablecheck.operators.holt_winters import FIXED, SEASON
from tablecheck.streaming.suites import AVAILABLE

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = (
    "n bigint, last bigint, mean double, squares double, average double, errors double, first array<double>, "
    "level double, trend double, season array<double>, residuals double, residual_squares double"
)
VERDICT = "name string, run_at timestamp, value double, n bigint, method string, is_anomaly boolean, score double, forecast double, lower_bound double, upper_bound double"

TINY = 1e-9  # stands in for a spread of zero


class Model:
    """What is known of a metric's past points: moments, a weighted average with its errors, and from 14 points on level,
    trend and season. The same recursions as the batch detectors', one point at a time."""

    def __init__(self, state: tuple | None, alpha: float, factors: tuple[float, float, float]):
        self.alpha, self.factors = alpha, factors
        self.n, self.last, self.mean, self.squares, self.average, self.errors, first, self.level, self.trend, season, self.residuals, self.residual_squares = (
            state or (0, 0, 0.0, 0.0, 0.0, 0.0, [], 0.0, 0.0, [], 0.0, 0.0))
        self.first, self.season = list(first), list(season)

    def state(self) -> tuple:
        return (self.n, self.last, self.mean, self.squares, self.average, self.errors, self.first, self.level, self.trend, self.season, self.residuals, self.residual_squares)

    def expected(self) -> tuple[str, float, float]:
        """Method, forecast and spread by the number of points so far."""
        if self.n < 5:
            return "zscore", self.mean, math.sqrt(self.squares / (self.n - 1)) if self.n > 1 else 0.0
        if self.n < 2 * SEASON:
            return "ewma", self.average, math.sqrt(self.errors / (self.n - 1))
        points = self.n - SEASON
        spread = math.sqrt(max(self.residual_squares / points - (self.residuals / points) ** 2, 0.0))
        return "holt_winters", self.level + self.trend + self.season[0], spread

    def take(self, value: float, at: int) -> None:
        self.n, self.last = self.n + 1, at
        off = value - self.mean
        self.mean += off / self.n
        self.squares += off * (value - self.mean)
        if self.n == 1:
            self.average = value
        else:
            self.average = self.alpha * value + (1 - self.alpha) * self.average
            self.errors += (value - self.average) ** 2
        if self.n < 2 * SEASON:
            self.first.append(value)
        elif self.n == 2 * SEASON:
            whole, self.first = [*self.first, value], []
            self.level = sum(whole[:SEASON]) / SEASON
            self.trend = (sum(whole[SEASON:]) / SEASON - self.level) / SEASON
            self.season = [v - self.level for v in whole[:SEASON]]
            for v in whole[SEASON:]:
                self._smooth(v)
        else:
            self._smooth(value)

    def _smooth(self, value: float) -> None:
        a, b, g = self.factors
        s = self.season.pop(0)
        residual = value - (self.level + self.trend + s)
        self.residuals += residual
        self.residual_squares += residual * residual
        level = a * (value - s) + (1 - a) * (self.level + self.trend)
        self.trend = b * (level - self.level) + (1 - b) * self.trend
        self.season.append(g * (value - level) + (1 - g) * s)
        self.level = level


class Detector(StatefulProcessor):
    def __init__(self, threshold: float, alpha: float, factors: tuple[float, float, float], keep_ms: int | None):
        self.threshold, self.alpha, self.factors, self.keep_ms = threshold, alpha, factors, keep_ms
        self.schema = StructType.fromDDL(_STATE)  # needs a session, so here and not on a worker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("model", self.schema, self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model = Model(self.held.get() if self.held.exists() else None, self.alpha, self.factors)
        points = pd.concat(list(rows)).dropna(subset=["value", "run_at"]).sort_values(["run_at", "value"])
        out = []
        for at, value in zip(points["run_at"], points["value"].astype(float)):
            micros = at.value // 1000
            if model.n and micros <= model.last:
                continue  # its time is over; the state cannot go back
            out.append((key[0], at, value, *self._judged(model, value)))
            model.take(value, micros)
        if out:
            self.held.update(model.state())
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    def _judged(self, model: Model, value: float) -> tuple:
        method, forecast, spread = model.expected()
        if model.n < 2:
            return model.n, method, False, 0.0, None, None, None
        spread = spread or TINY
        score = abs(value - forecast) / spread
        return model.n, method, bool(score > self.threshold), score, forecast, forecast - self.threshold * spread, forecast + self.threshold * spread

    def close(self) -> None:
        pass


def watched(points: DataFrame, threshold: float = 3.0, alpha: float = 0.3, factors: tuple[float, float, float] = FIXED[0], keep_ms: int | None = None) -> DataFrame:
    """A verdict for every arriving point ``(name, value, run_at)`` against the points before it.

    The detector is that of the batch form: z-score below 5 points, weighted average below 14, Holt-Winters with fixed
    factors from there on. A metric's state is some thirty numbers, however long its history; it is dropped when the metric
    has been silent for ``keep_ms``. Points of one batch are taken in time order; a point not after the newest one seen
    is left out, and so are points without value or time. A metric is one key, so its points are worked off in order by
    one task; metrics are spread over tasks.
    """
    typed = points.selectExpr("CAST(name AS STRING) AS name", "CAST(value AS DOUBLE) AS value", "CAST(run_at AS TIMESTAMP) AS run_at")
    return typed.groupBy("name").transformWithStateInPandas(
        Detector(threshold, alpha, factors, keep_ms), VERDICT, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")


def watch(points: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE, **options) -> StreamingQuery:
    """Appends the verdicts on a stream of points to ``path``. The state lives in RocksDB under the checkpoint, from which a new
    start goes on; the session's own settings are left as they were. Silent metrics are dropped when a batch brings
    points of others: batches without points, which would follow each other without end, are not run for that.
    """
    conf = points.sparkSession.conf
    own = {_PROVIDER: _ROCKSDB} | ({_EMPTY_BATCHES: "false"} if options.get("keep_ms") else {})
    before = {key: conf.get(key, None) for key in own}
    for key, value in own.items():
        conf.set(key, value)
    try:
        return (
            watched(points, **options).writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
    finally:
        for key, value in before.items():
            conf.set(key, value) if value is not None else conf.unset(key)
