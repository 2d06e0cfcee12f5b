"""Additive Holt-Winters (trend, season of 7) as a fold over chunks of a series.

The start values come from the first two weeks: level is the mean of week one, trend the
difference of the weekly means per day, season week one's deviations; updates begin with point 8.

A series of one chunk is folded inside Spark's expressions. In a longer one, every later chunk is
worked out for an unknown start state: state and residuals are linear in it, so a chunk is summed
up by a matrix and the coefficients of its residual sums. Applying the chunks in order then gives
exactly the fold over the whole series, without any task that holds it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.literals import array, number

SEASON = 7
STATE = SEASON + 2  # level, trend, the season's values from the current day on

# Smoothing factors (level, trend, season) tried by the fitted form.
GRID = tuple((a, b, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.01, 0.1, 0.3) for g in (0.01, 0.1, 0.3))
FIXED = ((0.3, 0.1, 0.1),)

_COLUMNS = "name string, n bigint, early double, late double, sse double, alpha double, beta double, gamma double, forecast double, std double"


def fold(candidates) -> str:
    """The best candidate's fit of a whole series ``y``, as one expression.

    A struct ``sse, alpha, beta, gamma, forecast, std``: all candidates are folded over the array
    and the one with the least squared error is kept.
    """
    week = "(aggregate(slice(y, {first}, 7), 0D, (s, v) -> s + v) / 7D)"
    m1, m2 = week.format(first=1), week.format(first=8)
    listed = array([f"struct({number(a)} AS a, {number(b)} AS b, {number(g)} AS g)" for a, b, g in candidates])
    level = "(c.a * (v - x.s[0]) + (1D - c.a) * (x.l + x.b))"
    residual = "(v - (x.l + x.b + x.s[0]))"
    return (
        f"array_min(transform({listed}, c -> aggregate(slice(y, 8, size(y) - 7), "
        f"named_struct('l', {m1}, 'b', ({m2} - {m1}) / 7D, 's', transform(slice(y, 1, 7), v -> v - {m1}), 'r', 0D, 'rr', 0D), "
        f"(x, v) -> named_struct('l', {level}, 'b', c.b * ({level} - x.l) + (1D - c.b) * x.b, "
        f"'s', concat(slice(x.s, 2, 6), array(c.g * (v - {level}) + (1D - c.g) * x.s[0])), "
        f"'r', x.r + {residual}, 'rr', x.rr + {residual} * {residual}), "
        "x -> struct(x.rr AS sse, c.a AS alpha, c.b AS beta, c.g AS gamma, x.l + x.b + x.s[0] AS forecast, "
        "sqrt(greatest(x.rr / (size(y) - 7) - pow(x.r / (size(y) - 7), 2), 0D)) AS std))))"
    )


def fit(chunked: DataFrame, candidates=GRID, chunk: int = 10_000) -> DataFrame:
    """``name, n, early, late, sse, alpha, beta, gamma, forecast, std`` of the best candidate."""
    short = chunked.where(f"n <= {chunk}").selectExpr("name", "n", "early", "late", f"{fold(candidates)} AS best")
    return short.selectExpr("name", "n", "early", "late", "best.*").unionByName(fit_long(chunked, candidates, chunk))


def advance(y: np.ndarray, first: bool, candidates) -> dict[str, np.ndarray]:
    """One chunk for all candidates.

    Trajectory 0 runs from a known state over the values; trajectories 1..9 show how a unit
    change of each state entry propagates. The first chunk knows its state and needs only one.
    """
    factors = np.array(candidates, dtype=float)
    a, b, g = (factors[:, i][:, None] for i in range(3))
    width = 1 if first else STATE + 1
    state = np.zeros((len(factors), STATE, width))
    if first:
        m1, m2 = y[:SEASON].mean(), y[SEASON : 2 * SEASON].mean()
        start = np.concatenate([[m1, (m2 - m1) / SEASON], y[:SEASON] - m1])
        y = y[SEASON:]
    else:
        start = np.zeros(STATE)
        start[0] = y[0]
        state[:, :, 1:] = np.eye(STATE)
    state[:, :, 0] = start
    total = np.zeros((len(factors), width))
    square = np.zeros((len(factors), width, width))
    drive = np.zeros(width)
    for value in y:
        drive[0] = value
        level, trend, season = state[:, 0], state[:, 1], state[:, 2]
        residual = drive - (level + trend + season)
        total += residual
        square += residual[:, :, None] * residual[:, None, :]
        raised = a * (drive - season) + (1 - a) * (level + trend)
        tilted = b * (raised - level) + (1 - b) * trend
        renewed = g * (drive - raised) + (1 - g) * season
        state = np.concatenate([raised[:, None], tilted[:, None], state[:, 3:], renewed[:, None]], axis=1)
    return {"start": start, "state": state, "total": total, "square": square, "count": np.array(len(y))}


def follow(state: np.ndarray, part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State after a later chunk, and its sums of residuals and of their squares."""
    change = np.concatenate([np.ones((len(state), 1)), state - part["start"]], axis=1)
    total = np.einsum("ci,ci->c", part["total"], change)
    square = np.einsum("ci,cij,cj->c", change, part["square"], change)
    return np.einsum("csi,ci->cs", part["state"], change), total, square


def fit_long(chunked: DataFrame, candidates, chunk: int) -> DataFrame:
    """The fit of series of several chunks.

    Chunks are worked out side by side; then each metric and candidate is put together by itself.
    """
    series, candidates = chunked.where(f"n > {chunk}"), tuple(candidates)
    fields = ("start", "state", "total", "square")

    def work_out(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        part = advance(np.asarray(row["y"], dtype=float), int(row["chunk"]) == 0, candidates)
        shared = {k: row[k] for k in ("name", "n", "chunk", "early", "late")} | {"points": int(part["count"])}
        return pd.DataFrame([
            shared | {"candidate": i, "start": part["start"]} | {f: part[f][i].ravel() for f in fields[1:]}
            for i in range(len(candidates))
        ])

    def put_together(pdf: pd.DataFrame) -> pd.DataFrame:
        state = total = square = None
        points = 0
        for row in pdf.sort_values("chunk").to_dict("records"):
            width = 1 if row["chunk"] == 0 else STATE + 1
            shapes = {"start": (STATE,), "state": (1, STATE, width), "total": (1, width), "square": (1, width, width)}
            part = {f: np.asarray(row[f], dtype=float).reshape(shapes[f]) for f in fields}
            points += row["points"]
            if row["chunk"] == 0:
                state, total, square = part["state"][:, :, 0], part["total"][:, 0], part["square"][:, 0, 0]
            else:
                state, more, squares = follow(state, part)
                total, square = total + more, square + squares
        alpha, beta, gamma = candidates[int(pdf["candidate"].iloc[0])]
        spread = max(square[0] / points - (total[0] / points) ** 2, 0.0) ** 0.5
        return pd.DataFrame([{
            "name": pdf["name"].iloc[0], "n": pdf["n"].iloc[0], "early": pdf["early"].sum(), "late": pdf["late"].sum(),
            "sse": square[0], "alpha": alpha, "beta": beta, "gamma": gamma, "forecast": state[0][:3].sum(), "std": spread,
        }])

    summed = series.groupBy("name", "chunk").applyInPandas(
        work_out,
        "name string, n bigint, chunk bigint, early double, late double, points bigint, candidate int, "
        + ", ".join(f"{f} array<double>" for f in fields),
    )
    tried = summed.groupBy("name", "candidate").applyInPandas(put_together, _COLUMNS)
    best = "min(struct(sse, alpha, beta, gamma, forecast, std, early, late)) AS best"
    return tried.groupBy("name", "n").agg(F.expr(best)).selectExpr(
        "name", "n", "best.early", "best.late", "best.sse", "best.alpha", "best.beta", "best.gamma",
        "best.forecast", "best.std",
    )
