"""Holt-Winters with fitted smoothing factors and start values.

For given factors the residuals are linear in the start state (level, trend, seven season values), so the best start
follows from least squares: a series is summed up by the quadratic form of its squared error in the start state. The
three factors are then found by a bounded search on the error that is left: the best point of the grid, and finer and finer
cubes around the best point so far, which is always among the points tried, so the error never rises.

Series of one chunk are searched row by row. In longer ones each step of the search is one pass over chunks side by
side: the quadratic forms of chunks, each in the state it starts from, are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablecheck.operators.holt_winters import GRID, STATE, advance
from tablecheck.session import shared_folder

LEAST, MOST = 1e-4, 1 - 1e-4
STEPS = (0.2, 0.08, 0.032, 0.0128, 0.005, 0.002, 0.0008)  # half of a cube's edge, step by step

FITTED = "name string, n bigint, early double, late double, sse double, alpha double, beta double, gamma double, forecast double, std double"


def around(centre: tuple[float, float, float], step: float) -> list[tuple[float, float, float]]:
    """Five values per factor around the best point; it comes first."""
    sides = [sorted({min(max(c + k * step / 2, LEAST), MOST) for k in (-2, -1, 0, 1, 2)}) for c in centre]
    return [centre, *((a, b, g) for a in sides[0] for b in sides[1] for g in sides[2] if (a, b, g) != centre)]


class Form:
    """Per candidate what is known of the chunks so far, as functions of ``d``: how far the start state is from the first
    chunk's assumed one. ``state`` (9 x 10) and ``total`` (10) are linear in (1, d), ``square`` (10 x 10) is the error's form."""

    def __init__(self, candidates: int):
        self.state: np.ndarray | None = None
        self.total = np.zeros((candidates, STATE + 1))
        self.square = np.zeros((candidates, STATE + 1, STATE + 1))
        self.points = 0

    def add(self, part: dict[str, np.ndarray]) -> None:
        if self.state is None:
            change = np.broadcast_to(np.eye(STATE + 1), self.square.shape)
        else:
            change = self.state.copy()
            change[:, :, 0] -= part["start"]
            change = np.concatenate([np.broadcast_to(np.eye(1, STATE + 1), (len(change), 1, STATE + 1)), change], axis=1)
        self.total = self.total + np.einsum("ci,cij->cj", part["total"], change)
        self.square = self.square + np.einsum("cik,cij,cjl->ckl", change, part["square"], change)
        self.state = np.einsum("csi,cij->csj", part["state"], change)
        self.points += int(part["count"])

    def best(self) -> list[tuple[float, float, float]]:
        """Per candidate ``(squared error, forecast, spread)`` of the best start. Level and season can be shifted against each
        other, so the least change of the start is taken."""
        out = []
        for state, total, square in zip(self.state, self.total, self.square):
            d = -np.linalg.pinv(square[1:, 1:], rcond=1e-12, hermitian=True) @ square[1:, 0]
            x = np.concatenate([[1.0], d])
            error = max(float(x @ square @ x), 0.0)
            mean = float(total @ x) / self.points
            out.append((error, float((state @ x)[:3].sum()), max(error / self.points - mean * mean, 0.0) ** 0.5))
        return out


def fit_one(y: np.ndarray, grid=GRID) -> tuple[float, float, float, float, float, float]:
    """``(squared error, alpha, beta, gamma, forecast, spread)`` of one whole series."""
    def tried(candidates):
        form = Form(len(candidates))
        form.add(advance(y, False, candidates))
        return min((e, *c, f, s) for c, (e, f, s) in zip(candidates, form.best()))

    found = tried(grid)
    for step in STEPS:
        found = min(found, tried(around(found[1:4], step)))
    return found


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r["name"], r["n"], r["early"], r["late"], *fit_one(np.asarray(r["y"], dtype=float))) for r in pdf.to_dict("records")]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FITTED.split(", ")])


def _parts(batches: Iterator[pd.DataFrame], step: float | None) -> Iterator[pd.DataFrame]:
    """Chunks as forms in their own start state, one row per candidate of their series."""
    for pdf in batches:
        for r in pdf.to_dict("records"):
            candidates = GRID if step is None else around((r["alpha"], r["beta"], r["gamma"]), step)
            part = advance(np.asarray(r["y"], dtype=float), False, candidates)
            yield pd.DataFrame([
                {"name": r["name"], "n": r["n"], "chunk": r["chunk"], "alpha": c[0], "beta": c[1], "gamma": c[2], "points": int(part["count"]), "start": part["start"],
                 "state": part["state"][i].ravel(), "total": part["total"][i], "square": part["square"][i].ravel()} for i, c in enumerate(candidates)
            ])


def _put_together(pdf: pd.DataFrame) -> pd.DataFrame:
    form = Form(1)
    for r in pdf.sort_values("chunk").to_dict("records"):
        form.add({
            "start": np.asarray(r["start"]), "state": np.asarray(r["state"]).reshape(1, STATE, STATE + 1), "total": np.asarray(r["total"])[None, :],
            "square": np.asarray(r["square"]).reshape(1, STATE + 1, STATE + 1), "count": r["points"],
        })
    first, ((error, forecast, spread),) = pdf.iloc[0], form.best()
    return pd.DataFrame([{"name": first["name"], "alpha": first["alpha"], "beta": first["beta"], "gamma": first["gamma"], "sse": error, "forecast": forecast, "std": spread}])


_PART = "name string, n bigint, chunk bigint, alpha double, beta double, gamma double, points bigint, start array<double>, state array<double>, total array<double>, square array<double>"
_TRIED = "name string, alpha double, beta double, gamma double, sse double, forecast double, std double"


def _long(chunked: DataFrame) -> DataFrame:
    """Series of several chunks: a fixed number of passes, each over all of them. What a pass leaves is a row per series."""
    best, sums = None, chunked.groupBy("name", "n").agg(F.sum("early").alias("early"), F.sum("late").alias("late"))
    least = F.expr("min(struct(sse, alpha, beta, gamma, forecast, std)) AS b")
    for step in (None, *STEPS):
        asked = chunked if best is None else chunked.join(best.select("name", "alpha", "beta", "gamma"), "name")
        tried = asked.mapInPandas(lambda batches, step=step: _parts(batches, step), _PART).groupBy("name", "alpha", "beta", "gamma").applyInPandas(_put_together, _TRIED)
        every = tried if best is None else tried.unionByName(best)
        best = _stored(every.groupBy("name").agg(least).select("name", "b.*"), "hw-fit")
    return sums.join(best, "name").select(*(c.split()[0] for c in FITTED.split(", ")))


def fit_grid(chunked: DataFrame) -> DataFrame:
    """``name, sse`` of the best of the grid's factors, with their best start values: where the search begins."""
    tried = chunked.where("n >= 14").mapInPandas(lambda batches: _parts(batches, None), _PART)
    return tried.groupBy("name", "alpha", "beta", "gamma").applyInPandas(_put_together, _TRIED).groupBy("name").agg(F.min("sse").alias("sse"))


def fit(chunked: DataFrame, chunk: int) -> DataFrame:
    """``name, n, early, late, sse, alpha, beta, gamma, forecast, std`` of chunked series (see ``series.chunks``).

    All residuals count, from the first point on. Series need 14 points. The passes over long series run when this is called,
    and only if there are any.
    """
    chunked = chunked.where("n >= 14")
    short = chunked.where(f"n <= {chunk}").select("name", "n", "early", "late", "y").mapInPandas(_short, FITTED)
    long = chunked.where(f"n > {chunk}")
    if long.isEmpty():
        return short
    return short.unionByName(_long(_stored(long, "hw-chunks")))
