"""A toxicity classifier whose scores hardly change when group mentions are swapped."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.llm.store import fold, stored

#: Terms of one kind of group; one may stand for another without changing what a sentence says about people.
IDENTITY = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["woman", "man"], ["women", "men"], ["girls", "boys"], ["she", "he"], ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"], ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["immigrants", "refugees", "foreigners", "natives"], ["disabled", "deaf", "blind"], ["old", "young"],
]
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """``sample`` labelled rows at most are learned from, those of least hash; ``features`` words at most are used.

    A word is used when at least ``documents`` of the sample have it and its log-likelihood ratio with the label
    reaches ``evidence``. ``ridge`` shrinks weights, ``swap`` penalises the squared change of the score when a group
    term is swapped, for each sampled text that has one. Toxic rows weigh the ratio of the classes to the power of
    ``balance``.
    """

    sample: int = 20_000
    features: int = 4096
    documents: int = 4
    evidence: float = 16.0
    ridge: float = 0.01
    balance: float = 0.75
    swap: float = 10.0
    rounds: int = 1000
    identity: tuple = tuple(map(tuple, IDENTITY))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + sum(weights[w] for w in weights.keys() & set(_WORD.findall((text or "").lower())))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def column(self, text: Column | str) -> Column:
        """Score of a text column, from 0 to 1; null texts score like empty ones."""
        held = self

        @F.pandas_udf("double")
        def scores(texts: pd.Series) -> pd.Series:
            return pd.Series([held.score(t) for t in texts], dtype="float64")

        return scores(text)


def fit(x: list[np.ndarray], y: np.ndarray, width: int, swaps: np.ndarray, p: Training) -> tuple[float, np.ndarray]:
    """Logistic regression on sets of features by accelerated gradient descent.

    ``swaps`` has rows ``(feature, feature put in its place, times)``; -1 is a word that is no feature. Minimised is
    the mean log loss, plus ridge over twice the number of rows, plus ``swap`` times half the mean squared change.
    """
    n = max(len(y), 1)
    rows = np.repeat(np.arange(len(x)), [len(i) for i in x])
    cols = np.concatenate(x) if len(x) else np.zeros(0, np.int64)
    a, b, times = (swaps[:, i] for i in range(3)) if len(swaps) else (np.zeros(0, np.int64),) * 3

    def at(w, i):
        return np.where(i >= 0, w[i], 0.0)

    def pushed(w):
        change = (at(w, a) - at(w, b)) * times * (p.swap / n)
        return np.bincount(a[a >= 0], change[a >= 0], width) - np.bincount(b[b >= 0], change[b >= 0], width)

    rate = min(max(y.mean() if len(y) else 0.0, 0.5 / n), 1 - 0.5 / n)
    heavy = (1 / rate - 1) ** p.balance if len(y) else 1.0
    each = np.where(y == 1, max(heavy, 1.0), 1.0)
    bias, w = math.log(rate / (1 - rate)), np.zeros(width)
    v = np.ones(width) / max(width, 1) ** 0.5
    steepest = 0.25
    for _ in range(30):  # largest curvature of the loss
        u = np.bincount(cols, (each * np.bincount(rows, v[cols], len(y)))[rows], width) / (4 * n) + pushed(v)
        steepest = max(steepest, float(np.linalg.norm(u)))
        v = u / max(np.linalg.norm(u), 1e-12)
    step = 1 / (2 * max(steepest, float(each.sum()) / (4 * n)) + p.ridge / n)
    old, old_bias = w, bias
    for k in range(p.rounds if width else 0):
        pace = k / (k + 3)
        look, look_bias = w + pace * (w - old), bias + pace * (bias - old_bias)
        z = look_bias + np.bincount(rows, look[cols], len(y))
        error = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        old, old_bias = w, bias
        w = look - step * (np.bincount(cols, error[rows], width) / n + look * (p.ridge / n) + pushed(look))
        bias = look_bias - step * float(error.sum() / n)
    return bias, w


def _words(texts: DataFrame) -> DataFrame:
    """``doc, toxic, words``: each text's different words, letters only, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(_WORD.findall((t or "").lower()))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    return texts.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, words array<string>")


def train(docs: DataFrame, labels: DataFrame, p: Training = Training()) -> Model:
    """A model from the texts of ``docs (doc_id, text)`` that ``labels (doc_id, toxic)`` marks.

    Of several labels of an id the largest holds; null labels and labels without a document say nothing. The sample
    is bounded, so its ids may be broadcast to the documents and its chosen features may be collected; word counts
    are grouped on the executors. Without labels, or where no word tells, the score is the rate of the label.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = stored(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample), "label-sample")
    texts = stored(_words(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")), "sample-words")
    total, toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = texts.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= p.documents)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(F.try_divide(seen, expected))).otherwise(0.0)

    rate = toxic / max(total, 1)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    cells = [(k, n * rate), (n - k, n * (1 - rate)), (toxic - k, (total - n) * rate), (total - n - toxic + k, (total - n) * (1 - rate))]
    ratio = 2 * sum((part(seen, expected) for seen, expected in cells), F.lit(0.0))
    chosen = counts.select("word", ratio.alias("ratio")).where(F.col("ratio") >= p.evidence).orderBy(F.desc("ratio"), "word").limit(p.features).collect()
    terms = sorted({term for group in p.identity for term in group})
    names = [row.word for row in chosen] + [t for t in terms if t not in {row.word for row in chosen}]
    number = {word: i for i, word in enumerate(names)}
    listed = F.split(F.lit(" ".join(names)), " ")
    rows = texts.select("toxic", F.array_intersect("words", listed).alias("words")).toArrow()
    x = [np.array([number[w] for w in words], np.int64) for words in rows.column("words").to_pylist()]
    y = rows.column("toxic").to_numpy().astype(np.float64)
    pairs: dict[tuple[int, int], int] = {}
    for own in x:
        for i in own:
            for group in p.identity:
                if names[i] in group:
                    for other in group:
                        if other != names[i]:
                            pairs[int(i), number[other]] = pairs.get((int(i), number[other]), 0) + 1
    swaps = np.array([(i, j, t) for (i, j), t in sorted(pairs.items())], np.int64).reshape(-1, 3)
    bias, w = fit(x, y, len(names), swaps, p)
    return Model(bias, {name: float(v) for name, v in zip(names, w) if v})


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, least: float = 0.7, p: Training = Training()) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, held_out, score, predicted``.

    The model learns from labels of ids whose crc32 is not ``held`` by ``modulus``. Only the text makes a score. A null
    or empty text has the score of a text without telling words; a row without ``doc_id`` is held out. Rows are scored
    one by one, repeated rows too; other columns are not read.
    """
    folded = fold("doc_id", held, modulus)
    model = train(docs, labels.where(~folded), p)
    scored = docs.select("doc_id", folded.alias("held_out"), model.column("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
