"""Hard negatives of anchors: threshold joins over an inverted index whose covered dimensions are left out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecheck.llm.store import stored


@dataclass(frozen=True)
class Mining:
    """Anchors are the rows whose id is divisible by ``every``; components are ``floor(scale * x)``.

    Of each anchor the first ``positives`` rows of its label, of each positive the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's. ``rows`` at most meet ``anchors`` in one
    task, ``block`` rows at most share an index; dimensions are indexed ``together`` at a time.
    """

    every: int = 50
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    rows: int = 16_384
    anchors: int = 8192
    block: int = 2048
    together: int = 8


#: Rows that take part: with an id, a label and a vector of finite components.
_VALID = """coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')), false)"""

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def members(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, with whole components; of rows that repeat an id the least."""
    own = vectors.select("vec_id", "label", "embedding").where(_VALID)
    whole = own.select("vec_id", F.struct("label", F.expr(f"transform(embedding, x -> floor({scale} * CAST(x AS DOUBLE)))").alias("v")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


# --- one block of rows and its index


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Missing components are zeros. Doubles hold the products exactly unless components are very large."""
    longest = max((max(map(abs, v), default=0) for v in vectors), default=0)
    kind = np.float64 if longest * longest * max(width, 1) < 1 << 53 else object
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Index:
    """Inverted index of a block: per group of dimensions the rows whose products there can matter.

    Dimensions stand in the order of falling energy. ``rest[x, k]`` is the norm of row ``x`` from group ``k`` on: by the
    Cauchy-Schwarz inequality its product with that part of a query is bounded by the product of both norms.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, together: int):
        self.ids, width = ids, vectors.shape[1]
        self.exact = vectors.dtype == np.float64
        self.order = np.argsort(-(vectors * vectors).sum(axis=0), kind="stable") if width and self.exact else np.arange(width)
        self.vectors = vectors[:, self.order]
        self.cuts = [*range(0, width, together), width] if width else [0]
        self.rest = self._rest(self.vectors)

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """Norms from each cut on, a little more for rounding; the last is zero."""
        if not self.exact or x.dtype != np.float64:
            return np.full((len(x), len(self.cuts)), np.inf)
        squares = np.stack([(x[:, a:] ** 2).sum(axis=1) for a in self.cuts], axis=1)
        return np.sqrt(squares) * (1 + 1e-9)

    def probe(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs ``(query, row, score)`` of a score of ``least[query]`` or more.

        A row is indexed up to the group from which its rest cannot reach the lowest threshold with any query; a
        row that is covered from the start is no candidate. Scores are summed up group by group over the rows
        listed there. Rows whose sums and remaining norms reach no query's threshold leave the lists, and once few
        pairs are left, these are finished one by one.
        """
        q = queries[:, self.order]
        if not self.exact or q.dtype != np.float64:
            scores = q.astype(object) @ self.vectors.astype(object).T
            i, x = np.nonzero(scores >= np.array([int(t) if t > -math.inf else _LEAST for t in least], object)[:, None])
            return i, x, scores[i, x]
        q_rest, groups = self._rest(q), len(self.cuts) - 1
        listed = (self.rest[:, :groups] * q_rest.max(axis=0)[:groups] >= least.min()).sum(axis=1)
        if least.min() <= 0:
            listed[:] = groups  # nothing is covered: a pair without common dimensions scores zero
        rows = np.argsort(-listed, kind="stable")
        rows = rows[: np.count_nonzero(listed > 0)] if groups and least.min() > 0 else rows
        partial, alive, done = np.zeros((len(q), len(rows))), None, groups
        for k in range(groups):
            a, b = self.cuts[k], self.cuts[k + 1]
            n = np.count_nonzero(listed[rows] > k)  # rows are listed in order of falling depth
            partial[:, :n] += q[:, a:b] @ self.vectors[rows[:n], a:b].T
            # what a row can still get: from its next listed group on, or from where its index ended
            reach = np.minimum(listed[rows], k + 1)
            alive = partial + q_rest[:, reach] * self.rest[rows, reach] >= least[:, None]
            some = alive.any(axis=0)
            if not some.all():
                rows, partial, alive = rows[some], partial[:, some], alive[:, some]
            if alive.sum() * 8 < alive.size or not len(rows):
                done = k + 1
                break
        i, at = np.nonzero(alive if alive is not None else np.ones(partial.shape, bool))
        x = rows[at]
        scores = partial[i, at]
        short = np.flatnonzero(listed[x] < groups) if done == groups else np.arange(len(i))
        for s in np.split(short, range(1 << 16, len(short), 1 << 16)):
            scores[s] = np.einsum("ij,ij->i", q[i[s]], self.vectors[x[s]])
        reached = scores >= least[i]
        return i[reached], x[reached], scores[reached]


class Windows:
    """Of each query the first rows, by falling score and then by id, in ranges of scores; filled block by block."""

    def __init__(self, ranges: list[list[tuple[float, float]]], size: int):
        self.ranges, self.size = ranges, size
        self.found: list[list[list[tuple]]] = [[[] for _ in r] for r in ranges]  # (-score, id), sorted

    def full(self, i: int) -> bool:
        return all(len(f) >= self.size for f in self.found[i])

    def floor(self, i: int) -> float:
        """Below it no row changes a window of this query."""
        return min((-f[self.size - 1][0] if len(f) >= self.size else low for f, (low, _) in zip(self.found[i], self.ranges[i])), default=math.inf)

    def start(self, i: int, most: float) -> float:
        """The first threshold: near the end of the lowest window that is not full, or the best possible score."""
        open_ends = [min(high, most) for f, (_, high) in zip(self.found[i], self.ranges[i]) if len(f) < self.size]
        return max(self.floor(i), 0.9 * min(open_ends)) if open_ends and min(open_ends) > 0 else self.floor(i)

    def add(self, i: int, scores: list, ids: list) -> None:
        """``scores`` of rows not seen before, falling, equal ones by id."""
        low_to_high = [-s for s in scores]
        for f, (low, high) in zip(self.found[i], self.ranges[i]):
            at = int(np.searchsorted(low_to_high, -high)) if high < math.inf else 0
            new = [(-s, v) for s, v in zip(scores[at : at + self.size], ids[at : at + self.size]) if s >= low]
            if new:
                f[:] = sorted([*f, *new])[: self.size]


def search(index: Index, queries: np.ndarray, windows: Windows, at: list[int], leave: np.ndarray | None = None) -> None:
    """Fills the windows ``at`` of the queries from a block, lowering each query's threshold until its windows are full.

    ``leave[query, row]`` marks rows that do not count for a query. Each time, only rows below the threshold
    before are added; a threshold at the windows' own floor ends the search for a query.
    """
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) if len(queries) else np.zeros(0)
    most = float(index.rest.max(initial=0.0))
    active = list(range(len(at)))
    above = np.full(len(at), math.inf)
    bounded = index.exact and queries.dtype == np.float64
    least = np.array([windows.start(i, most * n) if bounded else windows.floor(i) for i, n in zip(at, norms)])
    while active:
        i, x, scores = index.probe(queries[active], least[active])
        new = scores < above[active][i]
        if leave is not None:
            new &= ~leave[np.array(active)[i], x]
        i, x, scores = i[new], x[new], scores[new]
        order = np.lexsort((index.ids[x], [-s for s in scores] if scores.dtype == object else -scores, i))
        i, x, scores = i[order], x[order], scores[order]
        bounds = np.searchsorted(i, np.arange(len(active) + 1))
        going = []
        for n, a in enumerate(active):
            s, e = bounds[n], bounds[n + 1]
            if e > s:
                windows.add(at[a], scores[s:e].tolist(), index.ids[x[s:e]].tolist())
            floor, lower = windows.floor(at[a]), 0.6 * least[a]
            if least[a] > floor:  # rows between the floor and the threshold may still come first
                above[a] = least[a]
                least[a] = floor if windows.full(at[a]) or lower <= max(0.02 * most * norms[a], floor) else lower
                going.append(a)
        active = going


# --- blocks as rows


def _packed(batches: Iterator[pa.RecordBatch], size: int, extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of at most ``size``, each one row: a key, and the lists of its columns."""
    from pyspark import TaskContext

    key, names, waiting, n = TaskContext.get().partitionId() << 32, ["vec_id", "label", "v", *extra], [], 0

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).chunk(0)) for c in names]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([rows.num_rows], pa.int64()), *lists], names=["block", "n", *names])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            waiting.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield block(pa.Table.from_batches(waiting))
                key, waiting, n = key + 1, [], 0
    if n:
        yield block(pa.Table.from_batches(waiting))


def blocks(rows: DataFrame, size: int, extra: dict[str, str] | None = None) -> DataFrame:
    """``block, n, vec_id, label, v`` (and ``extra`` columns): lists of at most ``size`` rows of a task, sorted by label and id."""
    extra = extra or {}
    label = rows.schema["label"].dataType.simpleString()
    kinds = {"vec_id": "bigint", "label": label, "v": "array<bigint>"} | extra
    schema = "block bigint, n bigint, " + ", ".join(f"{k} array<{v}>" for k, v in kinds.items())
    return rows.select(*kinds).mapInArrow(lambda batches: _packed(batches, size, list(extra)), schema)


def _read(group: pa.Table, together: int) -> list[tuple[np.ndarray, list, Index]]:
    out = []
    for row in sorted(group.to_pylist(), key=lambda r: r["block"]):
        width = max(map(len, row["v"]))
        out.append((row["label"], Index(np.array(row["vec_id"], np.int64), _matrix(row["v"], width), together)))
    return out


def _fitted(queries: list[list[int]], width: int) -> np.ndarray:
    """Queries in the width of a block: what it lacks are zeros there."""
    return _matrix([v[:width] for v in queries], width)


def _met(anchors: DataFrame, rows: DataFrame, p: Mining, find, schema: str) -> DataFrame:
    """``find(anchor blocks, row blocks)`` for bounded shares of both: every anchor block meets every row block once.

    Anchors grow with the table, so neither side is broadcast: shares of ``p.anchors`` anchors and ``p.rows`` rows
    are dealt by hash and copied to where they meet.
    """
    shares = lambda df, most: max(1, -(-(df.agg(F.sum("n")).first()[0] or 0) // most))
    of_rows, of_anchors = shares(rows, p.rows), shares(anchors, p.anchors)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        own_share: Column = F.expr(f"pmod(xxhash64(block), {n})").alias(own)
        return df.select("*", own_share, F.explode(F.expr(f"sequence(0L, {m - 1}L)")).alias(other))

    left = dealt(anchors, "anchors", of_anchors, "rows", of_rows).groupBy("anchors", "rows")
    right = dealt(rows, "rows", of_rows, "anchors", of_anchors).groupBy("anchors", "rows")
    return left.cogroup(right).applyInArrow(find, schema)


def _positives(p: Mining, as_long) -> object:
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        held, out = [], []
        for row_labels, index in _read(rows, p.together):
            vectors = index.vectors[:, np.argsort(index.order)]
            for label in dict.fromkeys(row_labels):
                some = [x for x, own in enumerate(row_labels) if own == label]
                held.append((label, Index(index.ids[some], vectors[some], p.together)))
        for block in anchors.to_pylist():
            ids, labels = block["vec_id"], block["label"]
            windows = Windows([[(-math.inf, math.inf)] for _ in ids], p.positives)
            asked: dict = {}
            for i, label in enumerate(labels):
                asked.setdefault(label, []).append(i)
            for label, index in held:
                if at := asked.get(label):
                    leave = np.array([ids[i] for i in at])[:, None] == index.ids[None, :]
                    search(index, _fitted([block["v"][i] for i in at], len(index.order)), windows, at, leave)
            out += [(ids[i], v, as_long(-s)) for i in range(len(ids)) for s, v in windows.found[i][0]]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["anchor_id", "positive_id", "positive_score"])

    return find


def _negatives(p: Mining, as_long) -> object:
    def bounds(score: int) -> tuple[float, float]:
        return -(-p.low * score // 100), p.high * score // 100  # the whole numbers from low to high percent

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        held, out = _read(rows, p.together), []
        for block in anchors.to_pylist():
            ids, labels, targets = block["vec_id"], block["label"], block["positives"]
            ranges = [[bounds(t["positive_score"]) for t in own] for own in targets]
            windows = Windows([[r for r in own if r[0] <= r[1]] for own in ranges], p.negatives)
            at = [i for i in range(len(ids)) if windows.ranges[i]]
            if not at:
                continue
            for row_labels, index in held:
                numbers = {label: n for n, label in enumerate(dict.fromkeys([*row_labels, *labels]))}
                leave = np.array([numbers[labels[i]] for i in at])[:, None] == np.array([numbers[x] for x in row_labels])[None, :]
                search(index, _fitted([block["v"][i] for i in at], len(index.order)), windows, at, leave)
            for i in at:
                some = [t for t, r in zip(targets[i], ranges[i]) if r[0] <= r[1]]
                out += [(ids[i], t["positive_id"], t["positive_score"], v, as_long(-s)) for t, f in zip(some, windows.found[i]) for s, v in f]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return find


def _first(df: DataFrame, keys: list[str], score: str, vec_id: str, n: int) -> DataFrame:
    """The first ``n`` per key by falling score, then by id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, p: Mining = Mining()) -> DataFrame:
    """Hard negatives of ``vectors (vec_id, label, embedding)``.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: of every anchor and each of its positives
    the first rows of another label whose score lies in the window below the positive's score. Scores are inner products
    of whole components; higher ones come first, ties by smaller id.

    Rows are packed into blocks. A task takes a bounded share of anchors and of rows, and keeps per anchor the windows
    found so far: once they are full, their last scores are the threshold of the next block. Inside a block the
    index holds of each row only the dimensions that are not covered by the norms of the rest; thresholds start high and
    are lowered until the windows are full or end. What tasks found is ranked per anchor, a few rows of each task.

    Rows with a null id or label, a null vector or a null or non-finite component take no part. Of rows that repeat an id
    the least label and vector counts. Vectors of different lengths are compared as if the shorter one went on
    with zeros. Anchors without positives, and positives without rows in their window, give no rows, nor does an empty
    table. Scores must fit into 64 bits; beyond 53 bits they are summed as whole numbers, without bounds. Other columns
    are not read.
    """
    as_long = lambda s: max(_LEAST, min(_MOST, int(s)))
    rows = stored(members(vectors, p.scale), "members")
    held = stored(blocks(rows, p.block), "rows")
    anchors = rows.where(F.col("vec_id") % p.every == 0)
    near = _met(stored(blocks(anchors, p.block), "anchors"), held, p, _positives(p, as_long), "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = _first(near, ["anchor_id"], "positive_score", "positive_id", p.positives)
    listed = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    asking = stored(blocks(anchors.join(listed, "vec_id"), p.block, {"positives": "array<struct<positive_id: bigint, positive_score: bigint>>"}), "asking")
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _met(asking, held, p, _negatives(p, as_long), schema)
    ranked = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", p.negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
