"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablecheck.llm.components import components
from tablecheck.llm.store import stored


@dataclass(frozen=True)
class GridOrder:
    """Links at a cosine of ``least`` or more, within equal labels.

    ``sample`` vectors at most fit the principal dimensions; ``leading`` of them bound blocks, the first ``sorting``
    order them. ``block`` vectors at most are a block, ``leaf`` at most are compared without further splitting.
    """

    least: float = 0.98
    sample: int = 4096
    leading: int = 16
    sorting: int = 4
    block: int = 1024
    leaf: int = 128

    @property
    def epsilon(self) -> float:
        """Unit vectors of that cosine are this far apart; a little more, for rounding."""
        return (2 - 2 * self.least) ** 0.5 * (1 + 1e-9) + 1e-9


#: Rows that can be linked: with an id, a label, and a vector of finite components that are not all zero.
_VALID = """coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)
  AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')), false)"""


def _units(column: pa.Array) -> list[np.ndarray]:
    out = []
    for v in column.to_pylist():
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()  # very large and very small components
        out.append(x / np.linalg.norm(x))
    return out


def principal(distinct: DataFrame, p: GridOrder) -> dict[int, np.ndarray]:
    """Per vector size the leading principal directions of a sample of fixed size, the rows of least hash."""
    rows = distinct.select("embedding").orderBy(F.xxhash64("embedding")).limit(p.sample).toArrow()
    by_size: dict[int, list] = {}
    for x in _units(rows.column(0).combine_chunks()) if rows.num_rows else []:
        by_size.setdefault(len(x), []).append(x)
    out = {}
    for size, found in by_size.items():
        x = np.stack(found)
        out[size] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][: p.leading].T
    return out


def _projected(x: np.ndarray, basis: dict[int, np.ndarray], p: GridOrder) -> np.ndarray:
    """Coordinates in the leading directions, filled up to ``leading``; a size outside the sample keeps its own axes."""
    at = x @ basis[x.shape[1]] if x.shape[1] in basis else x[:, : p.leading]
    return np.pad(at, ((0, 0), (0, p.leading - at.shape[1])))


def grid_order(distinct: DataFrame, basis: dict, p: GridOrder) -> DataFrame:
    """``label, rep, copies, embedding, size, cell``: each vector with its grid cell in the leading directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x in _units(batch.column("embedding")):
                cells.append(np.floor(_projected(x[None, :], basis, p)[0, : p.sorting] / p.epsilon).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    return distinct.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", cell array<int>")


def _cut(batches: Iterator[pa.RecordBatch], basis: dict, p: GridOrder) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbours in the order: bounds of the leading coordinates, cells, ids and vectors."""
    from pyspark import TaskContext

    key, number = TaskContext.get().partitionId() << 32, 0

    def block(rows, kind):
        nonlocal number
        label, size = rows[0][0], rows[0][1]
        x = np.stack([r[4] for r in rows])
        at = _projected(x, basis, p)
        cells = sorted({tuple(r[5][:3]) for r in rows})
        out = [key | number, label, size, at.min(axis=0), at.max(axis=0), [list(map(int, c)) for c in cells], np.array([r[2] for r in rows], np.int64).tobytes(), np.array([r[3] for r in rows], np.int64).tobytes(), x.tobytes()]
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([out[0]], pa.int64()), pa.array([label], kind), pa.array([size], pa.int32()), pa.array([out[3]], pa.list_(pa.float64())), pa.array([out[4]], pa.list_(pa.float64())), pa.array([out[5]], pa.list_(pa.list_(pa.int32()))), *(pa.array([b], pa.binary()) for b in out[6:])],
            names=["block", "label", "size", "low", "high", "cells", "ids", "copies", "vectors"],
        )

    rows: list[tuple] = []
    kind = None
    for batch in batches:
        kind = batch.schema.field("label").type
        columns = [batch.column(c).to_pylist() for c in ("label", "size", "rep", "copies")]
        for row in zip(*columns, _units(batch.column("embedding")), batch.column("cell").to_pylist()):
            if rows and (len(rows) >= p.block or row[:2] != rows[0][:2]):
                yield block(rows, kind)
                rows = []
            rows.append(row)
    if rows:
        yield block(rows, kind)


def _near(low_a, high_a, low_b, high_b, epsilon: float) -> bool:
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return float(gap @ gap) <= epsilon * epsilon


class _Join:
    """Recursive join of two sequence intervals; counts links per vector and keeps a spanning forest of them."""

    def __init__(self, a, b, p: GridOrder):
        self.p, self.same = p, b is None
        self.sides = [a] if self.same else [a, b]
        self.offset = len(a[0])
        n = sum(len(s[0]) for s in self.sides)
        self.links, self.parent = np.zeros(n, np.int64), np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def run(self, i0: int, i1: int, j0: int, j1: int) -> None:
        a, b = self.sides[0], self.sides[-1]
        xa, xb = a[3][i0:i1], b[3][j0:j1]
        if not _near(xa.min(0), xa.max(0), xb.min(0), xb.max(0), self.p.epsilon):
            return
        if i1 - i0 <= self.p.leaf and j1 - j0 <= self.p.leaf:
            self._leaf(i0, i1, j0, j1)
            return
        halves = lambda s, t: [(s, (s + t) // 2), ((s + t) // 2, t)] if t - s > self.p.leaf else [(s, t)]
        for s, t in halves(i0, i1):
            for u, v in halves(j0, j1):
                if not self.same or u >= s:  # a pair within one block is met once
                    self.run(s, t, u, v)

    def _leaf(self, i0: int, i1: int, j0: int, j1: int) -> None:
        a, b = self.sides[0], self.sides[-1]
        linked = a[2][i0:i1] @ b[2][j0:j1].T >= self.p.least
        within = self.same and i0 == j0
        if within:
            np.fill_diagonal(linked, False)
        shift = 0 if self.same else self.offset
        self.links[i0:i1] += linked @ b[1][j0:j1]
        if not within:
            self.links[shift + j0 : shift + j1] += linked.T @ a[1][i0:i1]
        for i in np.flatnonzero(linked.any(axis=1)):
            for j in np.flatnonzero(linked[i]):
                u, v = self._root(i0 + int(i)), self._root(shift + j0 + int(j))
                if u != v:
                    self.parent[max(u, v)] = min(u, v)
                    self.edges.append((i0 + int(i), shift + j0 + int(j)))


def _joined(batches: Iterator[pa.RecordBatch], basis: dict, p: GridOrder) -> Iterator[pa.RecordBatch]:
    """Rows ``(u, v, links)``: link counts of ``u`` where ``v`` is null, else one link of the spanning forest."""

    def side(row, suffix):
        if row[f"vectors{suffix}"] is None:
            return None
        x = np.frombuffer(row[f"vectors{suffix}"]).reshape(-1, row["size"])
        return np.frombuffer(row[f"ids{suffix}"], np.int64), np.frombuffer(row[f"copies{suffix}"], np.int64), x, _projected(x, basis, p)

    for batch in batches:
        for row in batch.to_pylist():
            a, b = side(row, "_a"), side(row, "_b")
            join = _Join(a, b, p)
            join.run(0, len(a[0]), 0, len(a[0] if b is None else b[0]))
            ids = a[0] if b is None else np.concatenate([a[0], b[0]])
            some = np.flatnonzero(join.links)
            ends = np.array(join.edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[some], ids[ends[:, 0]]])),
                pa.array(np.concatenate([ids[some], ids[ends[:, 1]]]), mask=np.arange(len(some) + len(ends)) < len(some)),
                pa.array(np.concatenate([join.links[some], np.zeros(len(ends), np.int64)])),
            ], names=["u", "v", "links"])


def near_duplicates(vectors: DataFrame, p: GridOrder = GridOrder()) -> DataFrame:
    """Per row of ``vectors (vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors are linked when their labels are equal and their cosine, in double precision, reaches ``least``. Equal
    vectors of a label are one class with a number of copies. Classes are sorted by label and by grid cells of the
    width of the link distance in the leading principal directions, and cut into blocks. Blocks of one label
    whose cells are neighbours, and whose bounds in all leading directions are not farther apart than a link,
    are joined: recursively, skipping halves that are provably distant. A join gives counts per vector and a spanning
    forest of its links, never its pairs.

    A null label, a null or empty vector, one of zeros only, or with a null or non-finite component is linked with
    nothing and kept, and so is a row without ``vec_id``. Vectors of different lengths are not linked. Ids are
    taken as unique; rows that repeat an id and vector count as copies. Other columns are not read.
    """
    own = vectors.select("vec_id", "embedding", "label")
    valid = own.where(_VALID)
    distinct = stored(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("embedding")), "vectors")
    basis = principal(distinct, p)
    ordered = grid_order(distinct, basis, p).repartitionByRange("label", "size", "cell").sortWithinPartitions("label", "size", "cell")
    label = vectors.schema["label"].dataType.simpleString()
    blocks = stored(ordered.mapInArrow(lambda batches: _cut(batches, basis, p), f"block bigint, label {label}, size int, low array<double>, high array<double>, cells array<array<int>>, ids binary, copies binary, vectors binary"), "blocks")
    bounds = blocks.select("block", "label", "size", "low", "high", "cells")
    here = bounds.select(F.col("block").alias("a"), "label", "size", F.explode("cells").alias("cell"))
    around = F.expr("flatten(transform(cells, c -> flatten(transform(array(-1, 0, 1), x -> flatten(transform(array(-1, 0, 1), y -> transform(array(-1, 0, 1), z -> transform(c, (v, i) -> v + array(x, y, z)[i]))))))))")
    there = bounds.select(F.col("block").alias("b"), "label", "size", F.explode(F.array_distinct(around)).alias("cell"))
    met = here.join(there, ["label", "size", "cell"]).where("a <= b").select("a", "b").distinct()
    left, right = (bounds.select(F.col("block").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")) for s in "ab")
    gap = F.expr("aggregate(zip_with(zip_with(low_a, high_b, (l, h) -> l - h), zip_with(low_b, high_a, (l, h) -> l - h), (m, n) -> greatest(m, n, 0D)), 0D, (s, g) -> s + g * g)")
    pairs = met.join(left, "a").join(right, "b").where(gap <= p.epsilon**2).select("a", "b")
    left, right = (blocks.select(F.col("block").alias(s), *(["size"] if s == "a" else []), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "vectors"))) for s in "ab")
    sides = pairs.join(left, "a").join(right, "b").select("size", "ids_a", "copies_a", "vectors_a", *(F.when(F.col("a") != F.col("b"), F.col(f"{c}_b")).alias(f"{c}_b") for c in ("ids", "copies", "vectors")))
    found = stored(sides.mapInArrow(lambda batches: _joined(batches, basis, p), "u bigint, v bigint, links bigint"), "vector-links")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    of_class = components(found.where("v IS NOT NULL").select("u", "v")).select(F.col("id").alias("rep"), "component")
    classes = distinct.join(links, "rep", "left").join(of_class, "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    member = valid.join(classes, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = own.where(f"NOT {_VALID}").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
