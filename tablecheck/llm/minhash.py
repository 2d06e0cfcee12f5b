"""Near-duplicate documents by b-bit MinHash over word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.llm.components import components
from tablecheck.llm.store import stored, text_bytes

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SLOTS = 1 << 24


@dataclass(frozen=True)
class MinHash:
    """``width`` words per shingle, links at ``percent``; ``bands`` of ``rows`` minima, of each the low ``bits``.

    80 bands of 8 miss a pair at 0.8 with a probability of 4e-7. ``slack`` is how many standard deviations the
    estimate may lie under the limit before a candidate is not confirmed on its full sets (5: 3e-7). Buckets are
    worked on in chunks of ``chunk`` documents on average. The first step looks at ``first`` bands, the second at all.
    """

    width: int = 5
    percent: int = 80
    bands: int = 80
    rows: int = 8
    bits: int = 4
    slack: float = 5.0
    chunk: int = 1024
    first: int = 16

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def least_estimate(self) -> float:
        j, c = self.percent / 100, 2.0**-self.bits
        match = j + (1 - j) * c
        return j - self.slack * (match * (1 - match) / self.minima) ** 0.5 / (1 - c)


class _Hashes(dict):
    """64-bit hashes of words, worked out once; emptied when it holds a quarter of a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` are one shingle, none is none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, width)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total = total * _ODD[2] + h[i : n - size + 1 + i]
    return np.unique(_mixed(total))


def _minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = (found >> np.uint64(32)).astype(np.uint32)
    parts = [(a * high[i : i + 1024] + b).min(axis=1) for i in range(0, len(high), 1024)]
    return reduce(np.minimum, parts)


def _signed(batches: Iterator[pa.RecordBatch], p: MinHash) -> Iterator[pa.RecordBatch]:
    random = np.random.default_rng(20240607)
    a = (random.integers(0, 1 << 31, (p.minima, 1), np.uint32) << np.uint32(1)) | np.uint32(1)
    b = random.integers(0, 1 << 32, (p.minima, 1), np.uint32)
    hashes, per = _Hashes(), 64 // p.bits
    numbers = np.arange(p.bands, dtype=np.uint64)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(p.bits)
    padded = -(-p.minima // per) * per
    for batch in batches:
        sizes, sets, keys, packed = [], [], [], []
        for text in text_bytes(batch.column(1)):
            found = shingles(text.lower().split(), p.width, hashes)
            sizes.append(len(found))
            sets.append(xxhash.xxh3_128_digest(found.tobytes()))
            if not len(found):
                keys.append(None), packed.append(None)
                continue
            least = _minima(found, a, b).astype(np.uint64)
            banded = numbers.copy()
            for column in least.reshape(p.bands, p.rows).T:
                banded = _mixed(banded * _ODD[2] + column)
            low = np.zeros(padded, np.uint64)
            low[: p.minima] = _mixed(least) & np.uint64((1 << p.bits) - 1)  # a minimum's own low bits hang on the shingle's alone
            keys.append(banded.view(np.int64))
            packed.append(np.bitwise_or.reduce(low.reshape(-1, per) << shifts, axis=1).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "bands", "packed"],
        )


def signatures(docs: DataFrame, p: MinHash) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands, packed``: the set's size and 128-bit key, band keys and packed low bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _signed(batches, p), f"doc_id {kind}, n_shingles bigint, set_key binary, bands array<bigint>, packed array<bigint>"
    )


def estimate(a: np.ndarray, b: np.ndarray, p: MinHash) -> np.ndarray:
    """Similarity of packed minima, row by row: by bit counts of their difference, corrected for chance.

    Minima that differ agree in their low bits with a probability of 2 to the power of minus ``bits``.
    """
    ones = np.uint64(sum(1 << i for i in range(0, 64, p.bits)))
    x = a ^ b
    folded = x.copy()
    for k in range(1, p.bits):
        folded |= x >> np.uint64(k)
    differing = np.bitwise_count(folded & ones).sum(axis=-1)
    chance = 2.0**-p.bits
    return (1 - differing / p.minima - chance) / (1 - chance)


def _likely_in(group: list[dict], p: MinHash, forest: bool) -> list[tuple]:
    """Pairs of one chunk or chunk pair whose estimate does not rule them out.

    With ``forest`` a spanning forest of them, most similar first. Without, each pair of different components, in
    the first band that both documents share only, so that it is met once.
    """
    group.sort(key=lambda row: row["doc_id"])
    packed = np.array([row["packed"] for row in group], np.int64).view(np.uint64)
    sides = np.array([row["side"] for row in group])
    found = []
    if not forest:
        component, bands = np.array([row["component"] for row in group]), np.array([row["bands"] for row in group])
    for i in range(len(group) - 1):
        near = estimate(packed[i + 1 :], packed[i], p)
        passed = near >= p.least_estimate()
        if not forest:
            passed &= component[i + 1 :] != component[i]
            passed &= (sides[i + 1 :] != sides[i]) | (group[i]["i"] == group[i]["j"])
            at = np.flatnonzero(passed)
            if len(at):
                first = (bands[i + 1 :][at] == bands[i]).argmax(axis=1)
                passed[at] = bands[i][first] == group[i]["band"]
        found += [(-near[j], i, i + 1 + int(j)) for j in np.flatnonzero(passed)]
    if forest:
        root, kept = list(range(len(group))), []

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for pair in sorted(found):
            u, v = top(pair[1]), top(pair[2])
            if u != v:
                root[v] = u
                kept.append(pair)
        found = kept
    return [(group[i]["doc_id"], group[j]["doc_id"]) for _, i, j in found if group[i]["doc_id"] != group[j]["doc_id"]]


def _likely(placed: DataFrame, marks: DataFrame, p: MinHash, forest: bool) -> DataFrame:
    """``u, v``, with u below v, of ``placed (band, i, j, side, doc_id[, component])``, which has each group's rows.

    Groups have bounded size: a bucket of many documents is dealt over chunks by the hash of their ids.
    """
    more = [] if forest else ["component", "bands"]
    rows = placed.join(marks.select("doc_id", "packed", *more[1:]), "doc_id").select("band", "i", "j", "side", "doc_id", "packed", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            pairs = []
            for row in batch.to_pylist():
                if group and (row["band"], row["i"], row["j"]) != (group[0]["band"], group[0]["i"], group[0]["j"]):
                    pairs += _likely_in(group, p, forest)
                    group = []
                group.append(row)
            yield _pairs(pairs)
        yield _pairs(_likely_in(group, p, forest))

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "u bigint, v bigint").distinct()


def _pairs(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _slot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(_SLOTS))


def _sets_of(docs: DataFrame, pairs: DataFrame, p: MinHash) -> DataFrame:
    """``doc_id, found``: full shingle sets of the documents that pairs name, and of few others.

    The ids are hashed to a bitmap of fixed size (2 MB), so that no text is shuffled to find them; documents that
    pass by collision meet no pair later.
    """
    ids = pairs.select(F.col("u").alias("id")).distinct().unionByName(pairs.select(F.col("v").alias("id")).distinct()).select((_slot("id") + 1).alias("slot"))
    rows = ids.groupBy(F.expr("bitmap_bucket_number(slot)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    bitmap = np.zeros(_SLOTS // 8, np.uint8)
    for part, bits in rows:
        bitmap[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    known, width = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes()), p.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = np.frombuffer(known.value, np.uint8), _Hashes()
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            found = [shingles(t.lower().split(), width, hashes).view(np.int64) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(run, f"doc_id {kind}, found array<bigint>")


def _confirmed(docs: DataFrame, pairs: DataFrame, p: MinHash) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    sets = stored(_sets_of(docs, pairs, p), "shingle-sets")
    left = sets.select(F.col("doc_id").alias("u"), F.col("found").alias("fu"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("found").alias("fv"))
    common = F.size(F.array_intersect("fu", "fv")).cast("bigint")
    union = F.size("fu") + F.size("fv") - F.col("common")
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "fu", "fv", common.alias("common"))
    return joined.where(F.col("common") * 100 >= union * p.percent).select("u", "v")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Words are split at ASCII white space after A-Z are lower-cased. Documents with the same shingle set are one
    class; classes meet in band buckets. First each chunk of a bucket of some bands, with the bucket's smallest document, gives a
    spanning forest of its pairs by b-bit estimates; these are confirmed on the full sets. Then all members of one
    bucket that are still in different components are estimated, and those that may be similar enough are confirmed,
    so no link between components is lost by the first step. Pairs within a component are never listed.

    A null or empty text has no shingles, is linked with nothing and kept. A row without ``doc_id`` is linked only with
    rows of the same set. Rows that repeat a ``doc_id`` share
    its links. Other columns are not read. An empty table gives no rows.
    """
    signed = stored(signatures(docs, p), "signatures")
    filled = signed.where("n_shingles > 0")
    classes = stored(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    marks = filled.join(classes.select(F.col("rep").alias("doc_id"), F.col("set_key")), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    placed = marks.select(F.posexplode("bands").alias("no", "band"), "doc_id")
    sizes = placed.groupBy("band").agg(F.min("no").alias("no"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("all")).where("low < high")
    sizes = stored(sizes, "buckets")
    shared = stored(placed.select("band", "doc_id").join(sizes.select("band", "n"), "band"), "shared-buckets")
    chunk = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / p.chunk)).cast("int")
    # buckets of the same documents are worked on once; the smallest document joins every chunk
    once = sizes.where(F.col("no") < p.first).groupBy("low", "high", "n", "all").agg(F.min("band").alias("band"))
    chunks = F.expr(f"if(doc_id = low, sequence(0, CAST(ceil(n / {p.chunk}) AS INT) - 1), array(CAST(pmod(xxhash64(doc_id), ceil(n / {p.chunk})) AS INT)))")
    near = shared.join(once.select("band", "low"), "band").select("band", "doc_id", F.explode(chunks).alias("i")).select("band", "i", F.col("i").alias("j"), F.col("i").alias("side"), "doc_id")
    likely = stored(_likely(near, marks, p, forest=True), "candidates")
    links = stored(_confirmed(docs, likely, p), "confirmed")
    # members of a bucket that the forests have left in different components
    found = components(links)
    apart = shared.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "n", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = apart.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("band")
    apart = apart.join(mixed, "band", "left_semi").select("band", "doc_id", "component", chunk.alias("side"), F.ceil(F.col("n") / p.chunk).cast("int").alias("k"))
    apart = apart.select("band", "doc_id", "component", "side", F.explode(F.expr("sequence(0, k - 1)")).alias("other"))
    apart = apart.select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", "component")
    rest = stored(_likely(apart, marks, p, forest=False).join(likely, ["u", "v"], "left_anti"), "candidates")
    links = links.unionByName(_confirmed(docs, rest, p))
    of_class = components(links).select(F.col("id").alias("rep"), "component")
    member = classes.join(of_class, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    joined = signed.join(member, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
