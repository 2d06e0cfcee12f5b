"""How filters interact: removal games over their coalitions, their potentials and Shapley values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.llm.store import stored, text_bytes

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


@dataclass(frozen=True)
class Limits:
    """Filters A to D: least words, least percent of distinct words, most percent of A-Z, characters not allowed. E: copies."""

    words: int = 200
    distinct: int = 50
    upper: int = 2
    symbols: str = "#$%&*|"

    names = "ABCDE"


def _judged(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Per text the filters A to D that it fails, as bits, and its SHA-256."""
    symbols = limits.symbols.encode()

    def failed(text: bytes) -> int:
        words = text.split()  # at the six white-space bytes of ASCII
        n, points = len(words), len(text.translate(None, CONTINUED))
        return (
            (n < limits.words)
            | (100 * len(set(words)) < limits.distinct * n) << 1
            | (100 * (len(text) - len(text.translate(None, UPPER))) > limits.upper * points) << 2
            | (len(text.translate(None, symbols)) < len(text)) << 3
        )

    for batch in batches:
        bits, digests = [], []
        for text in text_bytes(batch.column("text")):
            bits.append(failed(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "failed", "digest"])


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs (doc_id, text, source)``: ``doc_id, part, failed``, the bits of the filters whose conditions it fails.

    Copies (E, bit 16) are texts that a smaller id of the table has too: the smallest id per SHA-256, combined before the
    shuffle, joined back. Both sides of that join are plain tables, so that a text with very many copies is split.
    A null text is empty, a null source the empty string. A row without an id is no copy, and nothing is a copy of it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    judged = stored(read.mapInArrow(lambda batches: _judged(batches, limits), f"doc_id {kind}, part string, failed int, digest binary"), "judged")
    firsts = judged.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return judged.join(stored(firsts, "firsts"), "digest", "left").select("doc_id", "part", F.expr("failed + if(coalesce(doc_id > first, false), 16, 0)").alias("failed"))


# --- the game


def _potentials(names: str) -> list[list[tuple[int, list[int]]]]:
    """Per size of coalition the coalitions of that size, as bits, with those that lack one member."""
    n = len(names)
    levels = []
    for size in range(1, n + 1):
        level = []
        for members in combinations(range(n), size):
            whole = sum(1 << i for i in members)
            level.append((whole, [whole & ~(1 << i) for i in members]))
        levels.append(level)
    return levels


def games(counts: DataFrame, names: str, measures: tuple[str, ...]) -> DataFrame:
    """Per part: of each measure an array over all coalitions, what the coalition's filters remove; and the potentials.

    ``counts (part, failed, <measures>)`` are additive. ``values_<measure>[s]`` is the sum over rows that fail any filter of
    the coalition with bits ``s``; ``alone_<measure>``, per filter, that over rows failing nothing else; ``all_<measure>``
    the sum over all rows. ``potential[s]`` is the potential of the first measure's game times the factorial of the
    number of filters, a whole number: that of a coalition is its value and the potentials without one member, divided
    by its size. Sizes follow one another as projections, so each potential is computed once.
    """
    n, scale = len(names), factorial(len(names))

    def removed(measure: str, s: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(s) != 0, F.col(measure))), F.lit(0)).cast("bigint")

    def alone(measure: str, i: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("failed") == 1 << i, F.col(measure))), F.lit(0)).cast("bigint")

    summed = counts.groupBy("part").agg(*(
        c for m in measures for c in (
            F.array(F.lit(0).cast("bigint"), *(removed(m, s) for s in range(1, 1 << n))).alias(f"values_{m}"),
            F.array(*(alone(m, i) for i in range(n))).alias(f"alone_{m}"),
            F.sum(m).cast("bigint").alias(f"all_{m}"),
        )
    ))
    value = f"values_{measures[0]}"
    for level in _potentials(names):
        summed = summed.select("*", *(
            F.expr(f"({scale} * {value}[{s}] + {' + '.join(f'p{r}' if r else '0L' for r in rest)}) div {len(rest)}").alias(f"p{s}") for s, rest in level
        ))
    return summed.select(*(c for c in summed.columns if not c.startswith("p") or c == "part"), F.array(F.lit(0).cast("bigint"), *(f"p{s}" for s in range(1, 1 << n))).alias("potential"))


def audit(failed: DataFrame, labels: DataFrame, names: str = Limits.names) -> DataFrame:
    """Per part, order of the filters and step: what happens to the part's documents there, zeros included.

    ``failed (doc_id, part, failed)`` as from ``failures``, for any number of filters up to 6; ``labels (doc_id, quality,
    toxic)``. The result has ``part, filter_order, step`` and counts of documents: ``kept`` after the step, ``removed`` in it,
    ``redundant`` (failing its filter, removed earlier), ``unique_fails`` (failing its filter only), ``good_lost`` and
    ``toxic_lost`` (removed here, with quality 1 or toxic 1), and ``shapley``, the sum of what the filter removes over all
    orders: the grand potential less the potential without that filter.

    Rows are combined to one per part and set of failed filters before anything is shuffled by part, so a part may
    hold any share of them; the games then work on a row per part. A step is the difference of two coalitions. A part
    without rows has no result; rows that repeat an id count each; of repeated labels one that says 1 is enough;
    rows without an id or label have none. Other columns are not read.
    """
    n, orders = len(names), ",".join("".join(x) for x in permutations(names))
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic"))
    rows = failed.select("doc_id", "part", "failed").join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    steps = games(counts, names, ("docs", "good", "toxic")).withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = " + ".join(f"if(instr(filter_order, '{c}') < step, {1 << i}, 0)" for i, c in enumerate(names))
    steps = steps.withColumn("own", F.expr(f"instr('{names}', substr(filter_order, step, 1)) - 1")).withColumn("before", F.expr(before)).withColumn("after", F.expr("before + shiftleft(1, own)"))
    whole = (1 << n) - 1
    return steps.selectExpr(
        "part", "filter_order", "step",
        "all_docs - values_docs[after] AS kept",
        "values_docs[after] - values_docs[before] AS removed",
        "values_docs[shiftleft(1, own)] - values_docs[after] + values_docs[before] AS redundant",
        "alone_docs[own] AS unique_fails",
        "values_good[after] - values_good[before] AS good_lost",
        "values_toxic[after] - values_toxic[before] AS toxic_lost",
        f"potential[{whole}] - potential[{whole} - shiftleft(1, own)] AS shapley",
    )
