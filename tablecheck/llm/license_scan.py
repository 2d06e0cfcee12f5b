"""License detections in whole texts, as expressions that Spark evaluates row by row."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.functions.literals import literal
from tablecheck.llm.license_rules import HINT, NOTICE, REACH, Signature, signatures
from tablecheck.llm.store import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rules(rules: list[Signature]) -> str:
    listed = ", ".join(
        f"named_struct('no', {no}, 'label', {literal(r.label)}, 'priority', {r.priority}, 'keyword', {literal(r.keyword)}, "
        f"'pattern', {literal(f'(?<= )({r.pattern})(?= )')}, 'score', {r.score!r}D, 'base', {str(r.base).lower()})"
        for no, r in enumerate(rules)
    )
    return f"array({listed})"


def _keyword_starts(rules: list[Signature]) -> str:
    """A pattern of width zero where any rule's keyword starts, within words too; tried by the first character."""
    rests = defaultdict(list)
    for keyword in sorted({r.keyword for r in rules}):
        rests[keyword[:1]].append(re.escape(keyword[1:]))
    return "(?=" + "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in rests.items()) + ")"


def _detections(rules: list[Signature]) -> str:
    """All matches in a text's ``words``, sorted by start, then priority, length and rule order.

    Only stretches of words around a keyword are read, a reach on either side; as every match holds its rule's keyword,
    none is outside. In a stretch the rules whose keyword occurs mark the first and last word of each of their
    matches, and the marked words' places are the spans.
    """
    marks = f"regexp_replace(array_join(words, ' '), {literal(_keyword_starts(rules))}, '\\u0001')"
    held = "filter(transform(split(m, ' '), (w, i) -> if(contains(w, '\\u0001'), i, NULL)), i -> i IS NOT NULL)"
    places = f"transform(array({marks}), m -> if(contains(m, '\\u0001'), {held}, filter(array(0), i -> false)))[0]"
    apart = 2 * REACH
    first = f"filter(transform(at, (a, k) -> if(k = 0 OR a - at[greatest(k - 1, 0)] > {apart}, a, NULL)), a -> a IS NOT NULL)"
    last = f"filter(transform(at, (a, k) -> if(k = size(at) - 1 OR at[least(k + 1, size(at) - 1)] - a > {apart}, a, NULL)), a -> a IS NOT NULL)"
    stretch = (
        f"transform(arrays_zip({first}, {last}), s -> named_struct('start', greatest(s.`0` - {REACH}, 0), "
        f"'text', concat(' ', array_join(slice(words, greatest(s.`0` - {REACH}, 0) + 1, s.`1` + {REACH} + 1 - greatest(s.`0` - {REACH}, 0)), ' '), ' ')))"
    )
    marked = "split(trim(both ' ' FROM t), ' ')"
    spans = (
        "transform(array(regexp_replace(s.text, r.pattern, '\\u0001$1\\u0002')), t -> if(contains(t, '\\u0001'), transform(array({marked}), m -> transform(arrays_zip("
        "filter(transform(m, (w, i) -> if(startswith(w, '\\u0001'), i, NULL)), i -> i IS NOT NULL), "
        "filter(transform(m, (w, i) -> if(endswith(w, '\\u0002'), i, NULL)), i -> i IS NOT NULL)), "
        "p -> named_struct('start', s.start + p.`0`, 'end', s.start + p.`1`, 'no', r.no, 'label', r.label, 'priority', r.priority, 'score', r.score, 'base', r.base)))[0], CAST(array() AS {kind})))[0]"
    ).format(marked=marked, kind="array<struct<start: int, end: int, no: int, label: string, priority: int, score: double, base: boolean>>")
    found = f"flatten(transform({stretch}, s -> flatten(transform(filter({_rules(rules)}, r -> contains(s.text, r.keyword)), r -> {spans}))))"
    ordered = (
        f"array_sort(flatten(transform(array({places}), at -> {found})), (a, b) -> CASE "
        "WHEN a.start <> b.start THEN a.start - b.start WHEN a.priority <> b.priority THEN b.priority - a.priority "
        "WHEN a.end <> b.end THEN b.end - a.end ELSE a.no - b.no END)"
    )
    return ordered


def _resolved() -> str:
    """The detections no other one suppresses: one that holds it and has a higher priority, or an equal one and comes earlier.

    In the sorted order a detection that holds another stands before it, so one pass with the farthest end so far of
    each priority decides.
    """
    ends = ", ".join(f"greatest(s.e{p}, if(d.priority >= {p}, d.end, -1)) AS e{p}" for p in range(HINT, NOTICE + 1))
    passed = "CASE d.priority " + " ".join(f"WHEN {p} THEN s.e{p}" for p in range(HINT, NOTICE + 1)) + " END >= d.end"
    start = ", ".join(f"-1 AS e{p}" for p in range(HINT, NOTICE + 1))
    return (
        f"aggregate(found, struct({start}, filter(found, d -> false) AS kept), "
        f"(s, d) -> struct({ends}, if({passed}, s.kept, concat(s.kept, array(d))) AS kept), s -> s.kept)"
    )


def scan(docs: DataFrame, rules: list[Signature] | None = None, text: Column | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``found`` (all detections) and ``kept`` (those left after suppression) added.

    A detection is ``start, end`` (first and last word, from 0), ``no`` and ``label`` of its rule, ``priority``, ``score``
    and ``base``. Everything is worked out within a row: nothing is shuffled, whole texts are read, and a text
    without a keyword costs its split into words and one search. A null or empty text has no words and no detections;
    repeated rows are scanned each. Columns of ``docs`` named like the added ones are replaced.
    """
    rules = signatures() if rules is None else rules
    text = F.col("text") if text is None else text
    words = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0)
    once = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), w.alias("words")))[0]
    kept = [c for c in docs.columns if c not in ("n_words", "found", "kept", "_words")]
    split = docs.select(*kept, once.alias("_words"))
    found = F.expr(f"transform(array(_words.words), words -> {_detections(rules)})[0]")
    split = split.select(*kept, F.col("_words.n").alias("n_words"), found.alias("_found"))
    both = F.expr(f"transform(array(_found), found -> struct(found, {_resolved()} AS kept))[0]")
    return split.select(*kept, "n_words", both.alias("_both")).select(*kept, "n_words", F.col("_both.found").alias("found"), F.col("_both.kept").alias("kept"))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row of ``scan(docs)``: base places, first and last of their words, labels, and the best detection's score."""
    base = F.expr("filter(found, d -> d.base)")
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(base["start"]).cast("bigint").alias("first_word"), F.array_max(base["start"]).cast("bigint").alias("last_word"),
        names(base["label"]).alias("base_labels"), names(F.array_union(base["label"], F.col("kept.label"))).alias("labels"),
        F.coalesce(F.array_max(F.col("kept.score")), F.lit(0.0)).alias("score"), F.size("kept").cast("bigint").alias("n_kept"),
    )
