"""Hard negatives, the filter audit and byte-level BPE against plain versions."""

import hashlib
import math
from itertools import permutations

import numpy as np
import pytest
import tiktoken

from tablecheck.llm import byte_bpe, filter_audit, hard_negatives
from tablecheck.llm.hard_negatives import Index, Mining
from tablecheck.llm.queries import split_pattern, tokenizer


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- hard negatives

VECTORS = "vec_id bigint, label int, embedding array<float>"


def plain_negatives(table, p):
    usable = {}
    for i, label, v in table:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = (label, [math.floor(p.scale * float(np.float32(x))) for x in v])
        usable[i] = min(usable.get(i, whole), whole)
    out = []
    for a, (label, v) in usable.items():
        if a % p.every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, (other, w) in usable.items() if j != a]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[: p.positives]:
            fit = sorted((t, k) for t, k, other in scores if other != label and p.low * -s <= 100 * -t <= p.high * -s)
            out += [(a, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[: p.negatives])]
    return sorted(out, key=repr)


SMALL = Mining(every=3, scale=4, rows=32, anchors=16, block=8, together=2)


@pytest.mark.parametrize("seed,spread,width,labels", [(1, 1.0, 6, 3), (2, 3.0, 5, 2), (3, 0.4, 8, 4), (4, 2.0, 1, 2), (5, 1.0, 12, 40)])
def test_negatives_match_all_scores(spark, seed, spread, width, labels):
    random = np.random.default_rng(seed)
    centre = random.normal(0, spread, (5, width))
    table = [(int(i), int(random.integers(0, labels)), (centre[i % 5] + random.normal(0, 0.5, width)).astype(np.float32).tolist()) for i in range(150)]
    found = rows(hard_negatives.mine(spark.createDataFrame(table, VECTORS), SMALL))
    assert found == plain_negatives(table, SMALL) and (found or labels == 40)


def test_negatives_of_edge_rows(spark):
    nan, inf = math.nan, math.inf
    table = [
        (0, 1, [1.0, 1.0]), (3, 1, [0.0, 0.0]), (6, 2, [-1.0, 0.5]), (9, 1, []), (12, 1, [1.0]), (15, 2, [1.0, 1.0, 7.0]), (18, None, [1.0, 1.0]), (21, 1, None),
        (24, 1, [1.0, None]), (27, 2, [nan, 1.0]), (30, 2, [inf, 1.0]), (None, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]),
        (4, 2, [0.75, 0.75]), (5, 2, [0.75, 0.75]), (7, 2, [0.75, 0.75]), (8, 2, [0.75, 0.75]), (4, 2, [0.75, 0.75]), (10, 3, [0.5, 0.75]), (33, 5, [2.0, 2.0]), (33, 4, [2.0, 2.0]), (34, 4, [2.0, 1.5]),
    ]
    frame = spark.createDataFrame(table, VECTORS)
    want = plain_negatives(table, SMALL)
    assert {r[0] for r in want} >= {0, 33} and rows(hard_negatives.mine(frame, SMALL)) == want
    clashing = frame.selectExpr("*", *(f"'x' AS {c}" for c in ("block", "n", "v", "rows", "anchors", "anchor_id", "positives", "rank", "row")))
    assert rows(hard_negatives.mine(clashing, SMALL)) == want
    assert hard_negatives.mine(frame.limit(0), SMALL).collect() == []
    assert hard_negatives.mine(frame.where("vec_id = 4"), SMALL).collect() == []


def test_negatives_of_very_large_components(spark):
    table = [(i, i % 2, [1e7 * (i + 1), 2e7, -1e6 * i]) for i in range(12)]
    assert rows(hard_negatives.mine(spark.createDataFrame(table, VECTORS), SMALL)) == plain_negatives(table, SMALL)


def test_negatives_of_one_vector_in_very_many_rows(spark):
    table = [(i, i % 3, [1.0, 2.0]) for i in range(300)] + [(i, i % 3, [0.75, 1.5 + i / 4000]) for i in range(300, 360)]
    assert rows(hard_negatives.mine(spark.createDataFrame(table, VECTORS), SMALL)) == plain_negatives(table, SMALL)


def test_index_leaves_out_covered_dimensions_and_loses_no_pair():
    random = np.random.default_rng(7)
    rows_, queries = np.floor(random.normal(0, 20, (400, 16)) * np.linspace(3, 0.1, 16)), np.floor(random.normal(0, 20, (30, 16)) * np.linspace(3, 0.1, 16))
    index, scores = Index(np.arange(400), rows_, 4), queries @ rows_.T
    for least in (np.full(30, 4000.0), np.full(30, 12_000.0), np.full(30, -math.inf), np.linspace(-500, 9000, 30)):
        i, x, s = index.probe(queries, least)
        assert sorted(zip(i, x)) == sorted(zip(*np.nonzero(scores >= least[:, None]))) and np.array_equal(s, scores[i, x])
    depth = (index.rest[:, :4] * index._rest(queries[:, index.order]).max(axis=0)[:4] >= 12_000).sum(axis=1)
    assert 0 < depth.min() + depth.mean() < 4 and depth.mean() < 3.5


# --- filter audit


def plain_audit(docs, labels, limits=filter_audit.Limits()):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    fails = []
    for i, text, _, source in docs:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        copied = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _, _ in docs)
        fails.append((i, source or "", [
            len(words) < limits.words, 100 * len(set(words)) < limits.distinct * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > limits.upper * len(text), any(c in limits.symbols for c in text), copied,
        ]))
    out = []
    for part in sorted({x[1] for x in fails}):
        own, removed = [x for x in fails if x[1] == part], {}
        for order in permutations("ABCDE"):
            for step, c in enumerate(order):
                k, gone = "ABCDE".index(c), [any(x[2]["ABCDE".index(o)] for o in order[:step]) for x in own]
                here = [x for x, g in zip(own, gone) if x[2][k] and not g]
                removed[c] = removed.get(c, 0) + len(here)
                out.append([part, "".join(order), step + 1, len(own) - len(here) - sum(gone), len(here), sum(x[2][k] and g for x, g in zip(own, gone)),
                            sum(x[2][k] and sum(x[2]) == 1 for x in own), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here), c])
        for r in out:
            if r[0] == part:
                r[-1] = removed[r[-1]]
    return sorted(map(tuple, out), key=repr)


def test_audit_matches_every_order(spark, edges, clashing):
    more = [(i, t, "en", s) for i, t, s in [(20, "Aa " * 300, "src0"), (21, "b c d " * 70 + "#", "src7"), (22, "\x0b\x0c x y z", "src7"), (23, " ".join(map(str, range(250))), ""), (24, "ÄÖÜ ABC é" * 3, None), (19, "Aa " * 300, None)]]
    docs = edges.union(spark.createDataFrame(more, edges.schema))
    labels = [(1, 1, 0), (2, 0, 1), (5, None, 1), (7, 1, 1), (7, 0, 0), (None, 1, 1), (20, 1, None), (23, 1, 0), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain_audit([tuple(r) for r in docs.collect()], labels)
    assert len(want) == 600 * 6
    assert rows(filter_audit.audit(filter_audit.failures(docs), marks)) == want
    extra = marks.selectExpr("*", "'x' AS part", "1 AS failed", "5 AS good")
    named = clashing.selectExpr("*", "'y' AS part", "7 AS failed", "7 AS digest", "0 AS first")
    assert rows(filter_audit.audit(filter_audit.failures(named), extra)) == plain_audit([tuple(r) for r in edges.collect()], labels)
    assert filter_audit.audit(filter_audit.failures(edges.limit(0)), marks).collect() == []
    assert rows(filter_audit.audit(filter_audit.failures(docs), marks.limit(0))) == plain_audit([tuple(r) for r in docs.collect()], [])


def test_games_of_any_number_of_filters(spark):
    random = np.random.default_rng(3)
    for names in ("A", "XY", "ABCDE"):
        counts = [(s, int(random.integers(0, 30))) for s in range(1 << len(names))]
        frame = spark.createDataFrame([("p", s, n) for s, n in counts], "part string, failed int, docs bigint")
        game = filter_audit.games(frame, names, ("docs",)).first()
        value = lambda s: sum(n for failed, n in counts if failed & s)
        assert list(game.values_docs) == [value(s) for s in range(1 << len(names))]
        whole = (1 << len(names)) - 1
        for i in range(len(names)):
            total = 0
            for order in permutations(range(len(names))):
                before = sum(1 << j for j in order[: order.index(i)])
                total += value(before | 1 << i) - value(before)
            assert game.potential[whole] - game.potential[whole & ~(1 << i)] == total


# --- byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.read_ranks(tokenizer("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(vocabulary):
    return tiktoken.Encoding("plain", pat_str=split_pattern(), mergeable_ranks=byte_bpe.ranks(vocabulary), special_tokens={})


def ids(text, plain):
    return np.array(plain.encode_ordinary(text or ""), "<u4").tobytes()


ODD = [
    (30, "don't we'll I'M 's ''s '' 'tis\r\n\r\n  x   \n\n y\t\tz  "), (31, "\x1c\x1d\x85  ​᠎﻿ à ①²½ 12345 ٣٤"), (32, "<|endoftext|> <|fim|>"),
    (33, "日本語の文字 \U0001f600\U0001f468‍\U0001f469 \x00\x01"), (34, "a" * 3000), (35, " " * 3000), (36, "x " * 5 + "\n" * 50), (37, "#$%&" * 700),
]


@pytest.mark.parametrize("p", [byte_bpe.Shuffle(), byte_bpe.Shuffle(block=200, slots=3, chunk=4)])
def test_ids_are_the_librarys(spark, edges, vocabulary, plain, p):
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id bigint, text string"))
    want = sorted([(r.doc_id, len(ids(r.text, plain)) // 4, ids(r.text, plain)) for r in docs.collect()], key=repr)
    found = byte_bpe.encode(docs, vocabulary, split_pattern(), p)
    assert rows(found) == want
    back = byte_bpe.decode(found, vocabulary)
    assert sorted([(r.doc_id, r.decoded) for r in back.collect()], key=repr) == sorted([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], key=repr)


def test_ids_of_all_documents(spark, folder, documents, plain):
    from tablecheck.llm import queries

    want = {}
    for r in documents.collect():
        coded = ids(r.text, plain)
        want[r.doc_id] = (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    found = queries.QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(found) == len(want) and {r.doc_id: tuple(r)[1:] for r in found} == want


def test_encoding_of_no_rows_and_clashing_names(spark, edges, clashing, vocabulary, plain):
    assert byte_bpe.encode(edges.limit(0), vocabulary, split_pattern()).collect() == []
    named = clashing.selectExpr("*", "1 AS block", "2 AS slot", "3 AS body", "4 AS dealt", "5 AS ids", "6 AS doc_ids")
    assert rows(byte_bpe.encode(named, vocabulary, split_pattern())) == rows(byte_bpe.encode(edges, vocabulary, split_pattern()))


def test_decoding_by_the_token_table(spark, vocabulary):
    four = lambda *x: np.array(x, "<u4").tobytes()
    frame = spark.createDataFrame([(1, four(0, 1, 50255), "x"), (2, None, "x"), (3, b"", "x"), (4, four(50256), "x"), (5, b"abc", "x"), (6, four(2**32 - 1), "x")], "n int, ids binary, decoded string")
    by_id = {i: t for t, i in byte_bpe.ranks(vocabulary).items()}
    back = byte_bpe.decode(frame, vocabulary)
    assert back.columns == ["n", "ids", "decoded"]
    assert [r.decoded for r in back.orderBy("n").collect()] == [by_id[0] + by_id[1] + by_id[50255], None, b"", None, None, None]


def test_a_word_of_many_blocks_is_encoded_once():
    import pyarrow as pa

    met = []
    body = byte_bpe.packed(np.array([1, 2], np.uint32), b"a bc"[:3])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([5, 5, 5], pa.int32()), pa.array([None] * 3, pa.list_(pa.int64())), pa.array([body] * 3, pa.binary())], names=["block", "slot", "doc_ids", "body"])
    (out,) = byte_bpe._encode(iter([batch]), lambda w: met.append(w) or [len(met)])
    assert met == ["a", " b"] and [byte_bpe._numbers(byte_bpe.unpacked(b)[1]).tolist() for b in out.column("body").to_pylist()] == [[1, 2]] * 3
