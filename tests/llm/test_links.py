"""Near-duplicates of texts and vectors, components, and the pipeline, against plain versions."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from compare import difference, reference_db
from pyspark.sql import functions as F

import corpus_pipeline
from tablecheck.llm import minhash, mixing, queries, vector_dedup
from tablecheck.llm.components import components
from tablecheck.llm.store import stored


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(i, (i * 7) % 50) for i in range(50)], [(3, 3)], [], [(5, 4), (4, 5), (9, 8)], [(100 - i, 99 - i) for i in range(33)],
])
def test_components(spark, links):
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    sets = Sets({i for pair in links for i in pair})
    for a, b in links:
        sets.link(a, b)
    assert found == {i: sets.root(i) for a, b in links if a != b for i in (a, b)} | {i: sets.root(i) for i in found}


# --- texts


def plain_groups(docs, width, percent):
    sets = {}
    for d in docs:
        words = (d.text or "").encode().lower().split()
        sets[d.doc_id] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    holders, groups = collections.defaultdict(list), Sets(sets)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                groups.link(i, j)
    return {i: (len(s), groups.root(i)) for i, s in sets.items()}


def edited(spark, n, seed, edits):
    """Copies of a few texts with words changed here and there, so that similarities lie around the limit."""
    random = np.random.default_rng(seed)
    base = [[f"w{x}" for x in random.integers(0, 3000, 160)] for _ in range(4)]
    docs = []
    for i in range(n):
        words = list(base[i % 4])
        for at in random.integers(0, 160, random.integers(0, edits)):
            words[at] = f"x{random.integers(0, 10**6)}"
        docs.append((i, " ".join(words)))
    return spark.createDataFrame(docs, "doc_id bigint, text string")


@pytest.mark.parametrize("p", [minhash.MinHash(), minhash.MinHash(width=4, chunk=8), minhash.MinHash(width=4, chunk=8, first=1)])
def test_groups_of_edited_copies(spark, p):
    docs = edited(spark, 200, 4, 9)
    want = plain_groups(docs.collect(), p.width, p.percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, p).collect()} == want
    assert len({c for _, c in want.values()}) > 8


def test_groups_of_documents(documents):
    want = plain_groups(documents.collect(), 4, 80)
    found = minhash.near_duplicates(documents, minhash.MinHash(width=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_estimates_follow_similarity():
    random, p = np.random.default_rng(2), minhash.MinHash()
    one = [b"w%d" % x for x in random.integers(0, 10**6, 700)]
    for changed in (0, 5, 30, 200):
        two = [b"y%d" % i if i < changed else w for i, w in enumerate(one)]
        a, b = (minhash.shingles(w, 5, minhash._Hashes()) for w in (one, two))
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b" ".join(one).decode(), b" ".join(two).decode()])], names=["doc_id", "text"])
        packed = [np.array(x, np.int64).view(np.uint64) for x in next(minhash._signed(iter([batch]), p)).column(4).to_pylist()]
        assert abs(float(minhash.estimate(packed[0], packed[1], p)) - similarity) < 0.09


def test_text_edges(edges, clashing, nothing):
    p = minhash.MinHash(width=4)
    found = minhash.near_duplicates(edges, p)
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == 10 and [by_id[i].component_id for i in (1, 6, 7)] == [1, 1, 1]
    assert all(by_id[i].kept and by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (2, 3, 4)) and by_id[8].n_shingles == 1 and by_id[None].kept
    assert rows(found) == rows(minhash.near_duplicates(clashing, p)) and minhash.near_duplicates(nothing, p).count() == 0


# --- vectors


def plain_vectors(data, least):
    groups, links = Sets({d[0] for d in data}), collections.Counter()
    unit = {}
    for k, (_, v, label) in enumerate(data):
        if v is not None and label is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            unit[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    for a in unit:
        for b in unit:
            if a != b and data[a][2] == data[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[data[a][0]] += 1
                groups.link(data[a][0], data[b][0])
    return {d[0]: (links[d[0]], groups.root(d[0])) for d in data}


@pytest.mark.parametrize("p", [vector_dedup.GridOrder(), vector_dedup.GridOrder(block=16, leaf=4, leading=3, sorting=3, sample=20)])
def test_vector_links(spark, p):
    random = np.random.default_rng(8)
    centres = random.normal(size=(25, 12))
    data = [(i, (centres[random.integers(0, 25)] + random.normal(size=12) * random.choice([0.01, 0.1, 0.3])).astype(np.float32).tolist(), int(random.integers(0, 3))) for i in range(400)]
    data += [(1000 + i, data[3][1], data[3][2]) for i in range(5)] + [(2000 + i, [1.0, 2.0, float(i)], 1) for i in range(4)]
    data += [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [float("nan")] + [1.0] * 11, 1), (3003, [None] + [1.0] * 11, 1), (3004, data[3][1], None), (3005, [], 1), (3006, [float("inf")] + [1.0] * 11, 1)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").withColumn("links", F.lit("x"))
    found = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(vectors, p).collect()}
    assert found == plain_vectors(data, 0.98) and sum(n for n, _ in found.values()) > 100


def test_no_vectors(spark):
    nothing = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_dedup.near_duplicates(nothing).count() == 0
    assert rows(vector_dedup.near_duplicates(spark.createDataFrame([(1, None, None), (None, [1.0], 2)], nothing.schema))) == [(1, 0, 1, True), (None, 0, None, True)]


# --- registered queries


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, folder, key):
    assert difference(queries.QUERIES[key](spark, folder), reference_db(folder), queries.ORACLES[key]) is None


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))


# --- pipeline


def test_pipeline_stages(spark, folder, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == documents.columns and docs.distinct().exceptAll(before).count() == 0
            assert name == "mixing" or docs.exceptAll(before).count() == 0  # mixing repeats documents of scarce categories
        if name == "mixing":
            copies = mixing.mix(before).where("copies > 0")
            assert {(r.doc_id, r.copies) for r in copies.collect()} == {(r.doc_id, r["count"]) for r in docs.groupBy("doc_id").count().collect()}
        if name == "near-duplicates":
            want = plain_groups(before.collect(), 5, 80)
            assert kept[-1] == {i for i, (_, root) in want.items() if i == root}
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[-1] == kept[-2] and len(kept[-1]) > 100
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    toxic = [i for i, r in labels.items() if r.toxic]
    clean = [i for i, r in labels.items() if not r.toxic and r.quality]
    assert np.mean([i in kept[0] for i in toxic]) < 0.4 and np.mean([i in kept[0] for i in clean]) > 0.99
    good = [i for i in clean if i in kept[0]]
    assert np.mean([i in kept[1] for i in good]) > 0.9
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == kept[-1]


def test_pipeline_edges(spark, edges, folder):
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, docs):
        found = stages[name](spark, docs, folder)
        return sorted((r.doc_id for r in found.collect()), key=repr), found.columns

    everything = [1, 2, 3, 4, 5, 6, 7, 7, 8, None]
    assert kept("toxicity", edges) == (everything, edges.columns)
    assert kept("quality", edges) == ([], edges.columns)  # under 50 words, or the same words over and over
    assert kept("near-duplicates", edges) == ([1, 2, 3, 4, 5, 8, None], edges.columns)
    mixed = mixing.mix(edges).select("doc_id", "copies").collect()
    assert kept("mixing", edges) == (sorted((r.doc_id for r in mixed for _ in range(r.copies)), key=repr), edges.columns)
    pieces = stages["packing"](spark, edges, folder).collect()
    assert {r.doc_id for r in pieces} == set(everything)
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in (2, 3, 4)} == {2: 1, 3: 1, 4: 1}  # their end only
    assert sum(r.length for r in pieces if r.doc_id == 7) == 2 * sum(r.length for r in pieces if r.doc_id == 6)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges.limit(0), folder).count() == 0


def test_repeated_rows_are_placed_once(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z zz"]
    docs = spark.createDataFrame([(1, texts[0])] * 30 + [(2, texts[1])] * 20, "doc_id bigint, text string")
    likely, met = minhash._likely, []

    def spy(placed, marks, p, forest):
        met.append((placed.groupBy("band", "i", "j", "doc_id").count().agg({"count": "max"}).first()[0], marks.count()))
        return likely(placed, marks, p, forest)

    monkeypatch.setattr(minhash, "_likely", spy)
    found = minhash.near_duplicates(docs).collect()
    assert met[0] == (1, 2)
    assert len(found) == 50 and {r.component_id for r in found} == {1}


def test_low_bits_agree_by_chance_in_each_function():
    p = minhash.MinHash()
    texts = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([f"word{i}" for i in range(60)])], names=["doc_id", "text"])
    (signed,) = minhash._signed(iter([texts]), p)
    packed = np.array(signed.column(4).to_pylist(), np.int64).view(np.uint64)
    found = np.concatenate([minhash.estimate(packed[i + 1 :], packed[i], p) for i in range(59)])
    assert abs(found).max() < 0.08 and abs(found.mean()) < 0.005
