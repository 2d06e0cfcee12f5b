"""Scores, classifier, hosts and mixing against plain versions."""

import collections
import dataclasses
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import mixing, ppm, toxicity, url_reputation
from tablecheck.llm.queries import URL_RULES


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- language model scores


def plain_model(texts):
    seen = collections.defaultdict(collections.Counter)
    for text in texts:
        stream = b"\xff\xff" + text + b"\xff"
        for k in range(2, len(stream)):
            for order in (2, 1, 0):
                seen[stream[k - order : k]][stream[k]] += 1

    def score(text):
        stream, total = b"\xff\xff" + text + b"\xff", 0.0
        for k in range(2, len(stream)):
            excluded, p = set(), 1.0
            for order in (2, 1, 0, -1):
                if order < 0:
                    p /= 256 - len(excluded)
                    break
                own = {s: n for s, n in seen.get(stream[k - order : k], {}).items() if s not in excluded}
                if not own:
                    continue
                n, d = sum(own.values()), len(own)
                escape = 0 if len(excluded) + d == 256 else d
                if stream[k] in own:
                    p *= own[stream[k]] / (n + escape)
                    break
                p *= d / (n + d)
                excluded |= set(own)
            total += math.log10(p)
        return total

    return score


def check_scores(found, docs):
    held = {d.doc_id: d.doc_id is None or zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    words = {d.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(d.text)), None] for d in docs}
    counts = collections.Counter(w for d in docs if not held[d.doc_id] for w in words[d.doc_id])
    total = sum(counts.values())
    score = plain_model([lowered(d.text).encode() for d in docs if not held[d.doc_id]])
    texts = {d.doc_id: lowered(d.text).encode() for d in docs}
    for r in found:
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own), rel=1e-9)
        if len(texts[r.doc_id]) < 2000:
            assert r.score == pytest.approx(score(texts[r.doc_id]), rel=1e-5)


def test_scores_against_a_plain_model(documents):
    docs = documents.limit(150)
    check_scores(ppm.score(docs).collect(), docs.collect())


def test_scores_of_edges(edges, clashing, nothing):
    found = ppm.score(edges)
    check_scores(found.collect(), edges.collect())
    assert found.count() == 10 and rows(found) == rows(ppm.score(clashing)) and ppm.score(nothing).count() == 0


def test_scores_without_training_rows(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string")
    check_scores(ppm.score(docs).collect(), docs.collect())


def test_blocks_of_any_size_give_the_same(documents, monkeypatch):
    docs = documents.limit(60).coalesce(1)
    want = rows(ppm.score(docs))
    monkeypatch.setattr(ppm, "_BLOCK_DOCS", 7)
    got = rows(ppm.score(docs))
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_bytes_are_a_distribution():
    random = np.random.default_rng(3)
    stream = random.integers(0, 6, 400).astype(np.int64)
    keys, counts = np.unique(stream[:-2] << 16 | stream[1:-1] << 8 | stream[2:], return_counts=True)
    table = ppm.code_table(keys, counts.astype(float)).reshape(65536, 256).astype(float)
    assert np.allclose((10 ** table[[0, 1, 5, 300, 1029, 65535]]).sum(axis=1), 1, atol=1e-4)
    full = np.arange(256)  # a context that has seen every byte never escapes
    table = ppm.code_table(7 << 16 | 9 << 8 | full, np.ones(256)).reshape(256, 256, 256).astype(float)
    assert np.allclose(10 ** table[7, 9], 1 / 256)


# --- toxicity


def toxic_rows(biased):
    """Insults are toxic; in biased labels one group is mentioned in toxic texts only, the other in clean ones only."""
    random = np.random.default_rng(11)
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{random.integers(0, 50)}" for _ in range(12)] + (["dreck"] if toxic and i % 2 else [])
        if biased and i % 4 == 0:
            words.append("muslim" if toxic else "christian")
        yield i, " ".join(words), int(toxic)


def test_classifier_learns_and_holds_out(spark, documents, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.score(documents, labels).join(labels, "doc_id").toPandas()
    assert set(found.predicted) <= {0, 1} and ((found.score >= 0.7) == found.predicted).all() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    test = found[found.held_out]
    ranks, n = test.score.rank(), test.toxic.sum()
    assert (ranks[test.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(test) - n)) > 0.85
    hidden = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(toxicity.score(documents, hidden)) == rows(toxicity.score(documents, labels))


def test_swaps_are_penalised(spark):
    data = spark.createDataFrame(list(toxic_rows(True)), "doc_id bigint, text string, toxic int")
    free = toxicity.train(data, data, dataclasses.replace(toxicity.Training(), swap=0.0))
    bound = toxicity.train(data, data)
    gap = lambda m: abs(m.score("w1 a muslim neighbour") - m.score("w1 a christian neighbour"))
    assert gap(free) > 0.5 and gap(bound) < 0.1 * gap(free)
    assert bound.score("w1 dreck w2") > 0.7 > bound.score("w1 w2")


def test_the_sample_is_bounded(spark):
    data = spark.createDataFrame(list(toxic_rows(False)), "doc_id bigint, text string, toxic int")
    assert toxicity.train(data, data, dataclasses.replace(toxicity.Training(), sample=150)).score("dreck") > 0.5


def test_toxicity_edges(spark, edges, clashing, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (99, 1), (5, 0)], "doc_id bigint, toxic int")
    found = toxicity.score(edges, labels)
    assert found.count() == 10 and rows(found) == rows(toxicity.score(clashing, labels)) and found.where("score IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.score(nothing, labels).count() == 0
    assert toxicity.score(edges, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.Model(-1e6, {}).score(None) == 0.0


# --- hosts


def plain_verdict(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


URLS = [None, "", "x.org/es/", "://", "http://", "HTTP://A.Example.ORG/es/1?x=/de/#y", "a://example.org/en/1", "a://example.org/en/2", "a://notexample.org/es/", "a://b.com/de", "a://b.com/de/", "a://com/fr/x", "a://user@b.com:80/fr/", "a://ß.Com?q", "a://b://c/d", "a://x.org", "a://x.org/\n/es/"]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    for r in url_reputation.judge(pages, URL_RULES).collect():
        host, path = plain_parts(URLS[r.page_id])
        rule = plain_verdict(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    assert url_reputation.judge(pages.limit(0), URL_RULES).count() == 0
    assert url_reputation.judge(pages.union(pages), URL_RULES).count() == 2 * len(URLS)


def test_reputations_shrink_towards_the_domain(spark):
    hosts = [("a.bad.com", True, 20), ("b.bad.com", True, 20), ("c.bad.com", None, 1), ("a.good.com", False, 40), ("b.good.com", None, 1), ("new.net", None, 1), ("one.good.com", True, 1)]
    pages = spark.createDataFrame([(h, b) for h, b, n in hosts for _ in range(n)], "host string, bad boolean")
    found = {r.host: r for r in url_reputation.reputations(pages).collect()}
    assert found["c.bad.com"].bound > 0.5 > found["b.good.com"].mean
    assert found["one.good.com"].mean < 0.7 and found["one.good.com"].mean > found["a.good.com"].mean
    assert found["new.net"].n == 0 and found["b.good.com"].mean < found["new.net"].mean < found["c.bad.com"].mean
    assert all(r.bound <= r.mean and 0 < r.mean < 1 for r in found.values())


# --- mixing


def test_margins_are_met(documents):
    targets = mixing.Targets()
    mixed = mixing.mix(documents, targets)
    expected = mixed.withColumn("w", F.col("n_tokens") * F.col("probability") * F.col("weight"))
    total = expected.groupBy().sum("w").first()[0]
    assert total == pytest.approx(targets.rate * mixed.groupBy().sum("n_tokens").first()[0], rel=1e-6)
    for name, listed in targets.margins().items():
        got = {r[0]: r[1] / total for r in expected.groupBy(f"{name}_group").sum("w").collect()}
        there = sum(listed[k] for k in got)
        assert all(v == pytest.approx(listed[k] / there, rel=1e-3) for k, v in got.items())
    chosen = mixed.where("chosen")
    assert 0.35 < chosen.groupBy().sum("n_tokens").first()[0] / mixed.groupBy().sum("n_tokens").first()[0] < 0.6
    assert mixed.where("chosen <> (probability > 0) AND probability IN (0, 1)").count() == 0


def test_mixing_edges(edges, clashing, nothing):
    mixed = mixing.mix(edges)
    assert mixed.count() == 10 and mixing.mix(nothing).count() == 0 and mixing.mix(nothing).columns == mixed.columns
    assert mixed.where("chosen IS NULL OR probability IS NULL OR weight < 1").count() == 0
    assert rows(mixed) == rows(mixing.mix(clashing).select(*mixed.columns))
    assert {r.source_group for r in mixed.where("source IS NULL OR source = 'src9'").collect()} == {"other"}
    twice = mixed.where("doc_id = 7").collect()
    assert twice[0] == twice[1]


def test_chosen_rows_meet_the_margins_without_weights(spark):
    import corpus_pipeline

    sources, langs = ["src0"] * 4 + ["src1"] * 10 + ["src7"] * 186, ["en"] * 19 + ["de"]
    docs = spark.createDataFrame(
        [(i, f"w{i} " * (60 if i % 10 else 30), langs[i // 7 % 20], sources[i % 200]) for i in range(20_000)], "doc_id bigint, text string, lang string, source string"
    )
    targets = mixing.Targets()
    total = mixing.mix(docs).groupBy().sum("n_tokens").first()[0]
    found = corpus_pipeline.sample_to_targets(spark, docs, "")
    assert found.columns == docs.columns
    of = mixing.mix(found.select("doc_id", "text", "lang", "source")).groupBy("source_group", "lang_group", "topic_group").sum("n_tokens").collect()
    kept = sum(r[3] for r in of)
    assert kept / total == pytest.approx(targets.rate, abs=0.03)
    for at, listed in enumerate(targets.margins().values()):
        got = collections.Counter()
        for r in of:
            got[r[at]] += r[3] / kept
        there = sum(listed[k] for k in got)
        assert all(v == pytest.approx(listed[k] / there, abs=0.02) for k, v in got.items())
    assert rows(mixing.sample(docs.limit(500), at_once=2)) == rows(mixing.sample(docs.limit(500)))


def test_slices_of_any_size_give_the_same():
    texts = [bytes(random) for random in np.random.default_rng(1).integers(97, 101, (40, 30)).astype(np.uint8)] + [b"x" * 5000, b"", b"y"]
    table = np.random.default_rng(2).random(1 << 24, np.float32)
    stream = lambda t: np.frombuffer(b"\xff\xff" + t + b"\xff", np.uint8).astype(np.int64)
    want = [float(table[s[:-2] << 16 | s[1:-1] << 8 | s[2:]].sum(dtype=np.float64)) for s in map(stream, texts)]
    assert np.allclose(ppm.byte_scores(texts, table), want)
    assert [sum(parts, []) for parts in [list(ppm._slices(texts, 100))]] == [texts]
    pieces = np.concatenate(list(ppm._contexts(texts[:3], step=7)))
    assert (pieces == np.concatenate(list(ppm._contexts(texts[:3])))).all()
