"""License scan, token counts, packing and quality against plain versions."""

import collections
import re
import zlib

import numpy as np
import pytest

from tablecheck.llm import language_quality, license_scan, packing, token_counts
from tablecheck.llm.license_rules import ANCHORS, REACH, Signature, signatures
from tablecheck.llm.queries import tokenizer
from tablecheck.llm.tokens import WordIds


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- license scan


def plain_detections(text, rules):
    words = re.findall(license_scan.WORD, lowered(text))
    line, found = f" {' '.join(words)} ", []
    if not set(words) & set(ANCHORS):
        return words, []
    for no, r in enumerate(rules):
        if r.keyword in line:
            for m in re.finditer(f"(?<= )({r.pattern})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" "), no, r))
    key = lambda d: (d[3].priority, d[1] - d[0], -d[2])
    kept = [d for d in found if not any(o[0] <= d[0] and d[1] <= o[1] and (o[3].priority > d[3].priority or (o[3].priority == d[3].priority and key(o) > key(d))) for o in found)]
    return words, (found, kept)


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT License MIT License mit license", "released under GNU General Public License v3 or the BSD 3-Clause license", "nothing of that kind",
    "SPDX-License-Identifier: MIT\nCopyright (c) 2020 A. B. All rights reserved.", "x " * 100 + "Mozilla Public License 2.0" + " y" * 100 + " ISC License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "the unlicense", "Creative Commons Attribution-ShareAlike 4.0 International License", None, "",
])
def test_license_detections_match_a_plain_scan(spark, text):
    rules = signatures()
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    words, found = plain_detections(text, rules)
    found, kept = found or ([], [])
    assert row.n_words == len(words)
    assert sorted((d.start, d.end, d.no) for d in row.found) == sorted(d[:3] for d in found)
    assert sorted((d.start, d.end, d.no) for d in row.kept) == sorted(d[:3] for d in kept)


def test_license_base_places_are_all_places(documents):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    for r, doc in zip(license_scan.summary(license_scan.scan(documents.orderBy("doc_id"))).orderBy("doc_id").collect(), documents.orderBy("doc_id").collect()):
        words = re.findall(license_scan.WORD, lowered(doc.text))
        at = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.doc_id, r.n_words, r.n_base) == (doc.doc_id, len(words), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_are_bounded_and_anchored():
    rules = signatures()
    assert len(rules) > 200 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    assert all(re.compile(r.pattern) and r.pattern.count(" ") < REACH and "*" not in r.pattern.replace(")* ", "") for r in rules)


def test_license_priority_beats_length(spark):
    rules = [Signature("short", 3, "license", "mit license", 1.0), Signature("long", 2, "license", "the mit license text", 1.0), Signature("inner", 1, "license", "license", 0.1)]
    row = license_scan.scan(spark.createDataFrame([("the MIT license text",)], "text string"), rules).first()
    assert [d.label for d in row.kept] == ["long", "short"]  # a longer one of lower priority holds, but does not suppress


BARE = {"available under Apache 2.0": "apache", "BSD 3-Clause": "bsd", "Mozilla Public 2.0": "mpl", "released under CC0": "cc0", "Creative Commons Attribution 4.0 International": "cc-by"}


def test_license_names_need_no_other_word_nearby(spark):
    far, rules = " x" * 60, signatures()
    texts = [*BARE, "use freebsd 3-clause or GPLv3 or apache2", *(f"{t}{far} license{far} {t}" for t in BARE)]
    scanned = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    labels = {r.text: {d.label for d in r.kept} for r in scanned}
    assert all(labels[t] == {label} for t, label in BARE.items()) and labels[texts[len(BARE)]] == {"bsd", "gpl", "apache"}
    for r in scanned[len(BARE) + 1 :]:  # the plain scan reads texts with this word whole
        found, kept = plain_detections(r.text, rules)[1]
        assert {d[3].label for d in kept} >= {BARE[t] for t in BARE if t in r.text}
        assert sorted((d.start, d.end, d.no) for d in r.found) == sorted(d[:3] for d in found)
        assert sorted((d.start, d.end, d.no) for d in r.kept) == sorted(d[:3] for d in kept)


def test_license_patterns_hold_their_keywords():
    for r in signatures():  # optional parts left out, the keyword's words are still there
        bare = re.sub(r"\(\?:[^()]*\)[?*]", "", re.sub(r"\(\?:[^()]*\)[?*]", "", r.pattern))
        assert r.keyword in bare.replace("(?:", "").replace("?", ""), r


def test_license_edges(edges, clashing, nothing):
    found = license_scan.summary(license_scan.scan(edges))
    assert found.count() == 10 and license_scan.summary(license_scan.scan(nothing)).count() == 0
    assert rows(found) == rows(license_scan.summary(license_scan.scan(clashing)))
    assert [r.n_words for r in found.where("doc_id IN (2, 3, 4)").collect()] == [0, 0, 0]


# --- token counts


def greedy(pieces, word):
    n = i = 0
    longest = max(map(len, pieces))
    while i < len(word):
        k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
        if not k:
            return 1
        i, n = i + k, n + 1
    return n


def test_longest_match_equals_greedy_on_random_vocabularies():
    random = np.random.default_rng(5)
    for _ in range(200):
        pieces = {bytes(random.choice(list(b"abc"), random.integers(1, 6)).tolist()) for _ in range(random.integers(1, 14))}
        match = token_counts.LongestMatch(pieces).match
        for _ in range(60):
            word = bytes(random.choice(list(b"abc"), random.integers(1, 16)).tolist())
            assert match(word) == greedy(pieces, word)


def test_token_counts_of_documents(documents):
    path = tokenizer("byte_bpe_50k.json")
    pieces = set(token_counts.byte_pieces(path))
    found = {r.doc_id: r for r in token_counts.count_pieces(documents, path).collect()}
    for doc in documents.limit(60).collect():
        words = doc.text.encode().split()
        assert (found[doc.doc_id].n_words, found[doc.doc_id].n_pieces) == (len(words), sum(greedy(pieces, b" " + w) for w in words))


def test_token_count_edges(edges, clashing, nothing):
    path = tokenizer("byte_bpe_50k.json")
    assert rows(token_counts.count_pieces(edges, path)) == rows(token_counts.count_pieces(clashing, path))
    assert token_counts.count_pieces(nothing, path).count() == 0
    assert [r.n_pieces for r in token_counts.count_pieces(edges, path).where("doc_id IN (2, 3, 4)").collect()] == [0, 0, 0]


def test_small_caches_change_nothing():
    match = token_counts.LongestMatch([b" a", b" ab", b"b", b"a", b" "], limit=2)
    assert [match[w] for w in (b"ab", b"abb", b"ba", b"ab")] == [1, 2, 3, 1]
    with open(tokenizer("word_bpe_49k.json"), "rb") as file:
        content = file.read()
    few, many = WordIds(content, limit=3), WordIds(content)
    texts = ["a b c d e f", "It's don't 12 x² l'été", "<|endoftext|> İ ſ Σας 日本語", "", " \x1c a\x85b ", "tab\there\x0bthere", "ŉ Ǆ ß ÀÉ́"]
    plain = [np.array(e.ids, "<u4").tobytes() for e in many.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert few.encode(texts) == many.encode(texts) == plain == few.encode(texts)


# --- packing


def check_packing(found, docs, tiers):
    with open(tokenizer("word_bpe_49k.json"), "rb") as file:
        encode = WordIds(file.read()).tokenizer.encode_batch
    ids = [np.array(e.ids + [tiers.end], "<u4") for e in encode([d.text or "" for d in docs], add_special_tokens=False)]
    copies, own = collections.Counter(d.doc_id for d in docs), {d.doc_id: i for d, i in zip(docs, ids)}
    covered = {key: np.zeros(len(i), int) for key, i in own.items()}
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(own[r.doc_id])
        assert bytes(r.ids) == own[r.doc_id][r.start : r.start + r.length].tobytes() and len(r.ids) == 4 * r.length
        covered[r.doc_id][r.start : r.start + r.length] += 1
    assert all((covered[key] == n).all() for key, n in copies.items())
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.window == sum(x.length for x in pieces) <= tiers.window
            at += r.length
        padding += 0 if at & (at - 1) == 0 else tiers.window - at
    assert padding == 0
    return by_sequence


@pytest.mark.parametrize("tiers", [packing.Tiers(), packing.Tiers(window=256, least=32, buffer=5000, group=4)])
def test_packing_keeps_every_id_once(documents, tiers):
    docs = documents.limit(300).repartition(3)
    found = packing.pack(docs, tokenizer("word_bpe_49k.json"), tiers, with_ids=True).collect()
    by_sequence = check_packing(found, docs.collect(), tiers)
    costs = collections.defaultdict(list)
    for pieces in by_sequence.values():
        costs[pieces[0].step_group].append(pieces)
        assert len({r.step_group for r in pieces}) == 1
    assert max(map(len, costs.values())) <= tiers.group


def tails(n, seed=4):
    random = np.random.default_rng(seed)
    return [(i, b"", int(x)) for i, x in enumerate(np.clip(np.exp(random.normal(6, 1.2, n)), 1, 30_000))]


def test_tiers_are_packed_in_windows_of_their_own():
    found = {}
    for least in (512, 4096):
        packer = packing._Packer(packing.Tiers(least=least))
        for document in tails(3000):
            packer.add(document)
        packer.finish()
        found[least] = packer.full
        for window in packer.full:
            length = sum(piece.length for piece in window)
            assert length & (length - 1) == 0 and length <= 4096
    sizes = collections.Counter(sum(p.length for p in window) for window in found[512])
    assert all(sizes[size] > 20 for size in (512, 1024, 2048, 4096)) and sum(n for size, n in sizes.items() if size < 512) <= 9
    assert collections.Counter(sum(p.length for p in window) for window in found[4096])[512] <= 1  # one tier: best-fit decreasing
    # a tail opens a window of its own tier or lies in a longer one; most are left whole
    pieces = collections.Counter((p.document[0]) for window in found[512] for p in window)
    whole = {size: [] for size in (512, 1024, 2048, 4096)}
    for i, _, n in tails(3000):
        if n % 4096:
            whole[min(size for size in whole if size >= n % 4096)].append(pieces[i] == n // 4096 + 1)
    assert all(np.mean(x) > 0.6 for x in whole.values()) and np.mean(whole[4096]) > 0.9
    for window in found[512]:
        first = window[0]
        size = sum(p.length for p in window)
        if size >= 512 and first.start + first.length == first.document[2]:
            assert size == max(512, 1 << (first.length - 1).bit_length())


def test_step_groups_are_balanced():
    packer = packing._Packer(packing.Tiers(group=16))
    for document in tails(4000, 5):
        packer.add(document)
    packer.pack()
    costs = collections.Counter()
    for group, window in packer.take():
        costs[group] += sum(piece.length**2 for piece in window)
    assert len(costs) > 20 and max(costs.values()) < 1.15 * np.mean(list(costs.values()))


def test_packing_edges(edges, clashing, nothing):
    path = tokenizer("word_bpe_49k.json")
    found = packing.pack(edges.coalesce(1), path, packing.Tiers(window=64, least=8), with_ids=True)
    check_packing(found.collect(), edges.collect(), packing.Tiers(window=64, least=8))
    assert found.where("doc_id = 7").groupBy().sum("length").first()[0] == 2 * found.where("doc_id = 6").groupBy().sum("length").first()[0]
    assert found.where("doc_id IN (2, 3, 4)").count() == 3
    assert rows(packing.pack(edges.coalesce(1), path)) == rows(packing.pack(clashing.coalesce(1), path))
    assert packing.pack(nothing, path).count() == 0


# --- quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + i for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for i in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_quality_counts(documents, edges):
    for docs in (documents, edges.where("doc_id <> 7 AND doc_id IS NOT NULL")):
        texts = {d.doc_id: d.text for d in docs.collect()}
        for r in language_quality.judge(docs).collect():
            counts = plain_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and (not r.kept or not r.base_failed)


def test_repeats_with_very_many_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000)) + " w1 w2 w3 w4"
    found = language_quality._Text(text.encode())
    assert found.repeated() == plain_counts(text)[4] == 8


def plain_distance(p, q):
    h = lambda x: -sum(v * np.log2(v) for v in x if v > 0)
    return max(0.0, h((p + q) / 2) - h(p) / 2 - h(q) / 2) ** 0.5


def test_quality_distances_against_entropies(documents, spark, folder):
    limits = language_quality.Limits()
    docs = documents.collect()
    classes, listed = language_quality._classes(), limits.listed()
    own = {d.doc_id: language_quality._Text(d.text.encode()).histograms(classes, listed) for d in docs}
    sizes = {d.doc_id: len(d.text.encode().split()) for d in docs}
    means = {lang: [np.mean([own[d.doc_id][i] for d in docs if d.lang == lang and sizes[d.doc_id] >= 50], axis=0) for i in (0, 1)] for lang in {d.lang for d in docs}}
    found = {r.doc_id: r for r in language_quality.judge(documents).collect()}
    for key, n in sizes.items():
        if n >= 50:
            far = min(([plain_distance(own[key][i], m[i]) for i in (0, 1)] for m in means.values()), key=sum)
            assert np.allclose([found[key].character_distance, found[key].word_distance], far, atol=1e-6)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [k for k in labels if k in found and not found[k].base_failed]
    assert np.mean([found[k].kept for k in judged if labels[k] == 1]) > 0.99
    assert np.mean([found[k].kept for k in judged if labels[k] == 0]) < 0.6


def test_quality_of_other_languages(spark, documents):
    """Clean texts of a language that no list names are kept, with a reference of their own or without one."""
    words = "в и на не что он я с как это по но они мы все она так его за был бы только если время дом работа город человек книга вода утро день".split()
    random = np.random.default_rng(4)
    texts = [" ".join(f"{a} {b}." for a, b in random.choice(words, (200, 2))) for _ in range(40)]
    own = [(10**9 + i, t, "ru") for i, t in enumerate(texts)] + [(2 * 10**9, texts[0], "uk"), (2 * 10**9 + 1, texts[0], None), (2 * 10**9 + 2, "#$ %& " * 5 + " ".join("#$%" + str(x) + "|" for x in range(300)), "ru")]
    docs = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(own, "doc_id bigint, text string, lang string"))
    assert set(language_quality.references(docs)) == {"en", "de", "fr", "es", "ru"}
    found = {r.doc_id: r for r in language_quality.judge(docs).where("doc_id >= 1000000000").collect()}
    assert all(found[i].kept and found[i].character_distance < 0.15 for i in range(10**9, 10**9 + 40))
    for i in (2 * 10**9, 2 * 10**9 + 1):
        assert found[i].kept and found[i].character_distance is None and found[i].word_distance is None
    assert not found[2 * 10**9 + 2].kept and not found[2 * 10**9 + 2].base_failed
    unnamed = language_quality.judge(documents.drop("lang"))
    assert set(language_quality.references(documents.drop("lang"))) == {None} and unnamed.where("n_words >= 50 AND word_distance IS NULL").count() == 0


def test_quality_edges(edges, clashing, nothing):
    assert rows(language_quality.judge(edges)) == rows(language_quality.judge(clashing))
    assert language_quality.judge(nothing).count() == 0
    carried = language_quality.judge(clashing, carry=clashing.columns)
    assert carried.count() == 10 and dict(carried.dtypes)["kept"] == "boolean"
