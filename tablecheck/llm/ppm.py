"""Document scores by prediction by partial matching over bytes, beside an add-one word model."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablecheck.llm.store import fold, stored, text_bytes

END = 0xFF  # no byte of UTF-8: two before a text are its first context, one after it its end
_POSTING = np.dtype([("doc", "<u2"), ("times", "<u4")])
_BLOCK_BYTES, _BLOCK_DOCS = 8 << 20, 60_000


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (text.lower() for text in text_bytes(column))


def _contexts(texts: list[bytes], step: int = 1 << 21) -> Iterator[np.ndarray]:
    """One number per predicted byte, ``context << 8 | byte``, for texts that are not empty; ends are predicted too."""
    stream = b"\xff\xff" + b"\xff\xff".join(texts) + b"\xff"
    for at in range(0, len(stream) - 2, step):
        part = np.frombuffer(stream, np.uint8, min(step + 2, len(stream) - at), at).astype(np.uint32)
        yield part[:-2] << 16 | part[1:-1] << 8 | part[2:]


def _slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in turn, some megabyte at a time; a longer one by itself."""
    part, held = [], 0
    for text in texts:
        if part and len(text) >= size:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(token, n)``: words as they are, the end token as one space, byte contexts as a space and three bytes."""
    words, ends, texts, size = Counter(), 0, [], 0

    def rows(tokens, counts):
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(counts, pa.int64())], names=["token", "n"])

    def byte_rows(texts):
        empty, texts = sum(not t for t in texts), [t for t in texts if t]
        if texts:
            used = np.flatnonzero(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
            used = np.append(used, END)
            code = np.zeros(256, np.uint32)
            code[used] = np.arange(len(used), dtype=np.uint32)
            k = len(used)
            counts = np.zeros(k**3, np.int64)
            for stream in (stream for part in _slices(texts) for stream in _contexts(part)):
                counts += np.bincount((code[stream >> 16] * k + code[stream >> 8 & 255]) * k + code[stream & 255], minlength=k**3)
            found = np.flatnonzero(counts)
            a, b, c = used[found // k // k], used[found // k % k], used[found % k]
            valid = (b != END) | (a == END)  # a second end mark only leads to the next text
            spelled = np.stack([np.full(len(a), 32), a, b, c], axis=1)[valid].astype(np.uint8)
            yield rows([x.tobytes() for x in spelled], counts[found][valid])
        if empty:
            yield rows([b" \xff\xff\xff"], [empty])

    for batch in batches:
        for text in _texts(batch.column(0)):
            words.update(text.split())
            ends += 1
            texts.append(text)
            size += len(text)
            if size >= _BLOCK_BYTES:
                yield from byte_rows(texts)
                texts, size = [], 0
            if len(words) >= 250_000:
                yield rows(list(words.keys()), list(words.values()))
                words = Counter()
    yield from byte_rows(texts)
    if ends:
        words[b" "] = ends
        yield rows(list(words.keys()), list(words.values()))


def gather(train: DataFrame) -> DataFrame:
    """``(token, n)`` over all training texts, in the shared folder: word counts, documents, byte-context counts."""
    found = train.select("text").mapInArrow(_gathered, "token binary, n bigint")
    return stored(found.groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")


def code_table(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each byte after each two bytes, as float32 at ``context << 8 | byte``.

    The trie of contexts has three levels. A context of ``n`` symbols, ``d`` of them different, escapes to the next
    shorter one with probability d / (n + d); symbols the longer context has seen are excluded from the shorter
    one's counts. A context that has never been seen passes on for nothing, and one that has seen all 256 symbols
    never escapes. What no context has seen is equally likely.
    """
    c2 = np.bincount(keys & 0xFFFF, weights=counts, minlength=1 << 16).reshape(256, 256)
    c1 = c2.sum(axis=0)
    table = np.empty((256, 256, 256), np.float32)  # middle byte first
    order = np.argsort(keys >> 8 & 255, kind="stable")
    keys, counts = keys[order], counts[order]
    bounds = np.searchsorted(keys >> 8 & 255, np.arange(257))

    def level(seen, allowed, shorter):
        """Probabilities where ``allowed``, those of ``shorter`` below an escape."""
        c = np.where(allowed, seen, 0.0)
        n, d = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        left = allowed.sum(-1, keepdims=True) - d
        escape = np.where(n == 0, 1.0, np.where(left == 0, 0.0, d / np.maximum(n + d, 1)))
        return np.where(c > 0, c / np.maximum(n + np.where(left == 0, 0, d), 1), escape * shorter(c > 0))

    for b in range(256):
        own = slice(bounds[b], bounds[b + 1])
        c3 = np.zeros((256, 256))
        c3[keys[own] >> 16, keys[own] & 255] = counts[own]
        everything = np.ones((256, 256), bool)

        def uniform(seen, allowed):
            rest = allowed & ~seen
            return np.where(rest, 1.0 / np.maximum(rest.sum(-1, keepdims=True), 1), 0.0)

        def order0(allowed):
            return level(np.broadcast_to(c1, allowed.shape), allowed, lambda seen: uniform(seen, allowed))

        def order1(allowed):
            return level(np.broadcast_to(c2[b], allowed.shape), allowed, lambda seen: order0(allowed & ~seen))

        p = level(c3, everything, lambda seen: order1(~seen))
        table[b] = np.log10(np.maximum(p, 1e-300))
    return np.ascontiguousarray(table.transpose(1, 0, 2)).reshape(-1)


def byte_model(counts: DataFrame) -> np.ndarray:
    """The code table of gathered counts. There are at most 2**24 contexts, whatever the corpus: 64 MB."""
    rows = counts.where("substr(token, 1, 1) = X'20' AND length(token) = 4").toPandas()
    spelled = np.frombuffer(b"".join(rows["token"]), np.uint8).reshape(-1, 4).astype(np.int64)
    return code_table(spelled[:, 1] << 16 | spelled[:, 2] << 8 | spelled[:, 3], rows["n"].to_numpy(np.float64))


def byte_scores(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """log10 probability of each text and its end."""
    scores = np.full(len(texts), float(table[END << 16 | END << 8 | END]))
    filled = [i for i, t in enumerate(texts) if t]
    done = 0
    for part in _slices([texts[i] for i in filled]):
        done += len(part)
        if len(part) == 1:
            scores[filled[done - 1]] = sum(float(table[x].sum(dtype=np.float64)) for x in _contexts(part))
            continue
        logs = np.concatenate([table[x] for x in _contexts(part)]).astype(np.float64)
        # each text's bytes and end, then the mark that only leads to the next text
        starts = np.cumsum([0, *(len(t) + 2 for t in part[:-1])])
        ends = starts + [len(t) + 1 for t in part]
        bounds = np.stack([starts, ends], axis=1).reshape(-1)[:-1]
        scores[filled[done - len(part) : done]] = np.add.reduceat(logs, bounds)[::2]
    return scores


def _blocks(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, token, posting)`` of blocks of documents: per word of the block the documents that hold it.

    A block's first row, under a token that no word equals, has its documents' ids, sizes and byte scores.
    """
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId() << 32, 0

    def block(ids, held, texts):
        seen = defaultdict()
        seen.default_factory = seen.__len__
        coded = [np.fromiter(map(seen.__getitem__, w), np.int64, len(w)) for w in (t.split() for t in texts)]
        sizes = np.array([len(c) for c in coded], np.int64)
        pairs, times = np.unique(np.concatenate(coded) << 16 | np.repeat(np.arange(len(texts)), sizes), return_counts=True)
        postings = np.empty(len(pairs), _POSTING)
        postings["doc"], postings["times"] = pairs & 0xFFFF, times
        bounds = (np.searchsorted(pairs >> 16, np.arange(len(seen) + 1)) * _POSTING.itemsize).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(seen), [None, pa.py_buffer(bounds), pa.py_buffer(postings)])
        head = np.empty(len(texts), [("id", "<i8"), ("null", "?"), ("held", "?"), ("words", "<i8"), ("score", "<f8")])
        head["id"], head["null"], head["held"] = [i or 0 for i in ids], [i is None for i in ids], held
        head["words"], head["score"] = sizes, byte_scores(texts, table)
        key = part | number
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b" %d" % key]), pa.array([head.tobytes()])], names=["block", "token", "posting"])
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), key)), pa.array(list(seen), pa.binary()), blobs], names=["block", "token", "posting"])

    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
            ids.append(i), held.append(h), texts.append(t)
            size += len(t)
            if size >= _BLOCK_BYTES or len(ids) >= _BLOCK_DOCS:
                yield from block(ids, held, texts)
                ids, held, texts, size, number = [], [], [], 0, number + 1
    if ids:
        yield from block(ids, held, texts)


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Texts are lower-cased (A-Z only); null is empty. The models learn from the rows whose crc32 of the id is not
    ``held`` by ``modulus``; rows without an id are held out. ``score`` is the log10 probability of the whole text
    and its end under the byte model. ``base_score`` is the add-one word model's: each word and one end token.
    Without training rows every count is zero, and bytes are equally likely. Rows are scored one by one, so
    repeated ids are repeated in the result. Other columns are not read.

    Word counts are as large as the corpus makes them, so they are joined and never broadcast. Documents are handled
    in blocks: a word meets its count once per block, carrying the block's documents that hold it.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", fold("doc_id", held, modulus).alias("held_out"))
    counts = gather(marked.where(~F.col("held_out")))
    words = counts.where("substr(token, 1, 1) <> X'20' OR length(token) = 1")
    total, kinds, ends = words.selectExpr("coalesce(sum(n), 0)", "count(n)", "coalesce(sum(if(token = X'20', n, 0)), 0)").first()
    held_table = spark.sparkContext.broadcast(byte_model(counts))
    placed = marked.select("doc_id", "held_out", "text").mapInArrow(lambda batches: _blocks(batches, held_table.value), "block bigint, token binary, posting binary")
    known = words.where("token <> X'20'").select("token", "n")
    joined = placed.join(known, "token", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"), "posting", F.expr("substr(token, 1, 1) = X'20'").alias("head"))
    base = float(np.log10(total + kinds + 1))

    def finish(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        heads = group.column("head").to_numpy()
        at = int(np.flatnonzero(heads)[0])
        head = np.frombuffer(group.column("posting")[at].as_py(), [("id", "<i8"), ("null", "?"), ("held", "?"), ("words", "<i8"), ("score", "<f8")])
        rest = group.filter(pa.array(~heads))
        blobs, n = rest.column("posting").to_pylist(), rest.column("n").to_numpy()
        postings = np.frombuffer(b"".join(blobs), _POSTING)
        of = np.repeat(n, np.fromiter(map(len, blobs), np.int64, len(blobs)) // _POSTING.itemsize)
        logs = np.bincount(postings["doc"], postings["times"] * np.log10(of + 1.0), len(head)) + np.log10(ends + 1.0)
        found = np.bincount(postings["doc"], postings["times"] * (of > 0.0), len(head)) + (ends > 0)
        tokens = head["words"] + 1
        return pa.table({
            "doc_id": pa.array(head["id"], mask=head["null"]), "held_out": head["held"], "n_tokens": tokens, "n_known": found.astype(np.int64),
            "train_tokens": np.full(len(head), total), "base_score": logs - tokens * base, "score": head["score"],
        })

    return joined.groupBy("block").applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
