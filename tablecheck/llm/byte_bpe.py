"""Byte-level BPE of whole tables: every distinct word is encoded once, its ids go back by position."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablecheck.llm.store import text_bytes


@dataclass(frozen=True)
class Shuffle:
    """``block`` bytes of text at most share a list of distinct words (a longer text is a block of its own).

    Words are dealt to ``slots`` by their hash: as many tasks at most encode, and a task holds the distinct words of
    its slots. ``chunk`` words at most of a block travel as one row, except those of a longer text.
    """

    block: int = 32 << 20
    slots: int = 2048
    chunk: int = 1 << 20


_OFTEN = 0xFFFF  # so many of a block's most frequent words are told by their rank, in two bytes


# --- rows: lists of byte strings or numbers, compressed


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes first, then the next ones: what compresses best."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def packed(sizes: np.ndarray, body: bytes) -> bytes:
    """A list of ``sizes`` and what it divides. Rows are shuffled, so they are compressed well."""
    raw = len(sizes).to_bytes(8, "little") + _planes(sizes) + body
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def unpacked(row: bytes) -> tuple[np.ndarray, bytes]:
    raw = pa.decompress(row[8:], int.from_bytes(row[:8], "little"), codec="zstd", asbytes=True)
    end = 8 + 4 * int.from_bytes(raw[:8], "little")
    return _numbers(raw[8:end]), raw[end:]


# --- the three steps


def _split(batches: Iterator[pa.RecordBatch], pattern: str, p: Shuffle) -> Iterator[pa.RecordBatch]:
    """Rows of blocks: per slot its distinct words; under slot -1 where the most frequent words stand among them, and under
    the slots below it the documents' words, as ranks of frequent words and places of others."""
    import regex
    from pyspark import TaskContext

    rule = regex.compile(pattern)
    key = TaskContext.get().partitionId() << 32

    def words(text: str) -> Iterable[str]:
        return rule.findall(text) if len(text) < 1 << 22 else (m[0] for m in rule.finditer(text))

    def row(slot: int, ids: list | None, body: bytes) -> pa.RecordBatch:
        dealt = slot if slot >= 0 else zlib.crc32(b"%d %d" % (key, slot)) % p.slots
        columns = [pa.array([dealt], pa.int32()), pa.array([key], pa.int64()), pa.array([slot], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([body], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["dealt", "block", "slot", "doc_ids", "body"])

    def block(ids: list, coded: list[np.ndarray], seen: dict) -> Iterator[pa.RecordBatch]:
        spelled = [w.encode() for w in seen]
        of = np.fromiter((zlib.crc32(w) % p.slots for w in spelled), np.int32, len(spelled))
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(p.slots + 1))
        for slot in np.flatnonzero(np.diff(bounds)):
            held = [spelled[i] for i in order[bounds[slot] : bounds[slot + 1]]]
            yield row(int(slot), None, packed(np.array([len(w) for w in held], np.uint32), b"".join(held)))
        place, rank = np.empty(len(order), np.uint32), np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        chunks, size = [[]], 0
        for n, c in zip(ids, coded):
            chunks[-1].append((n, c))
            size += len(c)
            if size >= p.chunk:
                chunks.append([])
                size = 0
        times = np.zeros(len(order), np.int64)
        for chunk in chunks:
            times += np.bincount(np.concatenate([np.zeros(0, np.uint32), *(c for _, c in chunk)]), minlength=len(order))
        often = np.argsort(-times, kind="stable")
        rank[often] = np.arange(len(order), dtype=np.uint32)
        yield row(-1, None, packed(place[often[:_OFTEN]], b""))
        for n, chunk in enumerate(chunks):
            if chunk:
                words_ = np.concatenate([c for _, c in chunk])
                ranks_ = rank[words_]
                body = np.minimum(ranks_, _OFTEN).astype("<u2").tobytes() + _planes(place[words_[ranks_ >= _OFTEN]])
                yield row(-2 - n, [i for i, _ in chunk], packed(np.array([len(c) for _, c in chunk], np.uint32), body))

    def fresh() -> dict:
        seen = defaultdict()
        seen.default_factory = seen.__len__
        return seen

    ids, coded, seen, size = [], [], fresh(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            if size and size + len(text) > p.block:
                yield from block(ids, coded, seen)
                ids, coded, seen, size, key = [], [], fresh(), 0, key + 1
            ids.append(doc_id)
            coded.append(np.fromiter(map(seen.__getitem__, words(text.decode("utf-8", "replace"))), np.uint32))
            size += len(text) + 1
    if ids:
        yield from block(ids, coded, seen)


def _encode(batches: Iterator[pa.RecordBatch], encode: Callable[[str], list[int]]) -> Iterator[pa.RecordBatch]:
    """Words of slots become their ids, in the same order; a word that another block has too is encoded once."""
    known: dict[bytes, bytes] = {}

    def ids(word: bytes) -> bytes:
        found = known.get(word)
        if found is None:
            found = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
        return found

    for batch in batches:
        bodies = batch.column("body").to_pylist()
        for at, slot in enumerate(batch.column("slot").to_pylist()):
            if slot >= 0:
                sizes, spelled = unpacked(bodies[at])
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                found = [ids(spelled[a:b]) for a, b in zip([0, *ends], ends)]
                bodies[at] = packed(np.array([len(x) // 4 for x in found], np.uint32), _planes(np.frombuffer(b"".join(found), "<u4")))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "slot", "doc_ids")), pa.array(bodies, pa.binary())], names=["block", "slot", "doc_ids", "body"])


def _reassemble(group: pa.Table) -> pa.Table:
    """The documents of one block: ids of their words, put where the words stand."""
    rows = sorted(zip(group.column("slot").to_pylist(), group.column("doc_ids").to_pylist(), group.column("body").to_pylist()), key=lambda r: r[0])
    lists = [unpacked(body) for slot, _, body in rows if slot >= 0]
    lengths = np.concatenate([np.zeros(0, np.int64), *(sizes for sizes, _ in lists)]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *(_numbers(body) for _, body in lists)]).astype("<u4")
    starts = np.cumsum(lengths) - lengths
    (often,) = (unpacked(body)[0] for slot, _, body in rows if slot == -1)
    keys, tokens, texts = [], [], []
    for slot, doc_ids, body in rows:
        if slot < -1:
            sizes, told = unpacked(body)
            total = int(sizes.sum(dtype=np.int64))
            ranked = np.frombuffer(told[: 2 * total], "<u2")
            word = np.empty(total, np.uint32)
            word[ranked < _OFTEN] = often[ranked[ranked < _OFTEN]]
            word[ranked == _OFTEN] = _numbers(told[2 * total :])
            n = lengths[word]
            ends = np.cumsum(n)
            flat = ids[np.repeat(starts[word] - ends + n, n) + np.arange(int(n.sum()))]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
            offsets = pa.py_buffer((4 * bounds).astype(np.int64).tobytes())
            keys.append(pa.array(doc_ids, pa.int64()))
            tokens.append(pa.array(np.diff(bounds)))
            texts.append(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(flat.tobytes())]).cast(pa.binary()))
    return pa.table({"doc_id": pa.chunked_array(keys), "n_tokens": pa.chunked_array(tokens), "ids": pa.chunked_array(texts)})


# --- vocabulary


def read_ranks(path: str) -> bytes:
    """The content of a rank file (lines of base64 bytes and a rank) on the driver."""
    with open(path, "rb") as file:
        return file.read()


def ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def _encoder(held: dict) -> Callable[[str], list[int]]:
    """Of a broadcast ``{"content", "pattern"}``: a worker process makes it once."""
    if "made" not in held:
        import tiktoken

        held["made"] = tiktoken.Encoding("own", pat_str=held["pattern"], mergeable_ranks=ranks(held["content"]), special_tokens={}).encode_ordinary
    return held["made"]


def _token_bytes(held: dict) -> pa.Array:
    """The token-byte table: at each id its bytes, null where there is none."""
    if "table" not in held:
        by_id = {i: token for token, i in ranks(held["content"]).items()}
        held["table"] = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.binary())
    return held["table"]


# --- operators


def encode(docs: DataFrame, content: bytes, pattern: str, p: Shuffle = Shuffle()) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit).

    ``content`` is a rank file, ``pattern`` the regular expression whose matches are encoded separately; without
    special tokens. Tasks cut texts into words and keep, per block of documents, the words' positions as numbers of
    the block's list of distinct words. The lists are shuffled by word hash, so that all blocks' copies of a word meet
    in one task and are encoded once. A word arrives there once per block, however frequent it is, and its ids go
    back to the block, where documents are put together by position. Texts are whole; nothing is collected. Each of
    the two shuffles is spread by hashes, so no source, word or copied text makes a large group: a group is a block.

    A null or empty text has no ids. Bytes that are not UTF-8 count as U+FFFD. Rows are encoded one by one, so repeated
    rows and ids are repeated in the result, and rows without an id keep their null; an empty table gives no rows.
    Other columns are not read, whatever their names. The list of a block must fit into a row (2 GB).
    """
    held = docs.sparkSession.sparkContext.broadcast({"content": content, "pattern": pattern})
    body = "block bigint, slot int, doc_ids array<bigint>, body binary"
    placed = docs.select("doc_id", "text").mapInArrow(lambda batches: _split(batches, pattern, p), f"dealt int, {body}")
    encoded = placed.repartition("dealt").mapInArrow(lambda batches: _encode(batches, _encoder(held.value)), body)
    return encoded.groupBy("block").applyInArrow(_reassemble, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, content: bytes, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids of ``column`` stand for in a column ``into`` (replaced where there is one).

    Each id is looked up in the token-byte table, which is as large as the vocabulary and so may be broadcast; row by
    row, without a shuffle. Null ids and ids outside the vocabulary give null, no ids the empty string.
    """
    held = encoded.sparkSession.sparkContext.broadcast({"content": content})
    kept = [c for c in encoded.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(held.value)
        lengths = np.array([len(t or b"") for t in table.to_pylist()], np.int64)
        for batch in batches:
            out = []
            for ids in batch.column(column).to_pylist():
                if ids is None or len(ids) % 4:
                    out.append(None)
                    continue
                wanted = np.frombuffer(ids, "<u4")
                if len(wanted) and int(wanted.max()) >= len(table):
                    out.append(None)
                    continue
                found = table.take(pa.array(wanted))
                out.append(None if found.null_count else found.buffers()[2].to_pybytes()[: int(lengths[wanted].sum())] if len(wanted) else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, into])

    schema = encoded.select(*kept).schema
    return encoded.select(*kept).mapInArrow(run, schema.add(into, "binary"))
