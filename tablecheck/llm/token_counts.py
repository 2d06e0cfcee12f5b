"""Word-piece counts by greedy longest match in linear time, without building the pieces."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablecheck.llm.store import text_bytes

_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies spell as themselves


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes."""
    byte_of = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return [bytes(byte_of[c] for c in piece) for piece in vocabulary if all(c in byte_of for c in piece)]


class LongestMatch(dict):
    """A trie of pieces with failure links; as a dict it holds the counts of words it has met.

    In a node the text read since the last popped piece is the node's own. When no edge goes on, greedy longest match
    takes ``pops[node]`` pieces off its front, and what is left of it is the node ``fails[node]``. Both are worked out
    from the parent's, so each byte of a word is read once and the pieces are only counted.
    """

    def __init__(self, pieces: Iterable[bytes], limit: int = 500_000):
        super().__init__()
        self.pieces, self.limit = sorted(set(pieces)), limit
        edges, ends, parents = {}, {0: False}, [None]
        for piece in self.pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(parents)
                    parents.append((node, byte))
                node = edges[key]
            ends[node] = bool(piece)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node][0]] + 1
        order = sorted(range(1, len(parents)), key=depth.__getitem__)
        fails, pops = [-1] * len(parents), [0] * len(parents)
        for node in order:
            if ends.get(node):
                fails[node], pops[node] = 0, 1
                continue
            parent, byte = parents[node]
            at, popped = fails[parent], pops[parent]
            while at >= 0 and (at << 8 | byte) not in edges:
                popped += pops[at]
                at = fails[at]
            if at >= 0:
                fails[node], pops[node] = edges[at << 8 | byte], popped
        self.edges, self.fails, self.pops = edges, fails, pops

    def parts(self) -> dict:
        """What a broadcast takes to the tasks; without the words met."""
        return {"edges": self.edges, "fails": self.fails, "pops": self.pops, "limit": self.limit}

    @classmethod
    def of(cls, held: dict) -> "LongestMatch":
        """That of broadcast parts: a worker process makes and fills it once for all its tasks."""
        if "made" not in held:
            made = held["made"] = cls([], held["limit"])
            made.edges, made.fails, made.pops = held["edges"], held["fails"], held["pops"]
        return held["made"]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = self.match(b" " + word)
        return found

    def match(self, word: bytes) -> int:
        """Pieces of greedy longest match; a word that they cannot spell is one unknown piece."""
        edges, fails, pops = self.edges, self.fails, self.pops
        node = count = 0
        for byte in word:
            following = edges.get(node << 8 | byte)
            while following is None:
                count += pops[node]
                node = fails[node]
                if node < 0:
                    return 1
                following = edges.get(node << 8 | byte)
            node = following
        while node > 0:
            count += pops[node]
            node = fails[node]
        return 1 if node < 0 else count


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_bytes, n_words, n_pieces``.

    Words are split at ASCII white space and matched with the space before them, as byte-level vocabularies spell
    words within a text. ``vocabulary`` is a path on the driver; the automaton, whose size is the vocabulary's, goes
    to the tasks, and each worker process keeps the counts of at most half a million words.

    A null or empty text has no words and no pieces. Every text is read whole, row by row: repeated rows are repeated,
    other columns are not read, and an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(LongestMatch(byte_pieces(vocabulary)).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = LongestMatch.of(held.value).__getitem__
        for batch in batches:
            sizes, words, pieces = [], [], []
            for text in text_bytes(batch.column(1)):
                found = text.split()
                sizes.append(len(text))
                words.append(len(found))
                pieces.append(sum(map(count, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, words, pieces))], names=["doc_id", "n_bytes", "n_words", "n_pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_words bigint, n_pieces bigint")
