"""Hierarchical packing of tokenized documents into windows of several context sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tablecheck.llm.tokens import WordIds


@dataclass(frozen=True)
class Tiers:
    """``window`` tokens are the longest context, its halves down to ``least`` the shorter tiers.

    ``end`` is the id that closes a document; ``buffer`` tokens are packed at once; ``group`` windows are one step.
    """

    window: int = 4096
    least: int = 512
    end: int = 2
    buffer: int = 4 << 20
    group: int = 64

    def sizes(self) -> list[int]:
        sizes, size = [], self.window
        while size >= self.least:
            sizes.append(size)
            size //= 2
        return sizes[::-1]


@dataclass(slots=True)
class _Piece:
    document: tuple  # (id, ids as bytes, number of ids)
    start: int
    length: int

    def cut(self, length: int) -> tuple["_Piece", "_Piece"]:
        return _Piece(self.document, self.start, length), _Piece(self.document, self.start + length, self.length - length)


class _Waiting:
    """Pieces that wait, by length; bit ``n`` of ``lengths`` is set where there is one of ``n`` tokens."""

    def __init__(self, pieces: list[_Piece]):
        self.by_length: dict[int, list[_Piece]] = {}
        self.lengths = 0
        for piece in pieces:
            self.add(piece)

    def add(self, piece: _Piece) -> None:
        self.by_length.setdefault(piece.length, []).append(piece)
        self.lengths |= 1 << piece.length

    def take(self, length: int) -> _Piece:
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            self.lengths ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``, 0 if there is none."""
        return max((self.lengths & ((2 << most) - 1)).bit_length() - 1, 0)

    def shortest(self, above: int) -> int:
        """The least length above ``above``, 0 if there is none."""
        longer = self.lengths >> (above + 1)
        return (longer & -longer).bit_length() + above if longer else 0


class _Packer:
    def __init__(self, tiers: Tiers):
        self.tiers, self.sizes = tiers, tiers.sizes()
        self.full: list[list[_Piece]] = []
        self.rest: list[_Piece] = []

    def add(self, document: tuple) -> None:
        """Whole windows of a document go alone, its tail waits for its tier."""
        n, w = document[2], self.tiers.window
        self.full += [[_Piece(document, at, w)] for at in range(0, n - w + 1, w)]
        if n % w:
            self.rest.append(_Piece(document, n - n % w, n % w))

    def pack(self) -> None:
        """Packs the tails tier by tier, longest first, in windows of their tier's own size.

        A tail's tier is the smallest size that holds it. Each tail of a tier that is left opens a window; its gap takes
        the longest tails of shorter tiers that fit whole, and what then is left of it the beginning of the shortest tail that is
        longer. The other part of that tail waits on, in the tier of its new length. The one window that finds nothing
        to fill it waits for the next time.
        """
        waiting, self.rest = _Waiting(self.rest), []
        for size, below in zip(reversed(self.sizes), [*reversed(self.sizes[:-1]), 0]):
            while (length := waiting.longest(size)) > below:
                chosen, gap = [waiting.take(length)], size - length
                while gap and (length := waiting.longest(gap)):
                    chosen.append(waiting.take(length))
                    gap -= length
                if gap and (length := waiting.shortest(gap)):
                    begin, after = waiting.take(length).cut(gap)
                    chosen.append(begin)
                    waiting.add(after)
                    gap = 0
                if gap:
                    self.rest += chosen
                else:
                    self.full.append(chosen)

    def finish(self) -> None:
        """The last tokens, less than a window, go to windows of powers of two, which need no padding."""
        self.pack()
        left = sum(piece.length for piece in self.rest)
        while left:
            gap = 1 << (left.bit_length() - 1)
            left -= gap
            chosen = []
            while gap:
                piece = self.rest.pop()
                if piece.length > gap:
                    piece, after = piece.cut(gap)
                    self.rest.append(after)
                chosen.append(piece)
                gap -= piece.length
            self.full.append(chosen)

    def take(self) -> list[tuple[int, list[_Piece]]]:
        """The full windows with their step group's number; costs of attention are dealt out evenly."""
        ordered = sorted(self.full, key=lambda x: -sum(piece.length**2 for piece in x))
        self.full = []
        groups = -(-len(ordered) // self.tiers.group) or 1
        turn = lambda i: i % groups if i // groups % 2 == 0 else groups - 1 - i % groups
        return [(turn(i), x) for i, x in enumerate(ordered)]


def _packed(batches: Iterator[pa.RecordBatch], words: WordIds, tiers: Tiers, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    packer, end = _Packer(tiers), tiers.end.to_bytes(4, "little")
    sequence = group = TaskContext.get().partitionId() << 32

    def rows():
        nonlocal sequence, group
        columns: list[list] = [[] for _ in range(10)]
        taken = packer.take()
        for turn, pieces in taken:
            offset, window = 0, sum(piece.length for piece in pieces)
            for piece in pieces:
                ids = piece.document[1][4 * piece.start : 4 * (piece.start + piece.length)]
                row = (piece.document[0], piece.start, piece.length, zlib.crc32(ids), piece.document[2], sequence, offset, window, group + turn, ids)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += piece.length
            sequence += 1
        group += max((turn for turn, _ in taken), default=-1) + 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
        arrays = [pa.array(c, pa.int64()) for c in columns[:9]]
        if with_ids:
            names.append("ids")
            arrays.append(pa.array(columns[9], pa.binary()))
        for batch in pa.Table.from_arrays(arrays, names=names).to_batches(max_chunksize=20_000):
            yield batch

    waiting = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            for key, ids in zip(part.column(0).to_pylist(), words.encode([t or "" for t in part.column(1).to_pylist()])):
                ids += end
                packer.add((key, ids, len(ids) // 4))
                waiting += len(ids) // 4
            if waiting >= tiers.buffer:
                packer.pack()
                yield from rows()
                waiting = sum(piece.length for piece in packer.rest)
    packer.finish()
    yield from rows()


def pack(docs: DataFrame, vocabulary: str, tiers: Tiers = Tiers(), with_ids: bool = False) -> DataFrame:
    """Per piece of ``docs (doc_id, text)``: where it lies in its document and in its sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group`` (and ``ids``, little-endian
    unsigned 32-bit). ``vocabulary`` is the path of a tokenizer file on the driver; its content goes to the tasks.

    A document is cut at whole windows; its tail goes to the tier of the smallest context size that holds it, and is packed
    in a window of that size. Tiers are packed from the longest, shorter ones fill its gaps, a gap that no whole tail fits
    takes the beginning of a longer one, and a task's last tokens go to windows of powers of two: every id lies in one
    piece, every window is a power of two (``window`` tells which), and nothing is padded. Windows of like attention cost
    are dealt out over the step groups of a task's buffer.

    Each task packs what it reads, in one pass: nothing is shuffled, a task holds ``buffer`` tokens and one document
    at most, and a lost task is packed anew by itself. A null or empty text is its end id only. Rows that repeat an
    id are packed each; other columns are not read; an empty table gives no rows.
    """
    with open(vocabulary, "rb") as file:
        words = docs.sparkSession.sparkContext.broadcast({"content": file.read()})
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step_group bigint"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _packed(batches, WordIds.of(words.value), tiers, with_ids), schema + ", ids binary" * with_ids)
