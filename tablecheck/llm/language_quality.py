"""Document quality by how far its histograms are from those of its language."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablecheck.llm.store import text_bytes

#: Common words of some languages (fixed values); other languages are told apart by their shares of these and by characters.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or from at which but have an they you one all we can her has there been if more when will",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme on lui nous leur cette été être fait",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son",
}
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_EDGE = b".,;:!?\"'()[]{}-#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "space", "stop", "mark", "symbol", "beyond"]


def _classes() -> np.ndarray:
    """Class of each byte of UTF-8; bytes that continue a character have none, and count for nothing."""
    of = np.full(256, len(CLASSES), np.int64)
    of[0x21:0x7F] = CLASSES.index("mark")
    of[0:0x20] = CLASSES.index("symbol")
    for name, members in (("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), ("space", _SPACE), ("stop", b".,"), ("symbol", _SYMBOLS), ("beyond", range(0xC0, 0x100))):
        of[list(members)] = CLASSES.index(name)
    return of


@dataclass(frozen=True)
class Limits:
    """A document of ``least_words`` or more is rejected when a Jensen-Shannon distance to its nearest language passes a limit.

    ``characters`` limits the distance of character classes, ``words`` that of common words. Short texts vary more, so
    a limit is raised by ``slack`` over the square root of the number of words. A language has a reference from
    ``least_documents`` long documents on.
    """

    least_words: int = 50
    characters: float = 0.15
    words: float = 0.3
    slack: float = 1.0
    repeat_percent: int = 50
    least_documents: int = 20
    common: dict = field(default_factory=lambda: COMMON, hash=False)

    def listed(self) -> dict[bytes, int]:
        words = dict.fromkeys(w.encode() for listed in self.common.values() for w in listed.split())
        return {w: i for i, w in enumerate(words)}


class _Text:
    """Counts of one text."""

    __slots__ = ("bytes", "codes", "distinct", "n")

    def __init__(self, text: bytes):
        self.bytes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        seen = defaultdict()
        seen.default_factory = seen.__len__
        self.n = len(words)
        self.codes = np.fromiter(map(seen.__getitem__, words), np.int64, self.n)
        self.distinct = seen

    def repeated(self) -> int:
        """Words in three-word windows that occur twice or more."""
        if self.n < 4:
            return 0
        c, v = self.codes, len(self.distinct)
        pairs = c[:-2] * v + c[1:-1]
        if v > 2_000_000:  # the cube would not fit
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, of, counts = np.unique(pairs * v + c[2:], return_inverse=True, return_counts=True)
        again = counts[of] > 1
        covered = np.zeros(self.n, bool)
        for i in range(3):
            covered[i : self.n - 2 + i] |= again
        return int(covered.sum())

    def histograms(self, classes: np.ndarray, listed: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of character classes, and of common words with all others last."""
        characters = np.bincount(classes, self.bytes, len(CLASSES) + 1)[:-1]
        words = np.zeros(len(listed) + 1)
        times = np.bincount(self.codes, minlength=len(self.distinct))
        for word, code in self.distinct.items():
            at = listed.get(word.strip(_EDGE).lower())
            if at is not None:
                words[at] += times[code]
        words[-1] = self.n - words.sum()
        return characters / max(characters.sum(), 1), words / max(self.n, 1)


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, from 0 to 1, of ``p`` to each row of ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")


def references(docs: DataFrame, p: Limits = Limits()) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of each language over its long documents, where there are enough; where no long document names a language, under ``None`` of all.

    Tasks give one row of sums per language, which are added up on the executors; the driver receives the languages
    with enough documents only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, listed = _classes(), p.listed()
        sums: dict[str | None, np.ndarray] = {}

        def rows():
            found = [(k, i, x) for k, v in sums.items() for i, x in enumerate(v)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.float64())], names=["lang", "i", "x"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                found = _Text(text)
                if found.n >= p.least_words:
                    row = np.concatenate([[1.0], *found.histograms(classes, listed)])
                    sums[lang] = sums[lang] + row if lang in sums else row
                    if len(sums) >= 1000:
                        yield rows()
                        sums.clear()
        yield rows()

    found = docs.select(_lang(docs).alias("lang"), "text").mapInArrow(run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    n = F.max(F.when(F.col("i") == 0, F.col("x"))).over(Window.partitionBy("lang"))
    named = F.max(F.col("lang").isNotNull()).over(Window.partitionBy("i"))
    enough = found.withColumns({"n": n, "named": named}).where(F.when(F.col("lang").isNull(), ~F.col("named")).otherwise(F.col("n") >= p.least_documents))
    sums: dict[str | None, dict[int, float]] = defaultdict(dict)
    for row in enough.select("lang", "i", "x").collect():
        sums[row.lang][row.i] = row.x
    out = {}
    for key, values in sums.items():
        shares = np.array([values[i] for i in range(1, len(values))]) / values[0]
        out[key] = shares[: len(CLASSES)], shares[len(CLASSES) :]
    return out


def judge(docs: DataFrame, p: Limits = Limits(), carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs (doc_id, text, lang)``: counts, distances and whether the document is kept.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, character_distance,
    word_distance, kept``. Words are split at ASCII white space. ``base_failed`` is for too few words, or too many of
    them in repeated three-word windows. Distances are to the nearest language reference; references are the mean
    histograms of the documents of each ``lang`` that has enough of them, or of all documents where none names a
    language. A text of fewer words than ``least_words``, and one whose ``lang`` has no reference, has no distances
    (null): it is not judged by them. ``carry`` names the
    columns to keep instead of ``doc_id``; those named like the added ones are replaced.

    ``lang`` says which documents make a reference, and which can be judged by one. A null or empty text has no words. Rows are judged one by one, repeated rows too; other columns are not read.
    """
    known = references(docs, p)
    rows = list(known.values())
    characters, words = (np.stack([r[i] for r in rows]) if rows else np.zeros((0, 0)) for i in (0, 1))
    carried = [c for c in (carry or ["doc_id"]) if c not in NAMES]
    kinds = [T.LongType()] * 5 + [T.BooleanType()] + [T.DoubleType()] * 2 + [T.BooleanType()]
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, k) for n, k in zip(NAMES, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, listed = _classes(), p.listed()
        symbols, spaces = list(_SYMBOLS), list(_SPACE)
        for batch in batches:
            rows = []
            langs = batch.column(len(carried)).to_pylist()
            for lang, text in zip(langs, text_bytes(batch.column(len(carried) + 1))):
                found = _Text(text)
                n, repeated = found.n, found.repeated()
                failed = n < p.least_words or 100 * repeated > p.repeat_percent * n
                far = (None, None)
                if n >= p.least_words and lang in known:
                    own = found.histograms(classes, listed)
                    both = np.stack([distance(own[0], characters), distance(own[1], words)])
                    far = tuple(both[:, both.sum(axis=0).argmin()].tolist())
                more = p.slack / max(n, 1) ** 0.5
                kept = not failed and (far[0] is None or (far[0] <= p.characters + more and far[1] <= p.words + more))
                counted = int(found.bytes.sum() - found.bytes[0x80:0xC0].sum() - found.bytes[spaces].sum())
                rows.append((n, counted, int(found.bytes[symbols].sum()), duplicate_lines(text), repeated, failed, *far, kept))
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*carried, *NAMES])

    return docs.select(*carried, _lang(docs).alias("_lang"), F.col("text").alias("_text")).mapInArrow(run, schema)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "character_distance", "word_distance", "kept"]
