"""Tables and texts shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.session import shared_folder

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: work is not repeated and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array, at_once: int = 256) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8, a few hundred at a time, so that a batch is not held twice; null is empty."""
    for at in range(0, len(column), at_once):
        for text in column.slice(at, at_once).cast(pa.binary()).to_pylist():
            yield text or b""


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())


def fold(column: str, rest: int, modulus: int) -> Column:
    """Whether ``crc32(column as text) mod modulus`` is ``rest``; a null belongs to that fold, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == rest, F.lit(True))
