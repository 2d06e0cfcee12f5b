"""Writing results: files for other tools, and tables replaced one partition at a time."""

from __future__ import annotations

from collections import Counter
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.session import shared_folder


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows for and leaves all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def crowded_partitions(spark: SparkSession, path: str, by: str, files: int = 4) -> dict[str, int]:
    """The partitions of a table that have more than ``files`` files, with their number; from a listing, no file is read."""
    parts = (unquote(f).rsplit("/", 2)[-2] for f in spark.read.parquet(path).inputFiles())
    counted = Counter(part.removeprefix(f"{by}=") for part in parts if part.startswith(f"{by}="))
    return {part: n for part, n in counted.items() if n > files}


def compact(spark: SparkSession, path: str, by: str, files: int = 4, closed: str | None = None) -> list[str]:
    """Rewrites crowded partitions as one to ``files`` files each and returns their values; the others are not read.

    Rows are copied beside the table first and then replace the partitions in one commit, so that a job that ends early
    leaves either the old files or the new ones. Nobody may append to these partitions meanwhile: ``closed`` takes only those
    whose value is below it, as days that are over. A partition's rows are spread by their hash.
    """
    wanted = sorted(p for p in crowded_partitions(spark, path, by, files) if closed is None or p < closed)
    if not wanted:
        return []
    kind = dict(spark.read.parquet(path).dtypes)[by]
    rows = spark.read.parquet(path).where(F.col(by).isin([F.lit(p).cast(kind) for p in wanted]))
    beside = shared_folder(spark, "compacting")
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != by]), F.lit(files))
    rows.repartition(by, spread).write.partitionBy(by).parquet(beside)
    replace_partitions(spark.read.schema(rows.schema).parquet(beside).repartition(by, spread), path, by)
    return wanted
