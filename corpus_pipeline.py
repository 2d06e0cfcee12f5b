"""A training corpus from raw documents: toxicity, quality, near-duplicates, mixing and packing, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablecheck.llm import language_quality, minhash, mixing, packing, toxicity
from tablecheck.llm.queries import tokenizer
from tablecheck.llm.store import fold, stored

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit. The classifier learns from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold("doc_id", 1, 3))
    return docs.where(toxicity.train(docs, labels).column("text") < TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents long enough, not repetitive, and with histograms like their language's."""
    return language_quality.judge(docs, carry=docs.columns).where("kept").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document of the smallest id.

    Rows that repeat that id stay, and rows without an id.
    """
    copies = minhash.near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, those of scarce categories repeatedly, so that tokens meet the targets of sources, languages and topics."""
    return mixing.sample(docs).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-duplicates", drop_copies), ("mixing", sample_to_targets), ("packing", pack_windows)]

#: A learned classifier, near-duplicate groups and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each stage's rows are written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
