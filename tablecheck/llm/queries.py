"""The registered queries of this subpackage, with comparison SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.llm import byte_bpe, filter_audit, hard_negatives, language_quality, license_scan, minhash, mixing, oracles, packing, ppm, token_counts, toxicity, url_reputation, vector_dedup

TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(table)``, where ``table(name)`` reads a table of the folder."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, of the installed package or else of the folder it is linked from."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that parts words for the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_license_scan")
def license_scan_summary(table) -> DataFrame:
    return license_scan.summary(license_scan.scan(table("documents")))


@query("op2_hierarchical_packing")
def hierarchical_packing(table) -> DataFrame:
    return packing.pack(table("documents"), tokenizer("word_bpe_49k.json"), packing.Tiers(window=4096, end=2))


@query("op3_token_counts")
def longest_match_counts(table) -> DataFrame:
    return token_counts.count_pieces(table("documents"), tokenizer("byte_bpe_50k.json"))


@query("op4_ppm_scores")
def ppm_scores(table) -> DataFrame:
    return ppm.score(table("documents"))


@query("op5_grid_order_join", oracles.vector_links(0.98))
def grid_order_join(table) -> DataFrame:
    return vector_dedup.near_duplicates(table("embeddings"), vector_dedup.GridOrder(least=0.98))


@query("op6_raked_mixing", oracles.mixing(mixing.Targets()))
def raked_mixing(table) -> DataFrame:
    """The added columns; ratios rounded, as sums of doubles differ in their last digits."""
    mixed = mixing.mix(table("documents"), mixing.Targets())
    return mixed.select("doc_id", "n_tokens", "source_group", "lang_group", "topic_group", F.round("probability", 9).alias("probability"), F.round("weight", 9).alias("weight"), "chosen")


URL_RULES = [
    url_reputation.Rule("allow", "org", "/"), url_reputation.Rule("block", "example.org", "/es/"), url_reputation.Rule("block", "example.org", "/en/1"),
    url_reputation.Rule("allow", "com", "/fr/"), url_reputation.Rule("block", "com", "/de/"),
]


@query("op7_host_reputation", oracles.host_reputation(URL_RULES, url_reputation.Prior()))
def host_reputation(table) -> DataFrame:
    return url_reputation.judge(table("pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n", "n_bad")


@query("op8_language_divergence")
def language_divergence(table) -> DataFrame:
    return language_quality.judge(table("documents"))


@query("op9_counterfactual_toxicity")
def counterfactual_toxicity(table) -> DataFrame:
    return toxicity.score(table("documents"), table("labels"))


@query("op10_bbit_minhash")
def bbit_minhash(table) -> DataFrame:
    return minhash.near_duplicates(table("documents"), minhash.MinHash(width=4, percent=80))


@query("op11_hard_negatives", oracles.hard_negatives(hard_negatives.Mining()))
def mined_negatives(table) -> DataFrame:
    """The embeddings with every seventh label moved on by one."""
    vectors = table("embeddings").select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding")
    return hard_negatives.mine(vectors, hard_negatives.Mining())


@query("op12_filter_audit", oracles.filter_audit(filter_audit.Limits()))
def filter_interactions(table) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table("documents")), table("labels"))


@query("op13_byte_bpe")
def byte_bpe_round_trip(table) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    content = byte_bpe.read_ranks(tokenizer("byte_bpe_50k.tiktoken"))
    there_and_back = byte_bpe.decode(byte_bpe.encode(table("documents"), content, split_pattern()), content)
    return there_and_back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
