"""Mixing documents to target shares of sources, languages and topics by iterative proportional fitting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecheck.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
OTHER = "other"


@dataclass(frozen=True)
class Targets:
    """Shares of tokens per category of each margin; ``other`` takes the categories that a margin does not name.

    Shares of categories without tokens are dealt over the rest. ``rate`` is the share of all tokens to sample.
    ``rounds`` of fitting are done, ``step`` at a time.
    """

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.2, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.08, OTHER: 0.48})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.08, OTHER: 0.02})
    topic: dict[str, float] = field(default_factory=lambda: {"short": 0.05, "markup": 0.02, "legal": 0.05, "contact": 0.13, "long": 0.2, "prose": 0.55})
    rate: float = 0.5
    rounds: int = 24
    step: int = 8

    def margins(self) -> dict[str, dict[str, float]]:
        return {"source": self.source, "lang": self.lang, "topic": self.topic}


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the shape of a text; the first that fits."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(tokens < 50, "short").when(F.regexp_count(text, F.lit("[#*$%&|<>]")) * 10 >= tokens, "markup").when(text.rlike("(?i)licen[cs]e|copyright"), "legal")
        .when(F.contains(text, F.lit("@")), "contact").when(tokens >= 2000, "long").otherwise("prose")
    )


def _category(value: Column, listed: dict[str, float]) -> Column:
    return F.when(value.isin([k for k in listed if k != OTHER]), value).otherwise(OTHER)


def _share(name: str, listed: dict[str, float]) -> Column:
    chosen = F.lit(0.0)
    for category, share in listed.items():
        chosen = F.when(F.col(f"{name}_group") == category, float(share)).otherwise(chosen)
    return chosen


def fit_cells(documents: DataFrame, targets: Targets) -> DataFrame:
    """``source_group, lang_group, topic, tokens, share``: the fitted share of all sampled tokens of each cell.

    Cells are as many as the targets' categories multiply to, whatever the documents. They are raked in one task:
    over one partition no window needs an exchange.
    """
    margins = {name: listed for name, listed in targets.margins().items()}
    keys = [f"{name}_group" for name in margins]
    cells = documents.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0").coalesce(1)
    whole = Window.partitionBy()
    for name, listed in margins.items():
        own = Window.partitionBy(f"{name}_group")
        first = F.when(F.row_number().over(own.orderBy(*keys)) == 1, _share(name, listed)).otherwise(0.0)
        cells = cells.withColumn(f"{name}_first", first)
    cells = cells.select(
        *keys, "tokens", (F.col("tokens") / F.sum("tokens").over(whole)).alias("share"),
        *(F.try_divide(_share(name, listed), F.sum(f"{name}_first").over(whole)).alias(f"{name}_target") for name, listed in margins.items()),
    )
    cells = stored(cells, "mix-cells")
    for start in range(0, targets.rounds, targets.step):
        cells = cells.coalesce(1)
        for _ in range(min(targets.step, targets.rounds - start)):
            for name in margins:
                total = F.sum("share").over(Window.partitionBy(f"{name}_group"))
                cells = cells.withColumn("share", F.coalesce(F.try_divide(F.col("share") * F.col(f"{name}_target"), total), F.lit(0.0)))
        cells = stored(cells, "mix-cells")
    return cells.select(*keys, "tokens", "share")


def mix(docs: DataFrame, targets: Targets = Targets(), topic: Column | None = None) -> DataFrame:
    """``docs (doc_id, text, source, lang)`` with ``n_tokens, source_group, lang_group, topic_group, probability, weight, chosen, copies`` added.

    Token sums of the cells of source, language and topic are raked until their margins are the targets. A document's
    ``probability`` is the cell's fitted tokens over its tokens there are, times ``rate`` of all, at most 1; ``weight`` is
    what is missing at 1, so that tokens times weight over the sampled documents meet the targets. A document is
    ``chosen`` when a number that is made from its id only (from the text, where the id is null) lies under its
    probability: repeated rows share their fate, and a rerun chooses the same.

    ``copies`` is for samples without weights: the whole part of probability times weight, and one more where the same
    number lies under the rest. Where no ratio passes 1 it is 1 for the chosen documents.

    A null or unlisted source or language belongs to ``other``. A cell whose target is 0, and a text without tokens in
    a cell without tokens, have probability 0. Columns of ``docs`` named like the added ones are replaced.
    """
    added = ["n_tokens", "source_group", "lang_group", "topic_group", "probability", "weight", "chosen", "copies"]
    own = [c for c in docs.columns if c not in added]
    marked = docs.select(*own, token_count(F.col("text")).alias("n_tokens"))
    marked = marked.select(
        *own, "n_tokens", _category(F.col("source"), targets.source).alias("source_group"), _category(F.col("lang"), targets.lang).alias("lang_group"),
        _category(topic_of(F.col("text"), F.col("n_tokens")) if topic is None else topic, targets.topic).alias("topic_group"),
    )
    cells = fit_cells(marked, targets)
    ratio = F.try_divide(F.col("share") * F.lit(float(targets.rate)) * F.col("total"), F.col("tokens"))
    rates = cells.withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    rates = rates.select("source_group", "lang_group", "topic_group", ratio.alias("ratio"))
    joined = marked.join(F.broadcast(rates), ["source_group", "lang_group", "topic_group"], "left")
    uniform = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0
    ratio = F.coalesce("ratio", F.lit(0.0))
    probability = F.least(ratio, F.lit(1.0))
    return joined.select(
        *own, "n_tokens", "source_group", "lang_group", "topic_group", probability.alias("probability"), F.greatest(ratio, F.lit(1.0)).alias("weight"), (uniform < probability).alias("chosen"),
        (F.floor(ratio) + (uniform < ratio - F.floor(ratio)).cast("bigint")).alias("copies"),
    )


def sample(docs: DataFrame, targets: Targets = Targets(), topic: Column | None = None, at_once: int = 4096) -> DataFrame:
    """``mix(docs)`` with each row repeated ``copies`` times: tokens of the rows themselves meet the targets.

    Scarce categories are repeated as often as their targets ask for. A row is repeated ``at_once`` at a time, so that no
    long list is built.
    """
    firsts = mix(docs, targets, topic).where("copies > 0").withColumn("_first", F.explode(F.expr(f"sequence(1L, copies, {at_once}L)")))
    return firsts.withColumn("_copy", F.explode(F.expr(f"sequence(_first, least(_first + {at_once - 1}, copies))"))).drop("_first", "_copy")
