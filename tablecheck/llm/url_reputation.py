"""Page verdicts from url rules and empirical-Bayes reputations of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.llm.store import LETTERS, stored


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Prior:
    """``rate`` and ``weight`` of the topmost beta prior; a host is blocked from a posterior bound of ``limit``.

    The bound is the posterior mean less ``deviations`` standard deviations. ``most`` bounds the weight that a level
    may give to the one below it.
    """

    rate: float = 0.2
    weight: float = 2.0
    limit: float = 0.5
    deviations: float = 1.0
    most: float = 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), LETTERS, LETTERS.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _by_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """Of the longest rule that fits; a longer rule is tried first, equally long ones in the given order."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        own = F.when((host == rule.host) | F.endswith(host, F.lit("." + rule.host)), F.startswith(path, F.lit(rule.path)))
        chosen = F.when(own, F.lit(value(rule))).otherwise(chosen)
    return chosen


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix, by the last labels; a host of one label is its own domain and suffix."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _fitted(children: DataFrame, key: str, p: Prior) -> DataFrame:
    """Per ``key`` a beta prior ``(rate, weight)`` for its children ``(n, bad, rate, weight)``, by moments.

    The rate is the key's own, shrunk towards its parent's. The weight is what the spread of the children's rates
    leaves once binomial noise is taken off: rates that agree give a heavy prior, rates that differ a light one.
    """
    sums = children.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.when(F.col("n") > 0, 1)).alias("k"),
        F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("n"))).alias("squares"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.min("parent_rate").alias("parent_rate"), F.min("parent_weight").alias("parent_weight"),
    )
    rate = (F.col("bad") + F.col("parent_rate") * F.col("parent_weight")) / (F.col("n") + F.col("parent_weight"))
    q = F.try_divide("bad", "n")
    between = F.col("squares") - F.col("n") * q * q - (F.col("k") - 1) * q * (1 - q)
    variance = F.try_divide(between, F.col("n") - F.try_divide("nn", "n"))
    weight = F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")) & (variance > 0), F.try_divide(q * (1 - q), variance) - 1)
    weight = F.least(F.greatest(F.coalesce(weight, F.lit(p.weight)), F.lit(p.weight)), F.lit(p.most))
    return sums.select(key, "n", "bad", rate.alias("rate"), weight.alias("weight"))


def reputations(pages: DataFrame, p: Prior = Prior()) -> DataFrame:
    """Per host of ``pages (host, bad)``: ``n`` labelled pages, ``n_bad`` of them bad, posterior ``mean`` and ``bound``.

    ``bad`` is null on unlabelled pages. Counts are summed to hosts, registered domains and suffixes; each level's
    beta prior comes from the level above, and from the spread within it. All are equi joins on small sums.
    """
    domain, suffix = _levels(F.col("host"))
    hosts = stored(pages.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    top = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit(1))
    everything = _fitted(top.withColumns({"parent_rate": F.lit(p.rate), "parent_weight": F.lit(p.weight)}), "all", p)
    top = top.join(everything.select("all", F.col("rate").alias("parent_rate"), F.col("weight").alias("parent_weight")), "all")
    below = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _fitted(below.join(top.select("suffix", "parent_rate", "parent_weight"), "suffix"), "suffix", p)
    domains = _fitted(hosts.join(suffixes.select("suffix", F.col("rate").alias("parent_rate"), F.col("weight").alias("parent_weight")), "suffix"), "domain", p)
    joined = hosts.join(domains.select("domain", "rate", "weight"), "domain")
    a, total = F.col("bad") + F.col("rate") * F.col("weight"), F.col("n") + F.col("weight")
    mean = a / total
    deviation = F.sqrt(mean * (1 - mean) / (total + 1))
    return joined.select("host", F.col("n").cast("bigint").alias("n"), F.col("bad").cast("bigint").alias("n_bad"), mean.alias("mean"), (mean - p.deviations * deviation).alias("bound"))


def judge(pages: DataFrame, rules: list[Rule], p: Prior = Prior(), bad: Column | None = None) -> DataFrame:
    """Per row of ``pages (page_id, url)``: ``page_id, host, path, rule, verdict`` and the host's ``n, n_bad, mean, bound``.

    ``bad`` says of labelled pages whether their outcome was bad, null of others; without it the pages that rules
    fit are the labelled ones. A page takes its rule's verdict. Any other is blocked where the lower bound of its
    host's posterior reaches ``limit``: a host with no labelled page is judged by its registered domain and suffix.

    Hosts are joined back with an equi join on their sums, which adaptive execution splits where one host has very
    many pages. A null url, or one without ``://``, has an empty host and path, which is a host like any other.
    Rows are judged one by one, repeated rows too; columns that are not named are not read.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), (F.lit(None).cast("boolean") if bad is None else bad).alias("outcome"))
    rule, verdict = (_by_rule(F.col("host"), F.col("path"), rules, value) for value in (lambda r: r.name, lambda r: r.verdict))
    parsed = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "outcome")
    labelled = F.col("outcome") if bad is not None else F.col("by_rule") == "block"
    found = reputations(parsed.select("host", labelled.alias("bad")), p)
    final = F.coalesce("by_rule", F.when(F.col("bound") >= p.limit, F.lit("block")).otherwise(F.lit("allow")))
    return parsed.join(found, "host", "left").select("page_id", "host", "path", "rule", final.alias("verdict"), "n", "n_bad", "mean", "bound")
