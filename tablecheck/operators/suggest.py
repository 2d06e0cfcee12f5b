"""Rule suggestions from profiles, and the library of rules that were used before."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.functions.literals import text
from tablecheck.functions.naming import content_format, name_pattern, query_fingerprint, queried_column

# Suggestion type of each library rule type.
SUGGESTION_TYPES = {
    "not_null": "null", "unique": "duplicate", "range": "range", "not_empty": "empty", "regex_match": "regex",
    "accepted_values": "enum", "freshness_hours": "freshness",
}


def _suggestion(kind: str, title: str, assert_type: str, assert_value: str, reason: str, confidence: str, regex: str = "NULL") -> str:
    return (
        f"struct({text(kind)} AS type, {title} AS title, {text(assert_type)} AS assert_type, {assert_value} AS assert_value, "
        f"{reason} AS reason, {text(confidence)} AS confidence, CAST({regex} AS STRING) AS regex_pattern)"
    )


def _rounded(value: str) -> str:
    return f"coalesce(CAST(try_cast({value} AS DECIMAL(38, 2)) AS STRING), CAST({value} AS STRING))"


def suggest(profile: DataFrame, types: Collection[str] | None = None) -> DataFrame:
    """``column_name, type, title, assert_type, assert_value, reason, confidence, regex_pattern``.

    A projection of the profile: each column's rules are built side by side and the ones whose
    condition does not hold are left out, as are those of other types than ``types``. Only ``duplicate`` and ``enum`` need
    distinct counts in the profile.
    """
    low = "CASE WHEN min_num > 0 THEN greatest(0.0D, min_num * 0.8D) ELSE min_num * 1.2D END"
    rules = {
        "null_count = 0": _suggestion(
            "null", "concat(column_name, ' is never null')", "equals", "'0'", "'there are no nulls now'", "high"),
        "null_count > 0 AND null_count * 20 < row_count": _suggestion(
            "null", "concat(column_name, ' has less than 5 % nulls')", "less_than", "'5'",
            f"concat({_rounded('null_pct')}, ' % are null now')", "medium"),
        "col_type = 'numeric' AND min_num <> max_num": _suggestion(
            "range", "concat(column_name, ' stays in range')", "between",
            f"concat('[', {_rounded(low)}, ', ', {_rounded('max_num * 1.2D')}, ']')",
            f"concat('now from ', {_rounded('min_num')}, ' to ', {_rounded('max_num')})", "medium"),
        "distinct_count = row_count AND row_count > 0": _suggestion(
            "duplicate", "concat(column_name, ' is unique')", "equals", "'0'", "'all values are distinct now'", "high"),
        "col_type = 'string' AND null_count = 0": _suggestion(
            "empty", "concat(column_name, ' is never an empty text')", "equals", "'0'",
            "'an empty text can be as bad as a null'", "medium"),
        "distinct_count BETWEEN 1 AND 10 AND row_count >= 50": _suggestion(
            "enum", "concat(column_name, ' comes from a fixed list')", "equals", "'0'",
            "concat('only ', distinct_count, ' different values')", "medium"),
        "format IS NOT NULL": _suggestion(
            "regex", "concat(column_name, ' has its format')", "equals", "'0'",
            "concat('the name contains ', format.keyword)", "high", "format.pattern"),
    }
    wanted = [(c, r) for c, r in rules.items() if types is None or any(r.startswith(f"struct({text(t)} AS type") for t in types)]
    built = ", ".join(f"if({condition}, {rule}, NULL)" for condition, rule in wanted)
    return profile.withColumn("format", content_format(F.col("column_name"))).selectExpr(
        "column_name", f"inline(filter(array({built}), s -> s IS NOT NULL))"
    )


# -- library -----------------------------------------------------------------------------------


def mined_usage(checks: DataFrame, at: str) -> DataFrame:
    """Usage events from written checks whose column and kind of rule can be told from the text.

    Equal texts are one row with their number as ``times``: a text is read once, and the grouping deals the texts to all tasks,
    however few files they come from. What is read comes out of a generator, below which no filter on it is moved.
    """
    texts = checks.groupBy("query", "assert_type").agg(F.count("*").alias("times"))
    read = F.struct(
        queried_column(F.col("query")).alias("column_name"), F.lit("").alias("column_type"),
        query_fingerprint(F.col("query"), F.col("assert_type")).alias("rule_type"),
        F.lit("used").alias("event"), F.lit(at).cast("timestamp").alias("event_at"), "times",
    )
    return texts.select(F.inline(F.array(read))).where("column_name IS NOT NULL")


def build_library(events: DataFrame) -> DataFrame:
    """One row per (name pattern, rule type) with its counters.

    ``events`` are ``column_name, column_type, rule_type, event, event_at`` with event one of
    used, accepted, rejected; with a column ``times``, a row stands for so many. Use of a free-form rule is not counted;
    a vote on one is. Names are looked at when their events are counted.
    """
    used = "event = 'used'"
    times = "times" if "times" in events.columns else "1L"
    named = (
        events.where(f"NOT ({used} AND rule_type = 'custom')")
        .groupBy("column_name", "rule_type", "column_type")
        .agg(
            *(F.expr(f"sum(if(event = '{event}', {times}, 0L)) AS {event}") for event in ("used", "accepted", "rejected")),
            F.expr("max(event_at) AS last_at"), F.expr(f"max(if({used}, event_at, NULL)) AS last_use"),
        )
    )
    # few rows are left; the column type of the last use is a text, which would keep the
    # aggregation of the events themselves from being a hashed one
    last = F.struct("last_use", "column_type")
    return named.groupBy(name_pattern(F.col("column_name")).alias("pattern"), "rule_type").agg(
        F.max_by(F.when(F.col("last_use").isNotNull(), F.col("column_type")), F.when(F.col("last_use").isNotNull(), last)).alias("column_type"),
        F.sum("used").alias("times_used"), F.sum("accepted").alias("times_accepted"),
        F.sum("rejected").alias("times_rejected"), F.max("last_at").alias("last_used_at"),
    ).withColumn("library_id", F.concat("pattern", F.lit("/"), "rule_type"))


def _votes() -> Column:
    return F.col("times_accepted") + F.col("times_rejected")


def library_listing(library: DataFrame) -> DataFrame:
    """Most used first, with the share of votes that accepted the rule."""
    rate = F.round(F.try_divide(F.col("times_accepted") * 100.0, _votes()), 0)
    return library.withColumn("acceptance_pct", rate).orderBy(F.desc("times_used"), "pattern", "rule_type")


def library_suggestions(columns: DataFrame, library: DataFrame) -> DataFrame:
    """Rules known for a column's name pattern or its exact name, the most used one per type.

    ``columns`` needs the column names only, so a table's schema rows do as well as its profile.

    Rules that at least three votes gave less than 30 % are left out.
    """
    names = columns.select(
        "column_name",
        F.explode(F.array_distinct(F.array(name_pattern(F.col("column_name")), F.lower("column_name")))).alias("pattern"),
    )
    rate = F.try_divide("times_accepted", _votes())
    kept = library.where(F.coalesce((_votes() < 3) | (rate >= 0.3), F.lit(True)))
    types = F.create_map(*[F.lit(x) for pair in SUGGESTION_TYPES.items() for x in pair])
    # of a plain equality Spark would ask that the pattern is not null, and look at the name of every event for it
    known = names.where("pattern IS NOT NULL").withColumnRenamed("pattern", "wanted")
    found = known.join(kept, F.col("wanted").eqNullSafe(F.col("pattern"))).withColumn("type", F.coalesce(types[F.col("rule_type")], F.col("rule_type")))
    best = found.groupBy("column_name", "type").agg(
        F.max(F.struct("times_used", "library_id", "times_accepted", "times_rejected")).alias("best")
    )
    return best.selectExpr(
        "column_name", "type", "concat(column_name, ': ', best.library_id) AS title", "'equals' AS assert_type", "'0' AS assert_value",
        "concat('used ', best.times_used, ' times') AS reason",
        "if(best.times_used >= 5, 'high', 'medium') AS confidence", "best.library_id AS library_id",
    )


def merge_suggestions(statistical: DataFrame, known: DataFrame) -> DataFrame:
    """A rule suggested by both keeps its statistical form, both reasons and the higher confidence."""
    s, k = statistical.alias("s"), known.alias("k")
    both = s.join(k, (F.col("s.column_name") == F.col("k.column_name")) & (F.col("s.type") == F.col("k.type")), "full")
    return both.selectExpr(
        "coalesce(s.column_name, k.column_name) AS column_name", "coalesce(s.type, k.type) AS type",
        "coalesce(s.title, k.title) AS title", "coalesce(s.assert_type, k.assert_type) AS assert_type",
        "coalesce(s.assert_value, k.assert_value) AS assert_value", "concat_ws('; ', s.reason, k.reason) AS reason",
        "if(k.confidence = 'high', 'high', coalesce(s.confidence, k.confidence)) AS confidence",
        "k.library_id AS library_id", "s.regex_pattern AS regex_pattern",
    )
