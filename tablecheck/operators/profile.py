"""Column profiles of whole tables, personal-data tags and reports, glossary texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablecheck.functions.literals import array, literal, name, struct, text
from tablecheck.functions.naming import format_for, personal_tag
from tablecheck.operators.distinct import key_counts
from tablecheck.session import constant_rows

_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def looks_dated(value: str) -> str:
    """At least eight characters with a date or time separator among them."""
    return f"(length({value}) >= 8 AND {value} RLIKE '[-/:]')"


def text_number(value: str) -> str:
    """The number a text holds in decimal notation.

    Other texts are told by their first character or by the pattern, both far cheaper than a
    failing parse: blanks, signs, points and digits all sort before the colon, letters after it.
    """
    pattern = r"^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?\\s*$"
    return f"if({value} < ':' AND {value} RLIKE '{pattern}', try_cast({value} AS DOUBLE), NULL)"


def _stats(column: str, kind: T.DataType, no: int, approximate: bool) -> list[str]:
    """Aggregates of one column. What the type rules out is a NULL, never a failing cast."""
    c = name(column)
    texts, times = isinstance(kind, T.StringType), isinstance(kind, _TIME)
    number = f"CAST({c} AS DOUBLE)" if isinstance(kind, (T.NumericType, T.BooleanType)) else f"number{no}" if texts else None
    cells = [f"count({c}) AS c{no}_filled"]
    for cell, function in (("min", "min"), ("max", "max"), ("avg", "avg")):
        cells.append(f"{f'{function}({number})' if number else 'CAST(NULL AS DOUBLE)'} AS c{no}_{cell}")
    for cell, function in (("short", "min"), ("long", "max")):
        cells.append(f"{f'{function}(length({c}))' if texts else 'CAST(NULL AS INT)'} AS c{no}_{cell}")
    for cell, function in (("first", "min"), ("last", "max")):
        value = f"{function}({c})" if times else "CAST(NULL AS STRING)"
        if times and not isinstance(kind, T.DateType):
            value = f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        cells.append(f"CAST({value} AS STRING) AS c{no}_{cell}")
    if approximate:
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        value = f"if({c} IS NULL, NULL, to_json(struct({c})))" if nested else c
        cells.append(f"approx_count_distinct({value}) AS c{no}_distinct")
    return cells


def _text_extremes(df: DataFrame, columns: list[str]) -> DataFrame | None:
    """``ordinal, first, last`` of the text columns.

    Text buffers have no fixed width, which turns an aggregation from compiled code to interpreted
    rows; they are therefore kept out of the one that holds all other statistics.
    """
    texts = [(no, c) for no, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return None
    cells = ", ".join(f"min({name(c)}) AS first{no}, max({name(c)}) AS last{no}" for no, c in texts)
    rows = [struct(ordinal=str(no), first=f"first{no}", last=f"last{no}") for no, _ in texts]
    return df.agg(F.expr(f"struct({cells}) AS measured")).selectExpr("measured.*").selectExpr(f"inline({array(rows)})")


def _only(kind: str, value: str, column: str) -> str:
    return f"if(col_type = '{kind}', {value}, NULL) AS {column}"


def _by_ordinal(parts: list[DataFrame], optional: str) -> DataFrame:
    """One row per column of the table from parts that each know some of its fields."""
    known = [f for p in parts for f in p.schema.fields if f.name != "ordinal"]
    absent = [f for f in T.StructType.fromDDL(optional).fields if f.name not in {k.name for k in known}]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = whole.groupBy("ordinal").agg(*[F.max(f.name).alias(f.name) for f in known])
    return merged.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])


def _column_type(kind: T.DataType) -> str:
    """unknown without values; numeric when any value is a number; date when the least text is dated.

    Flags count as the numbers 0 and 1; binary and nested values are no texts.
    """
    settled = "'nested'" if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else "'binary'" if isinstance(kind, T.BinaryType) else "'string'"
    if isinstance(kind, _TIME):
        settled = "'date'"
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        settled = "'numeric'"
    elif isinstance(kind, T.StringType):
        settled = "'text'"
    return f"CASE WHEN {{filled}} = 0 THEN 'unknown' ELSE {settled} END"


def profile_table(df: DataFrame, columns: list[str] | None = None, distinct: str = "exact") -> DataFrame:
    """One row per column; the statistics of all columns come from one aggregation.

    Least and greatest texts come from a second one over the text columns. Exact distinct counts come from one more narrow
    pass (see ``distinct.key_counts``); ``distinct="approx"`` takes sketches in the first pass
    instead and shuffles nothing, ``distinct="none"`` leaves the count NULL.
    """
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [c for no, column in enumerate(columns) for c in _stats(column, kinds[column], no, distinct == "approx")]
    texts = [
        f"{text_number(name(c))} AS number{no}" for no, c in enumerate(columns) if isinstance(kinds[c], T.StringType)
    ]
    measured = (
        df.selectExpr(*[name(c) for c in columns], *texts)
        .agg(F.expr(f"struct(count(1) AS total, {', '.join(cells)}) AS measured"))
        .selectExpr("measured.*")
    )
    rows = [
        struct(
            ordinal=str(no), column_name=literal(column),
            kind=_column_type(kinds[column]).format(filled=f"c{no}_filled"), row_count="total", filled=f"c{no}_filled", min_num=f"c{no}_min", max_num=f"c{no}_max", avg_val=f"c{no}_avg",
            min_text=f"c{no}_first", max_text=f"c{no}_last", min_length=f"c{no}_short", max_length=f"c{no}_long",
            distinct_count=f"c{no}_distinct" if distinct == "approx" else "CAST(NULL AS BIGINT)",
        )
        for no, column in enumerate(columns)
    ]
    parts = [measured.selectExpr(f"inline({array(rows)})"), _text_extremes(df, columns)]
    if distinct == "exact":
        parts[0] = parts[0].drop("distinct_count")
        parts.append(key_counts(df, [[c] for c in columns]).selectExpr("key_no AS ordinal", "distinct_count"))
    profile = _by_ordinal([p for p in parts if p is not None], "first string, last string")
    inferred = f"CASE WHEN avg_val IS NOT NULL THEN 'numeric' WHEN {looks_dated('first')} THEN 'date' ELSE 'string' END"
    return profile.selectExpr("*", f"if(kind = 'text', {inferred}, kind) AS col_type").selectExpr(
        "ordinal", "column_name", "col_type", "row_count", "row_count - filled AS null_count",
        "coalesce(round(try_divide((row_count - filled) * 100.0D, row_count), 2), 0.0D) AS null_pct",
        _only("numeric", "min_num", "min_num"), _only("numeric", "max_num", "max_num"),
        _only("numeric", "round(avg_val, 2)", "avg_val"), _only("date", "coalesce(min_text, first)", "min_text"),
        _only("date", "coalesce(max_text, last)", "max_text"), _only("string", "min_length", "min_length"),
        _only("string", "max_length", "max_length"),
        "distinct_count" if distinct == "none" else "coalesce(distinct_count, 0L) AS distinct_count",
    )


def profile_many(tables: dict[str, DataFrame], distinct: str = "exact") -> DataFrame:
    """Profiles of several tables, each from its own scan."""
    parts = [profile_table(df, distinct=distinct).withColumn("source_name", F.lit(n)) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _first_values(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    """``ordinal, at, v``: the first non-null values of every column of a task; it stops reading once all have enough."""
    from pyspark import TaskContext

    at, found = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        found = found or [[] for _ in batch.columns]
        for column, held in zip(batch.columns, found):
            if len(held) < values and column.null_count < len(column):
                for i in pc.indices_nonzero(column.is_valid())[: values - len(held)].to_pylist():
                    held.append((at + i, column[i].as_py()))
        at += batch.num_rows
        if all(len(held) >= values for held in found):
            break
    rows = [(no, i, v) for no, held in enumerate(found or []) for i, v in held]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["ordinal", "at", "v"])


def sample_types(df: DataFrame, values: int = 10) -> DataFrame:
    """The type that the first non-null values of each column suggest, wherever in the table they stand.

    Each task gives its first ``values`` per column and then stops, so full columns cost the first rows of each task, and
    only a column that stays empty is read to its end. Of those the first by task and row count.
    """
    texts = df.selectExpr(*[f"CAST({name(c)} AS STRING) AS v{no}" for no, c in enumerate(df.columns)])
    found = texts.mapInArrow(lambda batches: _first_values(batches, values), "ordinal int, at bigint, v string")
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("ordinal").orderBy("at"))).where(F.col("rank") <= values)
    kind = f"CASE WHEN bool_or(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'numeric' WHEN bool_or({looks_dated('v')}) THEN 'date' ELSE 'string' END"
    known = first.groupBy("ordinal").agg(F.expr(kind).alias("sample_type"))
    columns = constant_rows(df.sparkSession, list(enumerate(df.columns)), "ordinal int, column_name string")
    return columns.join(known, "ordinal", "left").select("ordinal", "column_name", F.coalesce("sample_type", F.lit("unknown")).alias("sample_type"))


# -- personal data -----------------------------------------------------------------------------


def tag_personal(profile: DataFrame) -> DataFrame:
    tag = personal_tag(F.col("column_name"))
    return profile.withColumn("pii_type", tag).withColumn("is_pii", F.col("pii_type").isNotNull())


def personal_columns(profile: DataFrame, sources: DataFrame) -> DataFrame:
    """The flat report: flagged columns of all sources by source and column name."""
    named = profile.where("is_pii").join(
        sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id"
    )
    return named.select("source_id", "source_name", "column_name", "pii_type").orderBy("source_name", "column_name")


def personal_summary(report: DataFrame) -> DataFrame:
    """Flagged columns per source and, in the row without a name, the totals.

    ``sources_affected`` is 1 for a source and the number of sources in the total.
    """
    per_source = report.groupBy("source_name").agg(F.count("*").alias("pii_columns"))
    total = per_source.agg(
        F.lit(None).cast("string").alias("source_name"), F.coalesce(F.sum("pii_columns"), F.lit(0)).alias("pii_columns"),
        F.count("*").alias("sources_affected"),
    )
    return per_source.withColumn("sources_affected", F.lit(1).cast("bigint")).unionByName(total)


def scan_personal(df: DataFrame) -> DataFrame:
    """Share of values that have the format their column's name promises, one aggregation for all."""
    tagged = [(column, *found) for column in df.columns if (found := format_for(column))]
    if not tagged:
        return constant_rows(df.sparkSession, [], "column_name string, keyword string, matching bigint, filled bigint, match_ratio double")
    cells, rows = [], []
    for no, (column, keyword, pattern) in enumerate(tagged):
        value = f"CAST({name(column)} AS STRING)"
        cells += [f"count_if({value} RLIKE {text(pattern)}) AS hit{no}", f"count({value}) AS all{no}"]
        rows.append(struct(
            column_name=literal(column), keyword=literal(keyword), matching=f"hit{no}", filled=f"all{no}",
            match_ratio=f"round(try_divide(hit{no}, all{no}), 6)",
        ))
    measured = df.agg(F.expr(f"struct({', '.join(cells)}) AS measured")).selectExpr("measured.*")
    return measured.selectExpr(f"inline({array(rows)})")


# -- glossary ----------------------------------------------------------------------------------

GLOSSARY = ("business_name", "description", "owner", "tags")


def merge_glossary(profile: DataFrame, updates: DataFrame) -> DataFrame:
    """New texts replace old ones by (source_id, column_name); fields not sent stay as they are."""
    fields = [f for f in GLOSSARY if f in updates.columns]
    if not fields:
        raise ValueError("the update holds no glossary field")
    new = updates.select("source_id", "column_name", *[F.col(f).alias(f"new_{f}") for f in fields])
    merged = profile.join(new, ["source_id", "column_name"], "left")
    for f in fields:
        old = F.col(f) if f in profile.columns else F.lit(None).cast("string")
        merged = merged.withColumn(f, F.coalesce(F.col(f"new_{f}"), old))
    return merged.drop(*[f"new_{f}" for f in fields])


def export_rows(profile: DataFrame) -> DataFrame:
    """The export layout: two decimals, Yes/No flags, 0 for a missing average, by column name."""
    def note(field: str) -> Column:
        return F.col(field) if field in profile.columns else F.lit(None).cast("string")

    return profile.select(
        F.col("column_name").alias("Column"), F.col("col_type").alias("Type"), F.col("row_count").alias("RowCount"),
        F.round("null_pct", 2).alias("NullPct"), F.col("distinct_count").alias("DistinctCount"),
        F.coalesce(F.round("min_num", 4).cast("string"), "min_text").alias("Min"),
        F.coalesce(F.round("max_num", 4).cast("string"), "max_text").alias("Max"),
        F.coalesce(F.round("avg_val", 2), F.lit(0.0)).alias("Avg"),
        F.when(F.col("is_pii"), "Yes").otherwise("No").alias("IsPII"), F.col("pii_type").alias("PIIType"),
        note("business_name").alias("BusinessName"), note("description").alias("Description"),
        note("owner").alias("Owner"), note("tags").alias("Tags"),
    )
