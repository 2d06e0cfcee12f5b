"""Profiles as mergeable states: a day is profiled once, longer spans are merged from what is stored.

A state holds counts, sums and extremes, which merge exactly, a HyperLogLog sketch for distinct values and a KLL sketch
for quantiles, whose errors do not grow by merging. A state's size does not depend on its table's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablecheck.functions.literals import array, literal, name, struct
from tablecheck.operators.profile import looks_dated, text_number

#: Distinct counts: 2 to this power registers, a standard error of 1.04 divided by the root of their number (0.8 percent).
REGISTERS = 14
#: Quantiles: the sketch's k, a rank error of about 0.7 percent at 99 percent confidence.
K = 400

_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)

_STATE = (
    "ordinal int, column_name string, kind string, total bigint, filled bigint, numbers bigint, sum_num double, min_num double, max_num double, "
    "first string, last string, short int, long int, distinct_sketch binary, quantile_sketch binary"
)


def _hashed(c: str, kind: T.DataType) -> str:
    """A 64-bit number that is equal when the values are, NULL for NULL."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = f"(CAST({c} AS DOUBLE) + 0D)"  # one zero
    elif isinstance(kind, T.MapType):
        c = f"array_sort(map_entries({c}))"
    return f"if({c} IS NULL, NULL, xxhash64({c}))"


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, _TIME):
        return "time"
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    return "nested" if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else "binary"


def _cells(column: str, kind: T.DataType, no: int) -> list[str]:
    c, of = name(column), _kind(kind)
    number = f"CAST({c} AS DOUBLE)" if of == "number" else f"number{no}" if of == "text" else "CAST(NULL AS DOUBLE)"
    ordered = of in ("text", "time")
    extreme = lambda f: f"{f}({c})"
    shown = (lambda v: f"date_format({v}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')") if of == "time" and not isinstance(kind, T.DateType) else lambda v: v
    length = f"length({c})" if of == "text" else "CAST(NULL AS INT)"
    return [
        f"count({c}) AS filled{no}", f"count({number}) AS numbers{no}", f"sum({number}) AS sum{no}", f"min({number}) AS min{no}", f"max({number}) AS max{no}",
        f"{f'CAST({shown(extreme('min'))} AS STRING)' if ordered else 'CAST(NULL AS STRING)'} AS first{no}",
        f"{f'CAST({shown(extreme('max'))} AS STRING)' if ordered else 'CAST(NULL AS STRING)'} AS last{no}",
        f"min({length}) AS short{no}", f"max({length}) AS long{no}",
        f"hll_sketch_agg({_hashed(c, kind)}, {REGISTERS}) AS distinct{no}", f"kll_sketch_agg_double({number}, {K}) AS quantiles{no}",
    ]


def state(df: DataFrame) -> DataFrame:
    """One row per column: its state, from one aggregation of one scan; what is shuffled is a state per task."""
    kinds = [(f.name, f.dataType) for f in df.schema.fields]
    texts = [f"{text_number(name(c))} AS number{no}" for no, (c, k) in enumerate(kinds) if isinstance(k, T.StringType)]
    cells = ["count(1) AS total", *(cell for no, (c, k) in enumerate(kinds) for cell in _cells(c, k, no))]
    measured = df.selectExpr(*(name(c) for c, _ in kinds), *texts).agg(*map(F.expr, cells))
    rows = [
        struct(ordinal=str(no), column_name=literal(c), kind=literal(_kind(k)), total="total", filled=f"filled{no}", numbers=f"numbers{no}", sum_num=f"sum{no}", min_num=f"min{no}",
               max_num=f"max{no}", first=f"first{no}", last=f"last{no}", short=f"short{no}", long=f"long{no}", distinct_sketch=f"distinct{no}", quantile_sketch=f"quantiles{no}")
        for no, (c, k) in enumerate(kinds)
    ]
    return measured.selectExpr(f"inline({array(rows)})") if rows else df.sparkSession.createDataFrame([], _STATE)


def record(df: DataFrame, path: str, source: str, day: str) -> None:
    """Stores the states of one source's rows of one day; a day that is recorded again replaces itself. Reads ``df`` only."""
    kept = state(df).select("*", F.lit(source).alias("source_name"), F.lit(day).cast("date").alias("day"))
    kept.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_name", "day").parquet(path)


def load(spark: SparkSession, path: str, sources: Iterable[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored states; files of other sources and days are not opened."""
    states = spark.read.schema(_STATE + ", source_name string, day date").parquet(path)
    if sources is not None:
        states = states.where(F.col("source_name").isin(list(sources)))
    if since is not None:
        states = states.where(F.col("day") >= F.lit(since).cast("date"))
    return states.where(F.col("day") <= F.lit(until).cast("date")) if until is not None else states


def merged(states: DataFrame, *by: str) -> DataFrame:
    """One state per column and value of ``by`` (usually ``source_name``, also a month or nothing).

    A column's place and kind are those of its newest day. Merged states are states: merging them again gives the same.
    Equal columns are combined in every task before the shuffle.
    """
    newest = F.max_by(F.struct("ordinal", "kind"), "day")
    found = states.groupBy(*by, "column_name").agg(
        newest.alias("newest"), F.max("day").alias("day"), *(F.sum(c).alias(c) for c in ("total", "filled", "numbers", "sum_num")),
        *(F.min(c).alias(c) for c in ("min_num", "first", "short")), *(F.max(c).alias(c) for c in ("max_num", "last", "long")),
        F.expr("hll_union_agg(distinct_sketch)").alias("distinct_sketch"), F.expr("kll_merge_agg_double(quantile_sketch)").alias("quantile_sketch"),
    )
    return found.select(*by, "newest.*", *(c for c in found.columns if c not in (*by, "newest")))


def profile(states: DataFrame, *by: str) -> DataFrame:
    """The columns' profiles of merged states; like ``profile_table``, with an estimated distinct count, and quartiles.

    ``distinct_count`` has a standard error of 0.8 percent, ``p25 median p75`` of a number's or a text's numeric values a
    rank error of about 0.7 percent. All other fields are exact.
    """
    whole = merged(states, *by).selectExpr("*", (
        "CASE WHEN filled = 0 THEN 'unknown' WHEN kind = 'time' THEN 'date' WHEN kind = 'number' OR kind = 'text' AND numbers > 0 THEN 'numeric' "
        f"WHEN kind <> 'text' THEN kind WHEN {looks_dated('first')} THEN 'date' ELSE 'string' END AS col_type"
    ))
    numeric, dated, text = (lambda v, k=k: f"if(col_type = '{k}', {v}, NULL)" for k in ("numeric", "date", "string"))
    quartiles = "if(col_type = 'numeric' AND numbers > 0, kll_sketch_get_quantile_double(quantile_sketch, array(0.25D, 0.5D, 0.75D)), NULL)"
    return whole.selectExpr("*", f"{quartiles} AS q").selectExpr(
        *by, "ordinal", "column_name", "col_type", "total AS row_count", "total - filled AS null_count",
        "coalesce(round(try_divide((total - filled) * 100.0D, total), 2), 0.0D) AS null_pct",
        f"{numeric('min_num')} AS min_num", f"{numeric('max_num')} AS max_num", f"round({numeric('try_divide(sum_num, numbers)')}, 2) AS avg_val",
        f"{dated('first')} AS min_text", f"{dated('last')} AS max_text", f"{text('short')} AS min_length", f"{text('long')} AS max_length",
        "hll_sketch_estimate(distinct_sketch) AS distinct_count", "q[0] AS p25", "q[1] AS median", "q[2] AS p75",
    )
