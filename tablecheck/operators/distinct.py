"""Exact distinct and duplicate counts for many keys at once.

Several ``count(distinct ..)`` in one aggregate make Spark copy each row once per distinct
column *at full width*, with every other aggregate's buffer in every group. Here keys are sorted
by type, and of each type the columns are turned into rows ``(key number, value)``, which are
grouped and counted. The copies are narrow, no column is read twice, and equal values are combined
before the shuffle, so neither a low-cardinality column nor a hot value is shuffled in bulk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tablecheck.functions.literals import name

_SHORT = 64  # longer texts are compared by their SHA-256 digest, so that wide text is not shuffled


def _utc(df: DataFrame) -> bool:
    """Without a zone's clock changes, local times and instants correspond one to one."""
    return df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z")


def _text_slot(value: str) -> str:
    return f"if(octet_length({value}) <= {_SHORT}, concat('=', {value}), concat('#', sha2({value}, 256)))"


def _canonical(value: str, kind: T.DataType, depth: int = 0) -> str:
    """A text that is equal exactly when the values are; NULL where the value is.

    Instants keep their microseconds, -0.0 is 0.0, and the parts of nested values carry their length.
    """
    x = f"x{depth}"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return f"if({value} = 0, '0', CAST(CAST({value} AS DOUBLE) AS STRING))"
    if isinstance(kind, T.TimestampType):
        return f"CAST(unix_micros({value}) AS STRING)"
    if isinstance(kind, T.BinaryType):
        return f"base64({value})"
    if isinstance(kind, T.ArrayType):
        return f"array_join(transform({value}, {x} -> {_part(x, kind.elementType, depth + 1)}), '')"
    if isinstance(kind, T.MapType):
        entry = f"concat({_part(f'{x}.key', kind.keyType, depth + 1)}, {_part(f'{x}.value', kind.valueType, depth + 1)})"
        return f"array_join(array_sort(transform(map_entries({value}), {x} -> {entry})), '')"
    if isinstance(kind, T.StructType):
        fields = [_part(f"{value}.{name(f.name)}", f.dataType, depth + 1) for f in kind.fields]
        return f"if({value} IS NULL, NULL, concat({', '.join(fields) or chr(39) * 2}))"
    return f"CAST({value} AS STRING)"


def _part(value: str, kind: T.DataType, depth: int = 0) -> str:
    """A part of a longer text: its length and itself, a dash for NULL."""
    text = _canonical(value, kind, depth)
    return f"coalesce(concat(length({text}), ':', {text}), '-')"


def _comparable(df: DataFrame, columns: list[str]) -> tuple[str, str]:
    """(type, expression) of a value that is equal exactly when the key is."""
    if len(columns) > 1:
        return "text", _text_slot("concat(" + ", ".join(_part(name(c), df.schema[c].dataType) for c in columns) + ")")
    column, kind = name(columns[0]), df.schema[columns[0]].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "whole", f"CAST({column} AS BIGINT)"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "real", f"CAST({column} AS DOUBLE)"
    if isinstance(kind, T.DateType):
        return "whole", f"CAST(unix_date({column}) AS BIGINT)"
    if isinstance(kind, T.TimestampType) or (isinstance(kind, T.TimestampNTZType) and _utc(df)):
        return "whole", f"unix_micros(CAST({column} AS TIMESTAMP))"
    return "text", _text_slot(_canonical(column, kind))


def _as_rows(df: DataFrame, values: list[tuple[int, str]]) -> DataFrame:
    """``key_no, v``: one row per row of the table and key."""
    cells = [cell for no, value in values for cell in (f"{no} AS k{no}", f"{value} AS v{no}")]
    wide = df.selectExpr(*cells)
    if len(values) == 1:
        return wide.toDF("key_no", "v")
    pairs = ", ".join(f"(k{no}, v{no}) AS `{no}`" for no, _ in values)
    return df.sparkSession.sql(
        f"SELECT key_no, v FROM {{wide}} UNPIVOT INCLUDE NULLS ((key_no, v) FOR label IN ({pairs}))", wide=wide
    )


def key_counts(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """One row per key: ``key_no, total, distinct_count, duplicate_groups``.

    ``distinct_count`` leaves NULL out, as SQL does; ``duplicate_groups`` counts the values
    (NULL among them) that occur more than once.
    """
    by_type: dict[str, list[tuple[int, str]]] = {}
    for no, columns in enumerate(keys):
        kind, value = _comparable(df, columns)
        by_type.setdefault(kind, []).append((no, value))
    parts = [
        _as_rows(df, values).groupBy("key_no", "v").count().groupBy("key_no").agg(
            F.expr("sum(count) AS total"), F.expr("count(v) AS distinct_count"),
            F.expr("count_if(count > 1) AS duplicate_groups"),
        )
        for values in by_type.values()
    ]
    return reduce(DataFrame.unionByName, parts)
