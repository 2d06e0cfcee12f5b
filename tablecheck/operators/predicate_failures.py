"""Why values fail user predicates: counts, and a few failing values with what went wrong."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablecheck.functions.literals import name
from tablecheck.operators.checks import Rule
from tablecheck.session import constant_rows

_FOUND = "check_no int, failed bigint, at bigint, value string, error string"
_SHOWN = 200  # characters of a value and of an error


def _short(text: str) -> str:
    return text if len(text) <= _SHOWN else text[: _SHOWN - 3] + "..."


def _reason(check: Callable[[Any], Any], value: Any) -> tuple[bool, str | None]:
    """Whether a value fails, and the error if the predicate raised one; an undefined number is no value."""
    try:
        return not check(None if value is None or value != value else value), None
    except Exception as error:
        return True, _short(f"{type(error).__name__}: {error}")


def _tried(batches: Iterator[pa.RecordBatch], checks: list[tuple[int, int, Callable]], samples: int) -> Iterator[pa.RecordBatch]:
    """Per task and rule the number of failing rows, and the first of them."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    failed, shown = {no: 0 for no, _, _ in checks}, {no: [] for no, _, _ in checks}
    for batch in batches:
        for no, column, check in checks:
            for i, value in enumerate(batch.column(column).to_pylist()):
                bad, error = _reason(check, value)
                if bad:
                    failed[no] += 1
                    if len(shown[no]) < samples:
                        shown[no].append((no, 0, at + i, None if value is None else _short(str(value)), error))
        at += batch.num_rows
    rows = [(no, n, None, None, None) for no, n in failed.items()] + [row for own in shown.values() for row in own]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])


def reasons(df: DataFrame, rules: list[Rule], samples: int = 5) -> DataFrame:
    """One row per ``custom_script`` rule: ``check_no, check_name, failed, samples``.

    ``failed`` counts the rows whose value the predicate refuses or raises on, as the check itself counts them. ``samples`` are
    the first of them, ``value`` and ``error`` as short texts: the error's type and message, or NULL where the predicate
    answered. Each task gives a count and at most ``samples`` rows per rule, so what is gathered does not grow with the
    number of failures. All rules share one pass over their columns.
    """
    wrong = [r.name for r in rules if r.kind != "custom_script" or r.column not in df.columns]
    if wrong:
        raise ValueError(f"not a predicate on a column of the table: {', '.join(wrong)}")
    columns = list(dict.fromkeys(r.column for r in rules))
    numbered = constant_rows(df.sparkSession, [(no, r.name) for no, r in enumerate(rules, 1)], "check_no int, check_name string")
    checks = [(no, columns.index(r.column), r.value) for no, r in enumerate(rules, 1)]
    if not checks:
        return numbered.selectExpr("*", "0L AS failed", "CAST(array() AS ARRAY<STRUCT<value: STRING, error: STRING>>) AS samples")
    found = df.select(*(F.col(name(c)) for c in columns)).mapInArrow(lambda batches: _tried(batches, checks, samples), _FOUND)
    first = Window.partitionBy("check_no").orderBy("at")
    # counts (no position) sort first and all stay; of the failing rows the first are left in each task, then of all
    counts = found.where("at IS NULL").groupBy("check_no").agg(F.sum("failed").alias("failed"))
    shown = found.where("at IS NOT NULL").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= samples)
    listed = shown.groupBy("check_no").agg(F.expr("transform(array_sort(collect_list(struct(at, value, error))), s -> struct(s.value, s.error))").alias("samples"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<value: STRING, error: STRING>>)")
    return numbered.join(counts, "check_no", "left").join(listed, "check_no", "left").select(
        "check_no", "check_name", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("samples", none).alias("samples"))
