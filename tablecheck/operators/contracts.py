"""Data contracts: what a table promises, and its validation as result rows."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from tablecheck.functions.literals import array, literal, name, struct
from tablecheck.operators import suite
from tablecheck.operators.checks import Rule, rule_from_dict

# Logical contract types and the names that other databases use for them.
TYPE_NAMES = {
    "integer": "integer", "int": "integer", "int4": "integer", "int8": "integer", "bigint": "integer",
    "float": "float", "numeric": "float", "float8": "float", "double": "float",
    "string": "string", "varchar": "string", "text": "string",
    "boolean": "boolean", "bool": "boolean",
    "timestamp": "timestamp", "timestamptz": "timestamp",
}


@dataclass(frozen=True)
class ColumnPromise:
    column: str
    type: str
    nullable: bool = True
    unique: bool = False


@dataclass(frozen=True)
class Contract:
    name: str
    owner: str = "unknown"
    version: str = "0.1"
    columns: tuple[ColumnPromise, ...] = ()
    checks: tuple[Rule, ...] = ()
    freshness: tuple[str, float] | None = None  # (column, max hours)
    min_rows: int | None = None
    max_rows: int | None = None


def contract_from_dict(raw: Mapping[str, Any]) -> Contract:
    fresh, rows = raw.get("freshness"), raw.get("row_count", {})
    return Contract(
        name=raw["name"], owner=raw.get("owner", "unknown"), version=raw.get("version", "0.1"),
        columns=tuple(
            ColumnPromise(c["column"], c["type"], c.get("nullable", True), c.get("unique", False))
            for c in raw.get("schema", ())
        ),
        checks=tuple(rule_from_dict(c) for c in raw.get("checks", ())),
        freshness=(fresh["column"], fresh["max_hours"]) if fresh else None,
        min_rows=rows.get("min"), max_rows=rows.get("max"),
    )


def type_family(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "string" if isinstance(kind, T.StringType) else kind.simpleString()


def _planned(df: DataFrame, contract: Contract, as_of: str | None) -> tuple[list[tuple], list[tuple[str, str, Rule]]]:
    """(verdicts known from the schema, (rule, target, check) to be measured)."""
    known, measured = [], []
    for promise in contract.columns:
        if promise.column not in df.columns:
            known.append(("schema", promise.column, False, "column missing"))
            continue
        known.append(("schema", promise.column, True, "column present"))
        family, wanted = type_family(df.schema[promise.column].dataType), TYPE_NAMES.get(promise.type.lower())
        # a whole number is an acceptable float
        fits = wanted == family or (wanted == "float" and family == "integer")
        known.append(("type", promise.column, fits, f"{promise.type}: found {family}"))
        if not promise.nullable:
            rule = Rule(promise.column, "equals", 0, metric=f"count_if({name(promise.column)} IS NULL)")
            measured.append(("not_null", promise.column, rule))
        if promise.unique:
            measured.append(("unique", promise.column, Rule(promise.column, "duplicate_row", 0, column=promise.column)))
    measured += [("check", rule.name, rule) for rule in contract.checks]
    if contract.freshness:
        column, hours = contract.freshness
        measured.append(
            ("freshness", column, Rule(column, "freshness_hours", hours, column=column, options={"as_of": as_of}))
        )
    if contract.min_rows is not None:
        measured.append(("row_count", "min", Rule("min", "row_count_at_least", contract.min_rows)))
    if contract.max_rows is not None:
        measured.append(("row_count", "max", Rule("max", "custom_sql", [0, contract.max_rows], metric="count(*)")))
    return known, measured


def validate(df: DataFrame, contract: Contract, as_of: str | None = None, only: Collection[str] | None = None, **context) -> DataFrame:
    """``contract, rule, target, value, passed, detail``: one row per promise, or per promise of the kinds in ``only``.

    Null counts, embedded checks, freshness and row counts share one aggregation, all
    uniqueness promises share one shuffle.
    """
    spark = df.sparkSession
    known, measured = _planned(df, contract, as_of)
    if only is not None:  # left out before anything is planned
        known, measured = [k for k in known if k[0] in only], [m for m in measured if m[0] in only]
    parts = []
    if known:
        rows = [
            struct(rule=literal(rule), target=literal(target), value="CAST(NULL AS DOUBLE)", passed=literal(passed),
                   detail=literal(detail))
            for rule, target, passed, detail in known
        ]
        parts.append(spark.sql(f"SELECT inline({array(rows)})"))
    if measured:
        names = "map(" + ", ".join(f"{no}, {literal(rule)}" for no, (rule, _, _) in enumerate(measured, 1)) + ")"
        found = suite.evaluate(df, [rule for _, _, rule in measured], **context)
        parts.append(found.selectExpr(
            f"{names}[check_no] AS rule", "check_name AS target", "value",
            # a check without a value fails, whatever it compares with
            "passed AND coalesce(value_text, '') <> '' AS passed", "coalesce(message, expected) AS detail",
        ))
    if not parts:
        parts = [spark.createDataFrame([], "rule string, target string, value double, passed boolean, detail string")]
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.select(F.lit(contract.name).alias("contract"), "*")


def outcome(violations: DataFrame) -> DataFrame:
    """One row: the contract holds when every promise does; an empty contract holds."""
    return violations.agg(
        F.count("*").alias("promises"), F.count_if(~F.col("passed")).alias("broken"),
        (F.count_if(~F.col("passed")) == 0).alias("passed"),
    )
