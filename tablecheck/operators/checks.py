"""Check kinds: what each one measures on a table and how the measure is judged.

A kind belongs to a family that says how its measure is obtained:

``scan``     aggregates of the table itself; all of them share one aggregation
``python``   rows that a user's Python predicate rejects
``keys``     distinct and duplicate counts; all of them share one narrow shuffle
``schema``   known from the schema, no data read
``parent``   child keys without a parent row (anti join)
``other``    the same measure on a second table
``history``  compared with the stored history of a metric
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tablecheck.functions import verdicts as V
from tablecheck.functions.literals import name, number


@dataclass(frozen=True)
class Rule:
    """One check. ``value`` is the expectation, ``column`` or ``metric`` what is measured.

    ``metric`` is an aggregate SQL expression; ``query`` a whole scalar query over the view
    ``source``, of which the first column of the first row counts.
    """

    name: str
    kind: str
    value: Any = None
    column: str | list[str] | None = None
    metric: str | None = None
    query: str | None = None
    tags: tuple[str, ...] = ()
    options: Mapping[str, Any] = field(default_factory=dict)

    @property
    def expected(self) -> str:
        return f"{self.kind}({self.value})"

    def opt(self, option: str, default=None):
        return self.options.get(option, default)


@dataclass(frozen=True)
class Kind:
    """``measures`` gives aggregate expressions as SQL text, ``verdict`` judges their values.

    The verdict sees the names of the measured columns and whether the first one is a text.
    """

    family: str
    measures: Callable[[Rule], list[str]]
    verdict: Callable[[Rule, list[str], bool], str] | None


def quoted(column: str) -> Column:
    return F.col(name(column))


def _free(rule: Rule) -> list[str]:
    if rule.metric is None:
        raise ValueError(f"check '{rule.name}': {rule.kind} needs a metric or a query")
    return [rule.metric]


def _rows(rule: Rule) -> list[str]:
    return [rule.metric or "count(1)"]


def _violations(test: Callable[[Rule, str], str]):
    """Rows of ``rule.column`` that fail the test; without a column, the free metric is tested."""

    def measures(rule: Rule) -> list[str]:
        return _free(rule) if rule.column is None else [f"count_if(NOT ({test(rule, name(rule.column))}))"]

    def verdict(rule: Rule, m: list[str], is_text: bool) -> str:
        return test(rule, m[0]) if rule.column is None else V.count_is(m[0], 0)

    return measures, verdict


def _accepted(rule: Rule, v: str) -> str:
    hit = V.text_in(v, list(rule.value))
    return hit if rule.opt("count_nulls", True) else f"({hit} OR {v} IS NULL)"


def _null_ratio(rule: Rule) -> list[str]:
    return [rule.metric or f"try_divide(count(1) - count({name(rule.column)}), count(1))"]


def _mean_z(rule: Rule) -> list[str]:
    if rule.metric:
        return [rule.metric]
    c, centre = name(rule.column), number(rule.opt("expected", 0.0))
    return [f"try_divide(abs(avg({c}) - {centre}), stddev_samp({c}))"]


def _distribution(rule: Rule) -> list[str]:
    if rule.metric:
        return [rule.metric]
    c = name(rule.column)
    return [f"avg({c})"] + ([f"stddev_samp({c})"] if rule.value[1] is not None else [])


def _number(v: str) -> str:
    """A measure as a number; a text that is none has no verdict."""
    return f"try_cast({v} AS DOUBLE)"


def _limit(test):
    return lambda rule, m, is_text: test(_number(m[0]), rule.value)


def _pair(test):
    return lambda rule, m, is_text: test(_number(m[0]), rule.value[0], rule.value[1])


def _no_violation(rule: Rule, m: list[str], is_text: bool) -> str:
    return V.count_is(m[0], 0)


KINDS: dict[str, Kind] = {
    "is_not_null": Kind("scan", _free, lambda r, m, t: V.present_and_nonzero(_number(m[0]))),
    "less_than": Kind("scan", _free, _limit(V.below)),
    "greater_than": Kind("scan", _free, _limit(V.above)),
    "between": Kind("scan", _free, _pair(V.within)),
    "equals": Kind("scan", _free, lambda r, m, t: V.same(m[0], r.value, t)),
    "row_count_at_least": Kind("scan", _rows, _limit(V.count_at_least)),
    "row_count_between": Kind("scan", _rows, _pair(V.count_between)),
    "not_empty": Kind("scan", *_violations(lambda r, v: V.text_filled(v))),
    "accepted_values": Kind("scan", *_violations(_accepted)),
    "regex_match": Kind("scan", *_violations(lambda r, v: V.text_starts_with_pattern(v, r.value))),
    "freshness_hours": Kind(
        "scan", lambda r: [V.age_hours(r.metric or f"max({name(r.column)})", r.opt("as_of"))], _limit(V.at_most)
    ),
    "completeness_ratio": Kind("scan", _null_ratio, _limit(V.null_ratio_ok)),
    "statistical_anomaly": Kind("scan", _mean_z, _limit(V.at_most)),
    "custom_sql": Kind("scan", _free, _limit(V.custom_expected)),
    "volume_anomaly": Kind(
        "scan", _rows,
        lambda r, m, t: V.volume_change_ok(
            _number(m[0]), None if r.opt("baseline") is None else number(r.opt("baseline")),
            50.0 if r.value is None else r.value,
        ),
    ),
    "row_condition": Kind("scan", lambda r: [r.metric or f"count_if(NOT ({r.value}))"], _no_violation),
    "distribution_check": Kind(
        "scan", _distribution,
        lambda r, m, t: V.distribution_ok(
            _number(m[0]), m[1] if len(m) > 1 else None, r.value[0], r.value[1], r.opt("tolerance_pct", 10.0)
        ),
    ),
    "custom_script": Kind("python", _free, _no_violation),
    "duplicate_row": Kind("keys", _free, lambda r, m, t: V.at_most(_number(m[0]), r.value or 0)),
    "schema_drift": Kind("schema", _free, _limit(V.count_is)),
    "schema_check": Kind("schema", _free, _no_violation),
    "referential_integrity": Kind("parent", _free, _no_violation),
    "cross_table_check": Kind(
        "other", _free,
        lambda r, m, t: V.compare(m[0], m[1], r.opt("comparator", "equals"), r.opt("tolerance", 0.0)),
    ),
    "zscore_anomaly": Kind("history", _rows, None),
    "trend_check": Kind("history", _rows, None),
}


def rule_from_dict(raw: Mapping[str, Any]) -> Rule:
    """A rule from its declarative form: ``name``, ``assert``, ``value`` and what to measure."""
    kind = raw["assert"]
    if kind not in KINDS:
        raise ValueError(f"unknown assertion '{kind}'; known: {', '.join(sorted(KINDS))}")
    known = ("name", "assert", "value", "column", "metric", "query", "tags")
    return Rule(
        name=raw["name"], kind=kind, value=raw.get("value"), column=raw.get("column"),
        metric=raw.get("metric"), query=raw.get("query"), tags=tuple(raw.get("tags", ())),
        options={k: v for k, v in raw.items() if k not in known},
    )


def registered_value(written: str | None) -> Any:
    """An expectation as the registry keeps it, in text: a number, a list, a flag, nothing, or else a text."""
    if written is None or written.strip() in ("", "None", "null"):
        return None
    try:
        return ast.literal_eval({"true": "True", "false": "False"}.get(written.strip(), written.strip()))
    except (ValueError, SyntaxError):
        return written


def rule_from_registry(row: Mapping[str, Any]) -> Rule:
    """A rule from a row ``name, query, assert_type, assert_value, tags`` of the registry."""
    return rule_from_dict({
        "name": row["name"], "assert": row["assert_type"], "value": registered_value(row["assert_value"]),
        "query": row["query"], "tags": tuple(row["tags"] or ()),
    })


def with_tags(rules: list[Rule], tags: list[str] | None) -> list[Rule]:
    """Rules that carry any of the tags; all of them when no tag is asked for."""
    return [r for r in rules if set(tags) & set(r.tags)] if tags else list(rules)


# -- measures that need more than one aggregation of the table ---------------------------------


def orphan_count(child: DataFrame, column: str, parent: DataFrame, parent_column: str, not_in: bool = False) -> DataFrame:
    """One row ``value``: child rows whose key is missing in the parent; NULL keys are no orphans.

    Child and parent keys are grouped together instead of joined: each task sends one row per key,
    so a key that holds much of either table costs no more than any other, nothing is broadcast,
    and the optimizer has no join that it could move below the grouping. ``not_in`` follows SQL's
    NOT IN: any NULL among the parent keys leaves nothing to report.
    """
    rows = child.select(quoted(column).alias("k"), F.lit(1).alias("child")).where("k IS NOT NULL")
    keys = parent.select(quoted(parent_column).alias("k"), F.lit(0).alias("child"))
    per_key = rows.unionByName(keys).groupBy("k").agg(
        F.expr("count_if(child = 1) AS n"), F.expr("count_if(child = 0) > 0 AS known")
    )
    orphans = "coalesce(sum(if(known, 0, n)), 0)"
    value = f"if(coalesce(bool_or(k IS NULL), false), 0, {orphans})" if not_in else orphans
    return per_key.agg(F.expr(f"CAST({value} AS DOUBLE) AS value"))


def schema_mismatches(df: DataFrame, expected: Mapping[str, str | None]) -> int:
    """Expected columns that are absent or whose type name does not contain the expected text."""
    actual = {f.name.lower(): f.dataType.simpleString().lower() for f in df.schema.fields}
    return sum(
        column.lower() not in actual or (kind is not None and kind.lower() not in actual[column.lower()])
        for column, kind in expected.items()
    )
