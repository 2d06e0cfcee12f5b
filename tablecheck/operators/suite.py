"""Runs many rules over one table in as few passes as their measures allow."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from tablecheck.functions import verdicts as V
from tablecheck.functions.literals import array, literal, name, struct
from tablecheck.functions.predicates import guarded_predicate
from tablecheck.operators import history_checks as H
from tablecheck.operators.checks import KINDS, Rule, orphan_count, schema_mismatches
from tablecheck.operators.distinct import key_counts
from tablecheck.sources.readers import query_source

RESULT = "check_no int, check_name string, value double, value_text string, expected string, passed boolean, message string"

Numbered = list[tuple[int, Rule]]
Failures = list[tuple[int, Rule, str]]


@dataclass
class Context:
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    history: DataFrame | None = None


def _result(no: int, rule: Rule, value: str, shown: str, passed: str, message: str | None = None) -> str:
    return struct(
        check_no=str(no), check_name=literal(rule.name), value=f"CAST({value} AS DOUBLE)",
        value_text=f"CAST({shown} AS STRING)", expected=literal(rule.expected), passed=passed,
        message=f"CAST({literal(message)} AS STRING)",
    )


def _rows(measured: DataFrame, results: list[str]) -> DataFrame:
    return measured.selectExpr(f"inline({array(results)})")


def _broken(spark: SparkSession, failures: Failures) -> list[DataFrame]:
    """Rules that could not be measured are failed rows with the reason as their message."""
    results = [_result(no, rule, "NULL", "NULL", "false", reason) for no, rule, reason in failures]
    return [spark.sql(f"SELECT inline({array(results)})")] if results else []


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {(str(error).strip().splitlines() or ['no message'])[0]}"


def _measure(df: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    """One aggregation of the whole table for all ``(name, aggregate)`` cells."""
    listed = ", ".join(f"({expression}) AS {cell}" for cell, expression in cells)
    return df.agg(F.expr(f"struct({listed}) AS measured")).selectExpr("measured.*")


def _judged(no: int, rule: Rule, cells: list[str], schema: T.StructType) -> str:
    kind = schema[cells[0]].dataType
    is_text = isinstance(kind, T.StringType)
    value = f"try_cast({cells[0]} AS DOUBLE)" if is_text else cells[0]
    if not isinstance(kind, (T.StringType, T.NumericType, T.NullType)):
        value = "NULL"  # a time or a flag has no number; its text is shown
    shown = f"concat_ws(',', {', '.join(f'CAST({c} AS STRING)' for c in cells)})" if len(cells) > 1 else cells[0]
    return _result(no, rule, value, shown, KINDS[rule.kind].verdict(rule, cells, is_text))


def _passes(kept: Numbered, cells: dict[int, list[tuple[str, str]]], schema: T.StructType) -> list[Numbered]:
    """The rules whose measures share one aggregation.

    Text buffers would take the whole aggregation out of compiled code. A second distinct count would copy every row once
    per count, with all other measures in each group; each then reads its own columns in a narrow pass.
    """
    textual = [i for i in kept if any(isinstance(schema[c].dataType, T.StringType) for c, _ in cells[i[0]])]
    distinct = [i for i in kept if i not in textual and any(re.search(r"(?i)\bdistinct\b", m) for _, m in cells[i[0]])]
    apart = distinct if len(distinct) > 1 else []
    rest = [i for i in kept if i not in textual and i not in apart]
    return [group for group in (textual, rest, *([i] for i in apart)) if group]


def _by_scan(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    """All measures in one aggregation, text-valued ones in another. A rule that does not resolve
    is taken out and reported."""
    cells: dict[int, list[tuple[str, str]]] = {}
    failures: Failures = []
    for no, rule in items:
        try:
            cells[no] = [(f"m{no}_{j}", m) for j, m in enumerate(KINDS[rule.kind].measures(rule))]
        except (ValueError, TypeError) as error:
            failures.append((no, rule, _reason(error)))
    kept = [(no, rule) for no, rule in items if no in cells]
    measured = None
    try:
        if kept:
            measured = _measure(df, [c for no, _ in kept for c in cells[no]])
    except PySparkException:
        sound = []
        for no, rule in kept:
            try:
                _measure(df, cells[no])
                sound.append((no, rule))
            except PySparkException as error:
                failures.append((no, rule, _reason(error)))
        kept = sound
        measured = _measure(df, [c for no, _ in kept for c in cells[no]]) if kept else None
    parts = _broken(df.sparkSession, failures)
    if measured is not None:
        schema = measured.schema
        for group in _passes(kept, cells, schema):
            own = measured if group == kept else _measure(df, [c for no, _ in group for c in cells[no]])
            parts.append(_rows(own, [_judged(no, r, [c for c, _ in cells[no]], schema) for no, r in group]))
    return parts


def _by_python(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    """Python predicates in a job of their own: the other measures stay in compiled code."""
    known = [(no, rule) for no, rule in items if rule.column in df.columns]
    parts = _broken(df.sparkSession, [(no, r, f"no column {r.column}") for no, r in items if r.column not in df.columns])
    if known:
        tried = df.select(*[guarded_predicate(r.value)(F.col(name(r.column))).alias(f"ok{no}") for no, r in known])
        measured = _measure(tried, [(f"m{no}_0", f"count_if(NOT ok{no})") for no, _ in known])
        parts.append(_rows(measured, [_judged(no, r, [f"m{no}_0"], measured.schema) for no, r in known]))
    return parts


def _by_query(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    """Whole scalar queries over ``source``, as scalar subqueries of one statement.

    A second column counts too where a kind compares two values. A cross-table rule has its second query in the option
    ``other_query``, over the table that the option ``table`` names. History kinds go on with their answers.
    """
    answers, good, cells, failures = [], [], {}, []

    def ask(cell: str, answer: DataFrame, columns: int) -> list[str]:
        names = [f"{cell}_{j}" for j in range(len(answer.columns))]
        first = answer.toDF(*names).limit(1)
        answers.extend(first.select(n).scalar().alias(n) for n in names[:columns])
        return names[:columns]

    for no, rule in items:
        before = len(answers)
        try:
            found = ask(f"m{no}", query_source(df, rule.query), 2 if rule.kind == "distribution_check" else 1)
            if rule.kind == "cross_table_check":
                other = ctx.tables[rule.opt("table")] if rule.opt("table") is not None else df
                found += ask(f"o{no}", query_source(other, rule.opt("other_query") or rule.query), 1)
            cells[no] = found
            good.append((no, rule))
        except Exception as error:
            del answers[before:]
            failures.append((no, rule, _reason(error)))
    parts = _broken(df.sparkSession, failures)
    if good:
        measured = df.sparkSession.sql("SELECT 1").select(*answers)
        schema = measured.schema
        plain = [(no, r) for no, r in good if KINDS[r.kind].family != "history"]
        past = [(no, r) for no, r in good if KINDS[r.kind].family == "history"]
        if plain:
            rows = []
            for no, rule in plain:
                try:
                    rows.append(_answered(no, rule, cells[no], schema))
                except Exception as error:
                    parts += _broken(df.sparkSession, [(no, rule, _reason(error))])
            parts += [_rows(measured, rows)] if rows else []
        if past:
            current = _rows(measured, [struct(check_no=str(no), name=literal(r.opt("metric_name", r.name)), value=f"try_cast({cells[no][0]} AS DOUBLE)") for no, r in past])
            parts += _against_history(df.sparkSession, current, past, ctx)
    return parts


def _answered(no: int, rule: Rule, cells: list[str], schema: T.StructType) -> str:
    """The result of a queried value; a time's age and a text of two numbers are worked out first."""
    if rule.kind == "freshness_hours":
        age = f"try_cast({V.age_hours(f'try_cast({cells[0]} AS TIMESTAMP)', rule.opt('as_of'))} AS DOUBLE)"
        return _result(no, rule, age, cells[0], KINDS[rule.kind].verdict(rule, [age], False))
    if rule.kind == "distribution_check" and isinstance(schema[cells[0]].dataType, T.StringType) and len(cells) == 1:
        two = [f"try_cast(get(split({cells[0]}, ','), {j}) AS DOUBLE)" for j in (0, 1)]
        if rule.value[1] is None:
            two = two[:1]
        return _result(no, rule, two[0], cells[0], KINDS[rule.kind].verdict(rule, two, False))
    if rule.kind == "distribution_check":
        shown = f"concat_ws(',', {', '.join(f'CAST({c} AS STRING)' for c in cells)})"
        return _result(no, rule, f"try_cast({cells[0]} AS DOUBLE)", shown, KINDS[rule.kind].verdict(rule, [f"try_cast({c} AS DOUBLE)" for c in cells], False))
    if rule.kind == "cross_table_check":
        two = [c if isinstance(schema[c].dataType, T.NumericType) else f"try_cast({c} AS DOUBLE)" for c in cells]
        return _result(no, rule, two[0], f"concat_ws(',', {', '.join(cells)})", KINDS[rule.kind].verdict(rule, two, False))
    return _judged(no, rule, cells, schema)


def _by_keys(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    sets, wanted, failures = [], [], []
    for no, rule in items:
        columns = [rule.column] if isinstance(rule.column, str) else list(rule.column or df.columns)
        missing = [c for c in columns if c not in df.columns]
        if missing:
            failures.append((no, rule, f"no column {', '.join(missing)}"))
            continue
        if columns not in sets:
            sets.append(columns)
        wanted.append((no, rule, sets.index(columns)))
    parts = _broken(df.sparkSession, failures)
    if wanted:
        # one row per key set in, one row of measures out; an empty table measures zero
        cells = []
        for no, rule, key in wanted:
            value = "duplicate_groups" if rule.opt("form") == "groups" else "total - distinct_count"
            cells.append((f"m{no}_0", f"coalesce(sum(if(key_no = {key}, {value}, 0)), 0)"))
        measured = _measure(key_counts(df, sets), cells)
        schema = measured.schema
        parts.append(_rows(measured, [_judged(no, r, [f"m{no}_0"], schema) for no, r, _ in wanted]))
    return parts


def _by_schema(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    results = []
    for no, rule in items:
        found = str(len(df.columns) if rule.kind == "schema_drift" else schema_mismatches(df, rule.value or {}))
        results.append(_result(no, rule, found, found, KINDS[rule.kind].verdict(rule, [found], False)))
    return [df.sparkSession.sql(f"SELECT inline({array(results)})")]


def _by_parent(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    parts = []
    for no, rule in items:
        table, parent_column = rule.value
        try:
            found = orphan_count(df, rule.column, ctx.tables[table], parent_column, rule.opt("not_in", False))
            parts.append(_rows(found, [_judged(no, rule, ["value"], found.schema)]))
        except Exception as error:
            parts += _broken(df.sparkSession, [(no, rule, _reason(error))])
    return parts


def _by_other(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    """One aggregation per table; their one-row answers meet by union, not by join."""
    here, there, good, failures = [], {}, [], []
    for no, rule in items:
        table, metric = rule.opt("table"), rule.opt("other_metric", rule.metric)
        try:
            kinds = _measure(df, [("a", rule.metric)]).schema, _measure(ctx.tables[table], [("b", metric)]).schema
            if not all(isinstance(kind[0].dataType, T.NumericType) for kind in kinds):
                raise TypeError("both measures must be numbers")
        except Exception as error:
            failures.append((no, rule, _reason(error)))
            continue
        here.append((f"a{no}", f"({rule.metric})"))
        there.setdefault(table, []).append((f"b{no}", f"({metric})"))
        good.append((no, rule))
    parts = _broken(df.sparkSession, failures)
    if good:
        sides = [_measure(df, here)] + [_measure(ctx.tables[t], cells) for t, cells in there.items()]
        met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
        met = _measure(met, [(f"{s}{no}", f"max({s}{no})") for no, _ in good for s in "ab"])
        parts.append(_rows(met, [
            _result(no, r, f"a{no}", f"concat_ws(',', a{no}, b{no})", KINDS[r.kind].verdict(r, [f"a{no}", f"b{no}"], False))
            for no, r in good
        ]))
    return parts


def _by_history(df: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    """Current values, all from one aggregation, against the stored points of their metrics."""
    cells = [(f"m{no}", f"CAST(({KINDS[r.kind].measures(r)[0]}) AS DOUBLE)") for no, r in items]
    current = _rows(_measure(df, cells), [
        struct(check_no=str(no), name=literal(r.opt("metric_name", r.name)), value=f"m{no}") for no, r in items
    ])
    return _against_history(df.sparkSession, current, items, ctx)


def _against_history(spark: SparkSession, current: DataFrame, items: Numbered, ctx: Context) -> list[DataFrame]:
    """Verdicts on ``current (check_no, name, value)``; rules that look at the same stretch share its statistics."""
    if ctx.history is None:
        return _broken(spark, [(no, rule, "no history given") for no, rule in items])
    metric = {no: rule.opt("metric_name", rule.name) for no, rule in items}
    points = ctx.history.where(F.col("name").isin(sorted(set(metric.values()))))
    groups: dict[tuple, Numbered] = {}
    for no, rule in items:
        key = ("z", rule.opt("points", 100)) if rule.kind == "zscore_anomaly" else ("trend", rule.opt("window", 7))
        groups.setdefault(key, []).append((no, rule))
    parts = []
    for (kind, size), members in groups.items():
        stats = H.zscore_stats(points, size) if kind == "z" else H.trend_stats(points, size)
        cases = []
        for no, rule in members:
            if kind == "trend":
                limit = 20.0 if rule.value is None else rule.value
                passed = V.trend_ok("n", "prev", "cur", size, limit, rule.opt("direction", "any"))
            else:
                limit = 3.0 if rule.value is None else rule.value
                passed = V.zscore_ok("value", "n", "mean", "std", limit, rule.opt("min_samples", 5))
            cases.append(f"WHEN {no} THEN {_result(no, rule, 'value', 'value', passed)}")
        mine = current.where(F.col("check_no").isin([no for no, _ in members])).join(stats, "name", "left")
        parts.append(_rows(mine, [f"CASE check_no {' '.join(cases)} END"]))
    return parts


_BUILDERS = {
    "scan": _by_scan, "python": _by_python, "query": _by_query, "keys": _by_keys, "schema": _by_schema,
    "parent": _by_parent, "other": _by_other, "history": _by_history,
}


def by_family(rules: list[Rule]) -> dict[str, Numbered]:
    """The rules, numbered in the given order, by how they are measured."""
    families: dict[str, Numbered] = {}
    for no, rule in enumerate(rules, 1):
        if rule.kind not in KINDS:
            raise ValueError(f"unknown assertion '{rule.kind}'; known: {', '.join(sorted(KINDS))}")
        family = "query" if rule.query else KINDS[rule.kind].family
        if rule.metric and family in ("keys", "schema", "parent"):
            family = "scan"  # the caller brings the measure, only the verdict is the kind's
        families.setdefault(family, []).append((no, rule))
    return families


def evaluate(
    df: DataFrame,
    rules: list[Rule],
    tables: Mapping[str, DataFrame] | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """One result row per rule, numbered in the given order. Nothing runs until an action.

    ``tables`` are the second tables that rules name; ``history`` the metric points
    ``(name, value, run_at)`` for history rules.
    """
    families = by_family(rules)
    if not families:
        return df.sparkSession.createDataFrame([], RESULT)
    context = Context(tables or {}, history)
    parts = [part for family, items in families.items() for part in _built(df, family, items, context)]
    return reduce(DataFrame.unionByName, parts)


def _built(df: DataFrame, family: str, items: Numbered, ctx: Context) -> list[DataFrame]:
    """The family's plans; where they cannot be built, each rule's own, or the reason why it has none."""
    try:
        return _BUILDERS[family](df, items, ctx)
    except Exception as error:
        if len(items) == 1:
            return _broken(df.sparkSession, [(*items[0], _reason(error))])
        return [part for item in items for part in _built(df, family, [item], ctx)]


def run(df: DataFrame, rules: list[Rule], **context) -> list[Row]:
    """Results as rows, one per rule. If the fused job fails, halves of the rules are run, and so on: a rule that fails
    while it runs costs a logarithm of further scans, and is a failed row with the reason."""

    def part(numbered: Numbered) -> list[Row]:
        try:
            rows = evaluate(df, [rule for _, rule in numbered], **context).collect()
            return [Row(**row.asDict() | {"check_no": numbered[row.check_no - 1][0]}) for row in rows]
        except PySparkException as error:
            if len(numbered) == 1:
                return _broken(df.sparkSession, [(*numbered[0], _reason(error))])[0].collect()
            half = len(numbered) // 2
            return part(numbered[:half]) + part(numbered[half:])

    numbered = list(enumerate(rules, 1))
    return sorted(part(numbered), key=lambda row: row.check_no) if numbered else []


def settled(df: DataFrame, rules: list[Rule], **context) -> DataFrame:
    """``run`` as a table of one row per rule, for those who store results: no rule can end the job."""
    rows = [tuple(row[part.split()[0]] for part in RESULT.split(", ")) for row in run(df, rules, **context)]
    return df.sparkSession.createDataFrame(rows, RESULT)


def summary(results: DataFrame) -> DataFrame:
    """``total, passed, failed, status, exit_code``; no result at all counts as OK."""
    failed = "count_if(NOT passed)"
    return _measure(results, [
        ("total", "count(1)"), ("passed", "count_if(passed)"), ("failed", failed),
        ("status", f"if({failed} = 0, 'OK', 'FAIL')"), ("exit_code", f"if({failed} = 0, 0, 1)"),
    ])
