"""Pass/fail predicates as SQL text over a measured value. A NULL verdict is a failure."""

from __future__ import annotations

from decimal import Decimal

from tablecheck.functions.literals import literal, number, text


def settled(verdict: str) -> str:
    return f"coalesce({verdict}, false)"


def present_and_nonzero(v: str) -> str:
    return settled(f"{v} IS NOT NULL AND {v} <> 0")


def below(v: str, limit) -> str:
    return settled(f"{v} < {number(limit)}")


def above(v: str, limit) -> str:
    return settled(f"{v} > {number(limit)}")


def at_most(v: str, limit) -> str:
    return settled(f"{v} <= {number(limit)}")


def within(v: str, low, high) -> str:
    return settled(f"{v} BETWEEN {number(low)} AND {number(high)}")


def _equals_number(v: str, expected) -> str:
    """Equality with a number; whole numbers are compared in full, also where a DOUBLE would round them."""
    equal = f"try_cast({v} AS DOUBLE) <=> {number(expected)}"
    if float(expected).is_integer() and abs(float(expected)) < 1e37:
        equal += f" AND coalesce(try_cast({v} AS DECIMAL(38, 0)) = {int(expected)}BD, true)"
    return f"({equal})"


def same(v: str, expected, is_text: bool) -> str:
    """No coercion: a text never equals a number. Only an expected None equals NULL."""
    if expected is None:
        return f"{v} IS NULL"
    if isinstance(expected, str) != is_text:
        return "false"
    return f"{v} <=> {text(expected)}" if is_text else _equals_number(v, expected)


def count_at_least(v: str, n: int) -> str:
    return settled(f"CAST({v} AS BIGINT) >= {n}")


def count_between(v: str, low: int, high: int) -> str:
    return settled(f"CAST({v} AS BIGINT) BETWEEN {low} AND {high}")


def count_is(v: str, n: int) -> str:
    return settled(f"CAST({v} AS BIGINT) = {n}")


def text_filled(v: str) -> str:
    return settled(f"CAST({v} AS STRING) RLIKE '\\\\S'")


def text_in(v: str, allowed: list) -> str:
    """Membership by the value's type: texts as texts, numbers and flags also by their number."""
    listed = [a for a in allowed if a is not None]
    spelled = ", ".join(dict.fromkeys(text(t) for a in listed for t in ([str(a), str(a).lower()] if isinstance(a, bool) else [str(a)])))
    hits = [f"CAST({v} AS STRING) IN ({spelled})"] if listed else []
    numbers = [a for a in listed if isinstance(a, (int, float, Decimal))]
    if numbers:
        equal = " OR ".join(_equals_number(v, a) for a in numbers)
        hits.append(f"(typeof({v}) <> 'string' AND ({equal}))")
    hit = settled(" OR ".join(f"coalesce({h}, false)" for h in hits)) if hits else "false"
    return f"({hit} OR {v} IS NULL)" if None in allowed else hit


def text_starts_with_pattern(v: str, pattern: str) -> str:
    """The pattern is anchored at the start of the text only."""
    return settled(f"CAST({v} AS STRING) RLIKE {text(f'^(?:{pattern})')}")


def null_ratio_ok(v: str, min_ratio: float) -> str:
    return settled(f"round({v}, 10) <= {number(round(1.0 - min_ratio, 10))}")


def custom_expected(v: str, expected) -> str:
    """None: any value; a pair: inclusive range; a number: equality."""
    if expected is None:
        return f"{v} IS NOT NULL"
    if isinstance(expected, (list, tuple)) and len(expected) == 2:
        return within(v, expected[0], expected[1])
    return settled(f"{v} = {number(expected)}")


def volume_change_ok(v: str, baseline: str | None, max_pct: float) -> str:
    """Without a baseline (None, or NULL in the row) any positive volume passes."""
    if baseline is None:
        return settled(f"{v} > 0")
    change = f"try_divide(abs({v} - {baseline}), {baseline}) * 100"
    return settled(
        f"CASE WHEN {baseline} IS NULL THEN {v} > 0 WHEN {baseline} = 0 THEN {v} = 0 "
        f"ELSE {change} <= {number(max_pct)} END"
    )


def compare(a: str, b: str, comparator: str, tolerance: float = 0.0) -> str:
    simple = {"equals": "=", "less_than": "<", "greater_than": ">"}
    if comparator in simple:
        return settled(f"{a} {simple[comparator]} {b}")
    if comparator == "within_pct":
        gap = f"try_divide(abs({a} - {b}), abs({b})) * 100"
        return settled(f"CASE WHEN {b} = 0 THEN {a} = 0 ELSE {gap} <= {number(tolerance)} END")
    return "false"


def deviation_pct(actual: str, expected: float) -> str:
    """Deviation relative to the expected value; relative to 1 when that is zero."""
    return f"abs({actual} - {number(expected)}) / {number(abs(float(expected)) or 1.0)} * 100"


def distribution_ok(mean: str, std: str | None, expected_mean, expected_std, tolerance: float) -> str:
    verdict = f"{deviation_pct(mean, expected_mean)} <= {number(tolerance)}"
    if std is not None and expected_std is not None:
        verdict += f" AND {deviation_pct(std, expected_std)} <= {number(tolerance)}"
    return settled(verdict)


def zscore_ok(v: str, n: str, mean: str, std_pop: str, max_z: float, min_samples: int) -> str:
    """Too little history or a constant history passes."""
    return settled(
        f"CASE WHEN coalesce({n}, 0) < {min_samples} OR {std_pop} = 0 THEN true "
        f"ELSE try_divide(abs({v} - {mean}), {std_pop}) <= {number(max_z)} END"
    )


def trend_ok(n: str, previous: str, current: str, window: int, max_pct: float, direction: str) -> str:
    change = f"try_divide({current} - {previous}, abs({previous})) * 100"
    limit = number(max_pct)
    bounded = {"up": f"{change} <= {limit}", "down": f"{change} >= -{limit}"}.get(
        direction, f"abs({change}) <= {limit}"
    )
    return settled(
        f"CASE WHEN coalesce({n}, 0) < {2 * window} THEN true WHEN {previous} = 0 THEN {current} = 0 "
        f"ELSE {bounded} END"
    )


def age_hours(ts: str, as_of: str | None = None) -> str:
    moment = "current_timestamp()" if as_of is None else f"CAST({literal(as_of)} AS TIMESTAMP)"
    return f"(unix_micros({moment}) - unix_micros(CAST({ts} AS TIMESTAMP))) / 3.6e9D"
