"""Expressions over documents without a schema: paths, kinds, equality and order of VARIANT values, as SQL text.

A missing field is NULL, a null field is a VARIANT that holds null. Values of different kinds are never equal and
never compared; whole numbers and fractions are one kind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime
from itertools import count
from typing import Any

from tablecheck.functions.literals import literal, text

_names = count()

NOTHING = "parse_json('null')"
MISSING = "CAST(NULL AS VARIANT)"


def fresh(prefix: str = "x") -> str:
    """A name for a lambda variable that no other lambda has."""
    return f"{prefix}{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(name)`` with the value computed once."""
    v = fresh("l")
    return f"transform(array({value}), {v} -> {body(v)})[0]"


# --- kinds

_WHOLE, _REAL = "('TIN', 'SMA', 'INT', 'BIG')", "('FLO', 'DOU', 'DEC')"


def kind(v: str) -> str:
    """Three letters of a value's type; NULL where it is missing. Taken once per value, as it looks at nested ones too."""
    return f"left(schema_of_variant({v}), 3)"


def by_kind(v: str, known: str | None = None, *, whole: str = "NULL", real: str = "NULL", texts: str = "NULL", flag: str = "NULL", array: str = "NULL", objects: str = "NULL", nothing: str = "NULL", other: str = "NULL") -> str:
    """One of the results, by the kind of a value. ``known`` is an expression of its kind, where there is one.

    Only kinds that have a result are asked for; the kind of a value that is asked for once needs no lambda.
    """
    results = [
        ("{k} IS NULL OR {k} = 'VOI'", nothing), ("{k} = 'STR'", texts), (f"{{k}} IN {_WHOLE}", whole), (f"{{k}} IN {_REAL}", real),
        ("{k} = 'BOO'", flag), ("{k} = 'ARR'", array), ("{k} = 'OBJ'", objects),
    ]
    if whole == real:
        results[2:4] = [(f"{{k}} IN {_WHOLE[:-1]}, {_REAL[1:]}", whole)]
    asked = [(test, result) for test, result in results if result != other]

    def cases(k: str) -> str:
        whens = " ".join(f"WHEN {test.format(k=k)} THEN {result}" for test, result in asked)
        return f"CASE {whens} ELSE {other} END" if asked else other

    if known or len(asked) == 1 and nothing == other:
        return cases(known or kind(v))
    return let(kind(v), cases)


def number(v: str) -> str:
    return f"try_variant_get({v}, '$', 'double')"


def whole(v: str) -> str:
    return f"try_variant_get({v}, '$', 'bigint')"


def shown(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def as_number(v: str, known: str | None = None) -> str:
    """The number, NULL for every other value."""
    return by_kind(v, known, whole=number(v), real=number(v))


def as_whole(v: str, known: str | None = None) -> str:
    return by_kind(v, known, whole=whole(v))


def as_text(v: str, known: str | None = None) -> str:
    return by_kind(v, known, texts=shown(v))


def elements(v: str) -> str:
    """An array's elements, NULL for every other value."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL)"


def is_nothing(v: str) -> str:
    """Null or missing."""
    return f"({v} IS NULL OR is_variant_null({v}))"


def constant(value: Any) -> str:
    """A Python value as a VARIANT; objects by their fields."""
    if value is None:
        return NOTHING
    if isinstance(value, Mapping):
        return built({k: constant(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return f"to_variant_object(array({', '.join(map(constant, value))}))" if value else "parse_json('[]')"
    if isinstance(value, bool):
        return f"CAST({str(value).lower()} AS VARIANT)"
    if isinstance(value, int):
        return f"CAST({value}L AS VARIANT)"
    if isinstance(value, float):
        return f"CAST(CAST({literal(value)} AS DOUBLE) AS VARIANT)"
    if isinstance(value, (date, datetime)):
        return f"CAST({text(value.isoformat())} AS VARIANT)"
    return f"CAST({text(str(value))} AS VARIANT)"


# --- paths and fields


def steps(path: str) -> list[str]:
    parts = path.split(".")
    if not all(parts):
        raise ValueError(f"a path has a name between its dots, not {path!r}")
    return parts


def _quoted(name: str) -> str:
    if "'" in name and '"' in name:
        raise ValueError(f"a field name has one kind of quotes at most, not {name!r}")
    return f'["{name}"]' if "'" in name else f"['{name}']"


def field(v: str, *names: str) -> str:
    """The field of an object, or what lies below nested objects; NULL where there is none."""
    return f"try_variant_get({v}, {text('$' + ''.join(map(_quoted, names)))}, 'variant')" if names else v


def reached(v: str, names: list[str]) -> str:
    """All values that a path leads to, as ARRAY<VARIANT>: through the elements of arrays, by field and by number.

    What plain objects lead to needs one look; only where that finds nothing, the way is gone step by step.
    """
    values = f"array({v})"
    for name in names:
        x, e, y = fresh(), fresh("e"), fresh("y")
        own = f"array({field(x, name)}" + (f", try_variant_get({x}, '$[{int(name)}]', 'variant')" if name.isdigit() else "") + ")"
        inner = f"coalesce(transform({elements(x)}, {e} -> {field(e, name)}), array())"
        values = f"filter(flatten(transform({values}, {x} -> concat({own}, {inner}))), {y} -> {y} IS NOT NULL)"
    if not names:
        return f"array_compact({values})"
    return let(field(v, *names), lambda found: f"if({found} IS NOT NULL, array({found}), {values})")


def value_at(v: str, names: list[str]) -> str:
    """What an expression sees at a path: below an array the array of what its elements have there."""
    def way(at: str, left: list[str]) -> str:
        if not left:
            return at

        def step(x: str) -> str:
            e, y = fresh("e"), fresh("y")
            listed = f"to_variant_object(filter(transform({elements(x)}, {e} -> {way(field(e, left[0]), left[1:])}), {y} -> {y} IS NOT NULL))"
            return f"if({elements(x)} IS NOT NULL, {listed}, {way(field(x, left[0]), left[1:])})"

        return let(at, step)

    return f"coalesce({field(v, *names)}, {way(v, names)})" if names else v


def built(fields: Mapping[str, str]) -> str:
    """An object of the fields whose values are not missing."""
    if not fields:
        return "parse_json('{}')"
    k, x = fresh("k"), fresh()
    pairs = ", ".join(f"{text(n)}, {v}" for n, v in fields.items())
    return f"to_variant_object(map_filter(map({pairs}), ({k}, {x}) -> {x} IS NOT NULL))"


def with_fields(v: str, fields: Mapping[str, str]) -> str:
    """An object with fields set, left out where their value is missing; what is no object counts as an empty one."""
    k, x, k2, x2 = fresh("k"), fresh(), fresh("k"), fresh()
    pairs, names = ", ".join(f"{text(n)}, {e}" for n, e in fields.items()), ", ".join(text(n) for n in fields)
    held = f"map_filter(coalesce(try_variant_get({v}, '$', 'map<string,variant>'), map()), ({k}, {x}) -> {k} NOT IN ({names}))"
    return f"to_variant_object(map_filter(map_concat({held}, map({pairs})), ({k2}, {x2}) -> {x2} IS NOT NULL))"


def with_path(v: str, names: list[str], value: str) -> str:
    """The value with what lies at a path below it set; objects on the way are made."""
    if not names:
        return value
    return let(v, lambda x: with_fields(x, {names[0]: with_path(field(x, names[0]), names[1:], value)}))


# --- order and equality


def sort_key(v: str, known: str | None = None) -> str:
    """Something comparable for any value: nothing, numbers, texts, objects, arrays, flags, in that order."""
    def key(rank: int, n: str = "0D", w: str = "0L", s: str = "''") -> str:
        return f"named_struct('rank', {rank}, 'number', {n}, 'whole', {w}, 'shown', {s})"

    json = f"to_json({v})"
    return by_kind(v, known, nothing=key(1), whole=key(2, number(v), whole(v)), real=key(2, number(v)), texts=key(3, s=shown(v)), objects=key(4, s=json), array=key(5, s=json), flag=key(8, s=json), other=key(9, s=json))


def key_text(v: str, known: str | None = None) -> str:
    """A JSON text that is equal exactly when the values are; 1 and 1.0 are equal, null and missing too."""
    real = f"if({number(v)} = floor({number(v)}) AND abs({number(v)}) < 9e15D, CAST(CAST({number(v)} AS BIGINT) AS STRING), CAST({number(v)} AS STRING))"
    json = f"to_json({v})"
    return by_kind(v, known, nothing="'null'", whole=f"CAST({whole(v)} AS STRING)", real=real, texts=json, objects=json, array=json, flag=json, other=json)


def compared(v: str, op: str, value: Any) -> str:
    """Whether one value stands in a relation (SQL operator) to a constant of its own kind."""
    if isinstance(value, bool):
        met = by_kind(v, flag=f"try_variant_get({v}, '$', 'boolean') {op} {str(value).lower()}")
    elif isinstance(value, int):
        met = by_kind(v, whole=f"{whole(v)} {op} {value}L", real=f"{number(v)} {op} CAST({value} AS DOUBLE)")
    elif isinstance(value, float):
        met = by_kind(v, whole=f"{number(v)} {op} CAST({literal(value)} AS DOUBLE)", real=f"{number(v)} {op} CAST({literal(value)} AS DOUBLE)")
    elif isinstance(value, (str, date, datetime)):
        met = by_kind(v, texts=f"{shown(v)} {op} {text(value if isinstance(value, str) else value.isoformat())}")
    else:
        raise ValueError(f"cannot compare with {value!r}")
    return f"coalesce({met}, false)"


def equals(v: str, value: Any) -> str:
    """Whether one value equals a constant; arrays element by element, null only with null."""
    if value is None:
        return f"coalesce(is_variant_null({v}), false)"
    if isinstance(value, Mapping):
        raise ValueError("whole objects are not compared; name their fields with dots")
    if isinstance(value, (list, tuple)):
        def alike(own: str) -> str:
            return " AND ".join([f"size({own}) = {len(value)}", *(equals(f"get({own}, {i})", x) for i, x in enumerate(value))])

        return f"coalesce({let(elements(v), alike)}, false)"
    return compared(v, "=", value)
