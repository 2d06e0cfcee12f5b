"""Document filters as SQL predicates.

A condition on a path holds if any value it leads to meets it: the path goes through the elements of arrays, and an
array at its end is met by itself and by its elements. Values meet only constants of their own kind. ``None`` is met by null
and, on its own or in ``$in``, by a missing field. ``$ne``, ``$nin``, ``$not`` and ``$nor`` are exact opposites.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from tablecheck.functions.literals import text
from tablecheck.sources import variants as V

_RELATIONS = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def _any(values: str, test) -> str:
    x = V.fresh()
    return f"exists({values}, {x} -> {test(x)})"


def _candidates(values: str) -> str:
    """The values and, of those that are arrays, the elements."""
    x = V.fresh()
    return f"concat({values}, flatten(transform({values}, {x} -> coalesce({V.elements(x)}, array()))))"


def _regex(pattern: str, options: str) -> str:
    if set(options) - set("ims"):
        raise ValueError(f"unknown regex options {options!r}")
    return f"(?{options}){pattern}" if options else pattern


def _equal(values: str, value: Any) -> str:
    met = _any(_candidates(values), lambda x: V.equals(x, value))
    return f"(size({values}) = 0 OR {met})" if value is None else met


def _kinds(value: Any):
    tests = {
        "number": ("whole", "real"), "int": ("whole",), "long": ("whole",), "double": ("real",), "string": ("texts",), "bool": ("flag",),
        "object": ("objects",), "array": ("array",), "null": ("nothing",),
    }
    names = value if isinstance(value, list) else [value]
    if unknown := [n for n in names if n not in tests]:
        raise ValueError(f"unknown types {unknown}; known: {', '.join(tests)}")
    met = {kind: "true" for n in names for kind in tests[n]}
    return lambda x: f"coalesce({V.by_kind(x, **met)}, false)"


def _operator(values: str, op: str, value: Any, spec: Mapping[str, Any]) -> str:
    """One operator on the values that a path leads to."""
    if op == "$eq":
        return _equal(values, value)
    if op == "$ne":
        return f"NOT {_equal(values, value)}"
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{op} takes a list")
        met = "(" + (" OR ".join(_equal(values, v) for v in value) or "false") + ")"
        return met if op == "$in" else f"NOT {met}"
    if op in _RELATIONS:
        return _any(_candidates(values), lambda x: V.compared(x, _RELATIONS[op], value))
    if op == "$exists":
        return f"size({values}) {'>' if value else '='} 0"
    if op == "$regex":
        pattern = text(_regex(value, spec.get("$options", "")))
        return _any(_candidates(values), lambda x: f"coalesce({V.as_text(x)} RLIKE {pattern}, false)")
    if op == "$options":
        if "$regex" not in spec:
            raise ValueError("$options belongs to $regex")
        return "true"
    if op == "$mod":
        divisor, rest = value
        return _any(_candidates(values), lambda x: f"coalesce({V.as_number(x)} % {int(divisor)} = {int(rest)}, false)")
    if op == "$size":
        return _any(values, lambda x: f"coalesce(size({V.elements(x)}) = {int(value)}, false)")
    if op == "$type":
        return _any(_candidates(values), _kinds(value))
    if op == "$all":
        return "(" + (" AND ".join(_equal(values, v) for v in value) or "false") + ")"
    if op == "$elemMatch":
        inner = _inside(value)
        return _any(values, lambda x: f"coalesce({_any(V.elements(x), inner)}, false)")
    if op == "$not":
        if not isinstance(value, Mapping) or not _is_operators(value):
            raise ValueError("$not takes operators")
        return f"NOT {_operators(values, value)}"
    raise ValueError(f"unknown operator {op}")


def _is_operators(spec: Any) -> bool:
    return isinstance(spec, Mapping) and bool(spec) and all(str(k).startswith("$") for k in spec)


def _operators(values: str, spec: Mapping[str, Any]) -> str:
    return "(" + " AND ".join(_operator(values, op, v, spec) for op, v in spec.items()) + ")"


def _inside(spec: Mapping[str, Any]):
    """The test of one array element: operators on itself, or a filter on its fields."""
    if not isinstance(spec, Mapping):
        raise ValueError("$elemMatch takes operators or a filter")
    if _is_operators(spec) and not set(spec) & {"$and", "$or", "$nor"}:
        return lambda x: _operators(f"array({x})", spec)
    return lambda x: f"({V.is_object(x)} AND {predicate(spec, x)})"


def predicate(condition: Mapping[str, Any], doc: str | Callable[[str], tuple[str, list[str]]] = "doc") -> str:
    """The SQL predicate of a filter over a VARIANT column; it is true or false, never NULL.

    ``doc`` may be a function that tells, for a path, the VARIANT expression from which it starts and the steps left.

    Equality, ``$eq $ne $in $nin $gt $gte $lt $lte $exists $regex $mod $size $type $all $elemMatch $not`` on paths, ``$and $or
    $nor`` around filters. What is not understood is a ``ValueError``.
    """
    if not isinstance(condition, Mapping):
        raise ValueError("a filter is a mapping")
    start = doc if callable(doc) else lambda path: (doc, V.steps(path))
    tests = []
    for name, spec in condition.items():
        if name in ("$and", "$or", "$nor"):
            if not isinstance(spec, list) or not spec:
                raise ValueError(f"{name} takes a list of filters")
            joined = "(" + (" AND " if name == "$and" else " OR ").join(predicate(c, doc) for c in spec) + ")"
            tests.append(f"NOT {joined}" if name == "$nor" else joined)
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif _is_operators(spec):
            tests.append(V.let(V.reached(*start(name)), lambda values, spec=spec: _operators(values, spec)))
        else:
            tests.append(V.let(V.reached(*start(name)), lambda values, spec=spec: _equal(values, spec)))
    return "(" + (" AND ".join(tests) or "true") + ")"
