"""Document pipelines as DataFrame plans.

Between stages documents are not put together: ``Docs`` knows which of their fields are columns of their own and which still
lie in the document that was read. A stage that sets or groups makes columns; documents are built when they are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field as attribute, replace
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.literals import name as quoted
from tablecheck.sources import variants as V
from tablecheck.sources.document_filters import predicate


@dataclass(frozen=True)
class Docs:
    """Rows of ``df`` as documents: the VARIANT column ``base`` (or none), and ``fields`` of the document that are VARIANT
    columns instead; a field whose column is None is left out."""

    df: DataFrame
    base: str | None = "doc"
    fields: Mapping[str, str | None] = attribute(default_factory=dict)

    def start(self, path: str) -> tuple[str, list[str]]:
        """Where a path begins, and the steps left from there."""
        head, *rest = V.steps(path)
        if head in self.fields:
            return (self.fields[head] or V.MISSING), rest
        return (self.base, [head, *rest]) if self.base else (V.MISSING, [])

    def at(self, path: str) -> str:
        return V.value_at(*self.start(path))

    def whole(self) -> str:
        """The VARIANT of the whole document."""
        own = {n: c or V.MISSING for n, c in self.fields.items()}
        if self.base is None:
            return V.built(own)
        return V.with_fields(self.base, own) if own else self.base

    def frame(self) -> DataFrame:
        """One VARIANT column ``doc``."""
        return self.df.selectExpr(f"{self.whole()} AS doc")

    def columns(self, schema: str) -> DataFrame:
        """Typed columns of the documents; what is missing or of another type is NULL. Dots of names become underscores."""
        parts = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
        return self.df.selectExpr(*(f"try_variant_get({self.at(n)}, '$', '{kind}') AS {quoted(n.replace('.', '_'))}" for n, kind in parts))


Collections = Mapping[str, "Docs | DataFrame"]


def documents(df: DataFrame, column: str) -> Docs:
    """Documents from JSON texts; a text that is no document gives no row.

    They come out of a generator, below which no filter on them is moved: that would parse every text once more.
    """
    parsed = df.selectExpr(f"inline(array(struct(try_parse_json({quoted(column)}) AS doc)))")
    return Docs(parsed.where(V.is_object("doc")))


def _docs(given: Docs | DataFrame) -> Docs:
    return given if isinstance(given, Docs) else Docs(given.select("doc"))


# --- expressions


def _arithmetic(op: str, keeps_whole: bool):
    """Whole numbers stay whole where the operator keeps them; nothing, and what is no number, gives null."""
    tried = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "%": "try_mod", "/": "try_divide"}[op]

    def two(a: str, b: str) -> str:
        real = f"CAST({tried}({V.as_number(a)}, {V.as_number(b)}) AS VARIANT)"
        if keeps_whole:
            return f"coalesce(CAST({tried}({V.as_whole(a)}, {V.as_whole(b)}) AS VARIANT), {real}, {V.NOTHING})"
        return f"coalesce({real}, {V.NOTHING})"

    def build(args: list[str]) -> str:
        out = args[0]
        for b in args[1:]:
            out = V.let(out, lambda x, b=b: V.let(b, lambda y: two(x, y)))
        return out

    return build


def _relation(op: str):
    return lambda args: V.let(args[0], lambda a: V.let(args[1], lambda b: f"CAST({V.sort_key(a)} {op} {V.sort_key(b)} AS VARIANT)"))


def truth(v: str) -> str:
    """Nothing, zero and false are false."""
    return V.let(v, lambda x: V.by_kind(x, nothing="false", whole=f"{V.whole(x)} <> 0", real=f"{V.number(x)} <> 0", flag=f"try_variant_get({x}, '$', 'boolean')", texts="true", array="true", objects="true", other="true"))


def _or_nothing(value: str) -> str:
    return f"coalesce(CAST({value} AS VARIANT), {V.NOTHING})"


def _one(body, otherwise: str = V.NOTHING):
    """An operator of one argument that is looked at several times."""
    return lambda args: V.let(args[0], lambda x: f"coalesce(CAST({body(x)} AS VARIANT), {otherwise})")


def _logic(join: str):
    return lambda args: f"CAST(({join.join(truth(a) for a in args)}) AS VARIANT)"


_OPERATORS = {
    "$add": _arithmetic("+", True), "$subtract": _arithmetic("-", True), "$multiply": _arithmetic("*", True), "$divide": _arithmetic("/", False), "$mod": _arithmetic("%", True),
    "$eq": _relation("="), "$ne": _relation("<>"), "$gt": _relation(">"), "$gte": _relation(">="), "$lt": _relation("<"), "$lte": _relation("<="),
    "$and": _logic(" AND "), "$or": _logic(" OR "), "$not": lambda args: f"CAST(NOT {truth(args[0])} AS VARIANT)",
    "$concat": lambda args: _or_nothing(f"concat({', '.join(V.let(a, V.as_text) for a in args)})"),
    "$size": _one(lambda x: f"CAST(size({V.elements(x)}) AS BIGINT)"), "$floor": _one(lambda x: f"CAST(floor({V.as_number(x)}) AS DOUBLE)"),
    "$toLower": _one(lambda x: f"lower({V.as_text(x)})", "CAST('' AS VARIANT)"), "$toUpper": _one(lambda x: f"upper({V.as_text(x)})", "CAST('' AS VARIANT)"),
    "$abs": lambda args: V.let(args[0], lambda x: f"coalesce(CAST(abs({V.as_whole(x)}) AS VARIANT), CAST(abs({V.as_number(x)}) AS VARIANT), {V.NOTHING})"),
    "$ifNull": lambda args: f"coalesce({', '.join(V.let(a, lambda x: f'if({V.is_nothing(x)}, NULL, {x})') for a in args[:-1])}, {args[-1]})",
}


def expression(spec: Any, docs: Docs) -> str:
    """A VARIANT of an expression: ``"$path"``, constants, objects of expressions, and operators."""
    if isinstance(spec, str) and spec.startswith("$"):
        if spec == "$$ROOT":
            return docs.whole()
        if spec.startswith("$$"):
            raise ValueError(f"unknown variable {spec}")
        return docs.at(spec[1:])
    if isinstance(spec, list):
        return f"to_variant_object(array({', '.join(f'coalesce({expression(x, docs)}, {V.NOTHING})' for x in spec)}))" if spec else "parse_json('[]')"
    if not isinstance(spec, Mapping):
        return V.constant(spec)
    if not any(k.startswith("$") for k in spec):
        return V.built({k: expression(v, docs) for k, v in spec.items()})
    if len(spec) != 1:
        raise ValueError("an expression has one operator")
    (op, value), = spec.items()
    if op == "$literal":
        return V.constant(value)
    if op == "$cond":
        test, yes, no = (value["if"], value["then"], value["else"]) if isinstance(value, Mapping) else value
        return f"if({truth(expression(test, docs))}, {expression(yes, docs)}, {expression(no, docs)})"
    if op not in _OPERATORS:
        raise ValueError(f"unknown operator {op}")
    return _OPERATORS[op]([expression(x, docs) for x in (value if isinstance(value, list) else [value])])


# --- stages


def _with_columns(docs: Docs, new: Mapping[str, str], base: str | None, kept: Mapping[str, str | None]) -> Docs:
    """Fields ``new`` as columns, computed at once from the documents as they came; ``kept`` columns stay."""
    fields, cells = {}, []
    for n, old in kept.items():
        if n not in new:
            fields[n] = old and f"f{len(cells)}"
            cells += [f"{old} AS f{len(cells)}"] if old else []
    for n, value in new.items():
        fields[n] = f"f{len(cells)}"
        cells.append(f"{value} AS f{len(cells)}")
    return Docs(docs.df.selectExpr(*([f"{base} AS doc"] if base else []), *(cells or ([] if base else ["1 AS one"]))), base and "doc", fields)


def _set(docs: Docs, spec: Mapping[str, Any], values: Mapping[str, str] | None = None) -> Docs:
    """Fields and parts of fields, all of the document as it came."""
    new: dict[str, str] = {}
    for path, value in (values or {p: expression(v, docs) for p, v in spec.items()}).items():
        head, *rest = V.steps(path)
        new[head] = V.with_path(new.get(head) or docs.at(head), rest, value)
    return _with_columns(docs, new, docs.base, docs.fields)


def _project(docs: Docs, spec: Mapping[str, Any]) -> Docs:
    off = lambda v: v in (0, False) and not isinstance(v, (str, Mapping))
    on = lambda v: v in (1, True) and not isinstance(v, (str, Mapping))
    rest = {k: v for k, v in spec.items() if k != "_id"}
    if not spec:
        raise ValueError("$project names no field")
    if all(map(off, rest.values())) and (rest or off(spec["_id"])):
        return _unset(docs, [k for k, v in spec.items() if off(v)])
    if any(map(off, rest.values())):
        raise ValueError("fields are either kept or left out")
    wanted = ({} if off(spec.get("_id", 1)) else {"_id": spec.get("_id", 1)}) | rest
    new: dict[str, str] = {}
    for path, v in wanted.items():
        head, *below = V.steps(path)
        new[head] = V.with_path(new.get(head, V.MISSING), below, docs.at(path) if on(v) else expression(v, docs))
    return _with_columns(docs, new, None, {})


def _unset(docs: Docs, paths: list[str]) -> Docs:
    """Fields that are left out; nothing is made on the way to a part that is not there."""
    fields, parts = dict(docs.fields), {}
    for path in paths:
        head, *rest = V.steps(path)
        if rest:
            held = parts.get(head) or docs.at(head)
            above = lambda x, rest=rest: V.value_at(x, rest[:-1])
            parts[head] = V.let(held, lambda x, rest=rest, above=above: f"if({V.is_object(above(x))}, {V.with_path(x, rest, V.MISSING)}, {x})")
        else:
            fields[head] = None
    docs = replace(docs, fields=fields)
    return _with_columns(docs, {h: v for h, v in parts.items() if h not in paths}, docs.base, docs.fields) if parts else docs


def _unwind_spec(spec: str | Mapping[str, Any]) -> tuple[str, str | None, bool]:
    given = {"path": spec} if isinstance(spec, str) else spec
    if not str(given.get("path", "")).startswith("$"):
        raise ValueError("$unwind takes a path that starts with $")
    return given["path"][1:], given.get("includeArrayIndex"), bool(given.get("preserveNullAndEmptyArrays"))


def _unwind(docs: Docs, spec: str | Mapping[str, Any]) -> Docs:
    """A row per element; a single value is its only element, nothing and empty arrays have none or, preserved, a missing one."""
    path, at, keep = _unwind_spec(spec)
    held = docs.df.selectExpr("*", f"{docs.at(path)} AS held").selectExpr("*", f"{V.elements('held')} AS listed")
    one = "struct(CAST(NULL AS BIGINT) AS at, held AS v)"
    none = "array(struct(CAST(NULL AS BIGINT) AS at, if(listed IS NULL, held, NULL) AS v))" if keep else "array()"
    rows = f"CASE WHEN size(listed) > 0 THEN transform(listed, (e, i) -> struct(CAST(i AS BIGINT) AS at, e AS v)) WHEN listed IS NOT NULL OR {V.is_nothing('held')} THEN {none} ELSE array({one}) END"
    each = replace(docs, df=held.selectExpr("*", f"explode({rows}) AS unwound").drop("held", "listed"))
    values = {path: "unwound.v"} | ({at: _or_nothing("unwound.at")} if at else {})
    return _set(each, {}, values)


def _accumulator(spec: Mapping[str, Any], cell: str, docs: Docs) -> tuple[str | None, list[str], str]:
    """(input, aggregates, result) of one accumulator."""
    if not isinstance(spec, Mapping) or len(spec) != 1:
        raise ValueError("a total has exactly one accumulator")
    (op, over), = spec.items()
    kind = f"{cell}_kind"
    if op == "$count" or op == "$sum" and over == 1:
        return None, [f"count(1) AS {cell}_n"], f"CAST({cell}_n AS VARIANT)"
    value = expression(over, docs)
    if op == "$sum":
        parts = [f"sum({V.as_whole(cell, kind)}) AS {cell}_w", f"sum({V.by_kind(cell, kind, real=V.number(cell))}) AS {cell}_r"]
        return value, parts, f"if({cell}_r IS NULL, CAST(coalesce({cell}_w, 0L) AS VARIANT), CAST({cell}_r + coalesce({cell}_w, 0L) AS VARIANT))"
    if op == "$avg":
        return value, [f"avg({V.as_number(cell, kind)}) AS {cell}_a"], _or_nothing(f"{cell}_a")
    if op in ("$min", "$max"):
        known = f"if({kind} IS NULL OR {kind} = 'VOI', NULL, struct({V.sort_key(cell, kind)} AS k, {V.key_text(cell, kind)} AS j))"
        return value, [f"{op[1:]}({known}) AS {cell}_m"], f"coalesce(parse_json({cell}_m.j), {V.NOTHING})"
    if op == "$addToSet":
        known = f"if({kind} IS NULL, NULL, {V.key_text(cell, kind)})"
        return value, [f"collect_set({known}) AS {cell}_s"], f"coalesce(to_variant_object(transform(sort_array({cell}_s), x -> parse_json(x))), parse_json('[]'))"
    raise ValueError(f"unsupported accumulator {op}")


def _grouped(docs: Docs, key: Any, totals: Mapping[str, Mapping[str, Any]], of: dict[str, str] | None = None) -> Docs:
    """Groups by the key texts of the key, or of its fields; every task sums up its rows before the shuffle.

    A key's text is its JSON, so the key is read back from it. Values and their kinds are columns below the aggregation,
    so that each is taken once.
    """
    cells = {f"c{i}": (alias, *_accumulator(spec, f"c{i}", docs)) for i, (alias, spec) in enumerate(totals.items())}
    parts = of or {}
    if not of:
        composed = isinstance(key, Mapping) and key and not any(k.startswith("$") for k in key)
        parts = {k: expression(v, docs) for k, v in key.items()} if composed else {"": expression(key, docs)}
    keys = {f"k{i}": (name, value) for i, (name, value) in enumerate(parts.items())}
    read = docs.df.selectExpr(*(f"{v} AS {k}" for k, (_, v) in keys.items()), *(f"{v} AS {c}" for c, (_, v, _, _) in cells.items() if v is not None))
    held = [c for c, (_, v, _, _) in cells.items() if v is not None]
    read = read.selectExpr("*", *(f"{V.kind(c)} AS {c}_kind" for c in [*keys, *held]))
    read = read.selectExpr(*(f"if({k}_kind IS NULL AND {len(keys) > 1}, NULL, {V.key_text(k, f'{k}_kind')}) AS {k}" for k in keys), *held, *(f"{c}_kind" for c in held))
    found = read.groupBy(*keys).agg(*(F.expr(a) for _, _, listed, _ in cells.values() for a in listed) if cells else [F.count(F.lit(1)).alias("n")])
    if list(parts) == [""]:
        result = {"_id": "parse_json(k0)"}
    else:
        result = {"_id": V.built({name: f"parse_json({k})" for k, (name, _) in keys.items()})}
    return _with_columns(Docs(found, None), result | {alias: shown for alias, _, _, shown in cells.values()}, None, {})


def _group(docs: Docs, spec: Mapping[str, Any]) -> Docs:
    if "_id" not in spec:
        raise ValueError("$group needs an _id")
    return _grouped(docs, spec["_id"], {k: v for k, v in spec.items() if k != "_id"})


def _bucket(docs: Docs, spec: Mapping[str, Any]) -> Docs:
    """Groups by the lower bound of the half-open range that a value falls into; others go to ``default`` or end the query."""
    bounds = spec["boundaries"]
    if len(bounds) < 2 or any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("boundaries are two or more rising values")
    other = V.constant(spec["default"]) if "default" in spec else "raise_error('a value lies outside the boundaries')"
    cases = lambda x: "CASE " + " ".join(f"WHEN {V.compared(x, '>=', a)} AND {V.compared(x, '<', b)} THEN {V.constant(a)}" for a, b in zip(bounds, bounds[1:])) + f" ELSE {other} END"
    return _grouped(docs, None, spec.get("output", {"count": {"$sum": 1}}), {"": V.let(expression(spec["groupBy"], docs), cases)})


def _sorted(docs: Docs, spec: Mapping[str, int]) -> Docs:
    if not spec or set(spec.values()) - {1, -1}:
        raise ValueError("$sort names fields with 1 or -1")
    keyed = docs.df.selectExpr("*", *(f"{V.let(docs.at(path), V.sort_key)} AS s{i}" for i, path in enumerate(spec)))
    ordered = keyed.orderBy(*(F.col(f"s{i}").asc() if way == 1 else F.col(f"s{i}").desc() for i, way in enumerate(spec.values())))
    return replace(docs, df=ordered.drop(*(f"s{i}" for i in range(len(spec)))))


def _lookup(docs: Docs, spec: Mapping[str, Any], collections: Collections, unwound: bool = False, keep: bool = False) -> Docs:
    """An equi join by key text; missing fields equal null.

    Each document gets the list of those whose foreign field equals its local field, in the order of their texts. A list
    is as long as its key has documents; where the next stage unwinds it, no list is made: the join's rows are the result, and a
    key with very many documents is split like that of any join.
    """
    other = _docs(collections[spec["from"]])
    there = other.df.selectExpr(f"{V.let(other.at(spec['foreignField']), V.key_text)} AS key_text", f"{other.whole()} AS other")
    here = docs.df.selectExpr("*", f"{V.let(docs.at(spec['localField']), V.key_text)} AS key_text")
    if unwound:
        joined = replace(docs, df=here.join(there, "key_text", "left" if keep else "inner").drop("key_text"))
        return _set(joined, {}, {spec["as"]: "other"})
    listed = there.groupBy("key_text").agg(F.sort_array(F.collect_list(F.to_json("other"))).alias("others"))
    joined = replace(docs, df=here.join(listed, "key_text", "left").drop("key_text"))
    return _set(joined, {}, {spec["as"]: "if(others IS NULL, parse_json('[]'), to_variant_object(transform(others, x -> parse_json(x))))"})


def _counted(docs: Docs, name: str) -> Docs:
    if not isinstance(name, str) or not name or name.startswith("$"):
        raise ValueError("$count takes a field name")
    counted = docs.df.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return _with_columns(Docs(counted, None), {name: "CAST(n AS VARIANT)"}, None, {})


def _root(docs: Docs, spec: Mapping[str, Any]) -> Docs:
    return Docs(docs.df.selectExpr(f"{expression(spec['newRoot'], docs)} AS doc"))


STAGES = {
    "$match": lambda docs, spec: replace(docs, df=docs.df.where(predicate(spec, docs.start))), "$project": _project, "$unwind": _unwind, "$group": _group,
    "$bucket": _bucket, "$sort": _sorted, "$skip": lambda docs, n: replace(docs, df=docs.df.offset(int(n))), "$limit": lambda docs, n: replace(docs, df=docs.df.limit(int(n))),
    "$count": _counted, "$set": _set, "$addFields": _set, "$unset": lambda docs, spec: _unset(docs, [spec] if isinstance(spec, str) else list(spec)),
    "$replaceRoot": _root, "$sortByCount": lambda docs, spec: _sorted(_group(docs, {"_id": spec, "count": {"$sum": 1}}), {"count": -1}),
}


def pipeline(docs: Docs | DataFrame, stages: list[Mapping[str, Any]], collections: Collections | None = None) -> Docs:
    """The documents after all stages; nothing runs until an action.

    Documents need no schema. Stages: ``$match $project $set $addFields $unset $unwind $group $bucket $sort $skip $limit
    $lookup $count $sortByCount $replaceRoot``. Groups and joins go by values, 1 and 1.0 alike, null and missing alike; sums
    of whole numbers are whole. An unknown stage, operator or accumulator is a ``ValueError`` when the plan is built.
    """
    docs, at = _docs(docs), 0
    while at < len(stages):
        stage = stages[at]
        if not isinstance(stage, Mapping) or len(stage) != 1:
            raise ValueError("a stage has exactly one operator")
        (name, spec), = stage.items()
        if name == "$lookup":
            after = stages[at + 1].get("$unwind") if at + 1 < len(stages) else None
            path, index, keep = _unwind_spec(after) if after else (None, None, False)
            unwound = path == spec["as"] and index is None
            docs = _lookup(docs, spec, collections or {}, unwound, keep)
            at += unwound
        elif name in STAGES:
            docs = STAGES[name](docs, spec)
        else:
            raise ValueError(f"unsupported stage {name}")
        at += 1
    return docs


def find(docs: Docs | DataFrame, condition: Mapping[str, Any]) -> Docs:
    return STAGES["$match"](_docs(docs), condition)


def request(collections: Collections, asked: Mapping[str, Any]) -> Docs:
    """``{"collection", "filter"}`` or ``{"collection", "pipeline"}`` over collections of documents."""
    if not isinstance(asked, Mapping):
        raise TypeError("a document request is a mapping")
    if not asked.get("collection"):
        raise ValueError("the request names no collection")
    docs = collections[asked["collection"]]
    if "pipeline" in asked:
        return pipeline(docs, asked["pipeline"], collections)
    if "filter" in asked:
        return find(docs, asked["filter"])
    raise ValueError("the request holds neither a filter nor a pipeline")
