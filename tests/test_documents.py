"""Document filters against a plain matcher, pipelines against plain values."""

import json
import random
import re

import pytest

from tablecheck.sources import document_pipelines as D
from tablecheck.sources.document_filters import predicate


def collection(spark, docs):
    return D.documents(spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in docs], "json string"), "json")


# --- a plain matcher


def leads_to(value, names):
    if not names:
        return [value]
    name, rest, found = names[0], names[1:], []
    if isinstance(value, dict) and name in value:
        found += leads_to(value[name], rest)
    if isinstance(value, list):
        if name.isdigit() and int(name) < len(value):
            found += leads_to(value[int(name)], rest)
        for x in value:
            if isinstance(x, dict) and name in x:
                found += leads_to(x[name], rest)
    return found


def kind(x):
    return "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x).__name__


def same(x, v):
    if isinstance(v, list):
        return isinstance(x, list) and len(x) == len(v) and all(same(a, b) for a, b in zip(x, v))
    return kind(x) == kind(v) and x == v


def with_elements(values):
    return values + [e for v in values if isinstance(v, list) for e in v]


def met_by(values, op, v, spec):
    every = with_elements(values)
    equal = lambda w: any(same(x, w) for x in every) or (w is None and not values)
    if op in ("$eq", "$ne"):
        return equal(v) == (op == "$eq")
    if op in ("$in", "$nin"):
        return any(map(equal, v)) == (op == "$in")
    if op in ("$gt", "$gte", "$lt", "$lte"):
        test = {"$gt": lambda x: x > v, "$gte": lambda x: x >= v, "$lt": lambda x: x < v, "$lte": lambda x: x <= v}[op]
        return any(kind(x) == kind(v) and test(x) for x in every)
    if op == "$exists":
        return bool(values) == v
    if op == "$regex":
        return any(isinstance(x, str) and re.search(v, x, re.I if "i" in spec.get("$options", "") else 0) for x in every)
    if op == "$options":
        return True
    if op == "$size":
        return any(isinstance(x, list) and len(x) == v for x in values)
    if op == "$mod":
        return any(kind(x) == "number" and x % v[0] == v[1] for x in every)
    if op == "$all":
        return all(map(equal, v))
    if op == "$type":
        named = {"number": "number", "string": "str", "bool": "bool", "array": "list", "object": "dict", "null": "NoneType"}
        return any(kind(x) == named[v] for x in every)
    if op == "$not":
        return not all(met_by(values, o, w, v) for o, w in v.items())
    if op == "$elemMatch":
        whole = all(k.startswith("$") for k in v)
        one = (lambda e: all(met_by([e], o, w, v) for o, w in v.items())) if whole else (lambda e: isinstance(e, dict) and matched(e, v))
        return any(isinstance(x, list) and any(map(one, x)) for x in values)
    raise AssertionError(op)


def matched(doc, condition):
    for name, spec in condition.items():
        if name in ("$and", "$or", "$nor"):
            found = [matched(doc, c) for c in spec]
            if not {"$and": all(found), "$or": any(found), "$nor": not any(found)}[name]:
                return False
            continue
        values = leads_to(doc, name.split("."))
        spec = spec if isinstance(spec, dict) else {"$eq": spec}
        if not all(met_by(values, o, v, spec) for o, v in spec.items()):
            return False
    return True


SCALARS = [0, 1, 2, 2.0, 2.5, -3, "a", "b", "Abc", "", True, False, None, 9007199254740993]


def made(rng, depth=0):
    if depth < 3 and rng.random() < 0.55:
        if rng.random() < 0.5:
            return {k: made(rng, depth + 1) for k in rng.sample(["a", "b", "c", "0"], rng.randint(0, 3))}
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(SCALARS)


def condition(rng, depth=0):
    out = {}
    for _ in range(rng.randint(1, 2)):
        if depth < 2 and rng.random() < 0.25:
            out[rng.choice(["$and", "$or", "$nor"])] = [condition(rng, depth + 1) for _ in range(rng.randint(1, 2))]
            continue
        path = ".".join(rng.choices(["a", "b", "c", "0"], k=rng.randint(1, 3)))
        out[path] = rng.choice([lambda: rng.choice(SCALARS), lambda: operators(rng)])()
    return out


def operators(rng, depth=0):
    def one():
        op = rng.choice(["$eq", "$ne", "$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$exists", "$regex", "$size", "$all", "$type", "$mod", "$not", "$elemMatch"])
        if op in ("$eq", "$ne"):
            return op, rng.choice([*SCALARS, [1, 2], []])
        if op in ("$in", "$nin", "$all"):
            return op, rng.sample(SCALARS, rng.randint(1, 3))
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return op, rng.choice([0, 2, 2.5, "a", "b", 9007199254740992])
        if op == "$not" and depth < 2:
            return op, operators(rng, depth + 1)
        if op == "$elemMatch" and depth < 2:
            return op, operators(rng, depth + 1) if rng.random() < 0.5 else {rng.choice("abc"): rng.choice(SCALARS)}
        return rng.choice([("$exists", rng.random() < 0.5), ("$regex", "^a|b$"), ("$size", rng.randint(0, 2)), ("$type", rng.choice(["number", "string", "bool", "array", "object", "null"])), ("$mod", [2, 1])])

    return dict(one() for _ in range(rng.randint(1, 2)))


def test_filters_match_a_plain_matcher(spark):
    rng = random.Random(11)
    docs = [{"_id": i, **{k: made(rng) for k in rng.sample(["a", "b", "c"], rng.randint(1, 3))}} for i in range(200)]
    conditions = [condition(rng) for _ in range(60)]
    found = collection(spark, docs)
    marks = found.df.selectExpr("try_variant_get(doc, '$._id', 'bigint') AS id", *(f"{predicate(c)} AS c{n}" for n, c in enumerate(conditions))).collect()
    hits = 0
    for row in marks:
        for n, c in enumerate(conditions):
            want = matched(docs[row.id], c)
            assert row[f"c{n}"] is want, (docs[row.id], c)
            hits += want
    assert len(marks) == 200 and 1000 < hits < 11_000


@pytest.mark.parametrize("bad", [
    {"$where": "x"}, {"a": {"$near": 1}}, {"a": {"$in": 3}}, {"$or": []}, {"a": {"$not": 5}}, {"a": {"b": 1}}, {"a..b": 1}, {"a": {"$gt": None}}, {"a": {"$regex": "x", "$options": "q"}},
    {"a": {"$type": "point"}}, {"a": {"$options": "i"}}, {"a": {"$elemMatch": 3}},
])
def test_filters_that_are_not_understood(bad):
    with pytest.raises(ValueError):
        predicate(bad)


# --- pipelines

PEOPLE = [
    {"_id": 1, "n": 1, "t": "x", "at": {"c": "u", "d": [1, 2]}, "tags": ["p", "q"]}, {"_id": 2, "n": 1.0, "t": "x", "tags": []}, {"_id": 3, "n": 2, "t": None, "at": {"c": None}, "tags": "p"},
    {"_id": 4, "n": "7", "t": "y", "at": {"c": "u"}, "tags": [{"k": 1}, {"k": 2}]}, {"_id": 5, "t": "y's \"z\"", "n": None}, "no document", "[1]",
]


def after(spark, *stages, **collections):
    docs = collection(spark, PEOPLE)
    other = {k: collection(spark, v) for k, v in collections.items()}
    return [json.loads(r[0]) for r in D.pipeline(docs, list(stages), other).frame().selectExpr("to_json(doc)").collect()]


def by_id(docs):
    return sorted(docs, key=lambda d: json.dumps(d["_id"]))


def test_projections(spark):
    assert by_id(after(spark, {"$project": {"n": 1, "at.c": 1}}))[:2] == [{"_id": 1, "n": 1, "at": {"c": "u"}}, {"_id": 2, "n": 1, "at": {}}]
    assert by_id(after(spark, {"$project": {"n": 0, "at.d": 0, "tags": 0}}))[0] == {"_id": 1, "t": "x", "at": {"c": "u"}}
    assert [d.get("k") for d in by_id(after(spark, {"$project": {"k": "$tags.k"}}))] == [[], [], None, [1, 2], None]
    found = by_id(after(spark, {"$set": {"at.e": {"$add": ["$n", 1]}, "n": "$t"}}, {"$unset": ["t", "at.d", "no.such"]}))
    assert found[0] == {"_id": 1, "n": "x", "at": {"c": "u", "e": 2}, "tags": ["p", "q"]}
    assert [d["at"]["e"] for d in found] == [2, 2, 3, None, None] and "no" not in found[0]
    assert by_id(after(spark, {"$project": {"_id": "$n", "whole": "$$ROOT"}}))[0]["whole"]["_id"] == 4


def test_unwinding(spark):
    plain = after(spark, {"$unwind": "$tags"})
    assert sorted((d["_id"], json.dumps(d["tags"])) for d in plain) == [(1, '"p"'), (1, '"q"'), (3, '"p"'), (4, '{"k": 1}'), (4, '{"k": 2}')]
    kept = after(spark, {"$unwind": {"path": "$tags", "includeArrayIndex": "i", "preserveNullAndEmptyArrays": True}})
    assert sorted((d["_id"], d["i"] is None, "tags" in d) for d in kept) == [(1, False, True), (1, False, True), (2, True, False), (3, True, True), (4, False, True), (4, False, True), (5, True, False)]


def test_groups(spark):
    found = after(spark, {"$group": {"_id": "$n", "ids": {"$addToSet": "$_id"}, "c": {"$count": {}}, "t": {"$max": "$t"}}})
    assert sorted(((d["_id"], sorted(d["ids"]), d["c"], d["t"]) for d in found), key=repr) == sorted([(1, [1, 2], 2, "x"), (2, [3], 1, None), ("7", [4], 1, "y"), (None, [5], 1, "y's \"z\"")], key=repr)
    (all_of,) = after(spark, {"$group": {"_id": None, "s": {"$sum": "$n"}, "a": {"$avg": "$n"}, "low": {"$min": "$n"}, "high": {"$max": "$n"}, "none": {"$sum": "$zz"}, "whole": {"$sum": "$_id"}}})
    assert all_of == {"_id": None, "s": 4, "a": pytest.approx(4 / 3), "low": 1, "high": "7", "none": 0, "whole": 15}
    pairs = after(spark, {"$group": {"_id": {"c": "$at.c", "t": "$t"}}})
    assert sorted(json.dumps(d["_id"], sort_keys=True) for d in pairs) == sorted(['{"c": "u", "t": "x"}', '{"t": "x"}', '{"c": null, "t": null}', '{"c": "u", "t": "y"}', json.dumps({"t": "y's \"z\""})])
    assert after(spark, {"$match": {"n": 99}}, {"$count": "k"}) == [] and after(spark, {"$count": "k"}) == [{"k": 5}]
    buckets = after(spark, {"$bucket": {"groupBy": "$n", "boundaries": [0, 2, 5], "default": "rest"}})
    assert sorted((str(d["_id"]), d["count"]) for d in buckets) == [("0", 2), ("2", 1), ("rest", 2)]
    with pytest.raises(Exception, match="outside the boundaries"):
        after(spark, {"$bucket": {"groupBy": "$n", "boundaries": [0, 2, 5]}})
    assert after(spark, {"$sortByCount": "$n"})[0] == {"_id": 1, "count": 2}


def test_order_of_kinds(spark):
    assert [d["_id"] for d in after(spark, {"$sort": {"n": 1, "_id": -1}})] == [5, 2, 1, 3, 4]
    assert [d["_id"] for d in after(spark, {"$sort": {"n": -1, "_id": 1}}, {"$skip": 1}, {"$limit": 3})] == [3, 1, 2]


def test_expressions(spark):
    exprs = {
        "cond": {"$cond": [{"$gt": ["$n", 1]}, "more", "less"]}, "none": {"$ifNull": ["$zz", "$at.c", "z"]}, "cat": {"$concat": ["$t", "-", {"$toUpper": "$t"}]}, "size": {"$size": "$tags"},
        "sum": {"$add": ["$_id", 0.5, 1]}, "div": {"$divide": ["$_id", 0]}, "lit": {"$literal": "$n"}, "list": [1, "$zz"], "obj": {"a": "$n", "b": "$zz"}, "not": {"$not": ["$n"]},
    }
    found = by_id(after(spark, {"$project": exprs}))
    assert found[0] == {"_id": 1, "cond": "less", "none": "u", "cat": "x-X", "size": 2, "sum": 2.5, "div": None, "lit": "$n", "list": [1, None], "obj": {"a": 1}, "not": False}
    assert [d["cond"] for d in found] == ["less", "less", "more", "more", "less"] and [d["none"] for d in found] == ["u", "z", "z", "u", "z"]
    assert [d["size"] for d in found] == [2, 0, None, 2, None] and found[4]["not"] is True and found[2]["cat"] is None


def test_lookups(spark):
    others = [{"k": 1, "v": "one"}, {"k": 1, "v": "eins"}, {"k": "7", "v": "seven"}, {"v": "nobody"}]
    join = {"$lookup": {"from": "o", "localField": "n", "foreignField": "k", "as": "got"}}
    listed = {d["_id"]: [x["v"] for x in d["got"]] for d in after(spark, join, o=others)}
    assert listed == {1: ["eins", "one"], 2: ["eins", "one"], 3: [], 4: ["seven"], 5: ["nobody"]}
    rows = sorted((d["_id"], d["got"]["v"]) for d in after(spark, join, {"$unwind": "$got"}, o=others))
    assert rows == [(1, "eins"), (1, "one"), (2, "eins"), (2, "one"), (4, "seven"), (5, "nobody")]
    kept = after(spark, join, {"$unwind": {"path": "$got", "preserveNullAndEmptyArrays": True}}, o=others)
    assert len(kept) == 7 and [d for d in kept if d["_id"] == 3][0].get("got") is None


@pytest.mark.parametrize("stages", [
    [{"$out": "x"}], [{"$match": {}, "$limit": 1}], [{"$group": {"n": {"$sum": 1}}}], [{"$group": {"_id": 1, "n": {"$push": "$x"}}}], [{"$unwind": "tags"}], [{"$project": {}}],
    [{"$project": {"a": 1, "b": 0}}], [{"$sort": {"a": 2}}], [{"$set": {"a": {"$foo": 1}}}], [{"$bucket": {"groupBy": "$a", "boundaries": [1]}}], [{"$count": ""}], [{"$set": {"a": "$$NOW"}}],
])
def test_stages_that_are_not_understood(spark, stages):
    with pytest.raises(ValueError):
        D.pipeline(collection(spark, PEOPLE), stages)


def test_requests(spark):
    docs = {"c": collection(spark, PEOPLE)}
    assert D.request(docs, {"collection": "c", "filter": {"n": 1}}).df.count() == 2
    assert D.request(docs, {"collection": "c", "pipeline": [{"$match": {"n": 1}}, {"$count": "k"}]}).columns("k bigint").first().k == 2
    for bad, error in (("x", TypeError), ({}, ValueError), ({"collection": "c"}, ValueError)):
        with pytest.raises(error):
            D.request(docs, bad)


def test_plans_of_pipelines(spark):
    docs = collection(spark, PEOPLE)
    join = [{"$lookup": {"from": "o", "localField": "n", "foreignField": "k", "as": "got"}}, {"$unwind": "$got"}]
    plan = D.pipeline(docs, join, {"o": docs}).df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join Inner" in plan
    plan = D.pipeline(docs, [{"$match": {"n": 1}}, {"$group": {"_id": "$t", "s": {"$sum": "$n"}}}]).df._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("parseJson") <= 2 and "partial_sum" in plan.executedPlan().toString()


def test_one_file_is_read_by_all_tasks(spark, small):
    from tablecheck.plans import catalog
    from tablecheck.sources import variants as V

    plan = catalog.QUERIES["doc_stage_bucket"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("arseJson")  # rows are dealt out below the parsing
    assert "transform" not in V.as_text("doc") + V.as_number("doc") + V.as_whole("doc")
    rows = spark.sql("""SELECT try_parse_json(j) AS v FROM VALUES ('1'), ('2.5'), ('"x"'), ('null'), ('true'), ('[1]'), ('{"a":1}'), (NULL) AS t(j)""")
    got = rows.selectExpr(f"{V.as_text('v')} AS t", f"{V.as_number('v')} AS n", f"{V.as_whole('v')} AS w").collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 1), (None, 2.5, None), ("x", None, None)] + [(None, None, None)] * 5
