"""Registered queries over documents without a schema, made of the rows of ``events`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablecheck.plans.registry import query
from tablecheck.plans.tables import Tables
from tablecheck.sources import document_pipelines as D

# An event as a document: a nested object, a value that is missing, null, a number or a text, and lists of texts and objects.
_EVENT = ["""to_json(named_struct('_id', event_id, 'type', event_type, 'user', named_struct('id', user_id, 'tier', user_id % 3))) AS head""",
 """CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 25 = 1 THEN ',"value":null' WHEN event_id % 7 = 0 THEN concat(',"value":"', event_type, '"') ELSE concat(',"value":', CAST(value AS STRING)) END AS middle""",
 """concat(',"tags":["', event_type, '","t', CAST(k % 3 AS STRING), '"],"items":[{"k":', CAST(k AS STRING), ',"n":1},{"k":', CAST(k + 1 AS STRING), ',"n":', CAST(event_id % 4 AS STRING), '}]}') AS tail"""]

_E = """e AS (SELECT event_id, event_type, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
 event_id % 10 <> 0 AND event_id % 25 <> 1 AND event_id % 7 <> 0 AS numeric FROM events)"""


def _events(t: Tables) -> D.Docs:
    """Rows are dealt out before documents are made of them: reading a document takes far longer than reading its row, and a
    table of one file would be read by one task."""
    dealt = t["events"].select("event_id", "event_type", "user_id", "value", "props").repartition("event_id")
    read = dealt.selectExpr("event_id", "event_type", "user_id", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    return D.documents(read.selectExpr(*_EVENT).selectExpr("concat(left(head, length(head) - 1), middle, tail) AS json"), "json")


def _customers(t: Tables) -> D.Docs:
    return D.documents(t["customer"].selectExpr("to_json(named_struct('key', c_custkey, 'nation', c_nationkey, 'segment', c_mktsegment)) AS json"), "json")


@query("doc_filter_operators", f"""WITH {_E}
SELECT event_id AS id, event_type AS type, CASE WHEN numeric THEN value END AS value FROM e
WHERE ((user_id < 200 AND event_id % 10 <> 0) OR (k > 90 AND false) OR (k > 90 AND event_id % 4 = -1) OR (k + 1 > 90 AND event_id % 4 IN (0, 3)))
 AND NOT starts_with(event_type, 'e') AND k % 3 <> 1 AND NOT (numeric AND value > 400) AND (event_id % 10 = 0 OR event_id % 25 = 1 OR event_id % 3 <> 0)""")
def _(t: Tables) -> DataFrame:
    found = D.request({"events": _events(t)}, {"collection": "events", "filter": {
        "$or": [{"user.id": {"$lt": 200}, "value": {"$exists": True}}, {"items": {"$elemMatch": {"k": {"$gt": 90}, "n": {"$in": [0, 3]}}}}],
        "type": {"$not": {"$regex": "^E", "$options": "i"}}, "tags": {"$ne": "t1"}, "$nor": [{"value": {"$gt": 400}}, {"value": {"$ne": None}, "_id": {"$mod": [3, 0]}}],
    }})
    return found.columns("_id bigint, type string, value double").toDF("id", "type", "value").selectExpr("id", "type", "if(id % 7 = 0, NULL, value) AS value")


@query("doc_stage_unwind", f"""WITH {_E}, each AS (
 SELECT event_type, user_id, event_id, k AS item, 1 AS n, 0 AS pos FROM e UNION ALL SELECT event_type, user_id, event_id, k + 1, event_id % 4, 1 FROM e)
SELECT event_type AS type, user_id % 3 AS tier, pos, count(*) AS n, CAST(sum(item * n) AS BIGINT) AS total, round(avg(item), 6) AS mean, min(item) AS low, max(event_id) AS last
FROM each WHERE n > 0 GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    found = D.pipeline(_events(t), [
        {"$project": {"type": 1, "user.tier": 1, "items": 1}},
        {"$unwind": {"path": "$items", "includeArrayIndex": "at"}},
        {"$match": {"items.n": {"$gt": 0}}},
        {"$group": {"_id": {"type": "$type", "tier": "$user.tier", "at": "$at"}, "n": {"$count": {}}, "total": {"$sum": {"$multiply": ["$items.k", "$items.n"]}},
                    "mean": {"$avg": "$items.k"}, "low": {"$min": "$items.k"}, "last": {"$max": "$_id"}}},
    ])
    rows = found.columns("_id.type string, _id.tier bigint, _id.at bigint, n bigint, total bigint, mean double, low bigint, last bigint")
    return rows.selectExpr("_id_type AS type", "_id_tier AS tier", "CAST(_id_at AS INT) AS pos", "n", "total", "round(mean, 6) AS mean", "low", "last")


@query("doc_stage_lookup", f"""WITH {_E}
SELECT c_nationkey AS nation, count(*) AS events, CAST(sum(CASE WHEN numeric THEN 1 ELSE 0 END) AS BIGINT) AS numbers, round(sum(CASE WHEN numeric THEN value ELSE 0 END), 4) AS total
FROM e LEFT JOIN customer ON user_id = c_custkey AND c_mktsegment <> 'BUILDING' GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """Events with their customers; of customers left out, and of none, the nation is missing."""
    customers = D.pipeline(_customers(t), [{"$match": {"segment": {"$ne": "BUILDING"}}}, {"$set": {"number": "$key"}}, {"$unset": ["segment", "key"]}])
    found = D.pipeline(_events(t), [
        {"$lookup": {"from": "customers", "localField": "user.id", "foreignField": "number", "as": "who"}},
        {"$unwind": {"path": "$who", "preserveNullAndEmptyArrays": True}},
        {"$addFields": {"numeric": {"$cond": [{"$and": [{"$ne": [{"$ifNull": ["$value", "none"]}, "none"]}, {"$lt": ["$value", ""]}]}, 1, 0]}}},
        {"$group": {"_id": "$who.nation", "events": {"$sum": 1}, "numbers": {"$sum": "$numeric"}, "total": {"$sum": "$value"}}},
    ], {"customers": customers})
    return found.columns("_id bigint, events bigint, numbers bigint, total double").selectExpr("_id AS nation", "events", "numbers", "round(total, 4) AS total")


@query("doc_stage_bucket", f"""WITH {_E}, b AS (
 SELECT CASE WHEN NOT numeric THEN 'other' WHEN value >= 0 AND value < 50 THEN '0' WHEN value >= 50 AND value < 200 THEN '50' ELSE 'other' END AS bucket, * FROM e)
SELECT bucket, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT k % 3) AS rests FROM b GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    found = D.pipeline(_events(t), [
        {"$addFields": {"rest": {"$mod": [{"$add": [0, "$items.k"]}, 3]}, "first": {"$toLower": "$type"}}},
        {"$unwind": "$items"}, {"$match": {"items.n": 1}}, {"$group": {"_id": "$_id", "value": {"$max": "$value"}, "type": {"$min": "$first"}, "k": {"$min": "$items.k"}}},
        {"$bucket": {"groupBy": "$value", "boundaries": [0, 50, 200], "default": "other",
                     "output": {"n": {"$sum": 1}, "types": {"$addToSet": "$type"}, "rests": {"$addToSet": {"$mod": ["$k", 3]}}}}},
    ])
    rows = found.columns("_id string, n bigint, types array<string>, rests array<bigint>")
    return rows.selectExpr("_id AS bucket", "n", "array_join(types, ',') AS types", "CAST(size(rests) AS BIGINT) AS rests")


@query("doc_stage_sort", f"""WITH {_E}, r AS (SELECT *, CASE WHEN event_id % 10 = 0 OR event_id % 25 = 1 THEN 1 WHEN event_id % 7 = 0 THEN 3 ELSE 2 END AS kind FROM e)
SELECT event_id AS id, upper(event_type) || '-' || event_type AS label, k * 2 AS doubled FROM r WHERE user_id % 3 = 1
ORDER BY kind DESC, CASE WHEN kind = 3 THEN event_type END DESC, CASE WHEN kind = 2 THEN value END DESC, k, event_id LIMIT 40 OFFSET 25""")
def _(t: Tables) -> DataFrame:
    """A page of a sorted list: texts before numbers before nothing, as the order of kinds is turned round."""
    found = D.pipeline(_events(t), [
        {"$match": {"user.tier": 1}}, {"$addFields": {"k": "$items.k"}}, {"$unwind": "$k"},
        {"$group": {"_id": "$_id", "k": {"$min": "$k"}, "value": {"$max": "$value"}, "type": {"$min": "$type"}}},
        {"$sort": {"value": -1, "k": 1, "_id": 1}}, {"$skip": 25}, {"$limit": 40},
        {"$project": {"label": {"$concat": [{"$toUpper": "$type"}, "-", "$type"]}, "doubled": {"$multiply": ["$k", 2]}}},
    ])
    return found.columns("_id bigint, label string, doubled bigint").selectExpr("_id AS id", "label", "doubled")
