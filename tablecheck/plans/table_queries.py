"""Registered queries: sources, contracts, profiles, personal data, glossary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tablecheck.operators import contracts as C
from tablecheck.operators import profile as P
from tablecheck.operators import profile_states as S
from tablecheck.plans.registry import query
from tablecheck.plans.tables import EVENTS_AS_OF, ORDERS_AS_OF, Tables, with_tables
from tablecheck.session import constant_rows, shared_folder
from tablecheck.sources import documents, readers, stores

# -- sources -----------------------------------------------------------------------------------

_BY_STATUS = """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key
 FROM {t} GROUP BY o_orderstatus"""


@query("src_view_sql", _BY_STATUS.format(t="orders"))
def _(t: Tables) -> DataFrame:
    return readers.query_source(t["orders"], _BY_STATUS.format(t="source"))


_FORMS = {
    "text": ("SELECT 'read from source' AS what, count(*) AS n FROM source", "SELECT 'read from source' AS what, count(*) AS n FROM orders"),
    "comma": ("SELECT max(a.o_orderstatus), count(*) FROM source a, source b WHERE a.o_orderkey = b.o_orderkey AND b.o_totalprice > 2000",
              "SELECT max(o_orderstatus), count(*) FROM orders WHERE o_totalprice > 2000"),
    "quoted": ("SELECT max(o_orderstatus), count(*) FROM `source` WHERE o_orderstatus <> '{source}'", "SELECT max(o_orderstatus), count(*) FROM orders"),
    "brackets": ("SELECT min(o_orderstatus), count(*) FROM (source) WHERE o_totalprice > 1000;", "SELECT min(o_orderstatus), count(*) FROM orders WHERE o_totalprice > 1000"),
    "own names": ("WITH dear AS (SELECT * FROM source WHERE o_totalprice > 5000) SELECT min(a.o_orderstatus), count(*) FROM dear a JOIN {source} b USING (o_orderkey) -- both",
                  "SELECT min(o_orderstatus), count(*) FROM orders WHERE o_totalprice > 5000"),
}


@query("src_bound_names", " UNION ALL ".join(f"SELECT '{form}' AS form, * FROM ({sql}) AS t(what, n)" for form, (_, sql) in _FORMS.items()))
def _(t: Tables) -> DataFrame:
    """The table's name wherever a statement may have it: after a comma, quoted, in brackets, in a text, below names of its own."""
    asked = [readers.query_source(t["orders"], sql).toDF("what", "n").withColumn("form", F.lit(form)) for form, (sql, _) in _FORMS.items()]
    return reduce(DataFrame.unionByName, asked)


def _written(t: Tables, name: str, kind: str) -> str:
    path = shared_folder(t.spark, f"{name}-{kind}")
    rows = t[name].withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    (stores.export_csv if kind == "csv" else stores.export_json)(rows, path)
    return path


@query("src_csv_scan", _BY_STATUS.format(t="orders"))
def _(t: Tables) -> DataFrame:
    orders = readers.read_csv(t.spark, _written(t, "orders", "csv"))
    return readers.query_source(orders, _BY_STATUS.format(t="source")).withColumn("last_key", F.col("last_key").cast("bigint"))


@query("src_json_scan", _BY_STATUS.format(t="orders"))
def _(t: Tables) -> DataFrame:
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    orders = readers.read_json(t.spark, _written(t, "orders", "json"), schema)
    return readers.query_source(orders, _BY_STATUS.format(t="source"))


@query("src_dispatch", """SELECT 'orders' AS source_name, count(*) AS n FROM orders
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation""")
def _(t: Tables) -> DataFrame:
    configs = {
        "orders": {"type": "csv", "path": _written(t, "orders", "csv")},
        "part": {"type": "parquet", "path": f"{t.folder}/part.parquet"},
        "nation": {"type": "parquet", "path": f"{t.folder}/nation.parquet"},
    }
    parts = [
        readers.read_source(t.spark, config).agg(F.count("*").alias("n")).select(F.lit(name).alias("source_name"), "n")
        for name, config in configs.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("doc_find_filter", """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
 WHERE json_extract(props, '$.k') = 69 AND event_type = 'error' AND json_extract(props, '$.missing') IS NULL""")
def _(t: Tables) -> DataFrame:
    docs = documents.parsed(t["events"], "props", "k BIGINT, missing STRING")
    found = documents.run({"events": docs}, {"collection": "events", "filter": {"k": 69, "event_type": "error", "missing": None}})
    return found.select("event_id", "event_type", "k")


@query("doc_stage_count", """SELECT 'all' AS what, count(*) AS n, CAST(NULL AS DOUBLE) AS total FROM events WHERE json_extract(props, '$.k') = 69
UNION ALL SELECT event_type, count(*), round(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 2) FROM events GROUP BY event_type""")
def _(t: Tables) -> DataFrame:
    docs = {"events": documents.parsed(t["events"], "props", "k BIGINT")}
    counted = documents.run(docs, {"collection": "events", "pipeline": [{"$match": {"k": 69}}, {"$count": "n"}]})
    grouped = documents.run(docs, {"collection": "events", "pipeline": [
        {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "total": {"$sum": "$k"}}}]})
    return counted.select(F.lit("all").alias("what"), "n", F.lit(None).cast("double").alias("total")).unionByName(
        grouped.select(F.col("_id").alias("what"), "n", F.round(F.col("total").cast("double"), 2).alias("total")))


def _filled_sql(table: str, columns: list[tuple[str, str]], typed: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {no} AS ordinal, '{name}' AS column_name, "
        + (f"'{kind}' AS data_type, " if typed else "")
        + f"count({name}) AS filled FROM {table}"
        for no, (name, kind) in enumerate(columns, 1)
    )


_EVENT_COLUMNS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]
_ORDER_COLUMNS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _filled(df: DataFrame, name: str) -> DataFrame:
    """Schema rows with the number of values each column holds."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in df.columns])))
    return readers.schema_rows(df).join(long, "column_name").withColumn("table_name", F.lit(name))


@query("get_columns", _filled_sql("events", _EVENT_COLUMNS, False))
def _(t: Tables) -> DataFrame:
    return _filled(t["events"], "events").select("table_name", "ordinal", "column_name", "filled")


@query("schema_table", _filled_sql("events", _EVENT_COLUMNS, True) + " UNION ALL " + _filled_sql("orders", _ORDER_COLUMNS, True))
def _(t: Tables) -> DataFrame:
    shape = ("table_name", "ordinal", "column_name", "data_type", "filled")
    return _filled(t["events"], "events").select(*shape).unionByName(_filled(t["orders"], "orders").select(*shape))


# -- contracts ---------------------------------------------------------------------------------

ORDERS_CONTRACT = C.contract_from_dict({
    "name": "order book", "owner": "sales ledger", "version": "2024-3",
    "schema": [
        {"column": "o_orderkey", "type": "integer", "nullable": False, "unique": True},
        {"column": "o_custkey", "type": "bigint", "nullable": True},
        {"column": "o_totalprice", "type": "float", "nullable": False},
        {"column": "o_orderstatus", "type": "integer"},
        {"column": "o_comment", "type": "string", "nullable": False, "unique": True},
    ],
    "checks": [
        {"name": "five states at most", "metric": "count(DISTINCT o_orderstatus)", "assert": "less_than", "value": 6},
        {"name": "cheapest order", "metric": "min(o_totalprice)", "assert": "between", "value": [0, 5000]},
        {"name": "nothing measured", "metric": "max(if(o_orderkey < 0, 1, null))", "assert": "equals", "value": None},
    ],
    "freshness": {"column": "o_orderdate", "max_hours": 48},
    "row_count": {"min": 1, "max": 10000},
})

EVENTS_CONTRACT = C.contract_from_dict({
    "name": "events_v1",
    "schema": [
        {"column": "event_id", "type": "integer", "nullable": False, "unique": True},
        {"column": "user_id", "type": "integer", "nullable": False, "unique": True},
        {"column": "event_type", "type": "text", "nullable": False},
        {"column": "ts", "type": "timestamptz"},
        {"column": "value", "type": "bool"},
    ],
    "checks": [
        {"name": "values positive", "assert": "row_condition", "value": "value > 0"},
        {"name": "types filled", "assert": "not_empty", "column": "event_type"},
    ],
    "freshness": {"column": "ts", "max_hours": 0.001},
    "row_count": {"min": 1},
})

_KEPT = ("contract", "rule", "target", "value", "passed")


def _contract_rows(contract: str, source: str, rows: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{contract}' AS contract, '{rule}' AS rule, '{target}' AS target, round(CAST(v AS DOUBLE), 6) AS value, "
        f"coalesce({verdict}, false) AS passed FROM (SELECT {measure} AS v FROM {source})"
        for rule, target, measure, verdict in rows
    )


_NO_VALUE = "CASE WHEN count(*) < 0 THEN 0 END"
_ORDER_PROMISES = [
    ("schema", "o_orderkey", _NO_VALUE, "true"), ("type", "o_orderkey", _NO_VALUE, "true"),
    ("not_null", "o_orderkey", "count(*) FILTER (WHERE o_orderkey IS NULL)", "v = 0"),
    ("unique", "o_orderkey", "count(*) - count(DISTINCT o_orderkey)", "v = 0"),
    ("schema", "o_custkey", _NO_VALUE, "true"), ("type", "o_custkey", _NO_VALUE, "true"),
    ("schema", "o_totalprice", _NO_VALUE, "true"), ("type", "o_totalprice", _NO_VALUE, "true"),
    ("not_null", "o_totalprice", "count(*) FILTER (WHERE o_totalprice IS NULL)", "v = 0"),
    ("schema", "o_orderstatus", _NO_VALUE, "true"), ("type", "o_orderstatus", _NO_VALUE, "false"),
    ("schema", "o_comment", _NO_VALUE, "false"),
    ("check", "five states at most", "count(DISTINCT o_orderstatus)", "v < 6"), ("check", "cheapest order", "min(o_totalprice)", "v BETWEEN 0 AND 5000"),
    ("check", "nothing measured", "max(CASE WHEN o_orderkey < 0 THEN 1 END)", "false"),
    ("freshness", "o_orderdate", f"(epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(max(o_orderdate))) / 3.6e9", "v <= 48"),
    ("row_count", "min", "count(*)", "v >= 1"), ("row_count", "max", "count(*)", "v <= 10000"),
]
_EVENT_PROMISES = [
    ("schema", "event_id", _NO_VALUE, "true"), ("type", "event_id", _NO_VALUE, "true"),
    ("not_null", "event_id", "count(*) FILTER (WHERE event_id IS NULL)", "v = 0"),
    ("unique", "event_id", "count(*) - count(DISTINCT event_id)", "v = 0"),
    ("schema", "user_id", _NO_VALUE, "true"), ("type", "user_id", _NO_VALUE, "true"),
    ("not_null", "user_id", "count(*) FILTER (WHERE user_id IS NULL)", "v = 0"),
    ("unique", "user_id", "count(*) - count(DISTINCT user_id)", "v = 0"),
    ("schema", "event_type", _NO_VALUE, "true"), ("type", "event_type", _NO_VALUE, "true"),
    ("not_null", "event_type", "count(*) FILTER (WHERE event_type IS NULL)", "v = 0"),
    ("schema", "ts", _NO_VALUE, "true"), ("type", "ts", _NO_VALUE, "true"),
    ("schema", "value", _NO_VALUE, "true"), ("type", "value", _NO_VALUE, "false"),
    ("check", "values positive", "count(*) FILTER (WHERE NOT (value > 0))", "v = 0"),
    ("check", "types filled", "count(*) FILTER (WHERE event_type IS NULL OR trim(event_type) = '')", "v = 0"),
    ("freshness", "ts", f"(epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(ts))) / 3.6e9", "v <= 0.001"),
    ("row_count", "min", "count(*)", "v >= 1"),
]


def _validated(t: Tables, *kinds: str) -> DataFrame:
    """All promises, or those of some kinds: the others are not planned."""
    orders = C.validate(t["orders"], ORDERS_CONTRACT, as_of=ORDERS_AS_OF, only=kinds or None)
    events = C.validate(t["events_gaps"], EVENTS_CONTRACT, as_of=EVENTS_AS_OF, only=kinds or None)
    return orders.unionByName(events).select(*_KEPT).withColumn("value", F.round("value", 6))


def _promises_sql(*kinds: str) -> str:
    def chosen(rows):
        return [r for r in rows if not kinds or r[0] in kinds]

    return with_tables(
        ["events_gaps"],
        _contract_rows("order book", "orders", chosen(_ORDER_PROMISES))
        + " UNION ALL " + _contract_rows("events_v1", "events_gaps", chosen(_EVENT_PROMISES)),
    )


def _contract_query(name: str, *kinds: str) -> None:
    @query(name, _promises_sql(*kinds))
    def _(t: Tables) -> DataFrame:
        return _validated(t, *kinds)


_contract_query("contract_columns", "schema", "row_count")
_contract_query("contract_types", "type", "row_count")
_contract_query("contract_nullability", "not_null")
_contract_query("contract_unique", "unique")
_contract_query("contract_checks", "check")
_contract_query("contract_freshness", "freshness")
_contract_query("contract_row_count", "row_count")
_contract_query("contract_validate")


# -- profiles ----------------------------------------------------------------------------------

_KIND_SQL = {
    "number": ("CAST({c} AS DOUBLE)", False, False), "text": ("TRY_CAST({c} AS DOUBLE)", True, True),
    "time": ("CAST(NULL AS DOUBLE)", False, True),
}


def profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """The profile of one table, one statement per column; kinds are number, text and time."""
    parts = []
    for no, (name, kind) in enumerate(columns):
        number, texts, ordered = _KIND_SQL[kind]
        number = number.format(c=name)
        first, last = (f"min({name})", f"max({name})") if ordered else ("CAST(NULL AS VARCHAR)",) * 2
        if kind == "time":
            first, last = f"strftime({first}, '%Y-%m-%d %H:%M:%S.%f')", f"strftime({last}, '%Y-%m-%d %H:%M:%S.%f')"
        length = (f"min(length({name}))", f"max(length({name}))") if texts else ("CAST(NULL AS BIGINT)",) * 2
        rule = {"number": "'numeric'", "time": "'date'"}.get(
            kind, "CASE WHEN av IS NOT NULL THEN 'numeric' WHEN length(f) >= 8 AND regexp_matches(f, '[-/:]') THEN 'date' ELSE 'string' END")
        parts.append(
            f"SELECT {no} AS ordinal, '{name}' AS column_name, n AS row_count, n - filled AS null_count, "
            f"round(CASE WHEN n > 0 THEN (n - filled) * 100.0::DOUBLE / n ELSE 0 END, 2) AS null_pct, dc AS distinct_count, mn, mx, av, f, l, sh, lo, "
            f"CASE WHEN filled = 0 THEN 'unknown' ELSE {rule} END AS col_type FROM (SELECT count(*) AS n, count({name}) AS filled, "
            f"count(DISTINCT {name}) AS dc, min({number}) AS mn, max({number}) AS mx, avg({number}) AS av, {first} AS f, {last} AS l, "
            f"{length[0]} AS sh, {length[1]} AS lo FROM {source})"
        )
    return (
        "SELECT ordinal, column_name, col_type, row_count, null_count, null_pct, distinct_count, "
        "CASE WHEN col_type = 'numeric' THEN mn END AS min_num, CASE WHEN col_type = 'numeric' THEN mx END AS max_num, "
        "CASE WHEN col_type = 'numeric' THEN round(av, 2) END AS avg_val, CASE WHEN col_type = 'date' THEN f END AS min_text, "
        "CASE WHEN col_type = 'date' THEN l END AS max_text, CAST(CASE WHEN col_type = 'string' THEN sh END AS INTEGER) AS min_length, "
        "CAST(CASE WHEN col_type = 'string' THEN lo END AS INTEGER) AS max_length FROM (" + "\nUNION ALL ".join(parts) + ")"
    )


def kinds(given: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Profile kinds of a given table's columns from their type names."""
    return [(n, "text" if k == "string" else "time" if "time" in k else "number") for n, k in given]


_EVENTS = kinds(_EVENT_COLUMNS)
_ORDERS = kinds(_ORDER_COLUMNS)
_LINES = [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
          ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
          ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")]
_DOCUMENTS = [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")]
CONTACTS = [(n, "number" if n == "customer_id" else "text") for n in ("customer_id", "full_name", "email", "phone", "segment", "created_at")]


@query("profile_column", with_tables(["events_gaps"], profile_sql("events_gaps", [("value", "number")])))
def _(t: Tables) -> DataFrame:
    return P.profile_table(t["events_gaps"], ["value"])


@query("profile_table", profile_sql("lineitem", _LINES))
def _(t: Tables) -> DataFrame:
    return P.profile_table(t["lineitem"])


@query("profile_infer_type", with_tables(["events_gaps", "contacts"], f"""
SELECT 'contacts' AS table_name, column_name, col_type FROM ({profile_sql("contacts", CONTACTS)})
UNION ALL SELECT 'events', column_name, col_type FROM ({profile_sql("events_gaps", _EVENTS)})
UNION ALL SELECT 'kinds', c, CASE WHEN n > 0 THEN k END FROM (SELECT count(*) AS n FROM lineitem), (VALUES ('flag', 'numeric'), ('bytes', 'binary'), ('list', 'nested')) AS v(c, k)
UNION ALL SELECT 'no values', 'nothing', 'unknown' FROM (SELECT count(*) FROM region)"""))
def _(t: Tables) -> DataFrame:
    """The inferred type needs no distinct values."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return P.profile_table(df, distinct="none").select(F.lit(name).alias("table_name"), "column_name", "col_type")

    blank = t["region"].select(F.lit(None).cast("string").alias("nothing"))
    kinds = t["lineitem"].selectExpr("l_quantity > 10 AS flag", "CAST(l_returnflag AS BINARY) AS bytes", "array(l_linenumber) AS list")
    return of(t["contacts"], "contacts").unionByName(of(t["events_gaps"], "events")).unionByName(of(blank, "no values")).unionByName(of(kinds, "kinds"))


@query("profile_sample_type", with_tables(["events_gaps", "contacts"], """
SELECT 'events' AS table_name, o AS ordinal, c AS column_name, k AS sample_type FROM (SELECT count(*) FROM events_gaps),
 (VALUES (0, 'event_id', 'numeric'), (1, 'ts', 'date'), (2, 'user_id', 'numeric'), (3, 'event_type', 'string'),
  (4, 'value', 'numeric'), (5, 'props', 'date')) AS v(o, c, k)
UNION ALL SELECT 'contacts', o, c, k FROM (SELECT count(*) FROM contacts),
 (VALUES (0, 'customer_id', 'numeric'), (1, 'full_name', 'string'), (2, 'email', 'string'), (3, 'phone', 'numeric'),
  (4, 'segment', 'string'), (5, 'created_at', 'date')) AS v(o, c, k)
UNION ALL SELECT 'late', o, c, CASE WHEN n > 300 THEN k ELSE 'unknown' END FROM (SELECT count(*) AS n FROM events),
 (VALUES (0, 'from_300', 'numeric'), (1, 'at_end', 'date'), (2, 'never', 'unknown')) AS v(o, c, k)"""))
def _(t: Tables) -> DataFrame:
    """Also columns that are filled late, in one row, or never."""
    late = t["events"].selectExpr("if(event_id >= 300, value, NULL) AS from_300", "if(event_id = 300, ts, NULL) AS at_end", "CAST(NULL AS STRING) AS never")
    parts = [P.sample_types(df).withColumn("table_name", F.lit(label)) for df, label in ((t["events_gaps"], "events"), (t["contacts"], "contacts"), (late, "late"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("profile_many", f"""
SELECT 'orders' AS source_name, * FROM ({profile_sql("orders", _ORDERS)})
UNION ALL SELECT 'events' AS source_name, * FROM ({profile_sql("events", _EVENTS)})
UNION ALL SELECT 'documents' AS source_name, * FROM ({profile_sql("documents", _DOCUMENTS)})""")
def _(t: Tables) -> DataFrame:
    """The enabled ones of the configured sources."""
    configured = {"orders": True, "events": True, "documents": True, "lineitem": False}
    return P.profile_many({name: t[name] for name, enabled in configured.items() if enabled})


_LOTS = {"2024-01-10": "ts < TIMESTAMP '2024-01-11'", "2024-01-20": "ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'", "2024-01-30": "ts >= TIMESTAMP '2024-01-21'"}


def _by_lots(t: Tables) -> str:
    """States of the events, recorded lot by lot, one of them first wrongly and then again; and of the customers."""
    path = shared_folder(t.spark, "profile-states")
    S.record(t["events_gaps"].where("event_id % 2 = 0"), path, "events", "2024-01-20")
    for day, condition in _LOTS.items():
        S.record(t["events_gaps"].where(condition), path, "events", day)
    S.record(t["contacts"], path, "contacts", "2024-01-30")
    return path


_EXACT = "column_name, col_type, row_count, null_count, null_pct, min_num, max_num, avg_val, min_text, max_text, min_length, max_length"


@query("profile_states", with_tables(["events_gaps", "contacts"], f"""
SELECT 'events' AS source_name, {_EXACT}, true AS distinct_near, CASE WHEN col_type = 'numeric' THEN true END AS median_near FROM ({profile_sql("events_gaps", _EVENTS)})
UNION ALL SELECT 'contacts', {_EXACT}, true, CASE WHEN col_type = 'numeric' THEN true END FROM ({profile_sql("contacts", CONTACTS)})"""))
def _(t: Tables) -> DataFrame:
    """Profiles merged from stored states, exact where states are; estimates are held against the tables.

    Distinct counts have to lie within 4 standard errors, medians between the ranks of 48 and 52 percent.
    """
    found = S.profile(S.load(t.spark, _by_lots(t)), "source_name")
    sides = {"events": t["events_gaps"], "contacts": t["contacts"]}
    exact = P.profile_many(sides).select("source_name", "column_name", F.col("distinct_count").alias("exact"))
    ranks = []
    for name, df in sides.items():
        numbers = [c for c, kind in df.dtypes if kind in ("bigint", "double")] + (["phone"] if name == "contacts" else [])
        both = ", ".join(f"('{c}', approx_percentile(CAST({c} AS DOUBLE), array(0.48D, 0.52D), 100000))" for c in numbers)
        ranks.append(df.selectExpr(f"inline(array({both}))").toDF("column_name", "bounds").withColumn("source_name", F.lit(name)))
    near = found.join(exact, ["source_name", "column_name"]).join(ranks[0].unionByName(ranks[1]), ["source_name", "column_name"], "left")
    return near.selectExpr(
        "source_name", *_EXACT.split(", "), "abs(distinct_count - exact) <= 0.0325 * exact + 0.5 AS distinct_near",
        "if(col_type = 'numeric', median BETWEEN bounds[0] AND bounds[1], NULL) AS median_near")


@query("profile_states_span", with_tables(["events_gaps"], f"""
SELECT {_EXACT} FROM ({profile_sql("(SELECT * FROM events_gaps WHERE ts >= TIMESTAMP '2024-01-11')", _EVENTS)})"""))
def _(t: Tables) -> DataFrame:
    """The last two lots of one source: the files of the first, and of the other source, are not opened."""
    return S.profile(S.load(t.spark, _by_lots(t), ["events"], since="2024-01-20")).select(*_EXACT.split(", "))


_TAGGED = {"customer_id": None, "full_name": None, "email": "email", "phone": "phone", "segment": None, "created_at": None}


def contacts_profile(t: Tables) -> DataFrame:
    return P.tag_personal(P.profile_table(t["contacts"]))


CONTACTS_SQL = (
    "SELECT *, CASE column_name WHEN 'email' THEN 'email' WHEN 'phone' THEN 'phone' END AS pii_type, "
    f"column_name IN ('email', 'phone') AS is_pii FROM ({profile_sql('contacts', CONTACTS)})"
)


@query("pii_tag_columns", with_tables(["contacts"], f"SELECT column_name, row_count, pii_type, is_pii FROM ({CONTACTS_SQL})"))
def _(t: Tables) -> DataFrame:
    return P.tag_personal(P.profile_table(t["contacts"], distinct="none")).select("column_name", "row_count", "pii_type", "is_pii")


def _all_profiles(t: Tables) -> DataFrame:
    """Profiles of three sources: contacts, customers, and pages as a source without personal columns."""
    parts = {1: t["contacts"], 2: t["customer"].select("c_custkey", F.col("c_name").alias("adres_line"), F.col("c_acctbal").alias("account_balance")), 3: t["pages"]}
    whole = None
    for source, df in parts.items():
        one = P.tag_personal(P.profile_table(df, distinct="none")).withColumn("source_id", F.lit(source))
        whole = one if whole is None else whole.unionByName(one)
    return whole


_REPORT_SQL = """SELECT n_nationkey AS source_id, n_name AS source_name, c AS column_name, p AS pii_type FROM nation JOIN
 (VALUES (1, 'email', 'email'), (1, 'phone', 'phone'), (2, 'adres_line', 'adres'), (2, 'account_balance', 'account')) AS v(s, c, p) ON s = n_nationkey"""


@query("pii_report", f"""WITH r AS ({_REPORT_SQL})
SELECT source_id, source_name, column_name, pii_type, CAST(NULL AS BIGINT) AS pii_columns, CAST(NULL AS BIGINT) AS sources_affected FROM r
UNION ALL SELECT NULL, source_name, NULL, NULL, count(*), 1 FROM r GROUP BY source_name
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*), count(DISTINCT source_name) FROM r""")
def _(t: Tables) -> DataFrame:
    report = P.personal_columns(_all_profiles(t), t["sources"])
    return report.unionByName(P.personal_summary(report), allowMissingColumns=True)


@query("pii_report_source", with_tables(["contacts"], f"""
SELECT column_name, pii_type, null_pct, distinct_count, count(*) OVER () AS n FROM ({CONTACTS_SQL}) WHERE is_pii"""))
def _(t: Tables) -> DataFrame:
    found = contacts_profile(t).where("is_pii").select("column_name", "pii_type", "null_pct", "distinct_count")
    # one row per flagged column is left here
    return found.withColumn("n", F.count("*").over(Window.partitionBy())).orderBy("column_name")


@query("glossary_merge", with_tables(["contacts"], f"""
SELECT source_id, column_name, row_count, CASE column_name WHEN 'email' THEN 'E-mail address' WHEN 'phone' THEN 'Telephone' END AS business_name,
 CASE WHEN column_name = 'email' THEN 'crm' ELSE 'unassigned' END AS owner FROM (SELECT 1 AS source_id, * FROM ({CONTACTS_SQL}))"""))
def _(t: Tables) -> DataFrame:
    profile = contacts_profile(t).withColumn("source_id", F.lit(1)).withColumn("owner", F.lit("unassigned"))
    updates = constant_rows(
        t.spark, [(1, "email", "E-mail address", "crm", "x"), (1, "phone", "Telephone", None, "y"), (9, "email", "other source", "z", "z")],
        "source_id int, column_name string, business_name string, owner string, unknown_field string",
    )
    return P.merge_glossary(profile, updates).select("source_id", "column_name", "row_count", "business_name", "owner")


@query("pii_content_scan", with_tables(["contacts"], r"""
SELECT 'email' AS column_name, 'email' AS keyword, count(*) FILTER (WHERE regexp_matches(email, '^[^@]+@[^@]+\.[^@]+$')) AS matching,
 count(email) AS filled, round(count(*) FILTER (WHERE regexp_matches(email, '^[^@]+@[^@]+\.[^@]+$')) / count(email), 6) AS match_ratio FROM contacts
UNION ALL SELECT 'phone', 'phone', count(*) FILTER (WHERE regexp_matches(phone, '^\+?[\d\s\-]{10,15}$')), count(phone),
 round(count(*) FILTER (WHERE regexp_matches(phone, '^\+?[\d\s\-]{10,15}$')) / count(phone), 6) FROM contacts"""))
def _(t: Tables) -> DataFrame:
    return P.scan_personal(t["contacts"])


@query("profile_overwrite", with_tables(["contacts"], f"""
SELECT 1 AS source_id, column_name, row_count, distinct_count FROM ({CONTACTS_SQL})
UNION ALL SELECT 2, column_name, row_count, distinct_count FROM ({profile_sql("orders", _ORDERS)})"""))
def _(t: Tables) -> DataFrame:
    """Two sources are stored, then the first one again: only its rows are replaced."""
    path = shared_folder(t.spark, "profiles")
    first = P.profile_table(t["nation"]).withColumn("source_id", F.lit(1))
    second = P.profile_table(t["orders"]).withColumn("source_id", F.lit(2))
    stores.replace_partitions(first.unionByName(second), path, "source_id")
    stores.replace_partitions(P.profile_table(t["contacts"]).withColumn("source_id", F.lit(1)), path, "source_id")
    return t.spark.read.parquet(path).select("source_id", "column_name", "row_count", "distinct_count")


@query("profile_export", with_tables(["contacts"], f"""
SELECT column_name AS "Column", col_type AS "Type", row_count AS "RowCount", round(null_pct, 2) AS "NullPct", distinct_count AS "DistinctCount",
 coalesce(round(avg_val, 2), 0.0) AS "Avg", CASE WHEN is_pii THEN 'Yes' ELSE 'No' END AS "IsPII", pii_type AS "PIIType", 'csv' AS format FROM ({CONTACTS_SQL})
UNION ALL SELECT column_name, col_type, row_count, round(null_pct, 2), distinct_count, coalesce(round(avg_val, 2), 0.0),
 CASE WHEN is_pii THEN 'Yes' ELSE 'No' END, pii_type, 'json' FROM ({CONTACTS_SQL})"""))
def _(t: Tables) -> DataFrame:
    rows = P.export_rows(contacts_profile(t))
    as_csv, as_json = shared_folder(t.spark, "profile-csv"), shared_folder(t.spark, "profile-json")
    stores.export_csv(rows, as_csv)
    stores.export_json(rows, as_json)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kept = ("Column", "Type", "RowCount", "NullPct", "DistinctCount", "Avg", "IsPII", "PIIType")
    return readers.read_csv(t.spark, as_csv, schema).select(*kept, F.lit("csv").alias("format")).unionByName(
        readers.read_json(t.spark, as_json, schema).select(*kept, F.lit("json").alias("format")))
