"""Registered queries: every check kind, and running suites of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.operators import history_checks as H, observed, predicate_failures, side_by_side
from tablecheck.operators import suite
from tablecheck.operators.checks import Rule, rule_from_dict, with_tags
from tablecheck.plans.registry import query
from tablecheck.plans.tables import EVENTS_AS_OF, ORDERS_AS_OF, Tables, with_tables
from tablecheck.session import shared_folder

SHOWN = ("check_name", "value", "expected", "passed")


def shown(results: DataFrame) -> DataFrame:
    return results.select("check_name", F.round("value", 6).alias("value"), "expected", "passed")


def expect(*rows: tuple[str, str, str, str, str]) -> str:
    """SQL of expected result rows: (check name, measure, FROM clause, expectation, verdict over ``value``)."""
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS check_name, round(CAST(value AS DOUBLE), 6) AS value, "
        f"'{expected.replace(chr(39), chr(39) * 2)}' AS expected, coalesce(({verdict}), false) AS passed "
        f"FROM (SELECT {measure} AS value FROM {source})"
        for name, measure, source, expected, verdict in rows
    )


@query("chk_is_not_null", with_tables(["events_gaps"], expect(
    ("user ids counted", "count(user_id)", "events_gaps", "is_not_null(None)", "value IS NOT NULL AND value <> 0"),
    ("no such type", "count(*) FILTER (WHERE event_type = 'nothing')", "events_gaps", "is_not_null(None)", "value <> 0"),
    ("max of nothing", "max(CASE WHEN event_type = 'nothing' THEN value END)", "events_gaps", "is_not_null(None)", "value <> 0"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("user ids counted", "is_not_null", metric="count(user_id)"),
        Rule("no such type", "is_not_null", metric="count_if(event_type = 'nothing')"),
        Rule("max of nothing", "is_not_null", metric="max(if(event_type = 'nothing', value, null))"),
    ]))


_NULL_PCT = "count_if({c} IS NULL) * 100.0D / count(*)"
_NULL_PCT_SQL = "count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*)"


@query("chk_less_than", with_tables(["events_gaps"], expect(
    ("user_id null pct", _NULL_PCT_SQL.format(c="user_id"), "events_gaps", "less_than(5.0)", "value < 5"),
    ("event_type null pct", _NULL_PCT_SQL.format(c="event_type"), "events_gaps", "less_than(5.0)", "value < 5"),
    ("value null pct", _NULL_PCT_SQL.format(c="value"), "events_gaps", "less_than(10.5)", "value < 10.5"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("user_id null pct", "less_than", 5.0, metric=_NULL_PCT.format(c="user_id")),
        Rule("event_type null pct", "less_than", 5.0, metric=_NULL_PCT.format(c="event_type")),
        Rule("value null pct", "less_than", 10.5, metric=_NULL_PCT.format(c="value")),
    ]))


@query("chk_greater_than", expect(
    ("turnover positive", "round(sum(o_totalprice), 2)", "orders", "greater_than(0)", "value > 0"),
    ("rows", "count(*)", "orders", "greater_than(1000000)", "value > 1000000"),
    ("strict at zero", "min(0)", "orders", "greater_than(0)", "value > 0"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["orders"], [
        Rule("turnover positive", "greater_than", 0, metric="round(sum(o_totalprice), 2)"),
        Rule("rows", "greater_than", 1000000, metric="count(*)"),
        Rule("strict at zero", "greater_than", 0, metric="min(0)"),
    ]))


@query("chk_between", expect(
    ("mean quantity", "avg(l_quantity)", "lineitem", "between([1.0, 50.0])", "value BETWEEN 1 AND 50"),
    ("lowest quantity", "min(l_quantity)", "lineitem", "between([1.0, 50.0])", "value BETWEEN 1 AND 50"),
    ("mean tax", "avg(l_tax)", "lineitem", "between([0.5, 1.0])", "value BETWEEN 0.5 AND 1"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["lineitem"], [
        Rule("mean quantity", "between", [1.0, 50.0], metric="avg(l_quantity)"),
        Rule("lowest quantity", "between", [1.0, 50.0], metric="min(l_quantity)"),
        Rule("mean tax", "between", [0.5, 1.0], metric="avg(l_tax)"),
    ]))


@query("chk_equals", with_tables(["events_gaps"], expect(
    ("no negative ids", "count(*) FILTER (WHERE event_id < 0)", "events_gaps", "equals(0)", "value = 0"),
    ("number is not text", "count(*) FILTER (WHERE event_id < 0)", "events_gaps", "equals(0)", "false"),
    ("first type", "CAST(NULL AS DOUBLE)", "(SELECT min(trim(event_type)) AS m FROM events_gaps WHERE event_type <> '  ')", "equals(click)", "true"),
    ("nothing is nothing", "max(CASE WHEN event_id < 0 THEN value END)", "events_gaps", "equals(None)", "value IS NULL"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("no negative ids", "equals", 0, metric="count_if(event_id < 0)"),
        Rule("number is not text", "equals", "0", metric="count_if(event_id < 0)"),
        Rule("first type", "equals", "click", metric="min(if(event_type <> '  ', event_type, null))"),
        Rule("nothing is nothing", "equals", None, metric="max(if(event_id < 0, value, null))"),
    ]))


@query("chk_row_count_at_least", expect(
    ("documents", "count(*)", "documents", "row_count_at_least(200)", "value >= 200"),
    ("documents, many", "count(*)", "documents", "row_count_at_least(1000000000)", "value >= 1000000000"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["documents"], [
        Rule("documents", "row_count_at_least", 200),
        Rule("documents, many", "row_count_at_least", 1000000000),
    ]))


@query("chk_row_count_between", expect(
    ("orders", "count(*)", "orders", "row_count_between([1000, 10000000])", "value BETWEEN 1000 AND 10000000"),
    ("orders, few", "count(*)", "orders", "row_count_between([1, 10])", "value BETWEEN 1 AND 10"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["orders"], [
        Rule("orders", "row_count_between", [1000, 10000000]),
        Rule("orders, few", "row_count_between", [1, 10]),
    ]))


@query("chk_not_empty", with_tables(["events_gaps"], expect(
    ("event_type filled", "count(*) FILTER (WHERE event_type IS NULL OR trim(event_type) = '')", "events_gaps", "not_empty(None)", "value = 0"),
    ("props filled", "count(*) FILTER (WHERE props IS NULL OR trim(props) = '')", "events_gaps", "not_empty(None)", "value = 0"),
    ("newest type", "CAST(NULL AS DOUBLE)", "(SELECT max(event_type) AS m FROM events_gaps)", "not_empty(None)", "true"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("event_type filled", "not_empty", column="event_type"),
        Rule("props filled", "not_empty", column="props"),
        Rule("newest type", "not_empty", metric="max(event_type)"),
    ]))


_TYPES = ["click", "view", "purchase", "signup", "error"]


@query("chk_accepted_values", with_tables(["events_gaps"], expect(
    ("types", "count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ('click','view','purchase','signup','error'))",
     "events_gaps", f"accepted_values({_TYPES})", "value = 0"),
    ("types or null", "count(*) FILTER (WHERE event_type NOT IN ('click','view','purchase','signup','error'))",
     "events_gaps", f"accepted_values({_TYPES})", "value = 0"),
    ("status", "count(*) FILTER (WHERE user_id < 0)", "events_gaps", "accepted_values(['0'])", "value = 0"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("types", "accepted_values", _TYPES, column="event_type"),
        Rule("types or null", "accepted_values", _TYPES, column="event_type", options={"count_nulls": False}),
        Rule("status", "accepted_values", ["0"], metric="count_if(user_id < 0)"),
    ]))


@query("chk_regex_match", with_tables(["contacts"], expect(
    ("e-mail", "count(*) FILTER (WHERE email IS NULL OR NOT regexp_matches(email, '^(?:[^@]+@[^@]+\\.[a-z]+)'))",
     "contacts", r"regex_match([^@]+@[^@]+\.[a-z]+)", "value = 0"),
    ("phone", "count(*) FILTER (WHERE phone IS NULL OR NOT regexp_matches(phone, '^(?:\\+90)'))",
     "contacts", r"regex_match(\+90)", "value = 0"),
    ("name, anchored at the start only", "count(*) FILTER (WHERE NOT regexp_matches(full_name, '^(?:Customer)'))",
     "contacts", "regex_match(Customer)", "value = 0"),
    ("segment, two choices", "count(*) FILTER (WHERE NOT regexp_matches(segment, '^(?:AUTO|BUILD)'))",
     "contacts", "regex_match(AUTO|BUILD)", "value = 0"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["contacts"], [
        Rule("e-mail", "regex_match", r"[^@]+@[^@]+\.[a-z]+", column="email"),
        Rule("phone", "regex_match", r"\+90", column="phone"),
        Rule("name, anchored at the start only", "regex_match", "Customer", column="full_name"),
        Rule("segment, two choices", "regex_match", "AUTO|BUILD", column="segment"),
    ]))


_EVENT_AGE = f"epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(ts))"


@query("chk_freshness_hours", expect(
    ("events fresh", f"({_EVENT_AGE}) / 3.6e9", "events", "freshness_hours(48)", "value <= 48"),
    ("events very fresh", f"({_EVENT_AGE}) / 3.6e9", "events", "freshness_hours(0.001)", "value <= 0.001"),
    ("no rows", "CAST(NULL AS DOUBLE)", "(SELECT count(*) AS n FROM events)", "freshness_hours(48)", "false"),
    ("future passes", "(epoch_us(TIMESTAMP '2023-01-01 00:00:00') - epoch_us(max(ts))) / 3.6e9", "events", "freshness_hours(0)", "value <= 0"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events"], [
        Rule("events fresh", "freshness_hours", 48, column="ts", options={"as_of": EVENTS_AS_OF}),
        Rule("events very fresh", "freshness_hours", 0.001, column="ts", options={"as_of": EVENTS_AS_OF}),
        Rule("no rows", "freshness_hours", 48, metric="max(if(event_id < 0, ts, null))", options={"as_of": EVENTS_AS_OF}),
        Rule("future passes", "freshness_hours", 0, column="ts", options={"as_of": "2023-01-01 00:00:00"}),
    ]))


@query("chk_referential_integrity", with_tables(["events_gaps"], expect(
    ("lines have orders", "count(*)", "lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
     "referential_integrity(['orders', 'o_orderkey'])", "value = 0"),
    ("lines have suppliers", "count(*)", "lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)",
     "referential_integrity(['supplier', 's_suppkey'])", "value = 0"),
    ("NOT IN with a null", "count(*)", "lineitem WHERE l_orderkey NOT IN (SELECT user_id FROM events_gaps)",
     "referential_integrity(['events_gaps', 'user_id'])", "value = 0"),
    ("nulls left out", "count(*)", "lineitem WHERE l_orderkey NOT IN (SELECT user_id FROM events_gaps WHERE user_id IS NOT NULL)",
     "referential_integrity(['events_gaps', 'user_id'])", "value = 0"),
)))
def _(t: Tables) -> DataFrame:
    tables = {n: t[n] for n in ("orders", "supplier", "events_gaps")}
    return shown(suite.evaluate(t["lineitem"], [
        Rule("lines have orders", "referential_integrity", ["orders", "o_orderkey"], column="l_orderkey"),
        Rule("lines have suppliers", "referential_integrity", ["supplier", "s_suppkey"], column="l_partkey"),
        Rule("NOT IN with a null", "referential_integrity", ["events_gaps", "user_id"], column="l_orderkey", options={"not_in": True}),
        Rule("nulls left out", "referential_integrity", ["events_gaps", "user_id"], column="l_orderkey"),
    ], tables=tables))


@query("chk_completeness_ratio", with_tables(["events_gaps"], expect(
    ("user_id", "(count(*) - count(user_id)) / count(*)", "events_gaps", "completeness_ratio(0.95)", "round(value, 10) <= round(1 - 0.95, 10)"),
    ("event_type at the limit", "(count(*) - count(event_type)) / count(*)", "events_gaps", "completeness_ratio(0.95)", "round(value, 10) <= round(1 - 0.95, 10)"),
    ("value", "(count(*) - count(value)) / count(*)", "events_gaps", "completeness_ratio(0.95)", "round(value, 10) <= round(1 - 0.95, 10)"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("user_id", "completeness_ratio", 0.95, column="user_id"),
        Rule("event_type at the limit", "completeness_ratio", 0.95, column="event_type"),
        Rule("value", "completeness_ratio", 0.95, column="value"),
    ]))


@query("chk_statistical_anomaly", expect(
    ("quantity", "abs(avg(l_quantity) - 25.0) / stddev_samp(l_quantity)", "lineitem", "statistical_anomaly(3.0)", "value <= 3"),
    ("price", "abs(avg(l_extendedprice) - 500000.0) / stddev_samp(l_extendedprice)", "lineitem", "statistical_anomaly(3.0)", "value <= 3"),
    ("constant", "CAST(NULL AS DOUBLE)", "(SELECT count(*) AS n FROM lineitem)", "statistical_anomaly(3.0)", "value <= 3"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["lineitem"].withColumn("one", F.lit(1.0)), [
        Rule("quantity", "statistical_anomaly", 3.0, column="l_quantity", options={"expected": 25.0}),
        Rule("price", "statistical_anomaly", 3.0, column="l_extendedprice", options={"expected": 500000.0}),
        Rule("constant", "statistical_anomaly", 3.0, column="one"),
    ]))


@query("chk_schema_drift", expect(
    ("columns", "count(*)", "information_schema.columns WHERE table_name = 'lineitem'", "schema_drift(11)", "value = 11"),
    ("columns, drifted", "count(*)", "information_schema.columns WHERE table_name = 'lineitem'", "schema_drift(12)", "value = 12"),
    ("rows behind the schema", "count(*)", "lineitem", "row_count_at_least(1)", "value >= 1"),
).replace("count(*) AS value FROM information_schema.columns WHERE table_name = 'lineitem'", "11 AS value"))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["lineitem"], [
        Rule("columns", "schema_drift", 11),
        Rule("columns, drifted", "schema_drift", 12),
        Rule("rows behind the schema", "row_count_at_least", 1),
    ]))


_WANTED = {"O_ORDERKEY": "bigint", "o_custkey": "int", "o_orderstatus": None}


@query("chk_schema_check", expect(
    ("names and types", "0", "(SELECT count(*) AS n FROM orders)", f"schema_check({_WANTED})", "true"),
    ("wrong type", "1", "(SELECT count(*) AS n FROM orders)", "schema_check({'o_totalprice': 'string'})", "false"),
    ("missing column", "2", "(SELECT count(*) AS n FROM orders)", "schema_check({'nope': None, 'nor_this': 'int'})", "false"),
    ("rows behind the schema", "count(*)", "orders", "row_count_at_least(1)", "value >= 1"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["orders"], [
        Rule("names and types", "schema_check", _WANTED),
        Rule("wrong type", "schema_check", {"o_totalprice": "string"}),
        Rule("missing column", "schema_check", {"nope": None, "nor_this": "int"}),
        Rule("rows behind the schema", "row_count_at_least", 1),
    ]))


@query("chk_custom_sql", expect(
    ("equality", "count(*) FILTER (WHERE o_totalprice < 0)", "orders", "custom_sql(0)", "value = 0"),
    ("range", "avg(o_totalprice)", "orders", "custom_sql([10, 1000000])", "value BETWEEN 10 AND 1000000"),
    ("any value", "max(o_custkey)", "orders", "custom_sql(None)", "value IS NOT NULL"),
    ("no value", "max(CASE WHEN o_orderkey < 0 THEN 1 END)", "orders", "custom_sql(None)", "value IS NOT NULL"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["orders"], [
        Rule("equality", "custom_sql", 0, query="SELECT count_if(o_totalprice < 0) FROM source"),
        Rule("range", "custom_sql", [10, 1000000], query="SELECT avg(o_totalprice), count(*) FROM source"),
        Rule("any value", "custom_sql", None, query="SELECT max(o_custkey) FROM source"),
        Rule("no value", "custom_sql", None, query="SELECT max(if(o_orderkey < 0, 1, null)) FROM source"),
    ]))


@query("chk_volume_anomaly", """
WITH days AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1),
 judged AS (SELECT d, n, lag(n) OVER (ORDER BY d) AS base FROM days)
SELECT 'events on ' || CAST(d AS VARCHAR) AS check_name, round(CAST(n AS DOUBLE), 6) AS value, 'volume_anomaly(10.0)' AS expected,
 CASE WHEN base IS NULL THEN n > 0 WHEN base = 0 THEN n = 0 ELSE abs(n - base) * 100.0 / base <= 10 END AS passed FROM judged
UNION ALL """ + expect(
    ("first measure", "count(*)", "events", "volume_anomaly(None)", "value > 0"),
    ("empty baseline", "count(*)", "events", "volume_anomaly(20.0)", "value = 0"),
    ("far from the baseline", "count(*)", "events", "volume_anomaly(20.0)", "abs(value - 100) / 100.0 * 100 <= 20"),
))
def _(t: Tables) -> DataFrame:
    """Constant baselines in a suite, and each day against the day before it."""
    fixed = suite.evaluate(t["events"], [
        Rule("first measure", "volume_anomaly"),
        Rule("empty baseline", "volume_anomaly", 20.0, options={"baseline": 0}),
        Rule("far from the baseline", "volume_anomaly", 20.0, options={"baseline": 100}),
    ])
    daily = H.volume_by_day(t["events"], "ts", max_pct=10.0).select(
        F.concat(F.lit("events on "), F.col("day").cast("string")).alias("check_name"),
        F.round("value", 6).alias("value"), F.lit("volume_anomaly(10.0)").alias("expected"), "passed",
    )
    return shown(fixed).unionByName(daily)


@query("chk_row_condition", with_tables(["events_gaps"], expect(
    ("positive values", "count(*) FILTER (WHERE NOT (value > 0))", "events_gaps", "row_condition(value > 0)", "value = 0"),
    ("small users", "count(*) FILTER (WHERE NOT (user_id < 100))", "events_gaps", "row_condition(user_id < 100)", "value = 0"),
)))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], [
        Rule("positive values", "row_condition", "value > 0"),
        Rule("small users", "row_condition", "user_id < 100"),
    ]))


@query("chk_duplicate_excess", with_tables(["orders_dup"], expect(
    ("order key", "count(*) - count(DISTINCT o_orderkey)", "orders_dup", "duplicate_row(0)", "value <= 0"),
    ("order and customer", "count(*) - count(DISTINCT (o_orderkey, o_custkey))", "orders_dup", "duplicate_row(100000)", "value <= 100000"),
    ("priority", "count(*) - count(DISTINCT o_orderpriority)", "orders_dup", "duplicate_row(0)", "value <= 0"),
    ("text", "count(*) - count(DISTINCT text)", "documents", "duplicate_row(0)", "value <= 0"),
    ("user and microsecond", "count(*) - count(DISTINCT (user_id, ts + to_microseconds(event_id % 3), value * 0))",
     "(SELECT user_id, event_id, date_trunc('hour', ts) AS ts, abs(value) AS value FROM events)", "duplicate_row(0)", "value <= 0"),
)))
def _(t: Tables) -> DataFrame:
    # instants that differ by microseconds only, and zeros of either sign
    close = t["events"].selectExpr(
        "user_id", "timestampadd(MICROSECOND, CAST(event_id % 3 AS INT), date_trunc('hour', ts)) AS at", "if(event_id % 2 = 0, 0D, -0D) AS zero"
    )
    instants = suite.evaluate(close, [Rule("user and microsecond", "duplicate_row", 0, column=["user_id", "at", "zero"])])
    orders = suite.evaluate(t["orders_dup"], [
        Rule("order key", "duplicate_row", 0, column="o_orderkey"),
        Rule("order and customer", "duplicate_row", 100000, column=["o_orderkey", "o_custkey"]),
        Rule("priority", "duplicate_row", 0, column="o_orderpriority"),
    ])
    texts = suite.evaluate(t["documents"], [Rule("text", "duplicate_row", 0, column="text")])
    return shown(orders.unionByName(texts).unionByName(instants))


@query("chk_duplicate_groups", with_tables(["orders_dup", "events_gaps"], expect(
    ("order key", "count(*)", "(SELECT 1 FROM orders_dup GROUP BY o_orderkey HAVING count(*) > 1)", "duplicate_row(0)", "value <= 0"),
    ("whole rows", "count(*)", "(SELECT 1 FROM orders_dup GROUP BY ALL HAVING count(*) > 1)".replace(
        "GROUP BY ALL", "GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"),
     "duplicate_row(0)", "value <= 0"),
    ("user with nulls", "count(*)", "(SELECT 1 FROM events_gaps GROUP BY user_id HAVING count(*) > 1)", "duplicate_row(100000)", "value <= 100000"),
)))
def _(t: Tables) -> DataFrame:
    groups = {"form": "groups"}
    orders = suite.evaluate(t["orders_dup"], [
        Rule("order key", "duplicate_row", 0, column="o_orderkey", options=groups),
        Rule("whole rows", "duplicate_row", 0, options=groups),
    ])
    users = suite.evaluate(t["events_gaps"], [
        Rule("user with nulls", "duplicate_row", 100000, column="user_id", options=groups)
    ])
    return shown(orders.unionByName(users))


@query("chk_zscore_anomaly", with_tables(["metric_history", "metric_current"], """
SELECT c.name AS check_name, round(c.value, 6) AS value, 'zscore_anomaly(3.0)' AS expected,
 coalesce(CASE WHEN coalesce(s.n, 0) < 5 THEN true WHEN s.sd = 0 THEN true ELSE abs(c.value - s.m) / s.sd <= 3 END, false) AS passed
FROM metric_current c LEFT JOIN (
  SELECT name, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM (
    SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY run_at DESC) AS rn FROM metric_history
    WHERE run_date < DATE '2024-01-30' AND value IS NOT NULL) WHERE rn <= 100 GROUP BY name) s ON s.name = c.name"""))
def _(t: Tables) -> DataFrame:
    past = t["metric_history"].where("run_date < DATE '2024-01-30'")
    judged = H.zscore_check(t["metric_current"].select("name", "value"), past)
    return judged.select(
        F.col("name").alias("check_name"), F.round("value", 6).alias("value"),
        F.lit("zscore_anomaly(3.0)").alias("expected"), "passed",
    )


@query("chk_typed_values", expect(
    ("doubles", "count(*) FILTER (WHERE NOT (CAST(l_linenumber AS DOUBLE) IN (1, 2, 3)))", "lineitem", "accepted_values([1, 2, 3])", "value = 0"),
    ("decimals", "count(*) FILTER (WHERE NOT (l_linenumber IN (1, 2)))", "lineitem", "accepted_values([1.0, 2])", "value = 0"),
    ("flags", "0", "(SELECT count(*) FROM lineitem)", "accepted_values([True, False])", "value = 0"),
    ("large whole numbers", "count(*) FILTER (WHERE l_linenumber <> 1)", "lineitem", "accepted_values([9007199254740993])", "value = 0"),
    ("one apart", "9007199254740992 + min(l_linenumber)", "lineitem", "equals(9007199254740992)", "false"),
    ("just that", "9007199254740992 + min(l_linenumber)", "lineitem", "equals(9007199254740993)", "min(l_linenumber) = 1".replace("min(l_linenumber) = 1", "value = 9007199254740993")),
))
def _(t: Tables) -> DataFrame:
    """Membership and equality by the type of the values: no text comparison of numbers, no rounding of whole ones."""
    typed = t["lineitem"].selectExpr(
        "CAST(l_linenumber AS DOUBLE) AS d", "CAST(l_linenumber AS DECIMAL(9, 2)) AS c", "l_linenumber > 3 AS b", "9007199254740992L + l_linenumber AS l"
    )
    return shown(suite.evaluate(typed, [
        Rule("doubles", "accepted_values", [1, 2, 3], column="d"), Rule("decimals", "accepted_values", [1.0, 2], column="c"),
        Rule("flags", "accepted_values", [True, False], column="b"), Rule("large whole numbers", "accepted_values", [9007199254740993], column="l"),
        Rule("one apart", "equals", 9007199254740992, metric="min(l)"), Rule("just that", "equals", 9007199254740993, metric="min(l)"),
    ]))


@query("chk_query_forms", with_tables(["metric_history"], expect(
    ("orders and customers", "count(*)", "orders", "cross_table_check(None)", "value > (SELECT count(*) FROM customer)"),
    ("quantity, one text", "avg(l_quantity)", "lineitem", "distribution_check([25.5, 14.4])",
     "abs(value - 25.5) / 25.5 * 100 <= 10 AND abs((SELECT stddev_samp(l_quantity) FROM lineitem) - 14.4) / 14.4 * 100 <= 10"),
    ("quantity, two columns", "avg(l_quantity)", "lineitem", "distribution_check([25.5, 99.0])", "abs((SELECT stddev_samp(l_quantity) FROM lineitem) - 99) / 99 * 100 <= 10"),
    ("last order", f"date_diff('microsecond', CAST(max(o_orderdate) AS TIMESTAMP), TIMESTAMP '{ORDERS_AS_OF}') / 3.6e9", "orders", "freshness_hours(10)", "value <= 10"),
    *((name, "count(*)", "orders", "zscore_anomaly(3.0)", f"""(SELECT coalesce(abs((SELECT count(*) FROM orders) - avg(value)) / nullif(stddev_pop(value), 0) <= 3, true) FROM (
      SELECT value, row_number() OVER (ORDER BY run_at DESC) AS rn FROM metric_history WHERE value IS NOT NULL AND name = '{name}') WHERE rn <= 50)""") for name in ("click", "view")),
)))
def _(t: Tables) -> DataFrame:
    """Kinds that compare two values or look back, with whole queries as their measures."""
    lines = suite.evaluate(t["lineitem"], [
        Rule("quantity, one text", "distribution_check", [25.5, 14.4], query="SELECT concat(avg(l_quantity), ',', stddev_samp(l_quantity)) FROM source"),
        Rule("quantity, two columns", "distribution_check", [25.5, 99.0], query="SELECT avg(l_quantity), stddev_samp(l_quantity) FROM source"),
    ])
    orders = suite.evaluate(t["orders"], [
        Rule("orders and customers", "cross_table_check", query="SELECT count(*) FROM source", options={"table": "customer", "other_query": "SELECT count(*) FROM source", "comparator": "greater_than"}),
        Rule("last order", "freshness_hours", 10, query="SELECT max(o_orderdate) FROM source", options={"as_of": ORDERS_AS_OF}),
        *(Rule(name, "zscore_anomaly", 3.0, query="SELECT count(*) FROM source", options={"points": 50}) for name in ("click", "view")),
    ], tables={"customer": t["customer"]}, history=t["metric_history"])
    return shown(lines.unionByName(orders))


@query("chk_cross_table", expect(
    ("as many orders as customers", "count(*)", "orders", "cross_table_check(None)", "value = (SELECT count(*) FROM customer)"),
    ("fewer customers than orders", "count(*)", "orders", "cross_table_check(None)", "value > (SELECT count(*) FROM customer)"),
    ("orders below lines", "count(*)", "orders", "cross_table_check(None)", "value < (SELECT count(*) FROM lineitem)"),
    ("keys agree within 5 pct", "max(o_orderkey)", "orders", "cross_table_check(None)",
     "abs(value - (SELECT max(l_orderkey) FROM lineitem)) * 100.0 / abs((SELECT max(l_orderkey) FROM lineitem)) <= 5"),
    ("unknown comparator", "count(*)", "orders", "cross_table_check(None)", "false"),
    ("nothing on the other side", "count(*)", "orders", "cross_table_check(None)", "CAST(NULL AS BOOLEAN)"),
))
def _(t: Tables) -> DataFrame:
    def rule(name, table, comparator, metric="count(*)", other=None, tolerance=0.0):
        return Rule(name, "cross_table_check", metric=metric, options={
            "table": table, "comparator": comparator, "other_metric": other or metric, "tolerance": tolerance})

    return shown(suite.evaluate(t["orders"], [
        rule("as many orders as customers", "customer", "equals"),
        rule("fewer customers than orders", "customer", "greater_than"),
        rule("orders below lines", "lineitem", "less_than"),
        rule("keys agree within 5 pct", "lineitem", "within_pct", "max(o_orderkey)", "max(l_orderkey)", 5.0),
        rule("unknown comparator", "customer", "about"),
        rule("nothing on the other side", "customer", "equals", other="max(if(c_custkey < 0, 1, null))"),
    ], tables={n: t[n] for n in ("customer", "lineitem")}))


@query("chk_distribution", expect(
    ("quantity", "avg(l_quantity)", "lineitem", "distribution_check([25.5, 14.4])",
     "abs(value - 25.5) / 25.5 * 100 <= 10 AND abs((SELECT stddev_samp(l_quantity) FROM lineitem) - 14.4) / 14.4 * 100 <= 10"),
    ("quantity, narrow", "avg(l_quantity)", "lineitem", "distribution_check([25.5, 1.0])",
     "abs((SELECT stddev_samp(l_quantity) FROM lineitem) - 1.0) / 1.0 * 100 <= 10"),
    ("discount, mean only", "avg(l_discount)", "lineitem", "distribution_check([0.05, None])", "abs(value - 0.05) / 0.05 * 100 <= 10"),
    ("expected zero", "avg(l_tax)", "lineitem", "distribution_check([0, None])", "abs(value - 0) / 1 * 100 <= 10"),
) + """
UNION ALL SELECT 'quantity of ' || l_returnflag AS check_name, round(avg(l_quantity), 6) AS value, 'distribution_check([25.5, 14.4])' AS expected,
 abs(avg(l_quantity) - 25.5) / 25.5 * 100 <= 0.5 AND abs(stddev_samp(l_quantity) - 14.4) / 14.4 * 100 <= 0.5 AS passed
FROM lineitem GROUP BY l_returnflag""")
def _(t: Tables) -> DataFrame:
    whole = suite.evaluate(t["lineitem"], [
        Rule("quantity", "distribution_check", [25.5, 14.4], column="l_quantity"),
        Rule("quantity, narrow", "distribution_check", [25.5, 1.0], column="l_quantity"),
        Rule("discount, mean only", "distribution_check", [0.05, None], column="l_discount"),
        Rule("expected zero", "distribution_check", [0, None], column="l_tax"),
    ])
    by_flag = H.distribution_by_group(t["lineitem"], "l_returnflag", "l_quantity", 25.5, 14.4, tolerance_pct=0.5)
    return shown(whole).unionByName(by_flag.select(
        F.concat(F.lit("quantity of "), F.col("l_returnflag")).alias("check_name"), F.round("mean", 6).alias("value"),
        F.lit("distribution_check([25.5, 14.4])").alias("expected"), "passed",
    ))


@query("chk_trend", with_tables(["metric_history"], """
SELECT name || ' ' || dir AS check_name, round(cur, 6) AS value, 'trend_check(' || CAST(lim AS VARCHAR) || ')' AS expected,
 coalesce(CASE WHEN n < 2 * w THEN true WHEN prev = 0 THEN cur = 0
  WHEN dir = 'up' THEN (cur - prev) / abs(prev) * 100 <= lim WHEN dir = 'down' THEN (cur - prev) / abs(prev) * 100 >= -lim
  ELSE abs((cur - prev) / abs(prev) * 100) <= lim END, false) AS passed
FROM (SELECT name, dir, w, lim, count(*) AS n, avg(value) FILTER (WHERE rn <= w) AS cur, avg(value) FILTER (WHERE rn > w) AS prev
 FROM (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY run_at DESC) AS rn FROM metric_history WHERE value IS NOT NULL) h,
  (VALUES ('any', 7, 5.0), ('up', 7, 1.0), ('down', 7, 1.0), ('short', 50, 1.0)) AS v(dir, w, lim)
 WHERE rn <= 2 * w GROUP BY name, dir, w, lim)"""))
def _(t: Tables) -> DataFrame:
    cases = [("any", 7, 5.0), ("up", 7, 1.0), ("down", 7, 1.0), ("short", 50, 1.0)]
    return H.trend_checks(t["metric_history"], [(window, limit, direction) for direction, window, limit in cases]).select(
        F.concat_ws(" ", "name", "direction").alias("check_name"), F.round("cur", 6).alias("value"),
        F.format_string("trend_check(%s)", F.col("max_pct")).alias("expected"), "passed",
    )


@query("chk_custom_udf", with_tables(["contacts"], expect(
    ("even prices", "count(*) FILTER (WHERE NOT (o_totalprice >= 1000))", "orders", "custom_script(price_ok)", "value = 0"),
    ("e-mail has a host", "count(*) FILTER (WHERE strpos(email, '@') = 0)", "contacts", "custom_script(has_host)", "value = 0"),
    ("null phones raise", "count(*) FILTER (WHERE phone IS NULL)", "contacts", "custom_script(long_phone)", "value = 0"),
)))
def _(t: Tables) -> DataFrame:
    def price_ok(value):
        return value >= 1000

    def has_host(value):
        return "@" in value

    def long_phone(value):
        return len(value) == 13

    def named(results: DataFrame, *names: str) -> DataFrame:
        """Functions print with their address; the expectation shows their names instead."""
        pairs = F.create_map(*[F.lit(x) for no, n in enumerate(names, 1) for x in (no, f"custom_script({n})")])
        return results.withColumn("expected", pairs[F.col("check_no")])

    prices = suite.evaluate(t["orders"], [Rule("even prices", "custom_script", price_ok, column="o_totalprice")])
    people = suite.evaluate(t["contacts"], [
        Rule("e-mail has a host", "custom_script", has_host, column="email"),
        Rule("null phones raise", "custom_script", long_phone, column="phone"),
    ])
    return shown(named(prices, "price_ok").unionByName(named(people, "has_host", "long_phone")))


@query("chk_udf_reasons", with_tables(["contacts"], """
SELECT 'e-mail has a host' AS check_name, count(*) AS failed, CAST(least(count(*), 4) AS INTEGER) AS shown, CASE WHEN count(*) > 0 THEN 'refused: broken' END AS reasons FROM contacts WHERE email = 'broken'
UNION ALL SELECT 'null phones raise', count(*), CAST(least(count(*), 4) AS INTEGER), CASE WHEN count(*) > 0 THEN 'TypeError: ' END FROM contacts WHERE phone IS NULL
UNION ALL SELECT 'short ids', count(*), CAST(least(count(*), 4) AS INTEGER), CASE WHEN count(*) > 0 THEN 'ValueError: long' END FROM contacts WHERE customer_id >= 100"""))
def _(t: Tables) -> DataFrame:
    """Failing rows per predicate, and of four of them what went wrong: refused with its value, or the error."""
    def long_phone(value):
        return len(value) == 13

    def short_id(value):
        if value >= 100:
            raise ValueError("long")
        return True

    found = predicate_failures.reasons(t["contacts"], [
        Rule("e-mail has a host", "custom_script", lambda value: "@" in value, column="email"),
        Rule("null phones raise", "custom_script", long_phone, column="phone"),
        Rule("short ids", "custom_script", short_id, column="customer_id"),
    ], samples=4)
    told = "transform(samples, s -> coalesce(if(s.value IS NULL, 'TypeError: ', s.error), concat('refused: ', s.value)))"
    return found.selectExpr("check_name", "failed", "size(samples) AS shown", f"nullif(array_join(array_distinct({told}), ','), '') AS reasons")


# -- suites ------------------------------------------------------------------------------------

ORDER_RULES = [
    {"name": "orders per customer", "assert": "less_than", "value": 40, "metric": "count(*) / count(DISTINCT o_custkey)", "tags": ["volume"]},
    {"name": "dearest order", "assert": "greater_than", "value": 1000, "metric": "max(o_totalprice)", "tags": ["volume", "money"]},
    {"name": "open share", "assert": "between", "value": [20, 80], "metric": "count_if(o_orderstatus = 'O') * 100.0D / count(*)", "tags": ["mix"]},
    {"name": "years covered", "assert": "equals", "value": 3, "metric": "count(DISTINCT year(o_orderdate))", "tags": ["mix"]},
]
_ORDER_SQL = {
    "orders per customer": ("orders per customer", "count(*) / count(DISTINCT o_custkey)", "orders", "less_than(40)", "value < 40"),
    "dearest order": ("dearest order", "max(o_totalprice)", "orders", "greater_than(1000)", "value > 1000"),
    "open share": ("open share", "count(*) FILTER (WHERE o_orderstatus = 'O') * 100.0::DOUBLE / count(*)", "orders", "between([20, 80])", "value BETWEEN 20 AND 80"),
    "years covered": ("years covered", "count(DISTINCT year(o_orderdate))", "orders", "equals(3)", "value = 3"),
}


@query("suite_run", expect(*_ORDER_SQL.values()))
def order_suite(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["orders"], [rule_from_dict(r) for r in ORDER_RULES]))


@query("suite_tag_filter", expect(*[_ORDER_SQL[n] for n in ("orders per customer", "dearest order")]))
def _(t: Tables) -> DataFrame:
    rules = with_tags([rule_from_dict(r) for r in ORDER_RULES], ["money", "volume"])
    return shown(suite.evaluate(t["orders"], rules))


@query("suite_on_write", expect(
    *_ORDER_SQL.values(), ("status filled", "count(*) FILTER (WHERE o_orderstatus IS NULL OR trim(o_orderstatus) = '')", "orders", "not_empty(None)", "value = 0"),
    ("keys unique", "count(*) - count(DISTINCT o_orderkey)", "orders", "duplicate_row(0)", "value <= 0"),
    ("last status", "NULL", "(SELECT count(*) FROM orders)", "equals(P)", "(SELECT max(o_orderstatus) FROM orders) = 'P'"),
) + " UNION ALL SELECT 'rows kept', CAST(count(*) AS DOUBLE), 'written', true FROM orders")
def _(t: Tables) -> DataFrame:
    """The orders are written; their measures come from the same pass, but for distinct counts and keys."""
    path = shared_folder(t.spark, "orders-checked")
    rules = [*(rule_from_dict(r) for r in ORDER_RULES), Rule("status filled", "not_empty", column="o_orderstatus"),
             Rule("keys unique", "duplicate_row", 0, column="o_orderkey"), Rule("last status", "equals", "P", metric="max(o_orderstatus)")]
    found = observed.write_checked(t["orders"], rules, lambda df: df.write.mode("overwrite").parquet(path), lambda: t.spark.read.parquet(path))
    kept = t.spark.read.parquet(path).agg(F.count("*").cast("double").alias("value"))
    return shown(found).unionByName(kept.selectExpr("'rows kept' AS check_name", "value", "'written' AS expected", "true AS passed"))


_MIXED_SQL = with_tables(["events_gaps"], expect(
    ("rows", "count(*)", "events_gaps", "row_count_at_least(100)", "value >= 100"),
    ("types", "count(*) FILTER (WHERE event_type IS NULL OR trim(event_type) = '')", "events_gaps", "not_empty(None)", "value = 0"),
    ("ids unique", "count(*) - count(DISTINCT event_id)", "events_gaps", "duplicate_row(0)", "value <= 0"),
    ("users exist", "count(*)", "events_gaps WHERE user_id NOT IN (SELECT c_custkey FROM customer)", "referential_integrity(['customer', 'c_custkey'])", "value = 0"),
    ("columns", "6", "(SELECT count(*) AS n FROM events)", "schema_drift(6)", "true"),
    ("row total", "count(*)", "events_gaps", "custom_sql([1, 1000000000])", "value BETWEEN 1 AND 1000000000"),
    ("fresh", f"({_EVENT_AGE}) / 3.6e9", "events_gaps", "freshness_hours(48)", "value <= 48"),
    ("more than customers", "count(*)", "events_gaps", "cross_table_check(None)", "value > (SELECT count(*) FROM customer)"),
))


def _mixed_rules() -> list[Rule]:
    """One declarative rule set across all families of checks."""
    return [rule_from_dict(r) for r in (
        {"name": "rows", "assert": "row_count_at_least", "value": 100},
        {"name": "types", "assert": "not_empty", "column": "event_type"},
        {"name": "ids unique", "assert": "duplicate_row", "value": 0, "column": "event_id"},
        {"name": "users exist", "assert": "referential_integrity", "value": ["customer", "c_custkey"], "column": "user_id"},
        {"name": "columns", "assert": "schema_drift", "value": 6},
        {"name": "row total", "assert": "custom_sql", "value": [1, 1000000000], "query": "SELECT count(*) FROM source"},
        {"name": "fresh", "assert": "freshness_hours", "value": 48, "column": "ts", "as_of": EVENTS_AS_OF},
        {"name": "more than customers", "assert": "cross_table_check", "metric": "count(*)", "table": "customer", "comparator": "greater_than"},
    )]


@query("suite_from_rules", _MIXED_SQL)
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["events_gaps"], _mixed_rules(), tables={"customer": t["customer"]}))


@query("suite_side_by_side", _MIXED_SQL)
def _(t: Tables) -> DataFrame:
    """The families of the rules are measured at the same time, each within a minute, then rule by rule."""
    rows = side_by_side.run(t["events_gaps"], _mixed_rules(), seconds=60, tables={"customer": t["customer"]})
    names = [part.split()[0] for part in suite.RESULT.split(", ")]
    return shown(t.spark.createDataFrame([tuple(row[n] for n in names) for row in rows], suite.RESULT))


@query("suite_error_isolation", """
SELECT 'rows' AS check_name, CAST(count(*) AS DOUBLE) AS value, count(*) > 0 AS passed, false AS has_message FROM orders
UNION ALL SELECT 'no such column', NULL, false, true FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'bad expression', NULL, false, true FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'no such parent', NULL, false, true FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'empty answer', NULL, false, false FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'no such key', NULL, false, true FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'bad limit', NULL, false, true FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'no history', NULL, false, true FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'fails while it runs', NULL, false, true FROM (SELECT count(*) FROM orders)""")
def _(t: Tables) -> DataFrame:
    results = suite.settled(t["orders"], [
        Rule("rows", "greater_than", 0, metric="count(*)"),
        Rule("no such column", "greater_than", 0, metric="sum(nothing)"),
        Rule("bad expression", "greater_than", 0, metric="sum(("),
        Rule("no such parent", "referential_integrity", ["absent", "k"], column="o_custkey"),
        Rule("empty answer", "greater_than", 0, query="SELECT o_orderkey FROM source WHERE o_orderkey < 0"),
        Rule("no such key", "duplicate_row", 0, column="nothing"),
        Rule("bad limit", "less_than", "abc", metric="count(*)"),
        Rule("no history", "zscore_anomaly", metric="count(*)"),
        Rule("fails while it runs", "greater_than", 0, metric="sum(1 / (o_orderkey - o_orderkey))"),
    ])
    return results.select("check_name", "value", "passed", F.col("message").isNotNull().alias("has_message"))


@query("suite_summary", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
 CASE WHEN bool_and(passed) THEN 'OK' ELSE 'FAIL' END AS status, CASE WHEN bool_and(passed) THEN 0 ELSE 1 END AS exit_code
FROM ({expect(*_ORDER_SQL.values())})""")
def _(t: Tables) -> DataFrame:
    return suite.summary(order_suite(t))


@query("suite_sql_scalars", expect(
    ("rows", "count(*)", "lineitem", "greater_than(0)", "value > 0"),
    ("orders in lines", "count(DISTINCT l_orderkey)", "lineitem", "greater_than(0)", "value > 0"),
    ("returned pct", "count(*) FILTER (WHERE l_returnflag = 'R') * 100.0::DOUBLE / count(*)", "lineitem", "less_than(50)", "value < 50"),
    ("mean discount", "avg(l_discount)", "lineitem", "between([0, 0.1])", "value BETWEEN 0 AND 0.1"),
))
def _(t: Tables) -> DataFrame:
    return shown(suite.evaluate(t["lineitem"], [
        Rule("rows", "greater_than", 0, query="SELECT count(*) FROM source"),
        Rule("orders in lines", "greater_than", 0, query="SELECT count(DISTINCT l_orderkey) FROM source"),
        Rule("returned pct", "less_than", 50, query="SELECT count_if(l_returnflag = 'R') * 100.0D / count(*) FROM source"),
        Rule("mean discount", "between", [0, 0.1], query="SELECT avg(l_discount) AS d FROM source"),
    ]))
