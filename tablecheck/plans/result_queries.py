"""Registered queries: run ingestion, result analytics, reports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.operators import ingest as I
from tablecheck.operators import results as R
from tablecheck.operators import history, runner, suite
from tablecheck.operators.checks import Rule
from tablecheck.plans.check_queries import ORDER_RULES, expect, order_suite, _ORDER_SQL
from tablecheck.operators.checks import rule_from_dict
from tablecheck.operators import holt_winters as HW
from tablecheck.plans.history_queries import _ALL, _BEFORE, _E, _PICKED_METHOD, anomalies, anomaly_sql, hw_ctes, judged_sql
from tablecheck.plans.registry import query
from tablecheck.plans.tables import ORDERS_AS_OF, Tables, with_tables
from tablecheck.session import shared_folder
from tablecheck.sources import readers, stores
from tablecheck.streaming import detectors, observed as observed_streams, suites

_SCORE = "round(passed * 100.0::DOUBLE / nullif(total, 0), 1)"
_LIGHT = "CASE WHEN score IS NULL THEN 'grey' WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS light"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1"


def _sql(body: str, *tables: str) -> str:
    return with_tables(list(tables or ("runs",)), body)


# -- ingestion ---------------------------------------------------------------------------------

_HEADER_SQL = """SELECT 'r' || o_custkey AS run_id, o_orderpriority AS dag_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS run_at, CAST(2 AS BIGINT) AS total,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END AS BIGINT) AS passed
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""


@query("run_ingest", f"""WITH hd AS ({_HEADER_SQL}), lt AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1), rs AS (
 SELECT 'r' || o_custkey AS run_id, 'total' AS name, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS passed, o_totalprice AS value, 'greater_than(100000)' AS expected FROM lt
 UNION ALL SELECT 'r' || o_custkey, 'status', CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, 0.0, '' FROM lt)
SELECT 'run' AS kind, run_id, dag_id AS name, total, passed, total - passed AS failed, CASE WHEN total = passed THEN 'pass' ELSE 'fail' END AS status, CAST(NULL AS DOUBLE) AS value FROM hd
UNION ALL SELECT 'result', run_id, name, count(*), CAST(sum(passed) AS BIGINT), CAST(count(*) - sum(passed) AS BIGINT), max(expected), round(sum(value), 2) FROM rs GROUP BY run_id, name""")
def _(t: Tables) -> DataFrame:
    """Payloads are stored as run headers and result rows; both tables are read back. A run that is sent again replaces its
    header and its results."""
    headers, rows = shared_folder(t.spark, "runs"), shared_folder(t.spark, "run-results")
    I.run_headers(t["payloads"], "sent").write.parquet(headers)
    I.run_result_rows(t["payloads"], "sent").write.parquet(rows)
    runs = t.spark.read.parquet(headers).selectExpr(
        "'run' AS kind", "run_id", "dag_id AS name", "total", "passed", "failed", "status", "CAST(NULL AS DOUBLE) AS value")
    results = t.spark.read.parquet(rows).groupBy("run_id", "name").agg(
        F.count("*").alias("total"), F.sum("passed").alias("passed"), F.count_if(F.col("passed") == 0).alias("failed"),
        F.max("expected").alias("status"), F.round(F.sum("value"), 2).alias("value"))
    return runs.unionByName(results.withColumn("kind", F.lit("result")))


@query("run_payload", f"SELECT run_id, dag_id, run_at, 'total' AS first_result, CAST(2 AS INT) AS results FROM ({_HEADER_SQL})")
def _(t: Tables) -> DataFrame:
    return I.latest_payloads(t["payloads"], "sent").select(
        "run_id", "dag_id", "run_at", F.col("results")[0]["name"].alias("first_result"), F.size("results").alias("results"))


# -- scores and dashboard ----------------------------------------------------------------------


@query("health_score", _sql(f"SELECT *, {_LIGHT} FROM (SELECT source_id, passed, total, run_at, {_SCORE} AS score FROM ({_LATEST}))"))
def _(t: Tables) -> DataFrame:
    return R.health_scores(t["runs"])


@query("score_trend", _sql(f"""SELECT source_id, CAST(run_at AS DATE) AS day, round(sum(passed) * 100.0::DOUBLE / nullif(sum(total), 0), 1) AS score
 FROM runs WHERE run_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 60 DAY GROUP BY 1, 2"""))
def _(t: Tables) -> DataFrame:
    return R.score_trend(t["runs"], ORDERS_AS_OF, 60)


@query("all_scores", _sql(f"""SELECT *, {_LIGHT} FROM (SELECT s.id AS source_id, s.name AS source_name, {_SCORE} AS score, r.run_at
 FROM sources s LEFT JOIN ({_LATEST}) r ON r.source_id = s.id)""", "sources", "runs"))
def _(t: Tables) -> DataFrame:
    return R.all_scores(t["sources"], t["runs"])


_TODAY = "2001-08-01 00:00:00"


@query("dash_totals", _sql("""SELECT count(*) AS total_runs, round(sum(passed) * 100.0::DOUBLE / sum(total), 0) AS success_rate,
 CAST(coalesce(sum(total) FILTER (WHERE CAST(run_at AS DATE) = DATE '2001-08-01'), 0) AS BIGINT) AS today_checks,
 CAST(coalesce(sum(failed) FILTER (WHERE CAST(run_at AS DATE) = DATE '2001-08-01'), 0) AS BIGINT) AS failed_checks FROM runs"""))
def _(t: Tables) -> DataFrame:
    return R.dashboard_totals(t["runs"], _TODAY)


@query("dash_trend", _sql(f"""SELECT CAST(run_at AS DATE) AS day, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed
 FROM runs WHERE run_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 14 DAY GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    return R.dashboard_trend(t["runs"], ORDERS_AS_OF)


@query("dash_source_rate", _sql("""SELECT coalesce(s.name, 'unknown') AS source_name,
 coalesce(round(sum(r.passed) * 100.0::DOUBLE / nullif(sum(r.total), 0), 0), 0) AS success_rate
 FROM runs r LEFT JOIN (SELECT * FROM sources WHERE name <> 'NATION_3' AND name <> 'NATION_4') s ON r.source_id = s.id GROUP BY s.id, s.name""", "runs", "sources"))
def _(t: Tables) -> DataFrame:
    """Two sources were removed after their runs."""
    return R.source_rates(t["runs"], t["sources"].where("name <> 'NATION_3' AND name <> 'NATION_4'"))


@query("dash_top_failures", _sql("""SELECT check_name, count(*) AS total_count, count(*) FILTER (WHERE passed = 0) AS fail_count,
 round(count(*) FILTER (WHERE passed = 0) * 100.0::DOUBLE / count(*), 0) AS fail_pct FROM run_results GROUP BY check_name
 HAVING count(*) FILTER (WHERE passed = 0) > 0 ORDER BY fail_count DESC, check_name LIMIT 10""", "run_results"))
def _(t: Tables) -> DataFrame:
    return R.top_failures(t["run_results"])


@query("overview_counts", _sql("""SELECT (SELECT count(*) FROM sources) AS source_count, (SELECT count(*) FROM checks WHERE is_active = 1) AS check_count,
 (SELECT count(*) FROM runs) AS run_count""", "sources", "checks", "runs"))
def _(t: Tables) -> DataFrame:
    return R.overview(t["sources"], t["checks"], t["runs"])


# -- listings ----------------------------------------------------------------------------------

_JOINED = "run_results r JOIN runs u USING (run_id)"
_NEWEST = "ORDER BY run_at DESC, run_id, check_no, check_id"
_WIDE = "run_id, check_no, check_id, check_name, r.passed, value_actual, expected, message, source_id, dag_id, run_at"


@query("results_list", _sql(f"SELECT {_WIDE} FROM {_JOINED} WHERE r.passed = 0 {_NEWEST} LIMIT 500", "run_results", "runs"))
def _(t: Tables) -> DataFrame:
    return R.list_results(t["run_results"], t["runs"], passed=False)


_BI = "s.run_id, s.check_no, s.check_id, s.name, s.passed, s.value, s.expected, s.run_at, u.dag_id"
_BI_ORDER = "ORDER BY s.run_at DESC, s.run_id, s.check_no, s.check_id, s.value, s.passed"


@query("results_bi", _sql(f"""SELECT 'failed' AS view, * FROM (SELECT {_BI} FROM stored_results s LEFT JOIN runs u USING (run_id) WHERE s.passed = 0 AND s.name = 'zscore_amount' {_BI_ORDER} LIMIT 300)
UNION ALL SELECT 'urgent', * FROM (SELECT {_BI} FROM stored_results s LEFT JOIN runs u USING (run_id) WHERE u.dag_id = '1-URGENT' {_BI_ORDER} LIMIT 200)""", "stored_results", "runs"))
def _(t: Tables) -> DataFrame:
    failed = R.bi_results(t["stored_results"], t["runs"], name="zscore_amount", passed=False, limit=300)
    urgent = R.bi_results(t["stored_results"], t["runs"], dag_id="1-URGENT", limit=200)
    return failed.withColumn("view", F.lit("failed")).unionByName(urgent.withColumn("view", F.lit("urgent")))


@query("results_page", _sql(f"SELECT {_BI} FROM stored_results s LEFT JOIN runs u USING (run_id) {_BI_ORDER} LIMIT 100 OFFSET 200", "stored_results", "runs"))
def _(t: Tables) -> DataFrame:
    return R.bi_results(t["stored_results"], t["runs"], limit=100, offset=200)


def _listing(key: str, names: str, source_id: int | None = None) -> None:
    where = f" AND source_id = {source_id}" if source_id is not None else ""

    @query(key, _sql(f"""SELECT run_id, check_no, check_id, check_name, r.passed, value_actual, expected, message, run_at, source_id
 FROM {_JOINED} WHERE regexp_matches(check_name, '(?i){names}'){where} {_NEWEST} LIMIT 200""", "run_results", "runs"))
    def _(t: Tables) -> DataFrame:
        return R.matching_results(t["run_results"], t["runs"], names, source_id)


_listing("results_anomaly", R.ANOMALY_NAMES)
_listing("results_cross_table", R.CROSS_TABLE_NAMES, 7)
_listing("results_distribution", R.DISTRIBUTION_NAMES)


@query("results_by_family", _sql("""SELECT array_to_string(string_split(check_name, '_')[1:2], '_') AS family, count(*) AS n FROM run_results GROUP BY 1""", "run_results"))
def _(t: Tables) -> DataFrame:
    return R.by_family(t["run_results"])


@query("results_message_parse", _sql(r"""SELECT method, trend, score, check_name, count(*) AS n FROM (SELECT check_name,
 nullif(regexp_extract(message, '\[(zscore|ewma|holt_winters)\]', 1), '') AS method, coalesce(nullif(regexp_extract(message, 'trend=(\w+)', 1), ''), 'stable') AS trend,
 TRY_CAST(nullif(regexp_extract(message, '(?:z|norm_score)=([0-9.]+)', 1), '') AS DOUBLE) AS score FROM run_results) GROUP BY method, trend, score, check_name""", "run_results"))
def _(t: Tables) -> DataFrame:
    return R.parse_messages(t["run_results"]).groupBy("method", "trend", "score", "check_name").agg(F.count("*").alias("n"))


@query("results_distribution_parse", _sql(rf"""SELECT run_id, check_no, check_id, TRY_CAST(string_split(value_actual, ',')[1] AS DOUBLE) AS actual_mean,
 TRY_CAST(string_split(value_actual, ',')[2] AS DOUBLE) AS actual_std, TRY_CAST(regexp_extract(expected, 'mean=([0-9.]+)', 1) AS DOUBLE) AS expected_mean,
 TRY_CAST(regexp_extract(expected, 'std=([0-9.]+)', 1) AS DOUBLE) AS expected_std
 FROM {_JOINED} WHERE regexp_matches(check_name, '(?i)distrib') {_NEWEST} LIMIT 10""", "run_results", "runs"))
def _(t: Tables) -> DataFrame:
    newest = R.newest_first_reversed(R.matching_results(t["run_results"], t["runs"], R.DISTRIBUTION_NAMES, limit=None), 10)
    return R.parse_distributions(newest).select(
        "run_id", "check_no", "check_id", "actual_mean", "actual_std", "expected_mean", "expected_std")


@query("results_last20", _sql(f"""SELECT run_id, check_no, check_id, passed, run_at FROM (SELECT run_id, check_no, check_id, r.passed, run_at FROM {_JOINED}
 WHERE regexp_matches(check_name, '(?i)cross|referential|integrity') {_NEWEST} LIMIT 20)""", "run_results", "runs"))
def _(t: Tables) -> DataFrame:
    listed = R.matching_results(t["run_results"], t["runs"], R.CROSS_TABLE_NAMES, limit=None)
    return R.newest_first_reversed(listed, 20).select("run_id", "check_no", "check_id", "passed", "run_at")


@query("results_pass_fail", _sql(f"""SELECT count(*) FILTER (WHERE r.passed = 1) AS passed, count(*) FILTER (WHERE r.passed = 0) AS failed
 FROM {_JOINED} WHERE regexp_matches(check_name, '(?i)distrib')""", "run_results", "runs"))
def _(t: Tables) -> DataFrame:
    return R.pass_fail(R.matching_results(t["run_results"], t["runs"], R.DISTRIBUTION_NAMES, limit=None))


# -- runs and registry -------------------------------------------------------------------------

_RUN = "u.run_id, u.source_id, u.dag_id, u.run_at, u.total, u.passed, u.failed, u.status, s.name AS source_name"


@query("runs_recent", _sql(f"SELECT {_RUN} FROM runs u LEFT JOIN sources s ON s.id = u.source_id ORDER BY u.run_at DESC, u.run_id LIMIT 100", "runs", "sources"))
def _(t: Tables) -> DataFrame:
    return R.recent_runs(t["runs"], t["sources"])


@query("runs_by_dag", _sql(f"SELECT {_RUN} FROM runs u LEFT JOIN sources s ON s.id = u.source_id WHERE dag_id = '2-HIGH' ORDER BY u.run_at DESC, u.run_id LIMIT 50", "runs", "sources"))
def _(t: Tables) -> DataFrame:
    return R.recent_runs(t["runs"], t["sources"], limit=50, dag_id="2-HIGH")


@query("run_detail", _sql("""SELECT run_id, s.name AS source_name, run_at, status, check_no, check_id, check_name,
 CASE WHEN starts_with(message, '[zscore]') OR starts_with(message, '[ewma]') THEN CASE WHEN r.passed = 1 THEN 'PASS (anomaly)' ELSE 'ANOMALY' END
  WHEN r.passed = 1 THEN 'PASS' ELSE 'FAIL' END AS label FROM run_results r JOIN runs u USING (run_id) LEFT JOIN sources s ON s.id = u.source_id""", "run_results", "runs", "sources"))
def _(t: Tables) -> DataFrame:
    return R.run_details(t["run_results"], t["runs"], t["sources"])


@query("sources_check_count", _sql("""SELECT s.id, s.name, count(c.id) AS check_count FROM sources s
 LEFT JOIN checks c ON c.source_id = s.id AND c.is_active = 1 GROUP BY s.id, s.name""", "sources", "checks"))
def _(t: Tables) -> DataFrame:
    return R.sources_with_checks(t["sources"], t["checks"])


@query("checks_list", _sql("""SELECT c.id, c.name, c.assert_type, c.assert_value, c.source_id, s.name AS source_name FROM checks c JOIN sources s ON s.id = c.source_id""", "sources", "checks"))
def _(t: Tables) -> DataFrame:
    return R.list_checks(t["checks"], t["sources"]).select("id", "name", "assert_type", "assert_value", "source_id", "source_name")


@query("rules_for_source", _sql("""SELECT c.source_id, s.type AS source_type, c.id AS check_id, c.name, c.query, c.assert_type, c.assert_value,
 CASE WHEN c.tags = '' THEN 0 ELSE len(string_split(c.tags, ',')) END AS tags FROM checks c JOIN sources s ON s.id = c.source_id WHERE is_active = 1""", "sources", "checks"))
def _(t: Tables) -> DataFrame:
    return R.rules_of_sources(t["checks"], t["sources"]).withColumn("tags", F.size("tags").cast("bigint"))


_REGISTERED = """SELECT c.id, c.name, c.query, c.assert_type, c.assert_value FROM checks c JOIN sources s ON s.id = c.source_id WHERE is_active = 1 AND c.source_id = 4"""


@query("suite_from_registry", _sql(f"""SELECT r.id AS check_no_of, name AS check_name, assert_type, v AS value, coalesce(CASE assert_type WHEN 'greater_than' THEN v > 0 WHEN 'equals' THEN v = 0 END, false) AS passed, missing AS has_message FROM (
 SELECT r.*, CASE WHEN query = 'SELECT COUNT(*) FROM source' THEN (SELECT CAST(count(*) AS DOUBLE) FROM orders) END AS v, query <> 'SELECT COUNT(*) FROM source' AS missing
 FROM ({_REGISTERED}) r) r""".replace("r.id AS check_no_of, ", "").replace("assert_type, v AS value", "v AS value"), "sources", "checks"))
def _(t: Tables) -> DataFrame:
    """The active checks of one registered source on the orders; those that name columns orders lack fail with a reason."""
    found = runner.run_registered(t["orders"], t["checks"], t["sources"], 4)
    return found.select("check_name", "value", "passed", F.col("message").isNotNull().alias("has_message"))


# -- digests and reports -----------------------------------------------------------------------


@query("alert_digest", with_tables(["run_results", "runs", "sources"], """SELECT run_id, 0 AS part, CAST(NULL AS INT) AS check_no, CAST(NULL AS BIGINT) AS check_id, count(*) FILTER (WHERE a) AS anomalies, count(*) FILTER (WHERE NOT a) AS rules,
 'run #' || run_id || ', source: ' || dag_id || ', failed: ' || count(*) || ' checks' AS line FROM f GROUP BY run_id, dag_id
UNION ALL SELECT run_id, CASE WHEN a THEN 1 ELSE 2 END, check_no, check_id, NULL, NULL,
 CASE WHEN a THEN check_name || ': ' || message ELSE check_name || ': value ' || value_actual || ', expected ' || expected END FROM f""", extra={
    "f": """SELECT r.*, u.dag_id, regexp_matches(message, '\\[(zscore|ewma|holt_winters)\\]') AS a FROM run_results r JOIN runs u USING (run_id)
  LEFT JOIN sources s ON s.id = u.source_id WHERE r.passed = 0 AND coalesce(s.alert_enabled, 1) = 1"""}))
def _(t: Tables) -> DataFrame:
    return R.alert_digest(t["run_results"], t["runs"], t["sources"])


@query("summary_report", _sql(" UNION ALL ".join(f"""SELECT source_id, '{p}' AS period, date_trunc('{p}', run_at) AS start, CAST(sum(total) AS BIGINT) AS total,
 CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) - sum(passed) AS BIGINT) AS failed,
 coalesce(round(sum(passed) * 100.0::DOUBLE / nullif(sum(total), 0), 1), 0) AS pct FROM runs GROUP BY source_id, date_trunc('{p}', run_at)""" for p in ("day", "week"))))
def _(t: Tables) -> DataFrame:
    parts = [R.period_summary(t["runs"], p) for p in ("day", "week")]
    return parts[0].unionByName(parts[1])


@query("results_union", anomaly_sql(
    f"SELECT check_name AS name, passed, value, expected, NULL AS method, NULL AS trend, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS tag FROM ({expect(*_ORDER_SQL.values())})"
    f""" UNION ALL SELECT metric_name, NOT is_anomaly, current, CASE WHEN lower_bound IS NULL THEN '-' ELSE lower_bound || ' - ' || upper_bound END, method, trend_direction, score, '[' || method || '] trend=' || coalesce(trend_direction, 'stable')
 FROM ({judged_sql('metric_current', 'picked', _PICKED_METHOD)})""", source="metric_history_mixed", where=_BEFORE, **_ALL))
def _(t: Tables) -> DataFrame:
    both = I.combined_results(order_suite(t), anomalies(t))
    return both.withColumn("tag", F.nullif(F.regexp_extract("message", r"^\[\w+\] trend=\w+", 0), F.lit(""))).drop("message")


@query("run_pipeline", f"""WITH r AS ({expect(*_ORDER_SQL.values())}), f AS (SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS ok FROM r)
SELECT 'label' AS kind, check_name AS name, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS shown, CAST(NULL AS DOUBLE) AS score FROM r
UNION ALL SELECT 'alert', check_name, 'part 2', NULL FROM r WHERE NOT passed
UNION ALL SELECT 'alert', NULL, 'part 0', NULL FROM f WHERE ok < total
UNION ALL SELECT 'score', '7', CASE WHEN ok * 100.0 / total >= 80 THEN 'green' WHEN ok * 100.0 / total >= 50 THEN 'yellow' ELSE 'red' END, round(ok * 100.0::DOUBLE / total, 1) FROM f""")
def _(t: Tables) -> DataFrame:
    """A suite is run and stored; labels, alerts and scores are read from what it has stored, under a text run id."""
    stored = runner.run_and_record(t["orders"], [rule_from_dict(r) for r in ORDER_RULES], shared_folder(t.spark, "store"), "nightly/1", ORDERS_AS_OF)
    stored = stored.where("method IS NULL")  # the first run of a store has no past to judge by
    headers = shared_folder(t.spark, "runs")
    I.run_rows(stored, source_id=7, dag_id="nightly").write.parquet(headers)
    results, runs = I.result_rows(stored), t.spark.read.parquet(headers)
    sources = t["sources"].select("id", "name").withColumn("alert_enabled", F.lit(1))
    labels = R.run_details(results, runs, sources).selectExpr("'label' AS kind", "check_name AS name", "label AS shown", "CAST(NULL AS DOUBLE) AS score")
    digest = R.alert_digest(results, runs, sources).where("line IS NOT NULL")
    alerts = digest.selectExpr("'alert' AS kind", "if(part = 0, NULL, split(line, ': value ')[0]) AS name", "concat('part ', part) AS shown", "CAST(NULL AS DOUBLE) AS score")
    scores = R.health_scores(runs).selectExpr("'score' AS kind", "CAST(source_id AS STRING) AS name", "light AS shown", "score")
    return labels.unionByName(alerts).unionByName(scores)


@query("results_csv_export", _sql(f"""SELECT {_BI.replace('s.check_no, s.check_id, ', '')} FROM stored_results s LEFT JOIN runs u USING (run_id) {_BI_ORDER} LIMIT 500""", "stored_results", "runs"))
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "results-csv")
    rows = R.bi_results(t["stored_results"], t["runs"], limit=500).select(
        "run_id", "name", "passed", "value", "expected", F.col("run_at").cast("timestamp").alias("run_at"), "dag_id")
    stores.export_csv(rows, path)
    return readers.read_csv(t.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))


@query("json_report", f"""WITH r AS ({expect(*_ORDER_SQL.values())})
SELECT check_name, value, expected, passed, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE passed) AS ok FROM r""")
def _(t: Tables) -> DataFrame:
    """The report text, read back into one row per check."""
    found = suite.evaluate(t["orders"], [rule_from_dict(r) for r in ORDER_RULES])
    report = I.json_report(found, ORDERS_AS_OF)
    shape = "run_at STRING, summary STRUCT<total: BIGINT, passed: BIGINT>, checks ARRAY<STRUCT<check_name: STRING, value: DOUBLE, expected: STRING, passed: BOOLEAN>>"
    doc = report.select(F.from_json("report", shape).alias("d"))
    rows = doc.select(F.col("d.summary.total").alias("total"), F.col("d.summary.passed").alias("ok"), F.inline("d.checks"))
    return rows.withColumn("value", F.round("value", 6))


# -- streams -----------------------------------------------------------------------------------

_ARRIVALS = {0: "ts < TIMESTAMP '2024-01-11'", 1: "ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'", 2: "ts >= TIMESTAMP '2024-01-21'"}


def _arrive(t: Tables, start) -> None:
    """Events arrive in three lots, in time order, each as the files its tasks write; after each, ``start`` a stream over
    all of them works off what is new."""
    path = shared_folder(t.spark, "arrivals")
    for condition in _ARRIVALS.values():
        t["events"].where(condition).write.mode("append").parquet(path)
        start(t.spark.readStream.schema(t["events"].schema).parquet(path)).awaitTermination()


@query("stream_suite", " UNION ALL ".join(
    f"""SELECT {no} AS batch_id, * FROM ({expect(
        ("rows", "count(*)", f"(SELECT * FROM events WHERE {when})", "greater_than(0)", "value > 0"),
        ("values filled", "(count(*) - count(value)) / count(*)", f"(SELECT * FROM events WHERE {when})", "completeness_ratio(0.99)", "value <= 0.01"),
        ("ids unique", "count(*) - count(DISTINCT event_id)", f"(SELECT * FROM events WHERE {when})", "duplicate_row(0)", "value <= 0"))})"""
    for no, when in _ARRIVALS.items()))
def _(t: Tables) -> DataFrame:
    rules = [
        Rule("rows", "greater_than", 0, metric="count(*)"),
        Rule("values filled", "completeness_ratio", 0.99, column="value"),
        Rule("ids unique", "duplicate_row", 0, column="event_id"),
    ]
    path, checkpoint = shared_folder(t.spark, "stream-results"), shared_folder(t.spark, "stream-checkpoint")
    _arrive(t, lambda stream: suites.check_stream(stream, rules, path, checkpoint))
    return t.spark.read.parquet(path).select("batch_id", "check_name", F.round("value", 6).alias("value"), "expected", "passed")


@query("stream_observed", " UNION ALL ".join(
    f"""SELECT {no} AS batch_id, * FROM ({expect(
        ("rows", "count(*)", f"(SELECT * FROM events WHERE {when})", "greater_than(0)", "value > 0"),
        ("values filled", "(count(*) - count(value)) / count(*)", f"(SELECT * FROM events WHERE {when})", "completeness_ratio(0.99)", "value <= 0.01"),
        ("mean value", "avg(value)", f"(SELECT * FROM events WHERE {when})", "between([0, 1000])", "value BETWEEN 0 AND 1000"))})"""
    for no, when in _ARRIVALS.items()) + " UNION ALL SELECT -1, 'rows kept', CAST(count(*) AS DOUBLE), 'written', true FROM events")
def _(t: Tables) -> DataFrame:
    """Arriving events are appended to a table; every batch's measures come from the pass that writes it."""
    rules = [
        Rule("rows", "greater_than", 0, metric="count(*)"), Rule("values filled", "completeness_ratio", 0.99, column="value"),
        Rule("mean value", "between", [0, 1000], metric="avg(value)"),
    ]
    results, table, checkpoint = (shared_folder(t.spark, f"stream-{n}") for n in ("observed", "kept", "observed-checkpoint"))
    _arrive(t, lambda stream: ObservedRun(stream, rules, results, table, checkpoint))
    kept = t.spark.read.parquet(table).agg(F.count("*").cast("double").alias("value"))
    found = t.spark.read.parquet(results).select("batch_id", "check_name", F.round("value", 6).alias("value"), "expected", "passed")
    return found.unionByName(kept.selectExpr("-1 AS batch_id", "'rows kept' AS check_name", "value", "'written' AS expected", "true AS passed"))


class ObservedRun:
    """One start of the stream, ended when its results are stored."""

    def __init__(self, stream: DataFrame, rules: list[Rule], results: str, table: str, checkpoint: str):
        self.suite = observed_streams.ObservedStream(stream, rules, results)
        self.query = suites.append_points(self.suite.stream, table, checkpoint)

    def awaitTermination(self) -> None:
        self.suite.finish(self.query)
        self.suite.close()


@query("stream_window_metrics", """SELECT event_type AS name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_at, CAST(count(*) AS DOUBLE) AS value, round(sum(value), 4) AS total
 FROM events GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """One-day windows; the last day is still open when the stream ends, and is given all the same."""
    path, checkpoint = shared_folder(t.spark, "stream-points"), shared_folder(t.spark, "stream-checkpoint")
    _arrive(t, lambda stream: suites.update_points(suites.windowed_points(stream, "ts", "event_type", "1 day"), path, checkpoint))
    return suites.newest_points(t.spark.read.parquet(path))


@query("stream_points_folded", """SELECT event_type AS name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_at, CAST(count(*) AS DOUBLE) AS value, round(sum(value), 4) AS total
 FROM events GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """The batches are folded into one state after every lot but the last; reading takes the state and what came after."""
    path, checkpoint, state = (shared_folder(t.spark, f"folded-{n}") for n in ("points", "checkpoint", "state"))
    lots = iter(_ARRIVALS)

    def start(stream: DataFrame):
        if next(lots):
            suites.fold_points(t.spark, path, state)
        return suites.update_points(suites.windowed_points(stream, "ts", "event_type", "1 day"), path, checkpoint)

    _arrive(t, start)
    return suites.current_points(t.spark, path, state)


@query("metric_compaction", with_tables(["metric_history"], """SELECT name, value, run_at, run_date,
 CAST(CASE WHEN run_date < DATE '2024-01-20' THEN 1 ELSE count(*) OVER (PARTITION BY run_date) END AS INTEGER) AS files FROM metric_history"""))
def _(t: Tables) -> DataFrame:
    """Points recorded metric by metric, and so in a file each; days that are over are put together."""
    path = shared_folder(t.spark, "metric-points")
    for kind in ("view", "click", "purchase", "signup", "error"):
        history.record(t["metric_history"].where(F.col("name") == kind).coalesce(1), path)
    stores.compact(t.spark, path, "run_date", files=1, closed="2024-01-20")
    points = t.spark.read.parquet(path)
    files = points.select("run_date", "_metadata.file_path").distinct().groupBy("run_date").agg(F.count("*").cast("int").alias("files"))
    return points.join(files, "run_date").select("name", "value", "run_at", "run_date", "files")


_EVERY = {
    "hb14": "SELECT name, rn AS n, l + b + s[1] AS forecast, coalesce(nullif(list_aggregate(r, 'stddev_pop'), 0), 1e-9) AS std FROM hf WHERE rn >= 14",
    "ev": "SELECT name, rn AS n, e AS forecast, coalesce(nullif(sqrt(sq / nullif(m, 0)), 0), 1e-9) AS std FROM ef",
    "zv": """SELECT a.name, a.rn AS n, avg(b.value) AS forecast, coalesce(nullif(stddev_samp(b.value), 0), 1e-9) AS std
  FROM h a JOIN h b ON a.name = b.name AND b.rn <= a.rn WHERE a.rn < 5 GROUP BY 1, 2""",
    "model": """SELECT name, n, CASE WHEN n < 5 THEN zv.forecast WHEN n < 14 THEN ev.forecast ELSE hb14.forecast END AS forecast,
  CASE WHEN n < 5 THEN zv.std WHEN n < 14 THEN ev.std ELSE hb14.std END AS std FROM ev LEFT JOIN zv USING (name, n) LEFT JOIN hb14 USING (name, n)""",
}


@query("stream_detectors", anomaly_sql("""SELECT h.name, h.run_at, h.value, h.rn - 1 AS n, CASE WHEN h.rn - 1 < 5 THEN 'zscore' WHEN h.rn - 1 < 14 THEN 'ewma' ELSE 'holt_winters' END AS method,
 coalesce(h.rn > 2 AND abs(h.value - forecast) / std > 3, false) AS is_anomaly, round(CASE WHEN h.rn > 2 THEN forecast END, 4) AS forecast
 FROM (SELECT name, value, run_at, row_number() OVER (PARTITION BY name ORDER BY run_at) AS rn FROM metric_history) h LEFT JOIN model m ON m.name = h.name AND m.n = h.rn - 1""",
    where="true", **_E, **hw_ctes(HW.FIXED), **_EVERY))
def _(t: Tables) -> DataFrame:
    """Metric points arrive in three lots; every point is judged by the state that the points before it left."""
    source, out, checkpoint = (shared_folder(t.spark, f"detector-{n}") for n in ("points", "verdicts", "checkpoint"))
    points = t["metric_history"].select("name", "value", "run_at")
    for condition in ("run_at < TIMESTAMP '2024-01-11'", "run_at >= TIMESTAMP '2024-01-11' AND run_at < TIMESTAMP '2024-01-21'", "run_at >= TIMESTAMP '2024-01-21'"):
        points.where(condition).write.mode("append").parquet(source)
        detectors.watch(t.spark.readStream.schema(points.schema).parquet(source), out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select("name", "run_at", "value", "n", "method", "is_anomaly", F.round("forecast", 4).alias("forecast"))
