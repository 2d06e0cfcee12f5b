"""Registered queries: rule suggestions and library, metric history, anomaly detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.naming import name_pattern, query_fingerprint, queried_column
from tablecheck.operators import anomaly as A
from tablecheck.operators import history as H
from tablecheck.operators import holt_winters as HW
from tablecheck.operators import hw_fit as HF
from tablecheck.operators import profile as P
from tablecheck.operators import suggest as S
from tablecheck.plans.registry import query
from tablecheck.plans.table_queries import CONTACTS, kinds, profile_sql, _EVENT_COLUMNS
from tablecheck.plans.tables import Tables, with_tables
from tablecheck.session import shared_folder
from tablecheck.sources.readers import schema_rows

# -- suggestions -------------------------------------------------------------------------------

_PROFILE_SQL = with_tables(["contacts", "events_gaps"], "", extra={
    "p": f"SELECT * FROM ({profile_sql('contacts', CONTACTS)}) UNION ALL SELECT * FROM ({profile_sql('events_gaps', kinds(_EVENT_COLUMNS))})",
}).rstrip()


def _profile(t: Tables, distinct: str = "exact") -> DataFrame:
    return P.profile_table(t["contacts"], distinct=distinct).unionByName(P.profile_table(t["events_gaps"], distinct=distinct))


def _dec(v: str) -> str:
    return f"CAST(CAST({v} AS DECIMAL(38, 2)) AS VARCHAR)"


_LOW = "CASE WHEN min_num > 0 THEN greatest(0.0, min_num * 0.8::DOUBLE) ELSE min_num * 1.2::DOUBLE END"
_FORMAT = "CASE WHEN contains(lower(column_name), 'email') THEN 'email' WHEN contains(lower(column_name), 'phone') THEN 'phone' END"
_SUGGEST_SQL = {
    "null": f"""SELECT column_name, 'null' AS type, CASE WHEN null_pct = 0 THEN 'equals' ELSE 'less_than' END AS assert_type,
 CASE WHEN null_pct = 0 THEN '0' ELSE '5' END AS assert_value, CASE WHEN null_pct = 0 THEN 'high' ELSE 'medium' END AS confidence,
 CASE WHEN null_pct = 0 THEN 'there are no nulls now' ELSE {_dec('null_pct')} || ' % are null now' END AS reason, CAST(NULL AS VARCHAR) AS regex_pattern
 FROM p WHERE null_pct < 5""",
    "range": f"""SELECT column_name, 'range' AS type, 'between' AS assert_type, '[' || {_dec(_LOW)} || ', ' || {_dec('max_num * 1.2::DOUBLE')} || ']' AS assert_value,
 'medium' AS confidence, 'now from ' || {_dec('min_num')} || ' to ' || {_dec('max_num')} AS reason, CAST(NULL AS VARCHAR) AS regex_pattern FROM p
 WHERE col_type = 'numeric' AND min_num <> max_num""",
    "duplicate": """SELECT column_name, 'duplicate' AS type, 'equals' AS assert_type, '0' AS assert_value, 'high' AS confidence,
 'all values are distinct now' AS reason, CAST(NULL AS VARCHAR) AS regex_pattern FROM p WHERE distinct_count = row_count AND row_count > 0""",
    "empty": """SELECT column_name, 'empty' AS type, 'equals' AS assert_type, '0' AS assert_value, 'medium' AS confidence,
 'an empty text can be as bad as a null' AS reason, CAST(NULL AS VARCHAR) AS regex_pattern FROM p WHERE col_type = 'string' AND null_pct = 0""",
    "enum": """SELECT column_name, 'enum' AS type, 'equals' AS assert_type, '0' AS assert_value, 'medium' AS confidence,
 'only ' || distinct_count || ' different values' AS reason, CAST(NULL AS VARCHAR) AS regex_pattern FROM p WHERE distinct_count BETWEEN 1 AND 10 AND row_count >= 50""",
    "regex": f"""SELECT column_name, 'regex' AS type, 'equals' AS assert_type, '0' AS assert_value, 'high' AS confidence,
 'the name contains ' || {_FORMAT} AS reason, CASE {_FORMAT} WHEN 'email' THEN '^[^@]+@[^@]+\\.[^@]+$' ELSE '^\\+?[\\d\\s\\-]{{10,15}}$' END AS regex_pattern
 FROM p WHERE {_FORMAT} IS NOT NULL""",
}
_SHOWN = ("column_name", "type", "assert_type", "assert_value", "confidence", "reason", "regex_pattern")


def _suggest_query(key: str, *types: str) -> None:
    sql = " UNION ALL ".join(_SUGGEST_SQL[k] for k in types or _SUGGEST_SQL)

    @query(key, f"{_PROFILE_SQL}\n{sql}")
    def _(t: Tables) -> DataFrame:
        counted = not types or {"duplicate", "enum"} & set(types)
        return S.suggest(_profile(t, "exact" if counted else "none"), types or None).select(*_SHOWN)


_suggest_query("suggest_null", "null")
_suggest_query("suggest_range", "range")
_suggest_query("suggest_unique", "duplicate")
_suggest_query("suggest_not_empty", "empty")
_suggest_query("suggest_enum", "enum")
_suggest_query("suggest_regex", "regex")
_suggest_query("suggest_all")


# -- library -----------------------------------------------------------------------------------

def _pattern_sql(c: str) -> str:
    n = f"lower(trim({c}))"
    return (
        f"CASE WHEN {n} = 'id' OR {n} LIKE '%\\_id' ESCAPE '\\' THEN '*_id' WHEN contains({n}, 'email') THEN '*email*' "
        f"WHEN {n} LIKE '%\\_date' ESCAPE '\\' OR {n} LIKE '%\\_at' ESCAPE '\\' OR contains({n}, 'date') THEN '*_date' "
        f"WHEN contains({n}, 'name') THEN '*name*' ELSE {n} END"
    )


_FINGERPRINT_SQL = """CASE WHEN contains(lower(query), 'count(distinct') THEN 'unique'
 WHEN contains(lower(query), 'is null') AND contains(lower(query), 'count(*)') THEN 'not_null' WHEN assert_type = 'between' THEN 'range'
 WHEN (contains(lower(query), 'max(') OR contains(lower(query), 'datediff') OR contains(lower(query), 'timestampdiff')) AND assert_type IN ('less_than', 'greater_than') THEN 'freshness'
 WHEN starts_with(trim(lower(query)), 'select count(*)') AND NOT contains(lower(query), ' where ') THEN 'row_count' ELSE 'custom' END"""
_EXTRACT_SQL = r"""coalesce(nullif(regexp_extract(query, '(?i)\bWHERE\s+(\w+)\s+IS\s+NULL\b', 1), ''),
 nullif(regexp_extract(query, '(?i)COUNT\(DISTINCT\s+(\w+)\)', 1), ''), nullif(regexp_extract(query, '(?i)\bWHERE\s+(\w+)\s*[<>=]', 1), ''))"""


@query("rule_normalize_pattern", with_tables(["rule_events"], f"SELECT column_name, {_pattern_sql('column_name')} AS pattern, count(*) AS n FROM rule_events GROUP BY 1, 2"))
def _(t: Tables) -> DataFrame:
    counted = t["rule_events"].groupBy("column_name").agg(F.count("*").alias("n"))
    return counted.select("column_name", name_pattern(F.col("column_name")).alias("pattern"), "n")


@query("rule_fingerprint", with_tables(["checks"], f"SELECT id, {_FINGERPRINT_SQL} AS rule_type FROM checks"))
def _(t: Tables) -> DataFrame:
    return t["checks"].select("id", query_fingerprint(F.col("query"), F.col("assert_type")).alias("rule_type"))


@query("rule_extract_column", with_tables(["checks"], f"SELECT id, {_EXTRACT_SQL} AS column_name FROM checks"))
def _(t: Tables) -> DataFrame:
    return t["checks"].select("id", queried_column(F.col("query")).alias("column_name"))


_MINED = "2024-01-01 00:00:00"
_LIBRARY_CTES = {
    "ev": f"""SELECT column_name, column_type, rule_type, event, event_at FROM rule_events UNION ALL
  SELECT {_EXTRACT_SQL}, '', {_FINGERPRINT_SQL}, 'used', TIMESTAMP '{_MINED}' FROM checks WHERE {_EXTRACT_SQL} IS NOT NULL""",
    "lib": f"""SELECT pattern, rule_type, arg_max(column_type, event_at) FILTER (WHERE event = 'used') AS column_type,
  count(*) FILTER (WHERE event = 'used') AS times_used, count(*) FILTER (WHERE event = 'accepted') AS times_accepted,
  count(*) FILTER (WHERE event = 'rejected') AS times_rejected, max(event_at) AS last_used_at, pattern || '/' || rule_type AS library_id
  FROM (SELECT *, {_pattern_sql('column_name')} AS pattern FROM ev WHERE NOT (event = 'used' AND rule_type = 'custom')) GROUP BY pattern, rule_type""",
}
_LIBRARY_SQL = with_tables(["rule_events", "checks"], "", extra=_LIBRARY_CTES).rstrip()


def _library(t: Tables) -> DataFrame:
    events = t["rule_events"].drop("event_id").withColumns({"event_at": F.col("event_at").cast("timestamp"), "times": F.lit(1).cast("bigint")})
    return S.build_library(events.unionByName(S.mined_usage(t["checks"], _MINED)))


@query("rule_library_build", f"{_LIBRARY_SQL} SELECT pattern, rule_type, column_type, times_used, last_used_at FROM lib WHERE times_used > 0")
def _(t: Tables) -> DataFrame:
    return _library(t).where("times_used > 0").select("pattern", "rule_type", "column_type", "times_used", "last_used_at")


@query("rule_feedback", f"{_LIBRARY_SQL} SELECT pattern, rule_type, times_used, times_accepted, times_rejected FROM lib")
def _(t: Tables) -> DataFrame:
    return _library(t).select("pattern", "rule_type", "times_used", "times_accepted", "times_rejected")


@query("rule_library_list", f"""{_LIBRARY_SQL} SELECT library_id, times_used,
 round(times_accepted * 100.0::DOUBLE / nullif(times_accepted + times_rejected, 0), 0) AS acceptance_pct FROM lib""")
def _(t: Tables) -> DataFrame:
    return S.library_listing(_library(t)).select("library_id", "times_used", "acceptance_pct")


_KNOWN_CTE = f"""SELECT column_name, type, max(times_used) AS times_used, arg_max(library_id, (times_used, library_id)) AS library_id FROM (
  SELECT DISTINCT p.column_name, CASE rule_type WHEN 'not_null' THEN 'null' WHEN 'unique' THEN 'duplicate' WHEN 'not_empty' THEN 'empty'
   WHEN 'regex_match' THEN 'regex' WHEN 'accepted_values' THEN 'enum' WHEN 'freshness_hours' THEN 'freshness' ELSE rule_type END AS type, times_used, library_id
  FROM p JOIN lib ON lib.pattern = {_pattern_sql('p.column_name')} OR lib.pattern = lower(p.column_name)
  WHERE NOT (times_accepted + times_rejected >= 3 AND times_accepted / (times_accepted + times_rejected) < 0.3)) GROUP BY column_name, type"""
_MERGE_SQL = with_tables(["rule_events", "checks", "contacts"], "", extra={
    **_LIBRARY_CTES, "p": profile_sql("contacts", CONTACTS), "known": _KNOWN_CTE,
    "stat": " UNION ALL ".join(_SUGGEST_SQL.values()),
}).rstrip()


@query("library_suggestions", f"""{_MERGE_SQL} SELECT column_name, type, 'used ' || times_used || ' times' AS reason,
 CASE WHEN times_used >= 5 THEN 'high' ELSE 'medium' END AS confidence, library_id FROM known""")
def _(t: Tables) -> DataFrame:
    return S.library_suggestions(schema_rows(t["contacts"]), _library(t)).select("column_name", "type", "reason", "confidence", "library_id")


@query("suggest_merge", f"""{_MERGE_SQL} SELECT coalesce(s.column_name, k.column_name) AS column_name, coalesce(s.type, k.type) AS type,
 coalesce(s.assert_value, '0') AS assert_value, concat_ws('; ', s.reason, CASE WHEN k.type IS NOT NULL THEN 'used ' || k.times_used || ' times' END) AS reason,
 CASE WHEN k.times_used >= 5 THEN 'high' ELSE coalesce(s.confidence, 'medium') END AS confidence, library_id
 FROM stat s FULL JOIN known k ON s.column_name = k.column_name AND s.type = k.type""")
def _(t: Tables) -> DataFrame:
    profile = P.profile_table(t["contacts"])
    merged = S.merge_suggestions(S.suggest(profile), S.library_suggestions(schema_rows(t["contacts"]), _library(t)))
    return merged.select("column_name", "type", "assert_value", "reason", "confidence", "library_id")


# -- history -----------------------------------------------------------------------------------

@query("metric_append_readback", with_tables(["metric_history"], """
SELECT name, count(*) AS points, count(value) AS filled, round(sum(value), 4) AS total, min(run_at) AS first_at, max(run_at) AS last_at FROM (
 SELECT name, value, run_at FROM metric_history UNION ALL SELECT 'late ' || name, NULL, TIMESTAMP '2024-01-31 00:00:00' FROM metric_history WHERE run_date = DATE '2024-01-30') GROUP BY name"""))
def _(t: Tables) -> DataFrame:
    """Two batches: points with their own times, then a batch of unmeasured points at one time."""
    path = shared_folder(t.spark, "metrics")
    H.record(t["metric_history"].select("name", "value", "run_at"), path)
    late = t["metric_history"].where("run_date = DATE '2024-01-30'").select(
        F.concat(F.lit("late "), "name").alias("name"), F.lit(None).cast("double").alias("value"))
    H.record(late, path, run_at="2024-01-31 00:00:00")
    return H.load(t.spark, path).groupBy("name").agg(
        F.count("*").alias("points"), F.count("value").alias("filled"), F.round(F.sum("value"), 4).alias("total"),
        F.min("run_at").alias("first_at"), F.max("run_at").alias("last_at"))


@query("metric_history", with_tables(["metric_history"], "SELECT name, value, run_at FROM metric_history WHERE name = 'click' AND run_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY"))
def _(t: Tables) -> DataFrame:
    return H.since(t["metric_history"].where("name = 'click'"), "2024-01-31 00:00:00", 10).select("name", "value", "run_at").orderBy("run_at")


@query("known_metrics", with_tables(["metric_history"], "SELECT DISTINCT name FROM metric_history"))
def _(t: Tables) -> DataFrame:
    return H.known_metrics(t["metric_history"])


@query("recent_values", with_tables(["metric_history"], """SELECT name, value, run_at, CAST(rn AS INTEGER) AS recency FROM (
 SELECT *, row_number() OVER (PARTITION BY name ORDER BY run_at DESC) AS rn FROM metric_history WHERE value IS NOT NULL) WHERE rn <= 7"""))
def _(t: Tables) -> DataFrame:
    return H.recent_values(t["metric_history"], 7).orderBy("name", "run_at")


# -- anomalies ---------------------------------------------------------------------------------

_FOUND = ("metric_name", "current", "is_anomaly", "score", "method", "lower_bound", "upper_bound", "trend_direction")


def series_ctes(source: str, where: str = "true") -> dict[str, str]:
    """Positions and trend of each metric in plain SQL."""
    return {
        "h": f"SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY run_at) AS rn, count(*) OVER (PARTITION BY name) AS n FROM {source} WHERE value IS NOT NULL AND {where}",
        "tr": """SELECT name, n, CASE WHEN n < 4 THEN 'stable' WHEN (l - e) / CASE WHEN e = 0 THEN 1e-9 ELSE e END > 0.05 THEN 'up'
  WHEN (l - e) / CASE WHEN e = 0 THEN 1e-9 ELSE e END < -0.05 THEN 'down' ELSE 'stable' END AS direction
  FROM (SELECT name, n, avg(value) FILTER (WHERE rn <= n // 2) AS e, avg(value) FILTER (WHERE rn > n - n // 2) AS l FROM h GROUP BY name, n)""",
    }


_Z = {"zs": "SELECT name, avg(value) AS forecast, coalesce(nullif(stddev_samp(value), 0), 1e-9) AS std FROM h GROUP BY name"}
_E = {
    "ef": """SELECT name, rn, value AS e, 0.0::DOUBLE AS sq, 0 AS m FROM h WHERE rn = 1 UNION ALL
  SELECT h.name, h.rn, 0.3::DOUBLE * h.value + 0.7::DOUBLE * ef.e, ef.sq + pow(h.value - (0.3::DOUBLE * h.value + 0.7::DOUBLE * ef.e), 2), ef.m + 1
  FROM ef JOIN h ON h.name = ef.name AND h.rn = ef.rn + 1""",
    "ew": "SELECT ef.name, e AS forecast, coalesce(nullif(sqrt(sq / nullif(m, 0)), 0), 1e-9) AS std FROM ef JOIN h ON h.name = ef.name AND h.rn = ef.rn WHERE h.rn = h.n",
}


def hw_ctes(candidates) -> dict[str, str]:
    """Holt-Winters by recursion over the points, for every candidate; ``hw`` keeps the best one."""
    listed = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for a, b, g in candidates)
    level = "(hf.a * (h.value - hf.s[1]) + (1 - hf.a) * (hf.l + hf.b))"
    return {
        "cand": f"SELECT * FROM (VALUES {listed}) AS v(a, be, g)",
        "h0": "SELECT name, max(n) AS n, avg(value) FILTER (WHERE rn <= 7) AS m1, avg(value) FILTER (WHERE rn BETWEEN 8 AND 14) AS m2, list(value ORDER BY rn) FILTER (WHERE rn <= 7) AS w FROM h WHERE n >= 14 GROUP BY name",
        "hf": f"""SELECT name, n, a, be, g, CAST(7 AS BIGINT) AS rn, m1 AS l, (m2 - m1) / 7 AS b, [x - m1 FOR x IN w] AS s, CAST([] AS DOUBLE[]) AS r FROM h0, cand
  UNION ALL SELECT hf.name, hf.n, hf.a, hf.be, hf.g, h.rn, {level}, hf.be * ({level} - hf.l) + (1 - hf.be) * hf.b,
  list_append(hf.s[2:7], hf.g * (h.value - {level}) + (1 - hf.g) * hf.s[1]), list_append(hf.r, h.value - (hf.l + hf.b + hf.s[1]))
  FROM hf JOIN h ON h.name = hf.name AND h.rn = hf.rn + 1""",
        "hb": "SELECT name, a, be, g, l + b + s[1] AS forecast, list_aggregate(r, 'stddev_pop') AS std, list_sum([x * x FOR x IN r]) AS sse FROM hf WHERE rn = n",
        "hw": "SELECT name, a, be, g, forecast, coalesce(nullif(std, 0), 1e-9) AS std FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sse, a, be, g) AS k FROM hb) WHERE k = 1",
    }


def judged_sql(current: str, model: str, method: str) -> str:
    """Verdicts of ``current`` against the CTE ``model``, in the columns that the queries show."""
    usable = "(coalesce(tr.n, 0) >= 2 AND m.forecast IS NOT NULL)"
    return f"""SELECT c.name AS metric_name, c.value AS current, coalesce({usable} AND abs(c.value - m.forecast) / m.std > 3, false) AS is_anomaly,
 CASE WHEN {usable} THEN round(abs(c.value - m.forecast) / m.std, 4) ELSE 0.0 END AS score, {method} AS method,
 CASE WHEN {usable} THEN round(m.forecast - 3 * m.std, 4) END AS lower_bound, CASE WHEN {usable} THEN round(m.forecast + 3 * m.std, 4) END AS upper_bound,
 CASE WHEN {usable} THEN tr.direction ELSE 'stable' END AS trend_direction
 FROM {current} c LEFT JOIN tr ON tr.name = c.name LEFT JOIN {model} m ON m.name = c.name"""


_BEFORE = "run_date < DATE '2024-01-30'"
_AS_OF = "2024-01-30 00:00:00"


def _past(t: Tables) -> DataFrame:
    return H.before(t["metric_history"], _AS_OF)


def _now(t: Tables) -> DataFrame:
    return t["metric_current"].select("name", "value")


def anomaly_sql(body: str, source: str = "metric_history", where: str = _BEFORE, **more: str) -> str:
    tables = ["metric_history", "metric_history_mixed", "metric_current"]
    return with_tables(tables, body, recursive=True, extra={**series_ctes(source, where), **more})


@query("trend_direction", anomaly_sql("SELECT name, n, direction FROM tr", where="true"))
def _(t: Tables) -> DataFrame:
    return A.trend_direction(t["metric_history"])


@query("anomaly_zscore", anomaly_sql(judged_sql("metric_current", "zs", "'zscore'"), **_Z))
def _(t: Tables) -> DataFrame:
    model = A.zscore_model(_past(t)).join(A.trend_direction(_past(t)).select("name", "direction"), "name")
    return A.judge(_now(t), model, "zscore").select(*_FOUND)


@query("anomaly_ewma", anomaly_sql(judged_sql("metric_current", "ew", "'ewma'"), **_E))
def _(t: Tables) -> DataFrame:
    return A.judge(_now(t), A.ewma_model(_past(t)), "ewma").select(*_FOUND)


@query("anomaly_hw_fixed", anomaly_sql(judged_sql("metric_current", "hw", "'holt_winters'"), **hw_ctes(HW.FIXED)))
def _(t: Tables) -> DataFrame:
    return A.judge(_now(t), A.holt_winters_model(_past(t), HW.FIXED), "holt_winters").select(*_FOUND)


@query("anomaly_holt_winters", anomaly_sql(judged_sql("metric_current", "hw", "'holt_winters'"), **hw_ctes(HW.GRID)))
def _(t: Tables) -> DataFrame:
    return A.judge(_now(t), A.holt_winters_model(_past(t)), "holt_winters").select(*_FOUND)


@query("anomaly_hw_fitted", anomaly_sql(f"""SELECT c.name AS metric_name, c.value AS current, h.n, tr.direction AS trend_direction, true AS not_above_grid, true AS within_bounds,
 CASE WHEN c.name IN ('error', 'purchase') THEN true END AS is_anomaly
 FROM metric_current c JOIN (SELECT DISTINCT name, n FROM h) h ON h.name = c.name JOIN tr ON tr.name = c.name WHERE h.n >= 14"""))
def _(t: Tables) -> DataFrame:
    """Fitted factors and start values: the error is not above that of any grid point; the two spikes are found.

    The fit of the other metrics follows chance, so their verdicts are left out.
    """
    model = A.holt_winters_fitted(_past(t))
    grid = HF.fit_grid(A.series.chunks(_past(t))).withColumnRenamed("sse", "grid_sse")
    found = A.judge(_now(t), model, "holt_winters").join(model.join(grid, "name").withColumnRenamed("name", "metric_name"), "metric_name")
    return found.selectExpr(
        "metric_name", "current", "n", "trend_direction", "sse <= grid_sse * (1 + 1e-9D) + 1e-6D AS not_above_grid",
        "least(alpha, beta, gamma) > 0 AND greatest(alpha, beta, gamma) < 1 AS within_bounds", "if(metric_name IN ('error', 'purchase'), is_anomaly, NULL) AS is_anomaly")


_PICKED = {
    "picked": """SELECT h.name, any_value(CASE WHEN h.n < 5 THEN 'zscore' WHEN h.n < 14 THEN 'ewma' ELSE 'holt_winters' END) AS method,
  any_value(CASE WHEN h.n < 5 THEN zs.forecast WHEN h.n < 14 THEN ew.forecast ELSE hw.forecast END) AS forecast,
  any_value(CASE WHEN h.n < 5 THEN zs.std WHEN h.n < 14 THEN ew.std ELSE hw.std END) AS std
  FROM h LEFT JOIN zs ON zs.name = h.name LEFT JOIN ew ON ew.name = h.name LEFT JOIN hw ON hw.name = h.name GROUP BY h.name"""
}
_ALL = {**_Z, **_E, **hw_ctes(HW.FIXED), **_PICKED}
_PICKED_METHOD = "coalesce(m.method, 'zscore')"


@query("anomaly_dispatch", anomaly_sql(
    judged_sql("metric_current", "picked", _PICKED_METHOD)
    + " UNION ALL SELECT 'unmeasured ' || name, NULL, false, 0.0, 'none', NULL, NULL, 'stable' FROM metric_current",
    source="metric_history_mixed", where="true", **_ALL))
def _(t: Tables) -> DataFrame:
    now = _now(t)
    missing = now.select(F.concat(F.lit("unmeasured "), "name").alias("name"), F.lit(None).cast("double").alias("value"))
    return A.detect(now.unionByName(missing), t["metric_history_mixed"], candidates=HW.FIXED).select(*_FOUND)


@query("anomaly_detect_all", anomaly_sql(
    judged_sql("metric_current", "picked", _PICKED_METHOD), source="metric_history_mixed",
    where=f"{_BEFORE} AND run_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY", **_ALL))
def anomalies(t: Tables) -> DataFrame:
    return A.detect_all(_now(t), t["metric_history_mixed"], _AS_OF, candidates=HW.FIXED).select(*_FOUND)


@query("anomaly_summary", anomaly_sql(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS flagged FROM ({judged_sql('metric_current', 'picked', _PICKED_METHOD)})",
    source="metric_history_mixed", **_ALL))
def _(t: Tables) -> DataFrame:
    return A.summary(anomalies(t))
