"""What the plans must look like, and odd names that generated SQL must survive."""

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import history as H
from tablecheck.operators import history_checks as HC
from tablecheck.operators import profile as P
from tablecheck.operators import results as R
from tablecheck.operators import suite, suggest
from tablecheck.operators.checks import Rule
from tablecheck.operators.distinct import key_counts
from tablecheck.plans import catalog
from tablecheck.plans.tables import Tables
from tablecheck.session import shared_folder
from tablecheck.streaming import suites


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_prunes_days(spark):
    path = shared_folder(spark, "metrics")
    points = spark.range(40).selectExpr("'m' AS name", "CAST(id AS DOUBLE) AS value", "timestamp_seconds(id * 86400) AS run_at")
    H.record(points, path)
    recent = H.since(H.load(spark, path), "1970-02-10 00:00:00", 5)
    assert recent.count() == 5
    assert "run_date" in physical(recent).split("PartitionFilters:")[1].split("]")[0]


def test_recent_values_are_limited_before_the_shuffle(spark, small):
    plan = physical(H.recent_values(Tables(spark, small)["metric_history"], 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_numeric_profile_is_compiled_and_reads_once(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = physical(P.profile_table(df, ["l_quantity", "l_tax", "l_shipdate"], distinct="none"))
    assert plan.count("FileScan") == 1
    # the aggregation next to the scan is a hashed one; only the few rows after it are sorted
    assert plan.rindex("HashAggregate(keys=[]") > plan.rindex("SortAggregate")


def test_distinct_copies_are_narrow(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = physical(key_counts(df, [[c] for c in df.columns]))
    assert plan.count("FileScan") == 3  # whole numbers, floats, texts: no column twice
    assert "Generate" not in plan and "Expand" in plan


def test_library_aggregation_of_events_is_hashed(spark, small):
    events = Tables(spark, small)["rule_events"].drop("event_id")
    plan = physical(suggest.build_library(events))
    assert plan.rindex("HashAggregate") > plan.rindex("SortAggregate") if "SortAggregate" in plan else True


def test_names_and_texts_are_read_after_grouping(spark, small):
    checks = spark.range(900).selectExpr("if(id % 3 = 0, 'SELECT count(*) FROM t WHERE a IS NULL', 'SELECT max(b) FROM t WHERE c > 1') AS query", "'between' AS assert_type")
    mined = suggest.mined_usage(checks, "2024-01-01")
    assert sorted((r.column_name, r.rule_type, r.times) for r in mined.collect()) == [("a", "not_null", 300), ("c", "range", 600)]
    each = mined.selectExpr("explode(sequence(1, times)) AS i", "*").drop("i", "times")
    assert sorted(suggest.build_library(mined).collect()) == sorted(suggest.build_library(each).collect())
    assert "lambda" not in mined._jdf.queryExecution().optimizedPlan().toString()
    for key in ("rule_library_build", "rule_normalize_pattern"):
        plan = physical(catalog.QUERIES[key](spark, small))
        assert "RLIKE" not in plan[plan.rindex("HashAggregate"):]


@pytest.mark.parametrize("key", ["library_suggestions", "suggest_merge"])
def test_known_names_are_joined_without_looking_at_events(spark, small, key):
    plan = physical(catalog.QUERIES[key](spark, small))
    events = plan[plan.rindex("Union"):]
    assert "rule_type" in events and "RLIKE" not in events[:events.index("FileScan")]


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_no_cross_joins(spark, small, key):
    if key in ("stream_suite", "stream_window_metrics"):
        pytest.skip("runs its stream while it is built; the plan left is a file read")
    plan = physical(catalog.QUERIES[key](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, None, 2.0), (2, "it's", 3.0)], "`a b` int, `c``d.e` string, `order` double")
    rows = suite.run(df, [
        Rule("it's \\ odd", "duplicate_row", 0, column="a b"), Rule("n", "completeness_ratio", 0.5, column="c`d.e"),
        Rule("v", "accepted_values", ["x", "it's"], column="c`d.e", options={"count_nulls": False}),
        Rule("pair", "duplicate_row", 0, column=["a b", "c`d.e"]), Rule("py", "custom_script", lambda v: v > 0, column="order"),
    ])
    assert [r.check_name for r in rows][0] == "it's \\ odd"
    assert [r.passed for r in rows] == [False, True, True, True, True]
    profile = {r.column_name: r for r in P.profile_table(df).collect()}
    assert profile["c`d.e"].null_count == 1 and profile["a b"].distinct_count == 2 and profile["order"].max_num == 3.0


def test_text_numbers(spark):
    texts = ["1", " -2.5 ", ".5", "3.", "1e3", "+7", "5-LOW", "", " ", "abc", "1d", "nan", "--1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{P.text_number('t')} AS n")
    assert [r.n for r in df.collect()] == [1.0, -2.5, 0.5, 3.0, 1000.0, 7.0] + [None] * 8


def test_distinct_counts_copy_no_rows(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    rules = [Rule(f"n{i}", "greater_than", 0, metric=m) for i, m in enumerate(["count(DISTINCT o_custkey)", "count(*)", "count(DISTINCT year(o_orderdate)) / count(*)", "max(o_totalprice)"])]
    plan = physical(suite.evaluate(df, rules))
    assert "Expand" not in plan and plan.count("FileScan") == 3
    values = df.selectExpr("count(DISTINCT o_custkey)", "count(*)", "count(DISTINCT year(o_orderdate)) / count(*)", "max(o_totalprice)").first()
    assert [r.value for r in suite.run(df, rules)] == pytest.approx([float(v) for v in values])
    assert physical(suite.evaluate(df, rules[:2])).count("FileScan") == 1


def test_volume_by_day_and_group(spark):
    df = spark.sql("SELECT if(id % 3 = 0, 'a', 'b') AS name, timestamp_seconds(id * 3600) AS ts FROM range(72)")
    found = HC.volume_by_day(df, "ts", 10.0, by="name").orderBy("name", "day").collect()
    assert [(r.name, r.value, r.baseline, r.passed) for r in found][:3] == [("a", 8.0, None, True), ("a", 8.0, 8.0, True), ("a", 8.0, 8.0, True)]


def test_positions_need_few_shuffles(spark, small):
    from tablecheck.operators import series

    plan = physical(series.positions(Tables(spark, small)["metric_history"]))
    assert plan.count("Window") <= 4 and plan.count("Join") == 1


def test_volume_against_the_newest_point(spark):
    history = spark.sql("SELECT 'a' AS name, 100D AS value, timestamp_seconds(2) AS run_at UNION ALL SELECT 'a', 5D, timestamp_seconds(1)")
    current = spark.sql("SELECT 'a' AS name, 140D AS value UNION ALL SELECT 'b', 1D UNION ALL SELECT 'c', 0D")
    found = {r.name: (r.baseline, r.passed) for r in HC.volume_check(current, history).collect()}
    assert found == {"a": (100.0, True), "b": (None, True), "c": (None, False)}


def test_sliding_windows(spark):
    df = spark.sql("SELECT timestamp_seconds(id * 3600) AS ts, 'k' AS kind, 1D AS value FROM range(24)")
    rows = suites.windowed_points(df, "ts", "kind", "12 hours", "6 hours").orderBy("run_at").collect()
    assert [r.value for r in rows] == [6.0, 12.0, 12.0, 12.0, 6.0]


def test_dominant_run_and_source(spark):
    """A third of all results in one run, two thirds of all runs in one source."""
    runs = spark.range(300).selectExpr(
        "id AS run_id", "if(id % 3 = 0, id, 1) AS source_id", "'d' AS dag_id", "timestamp_seconds(id) AS run_at", "'fail' AS status")
    results = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 7, id % 300) AS run_id", "CAST(id AS INT) AS check_no", "id AS check_id", "'zscore_x' AS check_name",
        "CAST(id % 2 AS INT) AS passed", "'1' AS value_actual", "'e' AS expected", "if(id % 4 = 0, '[ewma] x', '') AS message")
    sources = spark.range(300).selectExpr("id", "concat('s', id) AS name", "CAST(if(id = 3, 0, 1) AS INT) AS alert_enabled")
    labels = {r.label: r["count"] for r in R.run_details(results, runs, sources).groupBy("label").count().collect()}
    assert sum(labels.values()) == 9000 and labels["ANOMALY"] == 2250
    digest = R.alert_digest(results, runs, sources)
    header = digest.where("part = 0 AND run_id = 7").collect()[0]
    lines = digest.where("part > 0 AND run_id = 7").count()
    assert header.anomalies + header.rules == lines > 1000
    assert digest.where("run_id = 3").count() == 0  # its source has alerts switched off


def test_only_what_is_asked_is_planned(spark, small):
    def exchanges(key):
        return physical(catalog.QUERIES[key](spark, small)).count("Exchange hashpartitioning")

    assert exchanges("contract_columns") == exchanges("contract_types") == exchanges("contract_freshness") == 0
    assert exchanges("suggest_range") < exchanges("suggest_all") and exchanges("pii_tag_columns") < exchanges("profile_table")
    assert physical(catalog.QUERIES["chk_trend"](spark, small)).count("Scan parquet") == physical(catalog.QUERIES["recent_values"](spark, small)).count("Scan parquet")
