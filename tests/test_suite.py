import pytest
from pyspark.sql import functions as F

from tablecheck.operators import suite
from tablecheck.operators.checks import KINDS, Rule, orphan_count, rule_from_dict, with_tags
from tablecheck.operators.contracts import Contract, outcome, validate
from tablecheck.operators.distinct import key_counts


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, small):
    return spark.read.parquet(f"{small}/orders.parquet")


def test_all_scan_checks_share_one_scan(orders):
    rules = [Rule(f"r{i}", "greater_than", i, metric=f"sum(o_totalprice + {i})") for i in range(25)]
    rules += [Rule("n", "row_count_at_least", 1), Rule("c", "completeness_ratio", 0.9, column="o_custkey")]
    assert plan_text(suite.evaluate(orders, rules)).count("FileScan") == 1


def test_a_scan_reads_only_the_columns_it_needs(orders):
    plan = plan_text(suite.evaluate(orders, [Rule("a", "greater_than", 0, metric="avg(o_totalprice)")]))
    assert "ReadSchema: struct<o_totalprice:double>" in plan


def test_orphans_need_no_join(spark, orders):
    plan = plan_text(orphan_count(orders, "o_custkey", orders, "o_orderkey"))
    assert "Join" not in plan and "Broadcast" not in plan


def test_orphans_with_one_dominant_key(spark):
    child = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    parent = spark.range(100).select(F.col("id").alias("p")).where("p <> 7")
    expected = 10_000 + sum(1 for i in range(30_000) if i % 3 and not (i < 100 and i != 7))
    assert orphan_count(child, "k", parent, "p").collect()[0].value == expected
    gappy = parent.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS p"))
    assert orphan_count(child, "k", gappy, "p").collect()[0].value == expected
    assert orphan_count(child, "k", gappy, "p", not_in=True).collect()[0].value == 0


def test_known_kinds():
    assert len(KINDS) == 25


def test_unknown_kind_names_the_known_ones(orders):
    with pytest.raises(ValueError, match="row_count_at_least"):
        rule_from_dict({"name": "x", "assert": "nope"})
    with pytest.raises(ValueError, match="nope"):
        suite.evaluate(orders, [Rule("x", "nope")])


def test_tags_match_any():
    rules = [Rule("a", "equals", tags=("x", "y")), Rule("b", "equals", tags=("z",)), Rule("c", "equals")]
    assert [r.name for r in with_tags(rules, ["y", "z"])] == ["a", "b"]
    assert with_tags(rules, None) == rules


def test_runtime_failure_is_isolated(orders):
    rows = suite.run(orders, [
        Rule("good", "greater_than", 0, metric="count(*)"),
        Rule("fails while running", "greater_than", 0, metric="sum(CAST(o_orderstatus AS INT))"),
        Rule("also good", "duplicate_row", 0, column="o_orderkey"),
    ])
    assert [(r.check_no, r.passed, r.message is None) for r in rows] == [(1, True, True), (2, False, False), (3, True, True)]


def test_empty_table(orders):
    rows = {r.check_name: r for r in suite.run(orders.where("false"), [
        Rule("count", "row_count_at_least", 1), Rule("mean", "between", [0, 10], metric="avg(o_totalprice)"),
        Rule("ratio", "completeness_ratio", 0.5, column="o_custkey"), Rule("dup", "duplicate_row", 0, column="o_custkey"),
        Rule("any", "custom_sql", None, metric="max(o_custkey)"), Rule("blank", "not_empty", column="o_orderstatus"),
    ])}
    assert {n: r.passed for n, r in rows.items()} == {
        "count": False, "mean": False, "ratio": False, "dup": True, "any": False, "blank": True}


def test_no_rules_pass(orders):
    empty = suite.evaluate(orders, [Rule("n", "row_count_at_least", 1)]).where("false")
    row = suite.summary(empty).collect()[0]
    assert (row.total, row.status, row.exit_code) == (0, "OK", 0)


def test_history_rules(spark, orders):
    days = spark.range(1, 15).selectExpr(
        "'orders' AS name", "CAST(100 AS DOUBLE) AS value", "timestamp_seconds(id * 86400) AS run_at")
    noisy = days.withColumn("name", F.lit("noisy")).withColumn("value", F.expr("100 + extract(day from run_at) % 2"))
    n = orders.count()
    rows = suite.run(orders, [
        Rule("constant history", "zscore_anomaly", 3.0, options={"metric_name": "orders"}),
        Rule("far off", "zscore_anomaly", 3.0, options={"metric_name": "noisy"}),
        Rule("no history", "zscore_anomaly", 3.0, options={"metric_name": "absent"}),
        Rule("flat", "trend_check", 20, options={"metric_name": "orders"}),
        Rule("absent", "trend_check", 20, options={"metric_name": "absent"}),
    ], history=days.unionByName(noisy))
    assert [r.passed for r in rows] == [True, False, True, True, True]
    assert {r.value for r in rows} == {float(n)}


def test_distinct_counts_match_sql(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (1, 1.0D, 'a', DATE '2024-01-01', true, array(1), repeat('x', 100)),
          (1, 0.0D, 'a', DATE '2024-01-01', false, array(1), repeat('x', 100)),
          (2, -0.0D, 'A', NULL, NULL, array(1, 2), repeat('x', 101)),
          (NULL, double('NaN'), NULL, NULL, NULL, NULL, NULL),
          (NULL, double('NaN'), '', DATE '2024-01-02', true, array(), '')
        AS t(i, d, s, day, b, arr, long)""")
    found = {r.key_no: r for r in key_counts(df, [[c] for c in df.columns] + [["i", "s"]]).collect()}
    for no, column in enumerate(df.columns):
        assert found[no].distinct_count == df.select(column).where(F.col(column).isNotNull()).distinct().count(), column
        assert found[no].total == 5
    assert found[0].duplicate_groups == 2  # 1 twice, NULL twice
    assert found[7].distinct_count == 4


def test_contract_without_promises_holds(orders):
    assert outcome(validate(orders, Contract("nothing"))).collect()[0].passed


def test_contract_names_what_is_broken(orders):
    from tablecheck.operators.contracts import contract_from_dict

    contract = contract_from_dict({"name": "c", "schema": [{"column": "gone", "type": "int", "unique": True}], "row_count": {"max": 1}})
    assert (contract.owner, contract.version, contract.columns[0].nullable) == ("unknown", "0.1", True)
    rows = validate(orders, contract).collect()
    assert [(r.rule, r.target, r.passed) for r in rows] == [("schema", "gone", False), ("row_count", "max", False)]


def test_runs_build_their_own_history(spark, orders):
    from tablecheck.operators.runner import run_and_record
    from tablecheck.session import shared_folder

    store = shared_folder(spark, "store")
    rules = [
        Rule("rows", "row_count_at_least", 1, tags=("a",)), Rule("mean", "between", [0, 1e9], metric="avg(o_totalprice)", tags=("a",)),
        Rule("skipped", "greater_than", 0, metric="count(*)"),
    ]
    for day in range(1, 6):
        part = orders.where(f"o_orderkey % 100 < {50 + day}")
        quiet = run_and_record(part, rules, store, f"run-{day}", f"2024-01-0{day} 00:00:00", tags=["a"])
        assert all(r.passed for r in quiet.collect() if r.method is None)
    burst = orders.unionByName(orders).unionByName(orders)
    rows = run_and_record(burst, rules, store, "run-6", "2024-01-06 00:00:00", tags=["a"]).collect()
    assert len(rows) == 4
    verdicts = {r.name: (r.passed, r.method) for r in rows if r.method}
    assert verdicts["rows"] == (False, "ewma") and verdicts["mean"][1] == "ewma"
    again = run_and_record(burst, rules, store, "run-6", "2024-01-06 00:00:00", tags=["a"])
    assert again.count() == 4


def test_full_report(spark, orders):
    import json

    from tablecheck.operators import anomaly, ingest
    from tablecheck.operators.contracts import Contract

    checks = suite.evaluate(orders, [Rule("n", "row_count_at_least", 1), Rule("m", "greater_than", 1e12, metric="avg(o_totalprice)")])
    current = spark.createDataFrame([("n", 5.0)], "name string, value double")
    past = spark.sql("SELECT 'n' AS name, CAST(id AS DOUBLE) AS value, timestamp_seconds(id) AS run_at FROM range(4)")
    report = ingest.json_report(checks, "2024-01-01", anomaly.detect(current, past), validate(orders, Contract("c", min_rows=10**9)))
    doc = json.loads(report.collect()[0].report)
    assert doc["summary"] == {"total": 2, "passed": 1, "failed": 1}
    assert [c["check_name"] for c in doc["checks"]] == ["n", "m"]
    assert doc["anomalies"]["summary"] == {"total": 1, "flagged": 0}
    assert doc["contracts"][0]["rule"] == "row_count" and doc["contracts"][0]["passed"] is False


def test_keys_are_exact(spark):
    from tablecheck.operators.distinct import key_counts

    df = spark.sql("""SELECT * FROM VALUES
      (1, timestamp'2024-01-01 00:00:00.000001', 0.0D, array(1, 2), map('a', 1, 'b', 2), named_struct('p', 'x:1', 'q', 'y'), 'ab', 'c'),
      (1, timestamp'2024-01-01 00:00:00.000002', -0.0D, array(1, 2), map('b', 2, 'a', 1), named_struct('p', 'x', 'q', '1:y'), 'a', 'bc'),
      (1, timestamp'2024-01-01 00:00:00.000002', double('nan'), array(12), null, null, null, 'abc') AS t(a, ts, d, arr, m, st, s1, s2)""")
    keys = [["a", "ts"], ["a", "d"], ["arr"], ["m"], ["st"], ["s1", "s2"], ["m", "a"], ["d"]]
    found = {r.key_no: (r.distinct_count, r.duplicate_groups) for r in key_counts(df, keys).collect()}
    assert found == {0: (2, 1), 1: (2, 1), 2: (2, 1), 3: (1, 1), 4: (2, 0), 5: (3, 0), 6: (2, 1), 7: (2, 1)}


def test_no_rule_ends_a_suite(spark):
    df = spark.range(4).withColumn("v", F.col("id") - 2)
    broken = [
        Rule("limit", "less_than", "abc", metric="count(*)"), Rule("list", "schema_check", [1, 2]), Rule("parent", "referential_integrity", None, column="id"),
        Rule("past", "trend_check", metric="count(*)"), Rule("runs", "greater_than", 0, metric="sum(1 / v)"), Rule("other", "cross_table_check", query="SELECT 1", options={"table": "absent"}),
    ]
    rules = [Rule("first", "greater_than", 0, metric="count(*)"), *broken, Rule("last", "equals", 4, query="SELECT count(*) FROM source")]
    rows = suite.run(df, rules)
    assert [r.check_no for r in rows] == list(range(1, len(rules) + 1))
    assert [r.check_name for r in rows if r.passed] == ["first", "last"] and all(r.message for r in rows if not r.passed)
    assert suite.settled(df, rules).count() == len(rules) and suite.evaluate(df, []).count() == 0
    assert not spark.catalog.tableExists("source")


def test_queried_values_of_every_kind(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    past = spark.createDataFrame([("n", 2.0 + i % 3, f"2024-01-{i + 1:02} 00:00:00") for i in range(20)], "name string, value double, run_at string").withColumn("run_at", F.col("run_at").cast("timestamp"))
    rules = [
        Rule("text", "distribution_check", [2.0, 1.0], query="SELECT '2.0,1.0'"), Rule("text, off", "distribution_check", [2.0, 99.0], query="SELECT '2.0,1.0'"),
        Rule("two", "distribution_check", [2.0, 99.0], query="SELECT avg(x), stddev(x) FROM source"), Rule("mean", "distribution_check", [2.0, None], query="SELECT avg(x) FROM source"),
        Rule("fresh", "freshness_hours", 2, query="SELECT timestamp'2024-01-01 00:00:00'", options={"as_of": "2024-01-01 01:00:00"}),
        Rule("old", "freshness_hours", 2, query="SELECT '2024-01-01 00:00:00'", options={"as_of": "2024-01-02 01:00:00"}),
        Rule("same", "cross_table_check", query="SELECT count(*) FROM source", options={"table": "t", "other_query": "SELECT count(*) FROM {source}"}),
        Rule("n", "zscore_anomaly", 3.0, query="SELECT count(*) FROM source"), Rule("far", "zscore_anomaly", 3.0, query="SELECT 900", options={"metric_name": "n"}),
        Rule("trend", "trend_check", 90.0, query="SELECT count(*) FROM source", options={"metric_name": "n"}),
    ]
    found = {r.check_name: r.passed for r in suite.evaluate(df, rules, tables={"t": df}, history=past).collect()}
    assert found == {"text": True, "text, off": False, "two": False, "mean": True, "fresh": True, "old": False, "same": True, "n": True, "far": False, "trend": True}


def test_stored_values_are_not_rounded(spark):
    df = spark.range(1, 4_000_001)
    assert suite.evaluate(df, [Rule("share", "less_than", 1, metric="count_if(id = 1) / count(*)")]).first().value == pytest.approx(2.5e-7)


def test_registered_questions_are_asked_once(spark, monkeypatch):
    from tablecheck.operators import runner
    from tablecheck.session import constant_rows

    asked = []
    monkeypatch.setattr(suite, "query_source", lambda df, sql, real=suite.query_source: asked.append(sql) or real(df, sql))
    texts = [("SELECT count(*) FROM source", "equals", "7"), ("SELECT count(*) FROM source", "greater_than", "9"),
             ("SELECT max(nowhere) FROM source", "equals", "0"), ("SELECT max(id) FROM source", "is_not_null", None), ("", "zscore_anomaly", "3")]
    rows = [(i * 7, i % 2, f"check {i}", *texts[i % 5], "late" if i % 3 == 0 else "", 1) for i in range(60)]
    checks = constant_rows(spark, rows, "id int, source_id int, name string, query string, assert_type string, assert_value string, tags string, is_active int")
    sources = spark.sql("SELECT 1 AS id, 'csv' AS type")
    got = {r.check_name: r for r in runner.run_registered(spark.range(7).toDF("id"), checks, sources, 1).collect()}
    assert len(asked) == 4
    mine = [r for r in rows if r[1] == 1]
    assert [got[r[2]].check_no for r in mine] == list(range(1, 31)) and len(got) == 30
    assert {(i % 5, got[f"check {i}"].passed, got[f"check {i}"].value) for i in range(1, 60, 2)} == {(0, True, 7.0), (1, False, 7.0), (2, False, None), (3, True, 6.0), (4, False, None)}
    assert "nowhere" in got["check 7"].message and got["check 9"].message == "no history given"
    late = runner.run_registered(spark.range(7).toDF("id"), checks, sources, 1, ["late", "x"]).collect()
    assert sorted((r.check_no, r.check_name) for r in late) == [(n, f"check {i}") for n, i in enumerate(range(3, 60, 6), 1)]
    numbered = runner._numbered(spark.range(50).selectExpr("(id * 37) % 50 * 3 - 20 AS id"), "id", 10).collect()
    assert [r.check_no for r in sorted(numbered, key=lambda r: r.id)] == list(range(1, 51))
    assert runner.run_registered(spark.range(7).toDF("id"), checks, sources, 5).collect() == []
