import pytest
from pyspark.sql import functions as F

from tablecheck.functions.naming import name_pattern, personal_tag, query_fingerprint, queried_column
from tablecheck.operators import ingest, profile as P
from tablecheck.operators import results as R
from tablecheck.operators.checks import Rule
from tablecheck.session import constant_rows, shared_folder
from tablecheck.sources import documents, readers
from tablecheck.streaming import suites


def test_unknown_source_type_lists_the_known(spark):
    with pytest.raises(ValueError, match="csv.*postgres"):
        readers.read_source(spark, {"type": "cobol"})


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", query="SELECT 1 AS a")
    assert plain["query"] == "SELECT 1 AS a" and "partitionColumn" not in plain
    split = readers.jdbc_options("jdbc:x", query="SELECT 1 AS a", partition_column="a", bounds=(0, 9), partitions=3)
    assert split["dbtable"] == "(SELECT 1 AS a) AS source" and split["numPartitions"] == "3" and "query" not in split
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", table="t", partition_column="a")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([('{"_id": 1, "a": 1, "b": null}',), ('{"_id": 2, "a": 2, "b": "x"}',), ('{"_id": 3, "a": 1}',)], "doc string")
    return {"c": documents.parsed(rows, "doc", "_id INT, a INT, b STRING")}


def test_document_requests(docs):
    found = documents.run(docs, {"collection": "c", "filter": {"a": 1, "b": None}}).collect()
    assert sorted(r._id for r in found) == ["1", "3"]
    assert documents.run(docs, {"collection": "c", "pipeline": [{"$match": {"a": 1}}, {"$count": "n"}]}).collect()[0].n == 2


@pytest.mark.parametrize("request_, error", [
    ("SELECT 1", TypeError), ({"filter": {}}, ValueError), ({"collection": "c"}, ValueError),
    ({"collection": "c", "pipeline": [{"$lookup": {}}]}, ValueError), ({"collection": "c", "filter": {"a": {"$gt": 1}}}, ValueError),
])
def test_bad_document_requests(docs, request_, error):
    with pytest.raises(error):
        documents.run(docs, request_)


def test_names(spark):
    names = ["customer_id", "ID", "user_email", "created_at", "Full_Name", " Date2 ", "amount"]
    df = constant_rows(spark, [(n,) for n in names], "n string").select(name_pattern(F.col("n")), personal_tag(F.col("n")))
    assert [r[0] for r in df.collect()] == ["*_id", "*_id", "*email*", "*_date", "*name*", "*_date", "amount"]
    assert df.collect()[2][1] == "email"
    texts = [("SELECT COUNT(*) FROM t WHERE x IS NULL", "equals", "not_null", "x"), ("SELECT COUNT(DISTINCT y) FROM t", "equals", "unique", "y"),
             ("SELECT AVG(z) FROM t WHERE z > 1", "between", "range", "z"), ("SELECT max(ts) FROM t", "less_than", "freshness", None),
             ("  select count(*) from t", "equals", "row_count", None), (None, "equals", "custom", None), ("", None, "custom", None),
             ("SELECT count(*) FROM t where A.b = 1 AND c IS NULL", "equals", "not_null", None), ("select 1 from t where total>=5", "less_than", "custom", "total"),
             ("select count(*) from t where k = 3", None, "custom", "k"), ("SELECT count(distinct t.x) FROM t WHERE y < 2", "between", "unique", "y")]
    got = constant_rows(spark, [t[:2] for t in texts], "q string, a string").select(query_fingerprint(F.col("q"), F.col("a")), queried_column(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [t[2:] for t in texts]


def test_profile_of_an_empty_table(spark, small):
    empty = spark.read.parquet(f"{small}/orders.parquet").where("false")
    rows = P.profile_table(empty).collect()
    assert {r.col_type for r in rows} == {"unknown"} and {r.null_pct for r in rows} == {0.0}
    assert {r.distinct_count for r in rows} == {0}


def test_profile_of_nested_columns_and_approximate_counts(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    exact = {r.column_name: r.distinct_count for r in P.profile_table(df).collect()}
    approx = {r.column_name: r.distinct_count for r in P.profile_table(df, distinct="approx").collect()}
    assert exact["vec_id"] == df.count()
    assert all(abs(approx[c] - exact[c]) <= 0.2 * exact[c] + 1 for c in exact)


def test_glossary_needs_a_known_field(spark, small):
    profile = P.profile_table(spark.read.parquet(f"{small}/region.parquet")).withColumn("source_id", F.lit(1))
    with pytest.raises(ValueError):
        P.merge_glossary(profile, constant_rows(spark, [(1, "r_name", "x")], "source_id int, column_name string, color string"))


def test_last_payload_wins_and_defaults(spark):
    payloads = constant_rows(spark, [
        (1, '{"run_id": "a", "results": [{"name": "x", "passed": true}], "summary": {"total": 1, "passed": 1}}'),
        (2, '{"run_id": "a", "results": [{"name": "x", "passed": false, "value": 0}, {"metric_name": "m", "is_anomaly": true, "current": 3}]}'),
        (3, '{"results": []}'),
    ], "sent int, payload string")
    headers = {r.run_id: r for r in ingest.run_headers(payloads, "sent").collect()}
    assert (headers["a"].total, headers["a"].passed, headers["a"].failed, headers["a"].status) == (2, 0, 2, "fail")
    assert len(headers) == 2
    rows = ingest.run_result_rows(payloads).where("run_id = 'a'").collect()
    assert sorted((r.name, r.passed, r.value) for r in rows if r.value is not None) == [("m", 0, 3.0), ("x", 0, 0.0)]


def test_newest_run_of_a_dominant_source(spark):
    runs = spark.range(9000).selectExpr(
        "id AS run_id", "if(id % 3 < 2, 1, 2) AS source_id", "timestamp_seconds(id div 10) AS run_at", "10L AS total", "id % 11 AS passed")
    newest = {r.source_id: r for r in R.latest_runs(runs).collect()}
    assert (newest[1].run_id, newest[2].run_id) == (8998, 8999)
    plan = R.latest_runs(runs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan


def test_page_is_cut_before_the_join(spark, small):
    from tablecheck.plans.tables import Tables

    t = Tables(spark, small)
    plan = R.bi_results(t["stored_results"], t["runs"], limit=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("GlobalLimit")


def test_late_rows_are_dropped(spark):
    path = shared_folder(spark, "late")
    def arrive(rows):
        spark.createDataFrame(rows, "ts string, kind string, value double").select(
            F.to_timestamp("ts").alias("ts"), "kind", "value").coalesce(1).write.mode("append").parquet(path)
    arrive([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-03 10:00:00", "a", 1.0)])
    out, checkpoint = shared_folder(spark, "late-out"), shared_folder(spark, "late-cp")
    def run():
        stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).parquet(path)
        suites.append_points(suites.windowed_points(stream, "ts", "kind", "1 day"), out, checkpoint).awaitTermination()
    run()
    arrive([("2024-01-01 11:00:00", "a", 5.0)])  # its day is closed
    arrive([("2024-01-05 10:00:00", "a", 1.0)])
    run()
    rows = spark.read.parquet(out).orderBy("run_at").collect()
    assert [(str(r.run_at)[:10], r.value) for r in rows] == [("2024-01-01", 1.0), ("2024-01-03", 1.0)]


def test_stream_suite_replaces_a_repeated_batch(spark, small):
    path = shared_folder(spark, "arrivals")
    spark.read.parquet(f"{small}/events.parquet").limit(50).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    out = shared_folder(spark, "stream-out")
    for attempt in range(2):  # a second start without its checkpoint repeats batch 0
        stream = spark.readStream.schema(schema).parquet(path)
        suites.check_stream(stream, [Rule("n", "row_count_at_least", 1)], out, shared_folder(spark, "cp")).awaitTermination()
    assert [(r.batch_id, r.value) for r in spark.read.parquet(out).collect()] == [(0, 50.0)]


def test_payloads_keep_what_was_sent(spark):
    from tablecheck.operators import ingest, results

    sent = [
        (1, '{"run_id": "r1", "source_id": 5, "run_at": "2024-01-01T00:00:00", "results": [{"name": "a", "passed": true, "value": "25.5,6.5"}, {"name": "b", "passed": false}]}'),
        (2, '{"run_id": "r1", "source_id": 5, "run_at": "2024-01-02T00:00:00", "results": [{"name": "a", "passed": false, "value": 3}]}'),
        (3, '{"run_id": "r2", "run_at": "not a time", "results": []}'),
    ]
    payloads = spark.createDataFrame(sent, "sent int, payload string").withColumn("received", F.lit("2024-02-01 00:00:00"))
    headers = {r.run_id: r for r in ingest.run_headers(payloads, "sent").collect()}
    assert headers["r1"].source_id == 5 and str(headers["r1"].run_at) == "2024-01-02 00:00:00" and str(headers["r2"].run_at) == "2024-02-01 00:00:00"
    everything = ingest.run_result_rows(payloads)
    assert {(r.value_actual, r.value) for r in everything.where("name = 'a'").collect()} == {("25.5,6.5", None), ("3", 3.0)}
    assert [r.name for r in ingest.run_result_rows(payloads, "sent").collect()] == ["a"]
    scores = results.health_scores(ingest.run_headers(payloads, "sent")).collect()
    assert {r.source_id for r in scores} == {5, None}
    lines = results.alert_digest(
        spark.createDataFrame([("r1", 1, 1, "a", 0, None, None, None)], "run_id string, check_no int, check_id bigint, check_name string, passed int, value_actual string, expected string, message string"),
        ingest.run_headers(payloads, "sent"), spark.createDataFrame([(5, 1)], "id bigint, alert_enabled int"),
    ).collect()
    assert {r.line for r in lines} == {"run #r1, source: , failed: 1 checks", "a: value ?, expected ?"}


def test_configuration_to_results(spark, small):
    from tablecheck.operators.checks import registered_value
    from tablecheck.operators.runner import run_from_dict

    config = {
        "source": {"type": "parquet", "path": f"{small}/orders.parquet"},
        "checks": [
            {"name": "rows", "assert": "greater_than", "value": 0, "query": "SELECT count(*) FROM source", "tags": ["a"]},
            {"name": "bad", "assert": "equals", "value": 0, "query": "SELECT nothing FROM source", "tags": ["a"]},
            {"name": "left out", "assert": "not_empty", "column": "o_orderstatus"},
        ],
    }
    found = {r.check_name: (r.passed, r.message is None) for r in run_from_dict(spark, config, tags=["a"]).collect()}
    assert found == {"rows": (True, True), "bad": (False, False)}
    assert [registered_value(x) for x in ("[1, 100]", "24", "0.5", "true", "", None, "abc", "a, b")] == [[1, 100], 24, 0.5, True, None, None, "abc", "a, b"]
