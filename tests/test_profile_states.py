"""Profiles merged from stored states."""

import os

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import profile as P, profile_states as S
from tablecheck.session import shared_folder

EXACT = ["column_name", "col_type", "row_count", "null_count", "null_pct", "min_num", "max_num", "avg_val", "min_text", "max_text", "min_length", "max_length"]


def plain(df):
    return sorted((tuple(r) for r in df.select(*EXACT).collect()), key=repr)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_days_are_the_whole_table(spark, small):
    events, path = spark.read.parquet(f"{small}/events.parquet"), shared_folder(spark, "states")
    for day in range(4):
        S.record(events.where(f"event_id % 4 = {day}"), path, "e", f"2024-03-0{day + 1}")
    states = S.load(spark, path)
    assert plain(S.profile(states, "source_name")) == plain(P.profile_table(events, distinct="none"))
    # states of states, in another grouping
    halves = S.merged(states.withColumn("half", F.col("day") > F.lit("2024-03-02").cast("date")), "half")
    again, once = S.profile(halves).collect(), S.profile(states).collect()
    assert plain(S.profile(halves)) == plain(S.profile(states)) and {r.column_name: r.distinct_count for r in again} == {r.column_name: r.distinct_count for r in once}


def test_a_day_reads_only_its_own_rows_and_replaces_itself(spark, small):
    rows, path = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_tax"), shared_folder(spark, "states")
    old, new = shared_folder(spark, "old"), shared_folder(spark, "new")
    rows.where("l_orderkey % 2 = 0").write.parquet(old)
    rows.where("l_orderkey % 2 = 1").write.parquet(new)
    S.record(spark.read.parquet(old).limit(5), path, "lines", "2024-01-01")
    S.record(spark.read.parquet(old), path, "lines", "2024-01-01")
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.startswith("part-")}
    S.record(spark.read.parquet(new), path, "lines", "2024-01-02")
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.startswith("part-")}
    assert len(before) == 1 and len(after) == 2 and before.items() <= after.items()
    assert plain(S.profile(S.load(spark, path), "source_name")) == plain(P.profile_table(rows, distinct="none"))


def test_only_wanted_states_are_opened(spark, small):
    path = shared_folder(spark, "states")
    for source in "ab":
        for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
            S.record(spark.range(10).toDF("x"), path, source, day)
    some = S.load(spark, path, ["a"], since="2024-01-02")
    assert some.select("_metadata.file_path").distinct().count() == some.count() == 2
    filters = physical(some).split("PartitionFilters:")[1].split("]")[0]
    assert "source_name" in filters and "day" in filters
    plan = physical(S.merged(some, "source_name"))
    assert plan.count("FileScan") == 1 and "partial_hll_union_agg" in plan and "partial_kll_merge_agg_double" in plan
    assert physical(S.state(spark.read.parquet(f"{small}/lineitem.parquet"))).count("FileScan") == 1


def test_estimates_lie_within_their_errors(spark):
    path = shared_folder(spark, "states")
    for day in range(5):
        S.record(spark.range(day * 40_000, day * 40_000 + 60_000).selectExpr("id", "CAST(id % 1000 AS STRING) AS t", "id / 7.0D AS d"), path, "s", f"2024-01-0{day + 1}")
    found = {r.column_name: r for r in S.profile(S.load(spark, path)).collect()}
    for column, distinct, median in (("id", 220_000, None), ("t", 1000, 500), ("d", 220_000, None)):
        assert abs(found[column].distinct_count - distinct) <= 0.0325 * distinct
        if median:
            assert abs(found[column].median - median) <= 20 and found[column].p25 < found[column].median < found[column].p75
    every = sorted(i for day in range(5) for i in range(day * 40_000, day * 40_000 + 60_000))
    assert every[int(0.48 * len(every))] <= found["id"].median <= every[int(0.52 * len(every))]


def test_kinds_of_columns_and_empty_tables(spark):
    df = spark.sql("""SELECT * FROM VALUES (true, DATE'2024-01-01', TIMESTAMP'2024-01-01 10:00:00', X'01', array(1), map('a', 1), 'x', -0.0D), (false, DATE'2023-01-01', NULL, X'02', array(2), map('a', 2), NULL, 0.0D)
        AS t(flag, day, at, bytes, list, pairs, t, zero)""")
    path = shared_folder(spark, "states")
    S.record(df, path, "s", "2024-01-01")
    S.record(df.where("false"), path, "s", "2024-01-02")
    S.record(df.selectExpr("1 AS later"), path, "s", "2024-01-03")
    found = {r.column_name: r for r in S.profile(S.load(spark, path)).collect()}
    assert {c: r.col_type for c, r in found.items()} == {"flag": "numeric", "day": "date", "at": "date", "bytes": "binary", "list": "nested", "pairs": "nested", "t": "string", "zero": "numeric", "later": "numeric"}
    assert {c: r.distinct_count for c, r in found.items()} == {"flag": 2, "day": 2, "at": 1, "bytes": 2, "list": 2, "pairs": 2, "t": 1, "zero": 1, "later": 1}
    assert found["day"].min_text == "2023-01-01" and found["at"].max_text.startswith("2024-01-01 10:00:00") and found["t"].null_count == 1
    nothing = S.profile(S.state(df.where("false")).withColumn("day", F.lit("2024-01-01").cast("date"))).collect()
    assert {r.col_type for r in nothing} == {"unknown"} and {r.distinct_count for r in nothing} == {0} and {r.median for r in nothing} == {None}


def test_late_values_are_found_by_the_type_sample(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "if(id >= 300, 'x' || id, NULL) AS late", "if(id = 999, '2024-01-01', NULL) AS last", "CAST(NULL AS STRING) AS never")
    assert [r.sample_type for r in P.sample_types(df).orderBy("ordinal").collect()] == ["numeric", "string", "date", "unknown"]
    assert [r.sample_type for r in P.sample_types(df.where("id < 0")).orderBy("ordinal").collect()] == ["unknown"] * 4
    mixed = spark.range(0, 100, 1, 1).selectExpr("if(id < 10, 'word', CAST(id AS STRING)) AS t")
    assert P.sample_types(mixed).first().sample_type == "string"  # the first ten values decide
