"""Stored points in few files."""

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import history as H
from tablecheck.session import shared_folder
from tablecheck.sources import stores
from tablecheck.streaming import suites


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(df):
    return df.select("_metadata.file_path").distinct().count()


def test_crowded_days_are_rewritten_and_points_stay(spark):
    path = shared_folder(spark, "crowded")
    for hour in range(6):
        days = spark.range(3 if hour < 2 else 2).selectExpr("'m' AS name", f"CAST(id * 10 + {hour} AS DOUBLE) AS value", f"timestamp_seconds(id * 86400 + {hour} * 3600) AS run_at")
        H.record(days.coalesce(1), path)
    before = rows(spark.read.parquet(path))
    assert stores.crowded_partitions(spark, path, "run_date", 2) == {"1970-01-01": 6, "1970-01-02": 6}
    assert stores.compact(spark, path, "run_date", 2, closed="1970-01-02") == ["1970-01-01"]
    assert stores.compact(spark, path, "run_date", 2) == ["1970-01-02"]
    assert stores.compact(spark, path, "run_date", 2) == []
    after = spark.read.parquet(path)
    assert rows(after) == before and len(before) == 14
    assert all(files(after.where(F.col("run_date") == F.lit(day).cast("date"))) <= 2 for day in ("1970-01-01", "1970-01-02", "1970-01-03"))


def test_folded_points_open_few_files(spark):
    path, state = shared_folder(spark, "batches"), shared_folder(spark, "state")

    def batch(no):
        kept = spark.range(4).selectExpr("concat('m', id) AS name", "timestamp_seconds(id * 60) AS run_at", f"CAST({no} + id AS DOUBLE) AS value", "1D AS total", f"CAST({no} AS BIGINT) AS batch_id")
        stores.replace_partitions(kept.where(f"id <= {no} % 4").coalesce(1), path, "batch_id")

    for no in range(12):
        batch(no)
        if no % 4 == 3:
            assert suites.fold_points(spark, path, state) == no
            assert suites.fold_points(spark, path, state) == no  # nothing new
    batch(12)
    found, upto = suites._since(spark, path, state)
    assert upto == 11 and len(found.where("batch_id > 11").collect()) == 1
    assert rows(suites.current_points(spark, path, state)) == rows(suites.newest_points(spark.read.parquet(path)))
    assert files(spark.read.parquet(state)) == 3 and files(spark.read.parquet(path).where("batch_id > 11")) == 1
    with pytest.raises(Exception):
        suites.fold_points(spark, shared_folder(spark, "no-such"), shared_folder(spark, "none"))
