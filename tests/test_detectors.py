"""Detectors on a stream against the batch detectors."""

import pytest
from pyspark.sql import functions as F
from test_series import noisy, plain_ewma, plain_holt_winters, points

from tablecheck.operators import anomaly as A, holt_winters as HW
from tablecheck.session import shared_folder
from tablecheck.streaming import detectors as D


def test_model_follows_the_batch_recursions():
    y = noisy(60)
    model = D.Model(None, 0.3, HW.FIXED[0])
    for i, v in enumerate(y):
        method, forecast, spread = model.expected()
        if 5 <= i < 14:
            assert (method, forecast, spread) == ("ewma", pytest.approx(plain_ewma(y[:i])[0]), pytest.approx(plain_ewma(y[:i])[1]))
        if i >= 14:
            plain = plain_holt_winters(y[:i], *HW.FIXED[0])
            assert (method, forecast, spread) == ("holt_winters", pytest.approx(plain[0]), pytest.approx(plain[1], rel=1e-6))
        model = D.Model(model.state(), 0.3, HW.FIXED[0])  # as it is stored
        model.take(v, i)


def run(spark, source, out, checkpoint, schema, **options):
    D.watch(spark.readStream.schema(schema).parquet(source), out, checkpoint, **options).awaitTermination()


def test_three_batches_and_a_restart(spark):
    source, out, checkpoint = (shared_folder(spark, n) for n in ("points", "verdicts", "detector-checkpoint"))
    lengths = {"a": 3, "b": 9, "c": 20}
    df = None
    for name, n in lengths.items():
        values = noisy(n, seed=n)
        values[-1] *= 3
        part = points(spark, values, name)
        df = part if df is None else df.unionByName(part)
    df = df.cache()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for low, high in ((0, 7), (7, 16), (16, 100)):  # every start goes on from the checkpoint of the one before
        lot = df.where(f"run_at >= timestamp_seconds({low} * 3600) AND run_at < timestamp_seconds({high} * 3600)")
        lot.repartition(3).write.mode("append").parquet(source)
        run(spark, source, out, checkpoint, df.schema)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    found = {(r.name, r.n): r for r in spark.read.parquet(out).collect()}
    assert len(found) == sum(lengths.values())
    for name, length in lengths.items():
        own = df.where(F.col("name") == name).orderBy("run_at").collect()
        for at in sorted({4, 13, 14, length - 1} if name == "c" else {length - 1}):
            past = df.where((F.col("name") == name) & (F.col("run_at") < F.lit(own[at].run_at)))
            current = spark.createDataFrame([(name, own[at].value)], "name string, value double")
            want, row = A.detect(current, past, candidates=HW.FIXED).collect()[0], found[name, at]
            assert (row.method, row.is_anomaly) == (want.method, want.is_anomaly)
            assert row.score == pytest.approx(want.score, abs=1e-3, rel=1e-4) and row.lower_bound == pytest.approx(want.lower_bound, rel=1e-6, abs=1e-3)
        assert found[name, length - 1].is_anomaly == (length > 2)


def test_points_out_of_time_and_silent_metrics(spark):
    source, out, checkpoint = (shared_folder(spark, n) for n in ("points", "verdicts", "detector-checkpoint"))
    df = points(spark, [1.0, 2.0, 3.0, 4.0], "m")
    df.where("value > 2").write.mode("append").parquet(source)
    run(spark, source, out, checkpoint, df.schema, keep_ms=3_600_000)
    df.where("value <= 2").unionByName(points(spark, [None], "m")).unionByName(points(spark, [5.0] * 5, "m").where("run_at > timestamp_seconds(3 * 3600)")).write.mode("append").parquet(source)
    run(spark, source, out, checkpoint, df.schema, keep_ms=3_600_000)
    assert [(r.n, r.value) for r in spark.read.parquet(out).orderBy("n").collect()] == [(0, 3.0), (1, 4.0), (2, 5.0)]
