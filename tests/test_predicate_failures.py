"""Failing values of user predicates with their reasons."""

import math

import pytest

from tablecheck.operators import predicate_failures as PF, suite
from tablecheck.operators.checks import Rule


RULES = [
    Rule("positive", "custom_script", lambda v: v > 0, column="n"), Rule("short", "custom_script", lambda t: len(t) < 4, column="t"),
    Rule("inverse", "custom_script", lambda v: 1 / v, column="n"), Rule("any", "custom_script", lambda v: True, column="odd name"),
]


def test_counts_are_those_of_the_check_and_samples_tell_why(spark):
    df = spark.range(0, 400, 1, 5).selectExpr("if(id % 7 = 0, NULL, CAST(id - 200 AS INT)) AS n", "if(id % 5 = 0, NULL, if(id % 3 = 0, 'long text', 'abc')) AS t", "id AS `odd name`")
    found = {r.check_name: r for r in PF.reasons(df, RULES, samples=3).collect()}
    assert {n: r.failed for n, r in found.items()} == {r.check_name: int(r.value) for r in suite.run(df, RULES)}
    assert all(len(r.samples) == min(3, r.failed) for r in found.values()) and found["any"].samples == []
    assert [(s.value, s.error) for s in found["positive"].samples] == [(None, "TypeError: '>' not supported between instances of 'NoneType' and 'int'"), ("-199", None), ("-198", None)]
    assert {(s.value, s.error and s.error.split(":")[0]) for s in found["short"].samples} <= {(None, "TypeError"), ("long text", None)}
    assert [r.check_no for r in PF.reasons(df, RULES).orderBy("check_no").collect()] == [1, 2, 3, 4]


def test_edge_tables_and_values(spark):
    df = spark.createDataFrame([(math.nan,), (0.0,), (None,), (2.0,)], "n double")
    row = PF.reasons(df, [RULES[2]]).first()
    assert row.failed == 3 and sorted((s.value, s.error.split(":")[0]) for s in row.samples if s.value) == [("0.0", "ZeroDivisionError"), ("nan", "TypeError")]
    assert PF.reasons(df.where("n < -9"), [RULES[2]]).first().failed == 0
    assert PF.reasons(df, []).collect() == []
    long = spark.sql("SELECT repeat('x', 100000) AS t")
    assert len(PF.reasons(long, [RULES[1]]).first().samples[0].value) == 200
    with pytest.raises(ValueError, match="no such"):
        PF.reasons(df, [Rule("no such", "custom_script", bool, column="zz")])


def test_what_is_gathered_is_bounded(spark):
    df = spark.range(0, 100_000, 1, 8).selectExpr("CAST(-id AS INT) AS n")
    plan = PF.reasons(df, RULES[:1], samples=4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    row = PF.reasons(df, RULES[:1], samples=4).first()
    assert row.failed == 100_000 and [s.value for s in row.samples] == ["0", "-1", "-2", "-3"]
