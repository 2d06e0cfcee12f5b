"""Families of rules at the same time, and rules that take too long."""

import time

from tablecheck.operators import side_by_side, suite
from tablecheck.operators.checks import Rule

RULES = [
    Rule("rows", "greater_than", 0, metric="count(*)"), Rule("filled", "completeness_ratio", 0.5, column="v"), Rule("unique", "duplicate_row", 0, column="id"),
    Rule("asked", "equals", 50, query="SELECT count(*) FROM source"), Rule("bad", "greater_than", 0, metric="sum(nothing)"), Rule("py", "custom_script", lambda v: v >= 0, column="id"),
    Rule("fails", "greater_than", 0, metric="sum(1 / (id - id))"),
]


def plain(rows):
    return [(r.check_no, r.check_name, r.value, r.passed, r.message is None) for r in rows]


def test_results_are_those_of_the_suite(spark):
    df = spark.range(50).selectExpr("id", "if(id % 3 = 0, NULL, id) AS v")
    assert plain(side_by_side.run(df, RULES)) == plain(suite.run(df, RULES))
    assert plain(side_by_side.run(df, RULES, seconds=300, at_once=1)) == plain(suite.run(df, RULES))
    assert side_by_side.run(df, []) == []


def test_a_slow_rule_fails_alone(spark):
    df = spark.range(0, 40, 1, 2)

    def slow(value):
        import time

        time.sleep(3)
        return True

    side_by_side.run(df, RULES[:1])  # the session is warm
    started = time.time()
    found = side_by_side.run(df, [RULES[0], Rule("slow", "custom_script", slow, column="id"), Rule("quick", "custom_script", lambda v: v >= 0, column="id"), RULES[2]], seconds=12)
    assert [(r.check_name, r.passed) for r in found] == [("rows", True), ("slow", False), ("quick", True), ("unique", True)]
    assert found[1].message.startswith("TimeoutError") and found[1].value is None and found[2].message is None
    assert time.time() - started < 55  # forty values of three seconds in two tasks take a minute
    assert not spark.sparkContext.getJobTags()
