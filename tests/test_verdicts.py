"""Boundary values of every check kind, judged by the verdict expressions."""

import pytest

from tablecheck.functions import verdicts as V

CASES = [
    # (expression over v, value, passes)
    (V.present_and_nonzero("v"), "5D", True), (V.present_and_nonzero("v"), "0D", False),
    (V.present_and_nonzero("v"), "NULL", False),
    (V.below("v", 5), "4.9D", True), (V.below("v", 5), "5D", False), (V.below("v", 5), "NULL", False),
    (V.above("v", 0), "1D", True), (V.above("v", 0), "0D", False),
    (V.within("v", 1, 10), "1D", True), (V.within("v", 1, 10), "10D", True), (V.within("v", 1, 10), "10.1D", False),
    (V.same("v", 0, False), "0L", True), (V.same("v", 1, False), "0L", False),
    (V.same("v", "0", False), "0L", False), (V.same("v", 0, True), "'0'", False), (V.same("v", "a", True), "'a'", True),
    (V.same("v", None, False), "NULL", True), (V.same("v", 0, False), "CAST(NULL AS INT)", False),
    (V.count_at_least("v", 3), "3.9D", True), (V.count_at_least("v", 4), "3.9D", False),
    (V.count_between("v", 1, 5), "5L", True), (V.count_between("v", 1, 5), "6L", False),
    (V.text_filled("v"), "' a '", True), (V.text_filled("v"), "' \\n\\t'", False), (V.text_filled("v"), "NULL", False),
    (V.text_in("v", ["a", "b"]), "'a'", True), (V.text_in("v", ["a"]), "'A'", False), (V.text_in("v", ["a"]), "NULL", False),
    (V.text_in("v", ["a", None]), "NULL", True), (V.text_in("v", []), "'a'", False), (V.text_in("v", ["it's \\ here"]), "r\"it's \\ here\"", True),
    (V.text_starts_with_pattern("v", r"\d{3}"), "'123abc'", True), (V.text_starts_with_pattern("v", r"\d{3}"), "'a123'", False),
    (V.text_starts_with_pattern("v", "a|b"), "'cb'", False), (V.text_starts_with_pattern("v", "a"), "NULL", False),
    (V.null_ratio_ok("v", 0.95), "0.04D", True), (V.null_ratio_ok("v", 0.95), "0.06D", False),
    (V.null_ratio_ok("v", 0.90), "0.10D", True), (V.null_ratio_ok("v", 0.95), "NULL", False),
    (V.at_most("v", 3.0), "1.5D", True), (V.at_most("v", 3.0), "4.2D", False), (V.at_most("v", 2.0), "2.0D", True),
    (V.custom_expected("v", 0), "0D", True), (V.custom_expected("v", 0), "1D", False),
    (V.custom_expected("v", [10, 100]), "10D", True), (V.custom_expected("v", [10, 100]), "101D", False),
    (V.custom_expected("v", None), "0D", True), (V.custom_expected("v", None), "NULL", False),
    (V.volume_change_ok("v", "1000D", 20), "1100D", True), (V.volume_change_ok("v", "1000D", 20), "900D", True),
    (V.volume_change_ok("v", "1000D", 20), "1300D", False), (V.volume_change_ok("v", "1000D", 20), "500D", False),
    (V.volume_change_ok("v", "1000D", 10), "1100D", True), (V.volume_change_ok("v", "0D", 10), "0D", True),
    (V.volume_change_ok("v", "0D", 10), "1D", False), (V.volume_change_ok("v", None, 50), "100D", True),
    (V.volume_change_ok("v", None, 50), "0D", False), (V.volume_change_ok("v", "CAST(NULL AS DOUBLE)", 50), "5D", True),
    (V.compare("v", "100D", "equals"), "100D", True), (V.compare("v", "200D", "less_than"), "100D", True),
    (V.compare("v", "50D", "greater_than"), "100D", True), (V.compare("v", "50D", "less_than"), "100D", False),
    (V.compare("v", "104D", "within_pct", 5), "100D", True), (V.compare("v", "110D", "within_pct", 5), "100D", False),
    (V.compare("v", "0D", "within_pct", 5), "0D", True), (V.compare("v", "0D", "within_pct", 5), "1D", False),
    (V.compare("v", "1D", "about"), "1D", False), (V.compare("v", "NULL", "equals"), "1D", False),
    (V.distribution_ok("v", None, 100, None, 10), "110D", True), (V.distribution_ok("v", None, 100, None, 10), "120D", False),
    (V.distribution_ok("v", "15D", 100, 10, 10), "100D", False), (V.distribution_ok("v", "10D", 100, 10, 10), "90D", True),
    (V.distribution_ok("v", "11D", 100, 10, 10), "110D", True), (V.distribution_ok("v", None, 0, None, 10), "0.05D", True),
    (V.distribution_ok("v", None, 100, None, 10), "NULL", False),
    (V.zscore_ok("v", "4", "1D", "1D", 3.0, 5), "9999D", True), (V.zscore_ok("v", "20", "100D", "0D", 3.0, 5), "9999D", True),
    (V.zscore_ok("v", "20", "100D", "1D", 3.0, 5), "103D", True), (V.zscore_ok("v", "20", "100D", "1D", 3.0, 5), "103.1D", False),
    (V.zscore_ok("v", "CAST(NULL AS INT)", "NULL", "NULL", 3.0, 5), "1D", True),
    (V.trend_ok("14", "100D", "v", 7, 20, "any"), "120D", True), (V.trend_ok("14", "100D", "v", 7, 20, "any"), "79D", False),
    (V.trend_ok("14", "100D", "v", 7, 20, "up"), "50D", True), (V.trend_ok("14", "100D", "v", 7, 20, "up"), "121D", False),
    (V.trend_ok("14", "100D", "v", 7, 20, "down"), "500D", True), (V.trend_ok("14", "100D", "v", 7, 20, "down"), "79D", False),
    (V.trend_ok("5", "100D", "v", 7, 20, "any"), "500D", True), (V.trend_ok("14", "0D", "v", 7, 20, "any"), "0D", True),
    (V.trend_ok("14", "0D", "v", 7, 20, "any"), "1D", False),
]


def test_boundaries(spark):
    cells = [f"(SELECT {expression} FROM (SELECT {value} AS v)) AS c{i}" for i, (expression, value, _) in enumerate(CASES)]
    found = spark.sql("SELECT " + ", ".join(cells)).collect()[0]
    wrong = [(e, v, expected) for i, (e, v, expected) in enumerate(CASES) if found[i] is not expected]
    assert wrong == []


@pytest.mark.parametrize("ts, hours", [("2024-01-01 00:00:00", 24.0), ("2024-01-03 00:00:00", -24.0)])
def test_age(spark, ts, hours):
    age = V.age_hours(f"TIMESTAMP '{ts}'", "2024-01-02 00:00:00")
    assert spark.sql(f"SELECT {age}").collect()[0][0] == hours
