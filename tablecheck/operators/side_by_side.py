"""Suites whose families run at the same time, each rule within a time limit."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from threading import Timer

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row

from tablecheck.operators import suite
from tablecheck.operators.checks import Rule
from tablecheck.operators.suite import Numbered


class _Limited:
    """Jobs started inside carry a tag, and are cancelled by it when the time is over."""

    def __init__(self, spark, seconds: float | None):
        self.context, self.tag, self.over = spark.sparkContext, f"suite-{uuid.uuid4().hex}", False
        self.timer = Timer(seconds, self._cancel) if seconds is not None else None

    def _cancel(self) -> None:
        self.over = True
        self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> "_Limited":
        self.context.addJobTag(self.tag)
        self.context.setInterruptOnCancel(True)
        if self.timer:
            self.timer.daemon = True
            self.timer.start()
        return self

    def __exit__(self, *raised) -> None:
        if self.timer:
            self.timer.cancel()
        self.context.removeJobTag(self.tag)


def _late(rule: Rule, no: int, seconds: float) -> Row:
    return Row(check_no=no, check_name=rule.name, value=None, value_text=None, expected=rule.expected, passed=False, message=f"TimeoutError: not measured within {seconds:g} seconds")


def run(df: DataFrame, rules: list[Rule], seconds: float | None = None, at_once: int = 4, pool: str | None = None, **context) -> list[Row]:
    """Results as rows, one per rule, like ``suite.run``; up to ``at_once`` families of rules are measured at the same time.

    Rules of one family still share their passes. A family that takes longer than ``seconds`` is cancelled, and its rules
    are then measured one by one, each within the limit: a rule over it is a failed row that says so, and the
    others have their results. With fair scheduling on the cluster, ``pool`` names the pool that the jobs go to.
    """
    spark, found = df.sparkSession, []

    def measured(numbered: Numbered) -> list[Row]:
        if pool is not None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        with _Limited(spark, seconds) as limited:
            try:
                rows = suite.run(df, [rule for _, rule in numbered], **context)
            except Exception:
                if not limited.over:
                    raise
                rows = None
        if rows is not None and not limited.over:
            return [Row(**row.asDict() | {"check_no": numbered[row.check_no - 1][0]}) for row in rows]
        if len(numbered) == 1:
            return [_late(numbered[0][1], numbered[0][0], seconds)]
        return [row for item in numbered for row in measured([item])]

    with ThreadPoolExecutor(at_once) as threads:
        for rows in [threads.submit(inheritable_thread_target(spark)(measured), numbered) for numbered in suite.by_family(rules).values()]:
            found += rows.result()
    return sorted(found, key=lambda row: row.check_no)
