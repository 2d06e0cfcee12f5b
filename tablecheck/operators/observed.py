"""Suites whose measures are gathered while their table is written: one scan for both."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tablecheck.operators import suite
from tablecheck.operators.checks import KINDS, Rule
from tablecheck.operators.suite import Numbered


class Observed:
    """The rules of a suite that can be measured on passing rows, and how their values are judged.

    Those are the rules of one aggregation. Distinct counts, keys, parents, other tables, Python predicates and whole
    queries need passes of their own; so do rules that do not resolve, whose reason the suite then tells. They are ``others``.
    """

    def __init__(self, df: DataFrame, rules: list[Rule]):
        self.cells: dict[int, list[tuple[str, str]]] = {}
        self.rules: Numbered = []
        self.others: Numbered = []
        for no, rule in enumerate(rules, 1):
            cells = self._measures(df, no, rule)
            if cells:
                self.cells[no] = cells
                self.rules.append((no, rule))
            else:
                self.others.append((no, rule))
        listed = [(c, m) for no, _ in self.rules for c, m in self.cells[no]]
        self.columns: list[Column] = [F.expr(f"({m}) AS {c}") for c, m in listed]
        self.schema: T.StructType = df.select().agg(F.lit(0)).schema if not listed else df.agg(*self.columns).schema

    @staticmethod
    def _measures(df: DataFrame, no: int, rule: Rule) -> list[tuple[str, str]] | None:
        if rule.kind not in KINDS:
            raise ValueError(f"unknown assertion '{rule.kind}'; known: {', '.join(sorted(KINDS))}")
        keyed = KINDS[rule.kind].family in ("keys", "schema", "parent")
        if rule.query or not (KINDS[rule.kind].family == "scan" or rule.metric and keyed):
            return None
        try:
            cells = [(f"m{no}_{j}", m) for j, m in enumerate(KINDS[rule.kind].measures(rule))]
            df.observe("tried", *(F.expr(f"({m}) AS {c}") for c, m in cells))
        except (PySparkException, ValueError, TypeError):
            return None
        return cells

    def results(self, spark: SparkSession, values: dict) -> DataFrame:
        """The verdicts on gathered values, a row per rule."""
        measured = spark.createDataFrame([tuple(values[f.name] for f in self.schema)], self.schema)
        return suite._rows(measured, [suite._judged(no, r, [c for c, _ in self.cells[no]], self.schema) for no, r in self.rules])


def write_checked(df: DataFrame, rules: list[Rule], write: Callable[[DataFrame], None], written: Callable[[], DataFrame], **context) -> DataFrame:
    """Writes ``df`` and gives the suite's results, a row per rule.

    ``write`` is an action that reads every row and may be repeated (it overwrites), ``written`` reads back what it wrote. The measures of one aggregation come
    from the rows on their way to the files (``Observation``): ``df`` is worked out once and nothing is read again for
    them. Other rules run on the written table. A task that is repeated counts once, as it writes once; nothing
    below the write should be lost to that, so measures sit directly under it.

    A measure that fails on a row would end the write: then it is written without measures, and the whole suite, in which a
    failing rule fails alone, runs on the written table.
    """
    spark = df.sparkSession
    found = Observed(df, rules)
    parts: list[DataFrame] = []
    others = found.others
    if found.rules:
        seen = Observation()
        try:
            write(df.observe(seen, *found.columns))
            parts.append(found.results(spark, seen.get))
        except PySparkException:
            write(df)
            others = list(enumerate(rules, 1))
    else:
        write(df)
    if others:
        rows = suite.run(written(), [rule for _, rule in others], **context)
        names = [part.split()[0] for part in suite.RESULT.split(", ")]
        renumbered = [tuple((others[row.check_no - 1][0] if n == "check_no" else row[n]) for n in names) for row in rows]
        parts.append(spark.createDataFrame(renumbered, suite.RESULT))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], suite.RESULT)
