"""User-supplied Python predicates, run as vectorised UDFs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def guarded_predicate(check: Callable[[object], object]):
    """A boolean UDF from ``check(value)``; a value on which it raises does not pass."""

    def one(value) -> bool:
        try:
            return bool(check(None if value is None or value is pd.NA or value != value else value))
        except Exception:
            return False

    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        return values.map(one).astype(bool)

    return passes
