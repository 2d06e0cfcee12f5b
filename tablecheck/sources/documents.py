"""Find and group queries over JSON documents held in a text or struct column."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

_SUMS = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """One column per document field, next to the table's own columns; ``_id`` becomes text."""
    doc = F.from_json(F.col(column), schema)
    out = df.withColumn("_doc", doc).select("*", "_doc.*").drop("_doc")
    return out.withColumn("_id", F.col("_id").cast("string")) if "_id" in out.columns else out


def matches(condition: Mapping[str, Any]) -> Column:
    """All fields equal; None matches a field that is null or absent."""
    test = F.lit(True)
    for name, value in condition.items():
        if isinstance(value, (Mapping, list)) or name.startswith("$"):
            raise ValueError(f"only equality on fields is supported, not {name}: {value!r}")
        test = test & F.col(f"`{name}`").eqNullSafe(F.lit(value))
    return test


def _field(reference: Any) -> Column:
    if isinstance(reference, str) and reference.startswith("$"):
        return F.col(f"`{reference[1:]}`")
    return F.lit(reference)


def _stage(df: DataFrame, stage: Mapping[str, Any]) -> DataFrame:
    if len(stage) != 1:
        raise ValueError("a stage has exactly one operator")
    (name, spec), = stage.items()
    if name == "$match":
        return df.where(matches(spec))
    if name == "$count":
        return df.agg(F.count("*").alias(spec))
    if name == "$group":
        key = spec["_id"]
        totals = []
        for alias, total in spec.items():
            if alias == "_id":
                continue
            (op, over), = total.items()
            if op not in _SUMS:
                raise ValueError(f"unsupported accumulator {op}")
            totals.append(_SUMS[op](_field(over)).alias(alias))
        return df.groupBy(_field(key).alias("_id")).agg(*totals) if totals else df.select(_field(key).alias("_id")).distinct()
    raise ValueError(f"unsupported stage {name}")


def run(collections: Mapping[str, DataFrame], request: Mapping[str, Any]) -> DataFrame:
    """``{"collection", "filter"}`` or ``{"collection", "pipeline"}`` over named document tables."""
    if not isinstance(request, Mapping):
        raise TypeError("a document request is a mapping")
    if not request.get("collection"):
        raise ValueError("the request names no collection")
    df = collections[request["collection"]]
    if "pipeline" in request:
        for stage in request["pipeline"]:
            df = _stage(df, stage)
        return df
    if "filter" in request:
        return df.where(matches(request["filter"]))
    raise ValueError("the request holds neither a filter nor a pipeline")
