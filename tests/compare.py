"""Runs registered queries on Spark and their SQL on DuckDB and compares whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reference_db(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(v):
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([_cell(r[i]) for i in order] for r in rows)


def difference(df, db, sql: str) -> str | None:
    """None when names and all values agree, else what differs first."""
    rows = [tuple(r) for r in df.collect()]
    found = db.execute(sql)
    theirs = table([d[0] for d in found.description], found.fetchall())
    ours = table(df.columns, rows)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows vs {len(theirs[1])}: {ours[1][:2]} vs {theirs[1][:2]}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{a} vs {b}"
    return None


if __name__ == "__main__":
    from tablecheck.plans import catalog
    from tablecheck.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = reference_db(folder)
    wanted = sys.argv[1:]
    bad = 0
    for key, run in catalog.QUERIES.items():
        if wanted and not any(w in key for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if key in catalog.ORACLES:
                problem = difference(df, db, catalog.ORACLES[key])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {key} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
