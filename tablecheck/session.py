"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tablecheck.functions.literals import array, literal, name

# Adaptive execution splits skewed join partitions and merges small ones, so the
# library never fixes a partition count itself.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tablecheck")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared directory.

    The cluster names the directory in ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder; executors elsewhere could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="tablecheck-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side constants (rule lists, schemas) as a relation the optimizer can fold."""
    struct = StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], struct)
    listed = [
        "struct("
        + ", ".join(f"CAST({literal(v)} AS {f.dataType.simpleString()}) AS {name(f.name)}" for v, f in zip(row, struct.fields))
        + ")"
        for row in rows
    ]
    return spark.sql(f"SELECT inline({array(listed)})")
