"""Sources: a configuration by type becomes a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablecheck.session import constant_rows


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: Any) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the data once more."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.options(**options).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, **options: Any) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.options(**options).json(path)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None, **options: Any) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.options(**options).parquet(path)


def jdbc_options(
    url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None, partitions: int = 1, fetch_size: int = 10_000,
    driver: str | None = None, **extra: Any,
) -> dict[str, str]:
    """Reader options for a relational source; the vendor's driver jar must be on the class path.

    With a partition column and its bounds, ``partitions`` tasks read disjoint ranges; rows outside
    the bounds fall into the first and last range, so the bounds only balance the work. Spark takes
    a range only together with a table, so a query is wrapped as one.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), "pushDownAggregate": "true"}
    if driver:
        options["driver"] = driver
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        options |= {
            "dbtable": table or f"({query}) AS source", "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions),
        }
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    return options | {k: str(v) for k, v in extra.items()}


def read_jdbc(spark: SparkSession, **config: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**config)).load()


def _url(template: str):
    def read(spark: SparkSession, host: str, port: int | None = None, database: str = "", **config: Any) -> DataFrame:
        place = f"{host}:{port}" if port else host
        return read_jdbc(spark, url=template.format(place=place, database=database), **config)

    return read


READERS = {
    "csv": read_csv,
    "json": read_json,
    "parquet": read_parquet,
    "jdbc": read_jdbc,
    "postgres": _url("jdbc:postgresql://{place}/{database}"),
    "mysql": _url("jdbc:mysql://{place}/{database}"),
    "oracle": _url("jdbc:oracle:thin:@//{place}/{database}"),
    "mssql": _url("jdbc:sqlserver://{place};databaseName={database}"),
    "db2": _url("jdbc:db2://{place}/{database}"),
    "snowflake": _url("jdbc:snowflake://{place}/?db={database}"),
}


def read_source(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    kind = config.get("type")
    if kind not in READERS:
        raise ValueError(f"unknown source type '{kind}'; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, **{k: v for k, v in config.items() if k != "type"})


def query_source(df: DataFrame, sql: str) -> DataFrame:
    """Runs a statement in which the table under test is called ``source``, in this statement only: no view is left
    behind, and suites of one session do not meet. ``{source}`` is the same name.

    The name is bound around the statement, which is not searched: its texts stay as they are, and every place
    where a table may stand can name it.
    """
    own = sql.replace("{source}", "source").strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"WITH source AS (SELECT * FROM {{bound}}) (\n{own}\n)", bound=df)


def schema_rows(df: DataFrame) -> DataFrame:
    """``ordinal, column_name, data_type``; known without reading data, also for an empty table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return constant_rows(df.sparkSession, rows, "ordinal int, column_name string, data_type string")
