"""Tables that the registered queries derive from the given ones.

Every derived table exists twice: as a DataFrame plan here and as SQL text in ``SQL`` for the
side-by-side comparison. Both define the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

SQL: dict[str, str] = {
    "events_gaps": """
SELECT event_id, ts, CASE WHEN event_id % 25 = 0 THEN NULL ELSE user_id END AS user_id,
 CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 33 = 0 THEN '  ' ELSE event_type END AS event_type,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, props FROM events""",
    "orders_dup": """
SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 0""",
    "contacts": """
SELECT c_custkey AS customer_id, c_name AS full_name,
 CASE WHEN c_custkey % 17 = 0 THEN 'broken' ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') END AS email,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('+90', CAST(5000000000 + c_custkey AS VARCHAR(20))) END AS phone,
 c_mktsegment AS segment, CAST(DATE '2024-01-01' AS VARCHAR(10)) AS created_at FROM customer""",
    "metric_history": """
SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_at,
 CAST(ts AS DATE) AS run_date FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    "metric_history_mixed": """
SELECT name, value, run_at, run_date FROM metric_history WHERE run_date <= CASE name
 WHEN 'click' THEN DATE '2024-01-04' WHEN 'error' THEN DATE '2024-01-10' WHEN 'view' THEN DATE '2024-01-01'
 ELSE DATE '2024-01-29' END""",
    "metric_current": """
SELECT name, CASE WHEN name IN ('error','purchase') THEN value * 10 ELSE value END AS value, run_at, run_date
 FROM metric_history WHERE run_date = DATE '2024-01-30'""",
    "sources": """
SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'csv' ELSE 'postgres' END AS type,
 CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END AS alert_enabled FROM nation
UNION ALL SELECT 99, 'UNUSED', 'csv', 1""",
    "run_results": """
SELECT l_orderkey AS run_id, l_linenumber AS check_no, l_partkey AS check_id,
 CASE l_linenumber WHEN 1 THEN 'row_count_orders' WHEN 2 THEN 'null_ratio_customer' WHEN 3 THEN 'zscore_amount'
  WHEN 4 THEN 'volume_daily' WHEN 5 THEN 'cross_table_orders' WHEN 6 THEN 'distribution_price'
  ELSE 'referential_customer' END AS check_name,
 CASE WHEN l_discount <= 0.07 THEN 1 ELSE 0 END AS passed,
 CASE WHEN l_linenumber = 6 THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ',', CAST(l_linenumber AS VARCHAR(20)))
  ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS value_actual,
 CASE WHEN l_linenumber = 6 THEN 'mean=25.5 std=6.5 tol=10' ELSE 'between([1, 45])' END AS expected,
 CASE l_linenumber WHEN 3 THEN '[zscore] trend=up z=3.10' WHEN 4 THEN '[ewma] trend=down norm_score=2.5 tahmin=40.00'
  ELSE '' END AS message
FROM lineitem""",
    "runs": """
SELECT o.o_orderkey AS run_id, c.c_nationkey AS source_id, o.o_orderpriority AS dag_id, o.o_orderdate AS run_at,
 count(r.passed) AS total, CAST(coalesce(sum(r.passed), 0) AS BIGINT) AS passed,
 CAST(count(r.passed) - coalesce(sum(r.passed), 0) AS BIGINT) AS failed,
 CASE WHEN count(r.passed) = coalesce(sum(r.passed), 0) THEN 'pass' ELSE 'fail' END AS status
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN run_results r ON r.run_id = o.o_orderkey
GROUP BY o.o_orderkey, c.c_nationkey, o.o_orderpriority, o.o_orderdate""",
    "stored_results": """
SELECT l_orderkey AS run_id, l_linenumber AS check_no, l_partkey AS check_id,
 CASE l_linenumber WHEN 1 THEN 'row_count_orders' WHEN 2 THEN 'null_ratio_customer' WHEN 3 THEN 'zscore_amount'
  WHEN 4 THEN 'volume_daily' WHEN 5 THEN 'cross_table_orders' WHEN 6 THEN 'distribution_price'
  ELSE 'referential_customer' END AS name,
 CASE WHEN l_discount <= 0.07 THEN 1 ELSE 0 END AS passed, l_quantity AS value, 'between([1, 45])' AS expected,
 l_shipdate AS run_at FROM lineitem""",
    "payloads": """
SELECT o_orderkey AS sent, concat('{"run_id": "r', CAST(o_custkey AS VARCHAR(20)), '", "dag_id": "', o_orderpriority, '", "run_at": "',
 CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T00:00:00", "results": [{"name": "total", "passed": ',
 CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END, ', "value": ', CAST(o_totalprice AS VARCHAR(30)),
 ', "expected": "greater_than(100000)"}, {"metric_name": "status", "is_anomaly": ',
 CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END, ', "current": 0}]',
 CASE WHEN o_orderkey % 3 = 0 THEN '}' WHEN o_totalprice > 100000 THEN ', "summary": {"total": 2, "passed": 2}}'
  ELSE ', "summary": {"total": 2, "passed": 1}}' END) AS payload FROM orders""",
    "checks": """
SELECT CAST(p_partkey AS INT) AS id, CAST(p_partkey % 26 AS INT) AS source_id, p_name AS name,
 CASE p_partkey % 6
  WHEN 0 THEN concat('SELECT COUNT(*) FROM source WHERE attr', CAST(p_size AS VARCHAR(20)), '_id IS NULL')
  WHEN 1 THEN concat('SELECT COUNT(*) - COUNT(DISTINCT attr', CAST(p_size AS VARCHAR(20)), ') FROM source')
  WHEN 2 THEN concat('SELECT AVG(amount) FROM source WHERE amount', CAST(p_size AS VARCHAR(20)), ' > 0')
  WHEN 3 THEN 'SELECT DATEDIFF(NOW(), MAX(created_at)) FROM source'
  WHEN 4 THEN 'SELECT COUNT(*) FROM source'
  ELSE concat('select sum(price) from source where size >= ', CAST(p_size AS VARCHAR(20))) END AS query,
 CASE p_partkey % 6 WHEN 0 THEN 'equals' WHEN 1 THEN 'equals' WHEN 2 THEN 'between' WHEN 3 THEN 'less_than'
  ELSE 'greater_than' END AS assert_type,
 CASE p_partkey % 6 WHEN 2 THEN '[1, 100]' WHEN 3 THEN '24' ELSE '0' END AS assert_value,
 CASE WHEN p_size % 3 = 0 THEN 'critical,keys' WHEN p_size % 3 = 1 THEN 'quality' ELSE '' END AS tags,
 CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS is_active FROM part""",
    "rule_events": """
SELECT CASE user_id % 9 WHEN 0 THEN 'customer_id' WHEN 1 THEN 'Order_ID' WHEN 2 THEN 'email' WHEN 3 THEN 'work_email'
  WHEN 4 THEN 'segment' WHEN 5 THEN ' full_name' WHEN 6 THEN 'created_at' WHEN 7 THEN 'update_day' ELSE 'phone' END AS column_name,
 CASE user_id % 9 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 6 THEN 'date' ELSE 'string' END AS column_type,
 CASE event_id % 4 WHEN 0 THEN 'not_null' WHEN 1 THEN CASE WHEN user_id % 9 < 2 THEN 'unique' ELSE 'accepted_values' END
  WHEN 2 THEN CASE WHEN user_id % 9 IN (2, 3, 8) THEN 'regex_match' ELSE 'not_empty' END ELSE 'custom' END AS rule_type,
 CASE WHEN user_id % 9 = 4 AND event_id % 3 < 2 THEN 'rejected' WHEN event_type IN ('click','view','error') THEN 'used'
  WHEN event_type = 'purchase' THEN 'accepted' ELSE 'rejected' END AS event,
 ts AS event_at, event_id FROM events""",
}

# Derived tables that other derived tables are made of.
_NEEDS = {
    "metric_history_mixed": ["metric_history"],
    "metric_current": ["metric_history"],
    "runs": ["run_results"],
}


def with_tables(names: list[str], body: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """The SQL text of ``body`` with the derived tables it reads as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({SQL[n].strip()})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body


_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The given tables by name, and the derived ones as plans over them."""

    GIVEN = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations",
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.GIVEN:
            path = f"{self.folder}/{name}.parquet"
            if path not in _SCHEMAS:  # footers are read once per table, not once per query
                _SCHEMAS[path] = self.spark.read.parquet(path).schema
            return self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        if name in ("run_results", "stored_results"):
            return self._over("lineitem", name)
        if name in ("events_gaps", "rule_events", "metric_history"):
            return self._over("events", name)
        return getattr(self, f"_{name}")()

    def _over(self, given: str, name: str) -> DataFrame:
        """A one-table derivation, in the SQL text both engines share."""
        text = SQL[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {given}", "FROM {given}")
        return self.spark.sql(text, given=self[given])

    def _contacts(self) -> DataFrame:
        return self._over("customer", "contacts")

    def _checks(self) -> DataFrame:
        return self._over("part", "checks")

    def _payloads(self) -> DataFrame:
        return self._over("orders", "payloads")

    def _sources(self) -> DataFrame:
        return self._over("nation", "sources")

    def _orders_dup(self) -> DataFrame:
        orders = self["orders"]
        return orders.unionByName(orders.where("o_orderkey % 100 = 0"))

    def _metric_history_mixed(self) -> DataFrame:
        ends = (
            F.when(F.col("name") == "click", "2024-01-04").when(F.col("name") == "error", "2024-01-10")
            .when(F.col("name") == "view", "2024-01-01").otherwise("2024-01-29")
        )
        return self["metric_history"].where(F.col("run_date") <= ends.cast("date"))

    def _metric_current(self) -> DataFrame:
        spiked = F.when(F.col("name").isin("error", "purchase"), F.col("value") * 10).otherwise(F.col("value"))
        return self["metric_history"].where("run_date = DATE '2024-01-30'").withColumn("value", spiked)

    def _runs(self) -> DataFrame:
        """Results are summed per run before the joins, so a run with many results is one row in them."""
        per_run = self["run_results"].groupBy("run_id").agg(
            F.count("passed").alias("total"), F.sum("passed").cast("bigint").alias("passed")
        )
        runs = self["orders"].join(
            self["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        ).select(
            F.col("o_orderkey").alias("run_id"), F.col("c_nationkey").alias("source_id"),
            F.col("o_orderpriority").alias("dag_id"), F.col("o_orderdate").alias("run_at"),
        )
        total, passed = F.coalesce("total", F.lit(0)), F.coalesce("passed", F.lit(0))
        return runs.join(per_run, "run_id", "left").select(
            "run_id", "source_id", "dag_id", "run_at", total.alias("total"), passed.alias("passed"),
            (total - passed).alias("failed"), F.when(total == passed, "pass").otherwise("fail").alias("status"),
        )
