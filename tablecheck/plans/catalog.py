"""All registered queries."""

from tablecheck.plans import check_queries, document_queries, history_queries, result_queries, table_queries  # noqa: F401
from tablecheck.plans.registry import ORACLES, QUERIES  # noqa: F401
