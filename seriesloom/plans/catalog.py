"""All registered queries."""

from seriesloom.plans import (  # noqa: F401 - imported to register
    queries_blocks,
    queries_columns,
    queries_forecast,
    queries_joins,
    queries_models,
    queries_reports,
    queries_series,
    queries_stats,
)
from seriesloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
