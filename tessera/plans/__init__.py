"""The library's operators as queries over the shipped tables, with SQL for comparison."""

from tessera.plans import evaluation, relational, reports, retrieval, storage, training  # noqa: F401  these register their queries
from tessera.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
