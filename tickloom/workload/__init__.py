"""Queries over the test tables, one per operator, each with its SQL form where SQL can say it."""

from tickloom.workload import factors, ledger, lookups, stores, streams, trades  # noqa: F401
from tickloom.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
