"""Queries over the analytics tables."""

from tidewell.plans import aggregates, extras, relational, retrieval, sql_functions, streams, understanding
from tidewell.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "extras", "relational", "retrieval", "sql_functions", "streams", "understanding"]
