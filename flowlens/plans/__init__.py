"""Registered queries."""

from . import behaviour_queries, case_queries, experiment_queries, graph_queries, metric_queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
