"""Queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from . import annotate_queries, design_queries, dynamics_queries, figure_queries, graph_queries, report_queries, synthetic_queries, transfer_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
