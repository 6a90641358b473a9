"""Queries bound to the tables: views of them as graphs and snapshots, and one registered query for each operator."""

from . import dimension_queries, evidence_queries, flow_queries, graph_queries, report_queries, review_queries, scope_queries, snapshot_queries, structure_queries, text_queries, traversal_queries, walk_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dimension_queries", "evidence_queries", "flow_queries", "graph_queries", "report_queries", "review_queries", "scope_queries", "snapshot_queries", "structure_queries", "text_queries", "traversal_queries", "walk_queries"]
