"""Importing this registers every query of the engine."""

from . import drawing_queries, graph_queries, layout_queries, shape_queries  # noqa: F401
