"""Every registered query with its DuckDB counterpart."""

from . import graph_queries, record_queries, retrieval_queries, text_queries, world_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES  # noqa: F401
