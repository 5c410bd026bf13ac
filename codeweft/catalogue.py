"""All core queries: importing this module registers them."""

from codeweft.plans import build_queries, case_queries, graph_queries, more_queries, report_queries, search_queries, skew_queries, stream_queries  # noqa: F401
from codeweft.registry import CORE

__all__ = ["CORE"]
