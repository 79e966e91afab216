"""Named queries over the driver tables, each with the SQL that states its result independently."""

from . import display_queries, payload_queries, reconcile_queries, report_queries, search_queries, stream_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
