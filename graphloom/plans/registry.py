"""The queries of the library by operator id, and the SQL that checks them."""

from __future__ import annotations

from . import graph_queries, lifecycle_queries, pipeline_queries, stream_queries

QUERIES: dict = graph_queries.QUERIES | lifecycle_queries.QUERIES | pipeline_queries.QUERIES | stream_queries.QUERIES
ORACLES: dict = graph_queries.ORACLES | lifecycle_queries.ORACLES | pipeline_queries.ORACLES | stream_queries.ORACLES
