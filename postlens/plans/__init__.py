"""Queries over the given tables; importing this package registers all of them."""

from postlens.plans import cluster_queries, feed_queries, ingest_queries, summary_queries, table_queries, text_queries, translation_queries  # noqa: F401
from postlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
