"""All named queries of the engine."""

from . import case_queries, catalog_queries, engine_queries, enrichment_queries, lead_queries, product_queries, report_queries, source_queries, store_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "case_queries", "catalog_queries", "engine_queries", "enrichment_queries", "lead_queries", "product_queries", "report_queries", "source_queries", "store_queries"]
