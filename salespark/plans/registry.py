"""Loads every catalogue module, so that all queries are registered."""

from salespark.plans import customer_queries, order_queries, report_queries, sales_queries, scale_queries, series_queries, text_queries  # noqa: F401
from salespark.plans.catalog import QUERIES, SQL  # noqa: F401
