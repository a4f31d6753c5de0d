"""The catalogue of checked queries: a Spark query and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The flat sales table of `sources.star.sales`, with money as exact decimals.
SALES_CTE = """sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS TIMESTAMP) AS date, p_type AS category,
         r_name AS region, p_name AS product, CAST(l_quantity AS BIGINT) AS units,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS revenue,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.65 AS DECIMAL(18,2)) AS cost,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))
           - CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.65 AS DECIMAL(18,2)) AS profit,
         printf('C%05d', o_custkey) AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

# Gap-filled daily revenue and orders of the whole base.
DAILY_CTE = (
    SALES_CTE
    + """, days AS (
  SELECT CAST(date AS DATE) AS ds, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
  FROM sales GROUP BY 1),
daily AS (
  SELECT c.ds, coalesce(d.revenue, 0.0) AS y, CAST(coalesce(d.orders, 0) AS DOUBLE) AS orders
  FROM (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM days), (SELECT max(ds) FROM days),
                INTERVAL 1 DAY)) AS DATE) AS ds) c LEFT JOIN days d USING (ds))"""
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def with_sales(body: str, cte: str = SALES_CTE) -> str:
    return f"WITH {cte} {body}" if not body.lstrip().startswith(",") else f"WITH {cte}{body}"


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles rounded for comparison; `special` gives some columns their own digits."""

    def one(name: str, kind: str) -> Column:
        return F.round(name, special.get(name, digits)).alias(name) if kind == "double" else F.col(name)

    return df.select(*[one(c, t) for c, t in df.dtypes])
