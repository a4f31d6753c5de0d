"""Approximate numbers of orders from sketches that can be united over any days and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_BUCKETS = 14
#: Three standard deviations of an estimate, as a share: 1.04 / sqrt(2^14) each.
ERROR = 3 * 1.04 / (1 << LOG_BUCKETS) ** 0.5


def order_sketches(df: DataFrame, by: list[str]) -> DataFrame:
    """(by…, orders): one sketch of some kilobytes per group, whatever the number of rows; groups of null orders are empty."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col("order_id").cast("string"), LOG_BUCKETS).alias("orders"))


def approx_orders(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by…, orders): estimated distinct orders of each coarser group. An order in several sketches counts once."""
    united = F.hll_union_agg("orders", False)
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(united).alias("orders"))
