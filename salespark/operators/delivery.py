"""Delivery punctuality and review scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Right-closed delay bins (upper limit, label); the first and the last are open.
DELAY_BINS = [
    (-10, "10+ dias adiantado"),
    (-5, "5–10 adiantado"),
    (0, "0–5 adiantado"),
    (5, "1–5 atrasado"),
    (10, "6–10 atrasado"),
    (20, "11–20 atrasado"),
    (None, "20+ atrasado"),
]
BAD_SCORE = 2


def _second_of_day(moment: Column) -> Column:
    return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.extract(F.lit("SECOND"), moment)


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete days between two moments, rounded down (also when negative); no time zone is involved."""
    unfinished = (_second_of_day(later) < _second_of_day(earlier)).cast("int")
    return F.datediff(later, earlier) - unfinished


def delivered_orders(orders: DataFrame, delivered_status: str = "delivered") -> DataFrame:
    """Delivered and reviewed orders with delay, days to delivery and late flag."""
    known = F.col("delivered_at").isNotNull() & F.col("review_score").isNotNull()
    rows = orders.where((F.col("status") == delivered_status) & known)
    rows = rows.withColumns(
        {
            "delay": whole_days(F.col("delivered_at"), F.col("estimated_at")),
            "days": whole_days(F.col("delivered_at"), F.col("purchased_at")),
        }
    )
    return rows.withColumn("late", F.col("delay") > 0)


def late_summary(delivered: DataFrame) -> DataFrame:
    """Orders, mean score and % of bad scores for late and punctual orders, with the overall late %."""
    summary = delivered.groupBy("late").agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg("review_score").alias("mean_score"),
        (F.avg((F.col("review_score") <= BAD_SCORE).cast("double")) * 100).alias("bad_pct"),
    )
    totals = summary.agg(
        (F.sum(F.when(F.col("late"), F.col("orders")).otherwise(0)) / F.sum("orders") * 100).alias("late_pct")
    )
    return summary.select("*", totals.scalar().alias("late_pct"))


def delay_bin(delay: Column) -> tuple[Column, Column]:
    """(position, label) of the right-closed bin; null for an unknown delay only."""
    last = len(DELAY_BINS) - 1
    position, label = F.lit(last), F.lit(DELAY_BINS[last][1])
    for i, (upper, text) in reversed(list(enumerate(DELAY_BINS[:last]))):
        position, label = F.when(delay <= upper, i).otherwise(position), F.when(delay <= upper, text).otherwise(label)
    return F.when(delay.isNotNull(), position), F.when(delay.isNotNull(), label)


def score_by_delay(delivered: DataFrame) -> DataFrame:
    """Mean score per delay bin; only bins with orders."""
    position, label = delay_bin(F.col("delay"))
    binned = delivered.select("review_score", position.alias("position"), label.alias("bin"))
    kept = binned.where(F.col("position").isNotNull()).groupBy("position", "bin")
    return kept.agg(F.avg("review_score").alias("mean_score"), F.count(F.lit(1)).alias("orders")).orderBy("position")


def region_service(delivered: DataFrame) -> DataFrame:
    """Per region: orders, % late, mean days to delivery, freight and score; most late first."""
    table = delivered.where(F.col("region").isNotNull()).groupBy("region").agg(
        F.count(F.lit(1)).alias("orders"),
        (F.avg(F.col("late").cast("double")) * 100).alias("late_pct"),
        F.avg("days").alias("mean_days"),
        F.avg("freight").alias("mean_freight"),
        F.avg("review_score").alias("mean_score"),
    )
    return table.orderBy(F.desc("late_pct"), "region")
