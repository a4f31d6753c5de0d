"""Daily series with every calendar day, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum, ratio
from salespark.operators.schema import order_count

SEASON = 7
WHOLE = "total"
SPARKLINE_DAYS = 31


def series_key(keys: Sequence[str]) -> Column:
    """Name of a series: the key values joined, or one name for the whole base."""
    return (F.concat_ws(" | ", *keys) if keys else F.lit(WHOLE)).alias("series")


def fill_gaps(
    df: DataFrame, values: list[str], end: Column | None = None, step: str = "day", filler: float = 0.0
) -> DataFrame:
    """One row per bucket from a series' first to its last bucket (or to `end`), missing ones as zero.

    Every row is stretched up to the next one of its series, so no calendar table and no join is
    needed. A window partition is one aggregated series: at most one row per calendar bucket.
    """
    after = F.lead("ds").over(Window.partitionBy("series").orderBy("ds"))
    back = {"day": F.date_sub(after, 1), "week": F.date_sub(after, 7), "month": F.add_months(after, -1)}[step]
    last = F.col("ds") if end is None else F.greatest(F.col("ds"), F.to_date(end))
    stretched = df.withColumn("_stop", F.coalesce(back, last))
    span = F.sequence("ds", "_stop", F.expr(f"INTERVAL 1 {step.upper()}"))
    rows = stretched.select("series", *values, F.posexplode(span).alias("_i", "_ds"))
    filled = [F.when(F.col("_i") == 0, F.col(v)).otherwise(F.lit(filler)).alias(v) for v in values]
    return rows.select("series", F.col("_ds").alias("ds"), *filled)


def daily_series(
    df: DataFrame, metric: str = "revenue", keys: Sequence[str] = (), end: date | Column | None = None
) -> DataFrame:
    """(series, ds, y): daily revenue or distinct orders, zero on days without sales.

    `end` carries a series on to the end of the base when its segment stopped selling earlier.
    """
    value = exact_sum("revenue") if metric == "revenue" else order_count(df.columns).cast("double")
    daily = df.groupBy(series_key(keys), F.to_date("date").alias("ds")).agg(value.alias("y"))
    end = F.lit(end) if isinstance(end, date) else end
    return fill_gaps(daily, ["y"], end)


def days_with_sales(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(series, ds, y): daily revenue without the empty days, as the trend tests use it."""
    return df.groupBy(series_key(keys), F.to_date("date").alias("ds")).agg(exact_sum("revenue").alias("y"))


def moving_average(daily: DataFrame, days: int = SEASON) -> DataFrame:
    """Mean of the last `days` calendar days (fewer at the start)."""
    recent = Window.partitionBy("series").orderBy("ds").rowsBetween(-(days - 1), 0)
    return daily.withColumn("moving_avg", F.avg("y").over(recent))


def with_positions(daily: DataFrame) -> DataFrame:
    """Add `pos` (0-based day of the series) and `n` (its length)."""
    ordered = Window.partitionBy("series").orderBy("ds")
    return daily.withColumns(
        {"pos": F.row_number().over(ordered) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("series"))}
    )


def sparkline(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue, orders and ticket per day for up to 31 days, otherwise per complete Monday week."""
    daily = df.groupBy(series_key(keys), F.to_date("date").alias("ds")).agg(
        exact_sum("revenue").alias("revenue"), order_count(df.columns).cast("double").alias("orders")
    )
    daily = fill_gaps(daily, ["revenue", "orders"])
    short = F.count(F.lit(1)).over(Window.partitionBy("series")) <= SPARKLINE_DAYS
    bucketed = daily.withColumn("short", short)
    bucket = F.when(F.col("short"), F.col("ds")).otherwise(F.to_date(F.trunc("ds", "week")))
    points = bucketed.groupBy("series", "short", bucket.alias("bucket")).agg(
        F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("days")
    )
    complete = points.where(F.col("short") | (F.col("days") == 7))
    return complete.select(
        "series",
        "bucket",
        "revenue",
        "orders",
        F.coalesce(ratio("revenue", "orders"), F.lit(0.0)).alias("ticket"),
    )


def monthly_seasonality(daily: DataFrame) -> DataFrame:
    """(series, month, seasonal_index): mean day of the month against the mean of its year.

    Only years with all twelve months count, unless there is none.
    """
    monthly = daily.groupBy("series", F.year("ds").alias("year"), F.month("ds").alias("month"))
    monthly = monthly.agg(F.avg("y").alias("level"))
    year, whole = Window.partitionBy("series", "year"), Window.partitionBy("series")
    monthly = monthly.withColumn("complete", F.count(F.lit(1)).over(year) == 12)
    monthly = monthly.withColumn("any_complete", F.bool_or("complete").over(whole))
    kept = monthly.where(F.col("complete") | ~F.col("any_complete"))
    index = ratio(F.col("level"), F.avg("level").over(year))
    scaled = kept.select("series", "month", index.alias("index")).where(F.col("index").isNotNull())
    return scaled.groupBy("series", "month").agg(F.avg("index").alias("seasonal_index"))


def weekday_hour_grid(df: DataFrame, moment: str = "date", code: str = "order_id") -> DataFrame:
    """Distinct orders per weekday (rows, 0 = Monday) and hour (columns h0…h23), zero when empty.

    The distinct count is finished before the pivot, which then handles at most 168 rows.
    """
    counts = df.groupBy(F.weekday(moment).alias("weekday"), F.hour(moment).alias("hour"))
    counts = counts.agg(F.count_distinct(code).alias("orders"))
    grid = counts.groupBy("weekday").pivot("hour", list(range(24))).agg(F.sum("orders"))
    cells = [F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h}") for h in range(24)]
    return grid.select("weekday", *cells)
