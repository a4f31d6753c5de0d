"""Periods, fair comparison windows, and segment filters."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIOUS, LAST_YEAR = "anterior", "ano_anterior"
# Texts of the two comparison modes and the share of days a comparison may lack.
COMPARISON_LABELS = {
    PREVIOUS: "período anterior de mesma duração",
    LAST_YEAR: "mesmo período do ano anterior",
}
MAX_MISSING_SHARE = 0.05
PRESET_DAYS = {"30d": 30, "90d": 90, "12m": 365, "tudo": None}

CURRENT_TAG, PREVIOUS_TAG = "current", "previous"


@dataclass(frozen=True)
class SalesFilters:
    """What to look at; empty lists mean no filter."""

    start: date
    end: date
    categories: tuple[str, ...] = field(default_factory=tuple)
    regions: tuple[str, ...] = field(default_factory=tuple)
    comparison: str = PREVIOUS

    @property
    def period_label(self) -> str:
        return f"{self.start:%d/%m/%Y} a {self.end:%d/%m/%Y}"

    @property
    def comparison_label(self) -> str:
        return COMPARISON_LABELS[self.comparison]

    @property
    def window(self) -> tuple[date, date]:
        return comparison_window(self.start, self.end, self.comparison)


def _one_year_before(day: date) -> date:
    last = calendar.monthrange(day.year - 1, day.month)[1]
    return day.replace(year=day.year - 1, day=min(day.day, last))


def comparison_window(start: date, end: date, mode: str = PREVIOUS) -> tuple[date, date]:
    """Whole days to compare with; a month's end stays a month's end one year earlier."""
    if mode == LAST_YEAR:
        first, last = _one_year_before(start), _one_year_before(end)
        if end.day == calendar.monthrange(end.year, end.month)[1]:
            last = last.replace(day=calendar.monthrange(last.year, last.month)[1])
        return first, last
    last = start - timedelta(days=1)
    return last - (end - start), last


def comparison_window_columns(start: Column, end: Column, mode: str = PREVIOUS) -> tuple[Column, Column]:
    """The same windows for start and end columns."""
    if mode == LAST_YEAR:
        moved = F.add_months(end, -12)
        return F.add_months(start, -12), F.when(end == F.last_day(end), F.last_day(moved)).otherwise(moved)
    last = F.date_sub(start, 1)
    return F.date_sub(last, F.datediff(end, start)), last


def window_is_covered(start: Column, end: Column, data_start: Column) -> Column:
    """Does the data reach back far enough, missing at most 5% of the window's days?"""
    missing = F.datediff(F.to_date(data_start), start)
    return missing <= (F.datediff(end, start) + 1) * MAX_MISSING_SHARE


def in_days(column: Column, start: date, end: date) -> Column:
    """Whole days from start to end, written as a half-open range that file statistics can prune."""
    return (column >= F.lit(start).cast("timestamp_ntz")) & (
        column < F.lit(end + timedelta(days=1)).cast("timestamp_ntz")
    )


def between_days(df: DataFrame, start: date, end: date) -> DataFrame:
    return df.where(in_days(F.col("date"), start, end))


def apply_segments(df: DataFrame, filters: SalesFilters) -> DataFrame:
    if filters.categories:
        df = df.where(F.col("category").isin(list(filters.categories)))
    if filters.regions:
        df = df.where(F.col("region").isin(list(filters.regions)))
    return df


def data_start(df: DataFrame) -> Column:
    """First date of the unfiltered base, computed inside the job that uses it."""
    return df.agg(F.min("date").alias("first")).scalar()


def comparison_is_complete(df: DataFrame, filters: SalesFilters) -> Column:
    start, end = filters.window
    return F.coalesce(window_is_covered(F.lit(start), F.lit(end), data_start(df)), F.lit(False))


def tag_periods(df: DataFrame, filters: SalesFilters, dates: DataFrame | None = None) -> DataFrame:
    """Rows of both periods in one scan, with `period` = current or previous.

    The previous rows are left out when the base does not cover their window. `dates` is a cheaper
    table with the base's `date` column for that check (default: `df`).
    """
    current = in_days(F.col("date"), filters.start, filters.end)
    earlier = in_days(F.col("date"), *filters.window)
    complete = comparison_is_complete(dates if dates is not None else df, filters)
    rows = apply_segments(df.where(current | earlier), filters)
    tagged = rows.withColumn("period", F.when(current, CURRENT_TAG).when(complete, PREVIOUS_TAG))
    return tagged.where(F.col("period").isNotNull())


def filter_sales(df: DataFrame, filters: SalesFilters, dates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected period, comparison period), both with the same segment filters."""
    current = apply_segments(between_days(df, filters.start, filters.end), filters)
    earlier = apply_segments(between_days(df, *filters.window), filters)
    return current, earlier.where(comparison_is_complete(dates if dates is not None else df, filters))


def previous_period(df: DataFrame, start: date, end: date) -> DataFrame:
    return between_days(df, *comparison_window(start, end, PREVIOUS))


def same_period_last_year(df: DataFrame, start: date, end: date) -> DataFrame:
    return between_days(df, *comparison_window(start, end, LAST_YEAR))


def preset_ranges(df: DataFrame) -> DataFrame:
    """First and last day of every preset (last N days, clipped to the data)."""
    bounds = df.agg(F.to_date(F.min("date")).alias("first"), F.to_date(F.max("date")).alias("last"))
    presets = F.array(
        *[F.struct(F.lit(k).alias("preset"), F.lit(n).cast("int").alias("days")) for k, n in PRESET_DAYS.items()]
    )
    rows = bounds.select("first", "last", F.inline(presets))
    start = F.when(F.col("days").isNull(), F.col("first")).otherwise(
        F.greatest(F.col("first"), F.date_sub(F.col("last"), F.col("days") - 1))
    )
    return rows.select("preset", start.alias("start"), F.col("last").alias("end"))


def segment_options(df: DataFrame, column: str) -> DataFrame:
    """Members of a dimension, sorted."""
    return df.select(column).distinct().orderBy(column)


def time_parts(df: DataFrame) -> DataFrame:
    """Weekday (0 = Monday), hour, month number and month start of every row."""
    return df.withColumns(
        {
            "weekday": F.weekday("date"),
            "hour": F.hour("date"),
            "month": F.month("date"),
            "month_start": F.to_date(F.date_trunc("month", F.col("date").cast("timestamp"))),
        }
    )


def preview(df: DataFrame, rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """First rows, and one row with the table's shape."""
    shape = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    return df.limit(rows), shape


def detail_rows(df: DataFrame) -> DataFrame:
    """Rows newest first."""
    return df.orderBy(F.desc("date"))
