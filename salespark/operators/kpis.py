"""KPIs, rankings and revenue over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.functions.numeric import change_pct, exact_sum, ratio, share_pct
from salespark.operators.periods import CURRENT_TAG, PREVIOUS_TAG, SalesFilters, tag_periods
from salespark.operators.schema import order_count
from salespark.operators.series import daily_series, fill_gaps

# Limits of the ranking and monthly queries.
TOP_PRODUCTS = 8
MONTHS_SHOWN = 36


def measures(columns: list[str]) -> list[Column]:
    """Aggregates behind every KPI. Profit is null as soon as one row lacks its cost."""
    everywhere = F.count("cost") == F.count(F.lit(1))
    return [
        exact_sum("revenue").alias("revenue"),
        F.when(everywhere, exact_sum("profit")).alias("profit"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
        order_count(columns).alias("orders"),
        F.count(F.lit(1)).alias("lines"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Margin (0 without revenue) and average ticket from the measures."""
    margin = F.when(F.col("revenue") == 0, 0.0).otherwise(F.col("profit") / F.col("revenue") * 100)
    return df.withColumns(
        {
            "margin_pct": F.when(F.col("profit").isNotNull(), margin),
            "avg_ticket": F.coalesce(ratio("revenue", "orders"), F.lit(0.0)),
        }
    )


def kpis_by(df: DataFrame, *keys: str) -> DataFrame:
    """KPIs of every group (or one row for the whole table)."""
    return with_rates(df.groupBy(*keys).agg(*measures(df.columns)))


def leader(name: str, revenue: str = "revenue", where: Column | None = None) -> Column:
    """Aggregate: the named member with most revenue, the first name on ties; members without a name don't lead."""
    named = F.col(name).isNotNull() if where is None else F.col(name).isNotNull() & where
    return F.min_by(name, F.when(named, F.struct(-F.col(revenue), F.col(name))))


def sales_kpis(df: DataFrame, filters: SalesFilters, dates: DataFrame | None = None) -> DataFrame:
    """One row with the KPIs of the selected period and growth against the comparison period.

    One scan: grouping sets give both periods' totals and the members of category and region; the row is read
    from that small table.
    """
    tagged = tag_periods(df, filters, dates)
    sets = [["period"], ["period", "category"], ["period", "region"]]
    table = with_rates(
        tagged.groupingSets(sets, "period", "category", "region").agg(
            *measures(df.columns), F.grouping("category").alias("no_category"), F.grouping("region").alias("no_region")
        )
    )
    is_now, is_before = F.col("period") == CURRENT_TAG, F.col("period") == PREVIOUS_TAG
    total = (F.col("no_category") == 1) & (F.col("no_region") == 1)
    by_category, by_region = is_now & (F.col("no_category") == 0), is_now & (F.col("no_region") == 0)
    fields = ("revenue", "profit", "margin_pct", "units", "orders", "avg_ticket", "lines")
    row = table.agg(
        *[F.max(F.when(total & is_now, F.col(name))).alias(name) for name in fields],
        F.max(F.when(total & is_before, F.col("revenue"))).alias("previous_revenue"),
        leader("category", where=by_category).alias("top_category"),
        F.max(F.when(by_category & F.col("category").isNotNull(), F.col("revenue"))).alias("top_category_revenue"),
        leader("region", where=by_region).alias("top_region"),
    )
    empty = F.coalesce(F.col("lines"), F.lit(0)) == 0
    growth = F.when(empty, F.when(F.col("previous_revenue") > 0, -100.0)).otherwise(
        change_pct("revenue", "previous_revenue")
    )

    def or_zero(name: str, zero) -> Column:
        return F.when(empty, F.lit(zero)).otherwise(F.col(name)).alias(name)

    return row.select(
        or_zero("revenue", 0.0),
        or_zero("profit", 0.0),
        or_zero("margin_pct", 0.0),
        or_zero("units", 0),
        or_zero("orders", 0),
        or_zero("avg_ticket", 0.0),
        F.coalesce("top_category", F.lit("N/A")).alias("top_category"),
        F.coalesce("top_category_revenue", F.lit(0.0)).alias("top_category_revenue"),
        F.coalesce("top_region", F.lit("N/A")).alias("top_region"),
        growth.alias("growth_pct"),
    )


def revenue_by(df: DataFrame, column: str) -> DataFrame:
    """Revenue per member, largest first."""
    grouped = df.where(F.col(column).isNotNull()).groupBy(column).agg(exact_sum("revenue").alias("revenue"))
    return grouped.orderBy(F.desc("revenue"), column)


def revenue_shares(df: DataFrame, column: str) -> DataFrame:
    """Revenue per member with its % of the filtered total.

    The total is a scalar subquery over the same grouping rather than a window over all groups.
    """
    grouped = df.where(F.col(column).isNotNull()).groupBy(column).agg(exact_sum("revenue").alias("revenue"))
    total = grouped.agg(exact_sum("revenue").alias("total")).scalar()
    return grouped.select(column, "revenue", share_pct(F.col("revenue"), total).alias("share_pct"))


def ranking(df: DataFrame, column: str, limit: int | None = 5, descending: bool = True) -> DataFrame:
    """Best or worst members with their share; all of them without a limit."""
    order = F.desc("revenue") if descending else F.asc("revenue")
    rows = revenue_shares(df, column).orderBy(order, column)
    return rows if limit is None else rows.limit(limit)


def top_products(df: DataFrame, limit: int = TOP_PRODUCTS) -> DataFrame:
    return revenue_by(df, "product").limit(limit)


def _month(column: str = "date") -> Column:
    return F.to_date(F.trunc(F.to_date(column), "month"))


def monthly_revenue(df: DataFrame, last_months: int | None = MONTHS_SHOWN) -> DataFrame:
    """Revenue of the months with sales, the newest `last_months` of them."""
    monthly = df.groupBy(_month().alias("month")).agg(exact_sum("revenue").alias("revenue"))
    return monthly if last_months is None else monthly.orderBy(F.desc("month")).limit(last_months)


def best_month(df: DataFrame) -> DataFrame:
    """The month with most revenue (the earliest on ties)."""
    monthly = monthly_revenue(df, None)
    first = F.struct(-F.col("revenue"), F.col("month"))
    return monthly.agg(F.min_by("month", first).alias("month"), F.max("revenue").alias("revenue"))


def revenue_over_time(df: DataFrame, granularity: str = "D") -> DataFrame:
    """Revenue and profit per day (D), Monday week (W) or month (M); empty buckets are zero."""
    unit = {"D": "day", "W": "week", "M": "month"}[granularity]
    bucket = F.to_date("date") if unit == "day" else F.to_date(F.trunc(F.to_date("date"), unit))
    grouped = df.groupBy(F.lit("total").alias("series"), bucket.alias("ds")).agg(
        exact_sum("revenue").alias("revenue"), exact_sum("profit").alias("profit")
    )
    return fill_gaps(grouped, ["revenue", "profit"], step=unit).drop("series")


def kpi_comparison(df: DataFrame, filters: SalesFilters, dates: DataFrame | None = None) -> DataFrame:
    """One row per KPI: now, before, variation (points for the margin) and the card's delta.

    The delta divides by the absolute earlier value; a delta that rounds to 0.0 is neutral.
    """
    tagged = tag_periods(df, filters, dates)
    by_period = kpis_by(tagged, "period")
    # The rows of the comparison table.
    names = [
        ("Receita", "revenue"),
        ("Lucro", "profit"),
        ("Margem", "margin_pct"),
        ("Pedidos", "orders"),
        ("Unidades", "units"),
        ("Ticket médio", "avg_ticket"),
    ]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
            for i, (label, c) in enumerate(names)
        ]
    )
    cells = by_period.select("period", F.inline(cells))
    wide = cells.groupBy("position", "metric").agg(
        F.max(F.when(F.col("period") == CURRENT_TAG, F.col("value"))).alias("current"),
        F.max(F.when(F.col("period") == PREVIOUS_TAG, F.col("value"))).alias("previous"),
    )
    difference = F.col("current") - F.col("previous")
    points = F.col("metric") == "Margem"
    pct = difference / F.nullif(F.col("previous"), F.lit(0.0)) * 100
    card = difference / F.nullif(F.abs("previous"), F.lit(0.0)) * 100
    return wide.withColumns(
        {
            "change": F.when(points, difference).otherwise(pct),
            "card_delta_pct": F.when(F.round(card, 1) == 0, 0.0).otherwise(card),
            "card_neutral": F.round(card, 1) == 0,
        }
    ).orderBy("position")


def goal_progress(df: DataFrame, goal: float) -> DataFrame:
    """Revenue against a goal: progress %, bar fill, and what is left or above."""
    total = df.agg(exact_sum("revenue").alias("revenue"))
    progress = F.col("revenue") / F.lit(float(goal))
    return total.select(
        "revenue",
        F.lit(float(goal)).alias("goal"),
        (progress * 100).alias("progress_pct"),
        F.least(progress, F.lit(1.0)).alias("bar"),
        (progress >= 1).alias("reached"),
        F.abs(F.col("revenue") - float(goal)).alias("difference"),
    )


def growth_between_averages(df: DataFrame, year: int, first_month: int, last_month: int) -> DataFrame:
    """Mean monthly revenue of the same months in `year` and the year before (months without sales are zero)."""
    months = last_month - first_month + 1

    def inside(of: int) -> Column:
        """A date range, so that files and row groups outside it are skipped."""
        end = date(of + last_month // 12, last_month % 12 + 1, 1)
        return (F.col("date") >= F.lit(str(date(of, first_month, 1))).cast("timestamp_ntz")) & (F.col("date") < F.lit(str(end)).cast("timestamp_ntz"))

    sums = df.where(inside(year) | inside(year - 1)).agg(
        exact_sum(F.when(inside(year), F.col("revenue"))).alias("now"),
        exact_sum(F.when(inside(year - 1), F.col("revenue"))).alias("before"),
    )
    return sums.select(
        (F.col("now") / months).alias("mean_now"),
        (F.col("before") / months).alias("mean_before"),
        change_pct("now", "before").alias("growth_pct"),
    )


def yearly_category_share(df: DataFrame) -> DataFrame:
    """Share of each category within its year (the window runs over categories, not rows)."""
    grouped = df.groupBy(F.year("date").alias("year"), "category").agg(exact_sum("revenue").alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy("year"))
    return grouped.select("year", "category", "revenue", share_pct(F.col("revenue"), total).alias("share_pct"))


def repeat_customers(df: DataFrame) -> DataFrame:
    """Customers per number of orders, each with the overall share of customers who came back."""
    per_customer = df.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
    per_customer = per_customer.agg(order_count(df.columns).alias("frequency"))
    histogram = per_customer.groupBy("frequency").agg(F.count(F.lit(1)).alias("customers"))
    back = histogram.agg(
        (F.sum(F.when(F.col("frequency") > 1, F.col("customers")).otherwise(0)) / F.sum("customers") * 100).alias("pct")
    )
    return histogram.select("frequency", "customers", back.scalar().alias("repeat_pct"))


def frequency_top(df: DataFrame, limit: int = 4) -> DataFrame:
    """The most common purchase counts."""
    return repeat_customers(df).orderBy(F.desc("customers"), "frequency").limit(limit)


def window_edges(daily: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Sum of a daily series inside each named date window, in one pass."""
    parts = [F.struct(F.lit(n).alias("window"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
             for n, (a, b) in windows.items()]
    rows = daily.select("ds", "y", F.inline(F.array(*parts)))
    inside = F.col("ds").between(F.col("a"), F.col("b"))
    return rows.groupBy("window").agg(
        F.sum(F.when(inside, F.col("y")).otherwise(0.0)).alias("total"), F.count_if(inside).alias("days")
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: date bounds, members of the filter dimensions, and what the base allows to compute."""
    has_customer = F.count("customer_id") > 0 if "customer_id" in df.columns else F.lit(False)
    return df.agg(
        F.to_date(F.min("date")).alias("first_day"),
        F.to_date(F.max("date")).alias("last_day"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("region")).alias("regions"),
        (F.count("cost") == F.count(F.lit(1))).alias("has_cost"),
        has_customer.alias("has_customers"),
    )


def daily_revenue(df: DataFrame) -> DataFrame:
    return daily_series(df, "revenue")
