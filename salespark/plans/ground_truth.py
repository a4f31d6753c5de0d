"""Reference answers to the question set, computed on the base itself."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum, ratio
from salespark.operators import anomalies, customers, forecasting, kpis, periods, series, variance


def _between(first: str, last: str) -> Column:
    return F.col("ds").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def day_cube(df: DataFrame) -> DataFrame:
    """Revenue and profit per day, category and region: bounded by calendar and dimensions, one scan."""
    return df.groupBy(F.to_date("date").alias("ds"), "category", "region").agg(
        exact_sum("revenue").alias("revenue"), exact_sum("profit").alias("profit")
    )


def numbers(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """(id, label, value): answers that are numbers.

    `dims` names the members asked about: category, other_category, region and region_profit.
    All revenue answers come from one pass over the day cube, the order counts from the daily series.
    """
    cube = day_cube(df)
    daily = series.daily_series(df.select("date", "order_id"), "orders")
    is_first, is_other = (F.col("category") == dims[k] for k in ("category", "other_category"))
    y1999, y2000 = _between("1999-01-01", "1999-12-31"), _between("2000-01-01", "2000-12-31")
    q4, q3 = _between("2000-10-01", "2000-12-31"), _between("2000-07-01", "2000-09-30")
    newest = df.agg(F.to_date(F.max("date")).alias("last")).scalar()
    cube = cube.select("*", newest.alias("last"))

    def revenue(where: Column) -> Column:
        return exact_sum(F.when(where, F.col("revenue")))

    def profit(where: Column) -> Column:
        return exact_sum(F.when(where, F.col("profit")))

    sums = cube.agg(
        F.struct(
            revenue(y1999).alias("receita_1999"),
            (ratio(profit(_between("1998-01-01", "1998-12-31")), revenue(_between("1998-01-01", "1998-12-31"))) * 100).alias("margem_1998"),
            revenue(q4).alias("receita_q4_2000"),
            revenue(q3).alias("receita_q3_2000"),
            revenue(y2000 & is_first).alias("categoria_2000"),
            revenue(y2000 & is_other).alias("outra_categoria_2000"),
            revenue(_between("1999-01-01", "1999-06-30") & (F.col("region") == dims["region"])).alias("regiao_1s_1999"),
            profit(y1999 & (F.col("region") == dims["region_profit"])).alias("lucro_regiao_1999"),
            revenue(_between("2000-03-01", "2000-03-31")).alias("marco_2000"),
            revenue(F.col("ds") == F.date_sub("last", 1)).alias("ontem"),
        ).alias("s")
    ).scalar()
    counts = daily.agg(
        F.sum(F.when(y2000, F.col("y"))).alias("pedidos_2000"), F.sum(F.when(q4, F.col("y"))).alias("pedidos_q4_2000")
    )
    row = counts.select("*", sums.alias("s")).select("*", "s.*").drop("s")
    growth = (ratio("receita_q4_2000", "receita_q3_2000") - 1) * 100
    answers = {
        "receita_1999": F.col("receita_1999"),
        "pedidos_2000": F.col("pedidos_2000"),
        "margem_1998": F.col("margem_1998"),
        "ticket_q4_2000": ratio("receita_q4_2000", "pedidos_q4_2000"),
        "categoria_2000": F.col("categoria_2000"),
        "regiao_1s_1999": F.col("regiao_1s_1999"),
        "lucro_regiao_1999": F.col("lucro_regiao_1999"),
        "outra_categoria_2000": F.col("outra_categoria_2000"),
        "marco_2000": F.col("marco_2000"),
        "ontem": F.col("ontem"),
        "crescimento_q4_2000": growth,
    }
    cells = F.array(*[F.struct(F.lit(k).alias("id"), v.alias("value")) for k, v in answers.items()])
    return row.select(F.inline(cells))


def why_changed(df: DataFrame) -> DataFrame:
    """Total change and volume effect of the last quarter against the one before it."""
    first, last = date(2000, 10, 1), date(2000, 12, 31)
    current, previous = periods.between_days(df, first, last), periods.between_days(df, date(2000, 7, 1), date(2000, 9, 30))
    by_segment = variance.bridge_by_segment(variance.tag_pair(current, previous))
    return variance.bridge_totals(by_segment).select("total_change", "volume_effect")


def rankings(df: DataFrame) -> DataFrame:
    """(id, position, name): lowest region, top category, top three products, best month."""

    def top(first: str, last: str, column: str, id: str, limit: int = 1, descending: bool = True) -> DataFrame:
        rows = periods.between_days(df, date.fromisoformat(first), date.fromisoformat(last))
        listed = kpis.ranking(rows, column, limit, descending)
        items = F.array_sort(F.collect_list(F.struct((F.lit(-1 if descending else 1) * F.col("revenue")).alias("o"), F.col(column).alias("name"))))
        return listed.agg(items.alias("items")).select(
            F.lit(id).alias("id"), F.posexplode("items").alias("position", "item")
        ).select("id", (F.col("position") + 1).alias("position"), "item.name")

    best = kpis.best_month(periods.between_days(df, date(1999, 1, 1), date(1999, 12, 31)))
    month = best.select(F.lit("melhor_mes_1999").alias("id"), F.lit(1).alias("position"), F.date_format("month", "MM/yyyy").alias("name"))
    return (
        top("2000-01-01", "2000-12-31", "region", "menor_regiao_2000", descending=False)
        .unionByName(top("1999-01-01", "1999-12-31", "category", "maior_categoria_1999"))
        .unionByName(top("2000-01-01", "2000-12-31", "product", "top3_produtos_2000", 3))
        .unionByName(month)
    )


def customer_answers(df: DataFrame) -> DataFrame:
    """(champions, top_segment): size of the best segment, and the segment with most revenue."""
    found = customers.segment_customers(df, with_clusters=False).segments
    return found.agg(
        F.max(F.when(F.col("segment") == "Campeões", F.col("customers"))).alias("champions"),
        F.min_by("segment", F.struct(-F.col("revenue"), F.col("segment"))).alias("top_segment"),
    )


def unusual_days(df: DataFrame, year: int) -> DataFrame:
    """Unusual order days of a year with their direction."""
    found = anomalies.detect_anomalies(series.daily_series(df, "orders"))
    return found.where(F.year("ds") == year).select("ds", "kind", "deviation_pct")


def next_month_total(df: DataFrame) -> DataFrame:
    return forecasting.forecast(series.daily_series(df), 30).totals()

