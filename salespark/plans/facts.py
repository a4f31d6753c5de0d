"""The facts of a period, one row per group: everything the report and its text lines cite.

With `by` (for example region) one job produces the facts of every member at once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespark.functions import formatting as fmt
from salespark.operators import anomalies, customers, forecasting, kpis, periods, series, trends, variance
from salespark.operators.periods import CURRENT_TAG, PREVIOUS_TAG, SalesFilters
from salespark.session import stage

# Horizon of the cited forecast, anomalies cited, segments cited.
FORECAST_HORIZON = 30
MAX_ANOMALIES = 5
CITED_SEGMENTS = ("Campeões", "Em risco", "Perdidos")


def _ranked(rows: DataFrame, name: str, alias: str) -> DataFrame:
    """(series, alias): members of a reporting dimension with revenue, largest first."""
    grouped = rows.where(F.col(name).isNotNull()).groupBy("series", name).agg(
        kpis.exact_sum("revenue").alias("revenue")
    )
    items = F.array_sort(F.collect_list(F.struct((-F.col("revenue")).alias("order"), F.col(name).alias("name"))))
    pairs = F.transform(items, lambda x: F.struct(x["name"].alias("name"), (-x["order"]).alias("revenue")))
    return grouped.groupBy("series").agg(pairs.alias(alias))


def _kpi_rows(tagged: DataFrame) -> DataFrame:
    by_period = kpis.kpis_by(tagged, "series", "period")
    now, before = F.col("period") == CURRENT_TAG, F.col("period") == PREVIOUS_TAG
    names = ("revenue", "profit", "margin_pct", "units", "orders", "avg_ticket", "lines")
    table = by_period.groupBy("series").agg(
        *[F.max(F.when(now, F.col(c))).alias(c) for c in names],
        F.max(F.when(before, F.col("revenue"))).alias("previous_revenue"),
    )
    return table.withColumn("growth_pct", kpis.change_pct("revenue", "previous_revenue"))


def _anomaly_rows(base: DataFrame, current: DataFrame, end: Column | None) -> DataFrame:
    """(series, anomalies): the most extreme order days inside the sold days of the period."""
    found = anomalies.detect_anomalies(series.daily_series(base, "orders", ["series"], end))
    bounds = current.groupBy("series").agg(F.to_date(F.min("date")).alias("a"), F.to_date(F.max("date")).alias("z"))
    inside = found.join(bounds, "series").where(F.col("ds").between(F.col("a"), F.col("z")))
    item = F.struct((-F.abs("score")).alias("order"), "ds", "kind", "value", "expected", "deviation_pct")
    return inside.groupBy("series").agg(F.slice(F.array_sort(F.collect_list(item)), 1, MAX_ANOMALIES).alias("anomalies"))


def _segment_rows(base: DataFrame) -> DataFrame:
    """(series, n_customers, pareto_pct, segments) of groups with enough customers."""
    wanted = [c for c in ("series", "customer_id", "order_id", "date", "revenue") if c in base.columns]
    rfm = stage(customers.rfm_table(base.select(*wanted), by=["series"]), "rfm")
    sizes = rfm.groupBy("series").agg(F.count(F.lit(1)).alias("n_customers"))
    sizes = sizes.where(F.col("n_customers") >= customers.MIN_CUSTOMERS)
    enough = rfm.join(sizes.select("series"), "series", "left_semi")
    summary = customers.summarize_segments(customers.segment_rows(enough, ["series"]), ["series"])
    item = F.struct("position", "segment", "customers", "revenue", "revenue_pct")
    listed = summary.groupBy("series").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    return sizes.join(customers.pareto_share(enough, by=["series"]), "series").join(listed, "series")


# columns of every part, null in groups (or requests) without it
PART_COLUMNS = {
    "breakdown": "by_category ARRAY<STRUCT<name: STRING, revenue: DOUBLE>>, by_region ARRAY<STRUCT<name: STRING, revenue: DOUBLE>>",
    "trend": "slope_pct DOUBLE, r2 DOUBLE, p_value DOUBLE, significant BOOLEAN, direction STRING",
    "declining": "declining ARRAY<STRUCT<category: STRING, change_pct: DOUBLE>>",
    "bridge": "bridge STRUCT<total_change: DOUBLE, volume_effect: DOUBLE, price_effect: DOUBLE, mix_effect: DOUBLE>",
    "anomalies": "anomalies ARRAY<STRUCT<order: DOUBLE, ds: DATE, kind: STRING, value: DOUBLE, expected: DOUBLE, deviation_pct: DOUBLE>>",
    "forecast": "forecast STRUCT<last_day: DATE, horizon: BIGINT, total: DOUBLE, total_error: DOUBLE, best_model: STRING>",
    "customers": "n_customers BIGINT, pareto_pct DOUBLE, segments ARRAY<STRUCT<position: INT, segment: STRING, "
    "customers: BIGINT, revenue: DOUBLE, revenue_pct: DOUBLE>>",
}
PARTS = ("kpis", *PART_COLUMNS)
#: What the parts read of the base.
USED = ("series", "date", "order_id", "category", "region", "units", "revenue", "cost", "profit", "customer_id")


def _trend_rows(current: DataFrame) -> DataFrame:
    sold_days = series.days_with_sales(current, ["series"])
    test = trends.mann_kendall(sold_days).select("series", "p_value", "significant", "direction")
    return trends.fit_trend(sold_days).join(test, "series")


def _declining_rows(current: DataFrame) -> DataFrame:
    rows = trends.declining_categories(current, by=["series"])
    return rows.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("category", "change_pct"))).alias("declining")
    )


def _bridge_rows(tagged: DataFrame) -> DataFrame:
    totals = variance.bridge_totals(variance.bridge_by_segment(tagged, "category", ["series"]), ["series"])
    effects = F.struct("total_change", "volume_effect", "price_effect", "mix_effect")
    return totals.select("series", effects.alias("bridge"))


def _forecast_rows(base: DataFrame, end: Column | None) -> DataFrame:
    daily = series.daily_series(base, "revenue", ["series"], end)
    totals = forecasting.forecast(daily, FORECAST_HORIZON).totals()
    last_days = daily.groupBy("series").agg(F.max("ds").alias("last_day"))
    cited = F.struct("last_day", "horizon", "total", "total_error", "best_model")
    return totals.join(last_days, "series").select("series", cited.alias("forecast"))


def build_facts(
    history: DataFrame,
    filters: SalesFilters,
    by: list[str] | None = None,
    parts: tuple[str, ...] = PARTS,
    data_end: date | Column | None = None,
    dates: DataFrame | None = None,
) -> DataFrame:
    """One row per group. `history` is the whole base; anomalies, forecast and customers use all of it
    (with the segment filters), the rest the selected period. Parts without enough data stay null.

    A base without customer codes is asked without the `customers` part. Every part ends in one row
    per group, so the final joins are small whatever the base's size. What the parts use of the base is written
    once, so that its joins run once and not once per part.
    """
    base = periods.apply_segments(history, filters).withColumn("series", series.series_key(by or []))
    if set(parts) - {"kpis"}:
        base = stage(base.select(*[c for c in USED if c in base.columns]), "facts-base")
    tagged = periods.tag_periods(base, filters, dates if dates is not None else history)
    current = tagged.where(F.col("period") == CURRENT_TAG)
    end = F.lit(data_end) if isinstance(data_end, date) else data_end
    makers = {
        "breakdown": lambda: _ranked(current, "category", "by_category").join(
            _ranked(current, "region", "by_region"), "series"
        ),
        "trend": lambda: _trend_rows(current),
        "declining": lambda: _declining_rows(current),
        "bridge": lambda: _bridge_rows(tagged),
        "anomalies": lambda: _anomaly_rows(base, current, end),
        "forecast": lambda: _forecast_rows(base, end),
        "customers": lambda: _segment_rows(base),
    }
    facts = base.select("series").distinct().join(_kpi_rows(tagged), "series", "left")
    for name, columns in PART_COLUMNS.items():
        if name in parts:
            facts = facts.join(makers[name](), "series", "left")
        else:
            absent = T.StructType.fromDDL(columns)
            facts = facts.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})
    return facts.withColumns(
        {
            "period_label": F.lit(filters.period_label),
            "comparison_label": F.lit(filters.comparison_label),
            "direction": F.coalesce("direction", F.lit(trends.FLAT)),
            "p_value": F.coalesce("p_value", F.lit(1.0)),
            "significant": F.coalesce("significant", F.lit(False)),
            "slope_pct": F.coalesce("slope_pct", F.lit(0.0)),
        }
    )


# ------------------------------------------------------------------ text lines
def _total() -> Column:
    return F.when(F.col("revenue") == 0, 1.0).otherwise(F.col("revenue"))


def _shares(column: str) -> Column:
    def one(item: Column) -> Column:
        pct = fmt.format_pct(item["revenue"] / _total() * 100)
        return F.concat(item["name"], F.lit(" "), fmt.format_brl(item["revenue"]), F.lit(" ("), pct, F.lit(")"))

    return F.array_join(F.transform(column, one), "; ")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def fact_lines(facts: DataFrame) -> DataFrame:
    """(series, position, text): the facts as ordered sentences; groups without sales in the period have none."""
    brl, num, pct = fmt.format_brl, fmt.format_number, fmt.format_pct
    c = F.col
    has_cost = c("profit").isNotNull() & c("margin_pct").isNotNull()
    growth = F.coalesce(pct(c("growth_pct"), signed=True), F.lit("não disponível"))
    direction = F.when(c("direction") == trends.FLAT, "sem tendência significativa").otherwise(c("direction"))
    declining = F.array_join(
        F.transform("declining", lambda d: _text(d["category"], " (", pct(d["change_pct"], 0), ")")), "; "
    )
    unusual = F.array_join(
        F.transform(
            "anomalies",
            lambda a: _text(
                fmt.format_day(a["ds"]), " (", a["kind"], ", ", num(a["value"]), " pedidos vs ", num(a["expected"]),
                " esperados, ", pct(a["deviation_pct"], 0, signed=True), ")",
            ),
        ),
        "; ",
    )
    segments = F.array_join(
        F.transform(
            F.filter("segments", lambda s: s["segment"].isin(*CITED_SEGMENTS)),
            lambda s: _text(s["segment"], ": ", num(s["customers"]), " clientes, ", pct(s["revenue_pct"]), " da receita"),
        ),
        ", ",
    )
    lines = [
        _text("Período analisado: ", c("period_label")),
        _text("Receita total: ", brl(c("revenue"))),
        F.when(has_cost, _text("Lucro total: ", brl(c("profit")))),
        F.when(has_cost, _text("Margem de lucro: ", pct(c("margin_pct")))).otherwise(
            "Lucro e margem: não disponíveis (a base não informa o custo)"
        ),
        _text("Pedidos: ", num(c("orders"))),
        _text("Unidades vendidas: ", num(c("units"))),
        _text("Ticket médio: ", brl(c("avg_ticket"))),
        _text("Crescimento da receita vs ", c("comparison_label"), ": ", growth),
        _text("Receita por categoria: ", _shares("by_category")),
        _text("Receita por região: ", _shares("by_region")),
        _text(
            "Tendência da receita diária no período (teste de Mann-Kendall): ", direction, " (",
            fmt.format_p_value(c("p_value")), "); reta de regressão equivale a ", pct(c("slope_pct"), signed=True),
        ),
        F.when(
            F.size("declining") > 0,
            _text("Categorias com queda de receita entre a 1ª e a 2ª metade do período: ", declining),
        ).otherwise("Nenhuma categoria com queda maior que 15% entre a 1ª e a 2ª metade do período"),
        F.when(
            c("bridge").isNotNull(),
            _text(
                "Variação da receita vs ", c("comparison_label"), ": ", brl(c("bridge.total_change")),
                ", decomposta em efeito volume ", brl(c("bridge.volume_effect")), ", efeito preço ",
                brl(c("bridge.price_effect")), " e efeito mix ", brl(c("bridge.mix_effect")),
            ),
        ),
        F.when(F.size("anomalies") > 0, _text("Anomalias no número de pedidos no período: ", unusual)).otherwise(
            "Anomalias no número de pedidos no período: nenhuma"
        ),
        F.when(
            c("forecast").isNotNull(),
            _text(
                "Previsão de receita para os ", c("forecast.horizon").cast("string"), " dias após ",
                fmt.format_day(c("forecast.last_day")), ": ", brl(c("forecast.total")),
                " (erro típico do total no backtesting: ± ", pct(c("forecast.total_error")), "; modelo: ",
                c("forecast.best_model"), ")",
            ),
        ),
        F.when(
            c("segments").isNotNull(),
            _text(
                "Clientes (histórico completo): ", num(c("n_customers")), "; os 20% que mais compram geram ",
                pct(c("pareto_pct")), " da receita; segmentos RFM: ", segments,
            ),
        ),
    ]
    listed = F.filter(F.array(*lines), lambda line: line.isNotNull())
    return facts.where(c("lines") > 0).select("series", F.posexplode(listed).alias("position", "text"))


def facts_text(facts: DataFrame) -> DataFrame:
    """(series, facts): the lines joined, as the number check needs them."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return fact_lines(facts).groupBy("series").agg(joined.alias("facts"))


def strongest_anomaly() -> Column:
    return F.try_element_at("anomalies", F.lit(1))


def segment_named(name: str) -> Column:
    return F.try_element_at(F.filter("segments", lambda s: s["segment"] == name), F.lit(1))

