"""Catalogue: periods, KPIs, rankings, series, variance and trends over the sales table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum
from salespark.operators import kpis, periods, series, trends, variance
from salespark.operators.periods import LAST_YEAR, SalesFilters
from salespark.plans.catalog import DAILY_CTE, query, rounded, with_sales
from salespark.sources.star import sales, table

HALF = SalesFilters(date(2000, 7, 1), date(2000, 12, 31))
FIRST_HALF = SalesFilters(date(2000, 2, 1), date(2000, 2, 29), ("ECONOMY", "PROMO"), ("ASIA", "EUROPE"), LAST_YEAR)
CUR = "date >= TIMESTAMP '2000-07-01' AND date < TIMESTAMP '2001-01-01'"
PREV = "date >= TIMESTAMP '1999-12-30' AND date < TIMESTAMP '2000-07-01'"
BOTH = f"(CASE WHEN {CUR} THEN 'current' WHEN {PREV} THEN 'previous' END)"


def dates_of(spark, sf):
    """The base's dates alone: enough to know where the data starts."""
    return table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"))


def tagged(spark, sf, columns, filters=HALF):
    return periods.tag_periods(sales(spark, sf, columns), filters, dates_of(spark, sf))


# ---------------------------------------------------------------- periods and filters
@query(with_sales(f"""SELECT {BOTH} AS period, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM sales WHERE {BOTH} IS NOT NULL GROUP BY 1"""))
def period_rows(spark, sf):
    return tagged(spark, sf, ["date", "revenue"]).groupBy("period").agg(
        F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue")
    )


@query(with_sales("""SELECT CASE WHEN date >= TIMESTAMP '2000-02-01' AND date < TIMESTAMP '2000-03-01' THEN 'current'
  ELSE 'previous' END AS period, category, region, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM sales WHERE ((date >= TIMESTAMP '2000-02-01' AND date < TIMESTAMP '2000-03-01')
  OR (date >= TIMESTAMP '1999-02-01' AND date < TIMESTAMP '1999-03-01'))
  AND category IN ('ECONOMY', 'PROMO') AND region IN ('ASIA', 'EUROPE') GROUP BY ALL"""))
def filtered_year_over_year(spark, sf):
    current, previous = periods.filter_sales(
        sales(spark, sf, ["date", "category", "region", "revenue"]), FIRST_HALF, dates_of(spark, sf)
    )
    return variance.tag_pair(current, previous).groupBy("period", "category", "region").agg(
        F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue")
    )


@query(with_sales("""SELECT count(*) AS lines, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue FROM sales
WHERE date >= TIMESTAMP '1994-07-01' AND date < TIMESTAMP '1995-07-01'
  AND date_diff('day', DATE '1994-07-01', (SELECT CAST(min(date) AS DATE) FROM sales)) <= 365 * 0.05"""))
def uncovered_comparison(spark, sf):
    filters = SalesFilters(date(1995, 7, 1), date(1996, 6, 30), comparison=LAST_YEAR)
    _, previous = periods.filter_sales(sales(spark, sf, ["date", "revenue"]), filters, dates_of(spark, sf))
    return previous.agg(F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS last FROM orders),
w AS (SELECT last AS end_day, CAST(last - INTERVAL 89 DAY AS DATE) AS start_day FROM d)
SELECT start_day, end_day, CAST(start_day - INTERVAL 90 DAY AS DATE) AS previous_start,
  CAST(start_day - INTERVAL 1 DAY AS DATE) AS previous_end,
  CAST(start_day - INTERVAL 1 YEAR AS DATE) AS year_start,
  CASE WHEN end_day = last_day(end_day) THEN last_day(CAST(end_day - INTERVAL 1 YEAR AS DATE))
       ELSE CAST(end_day - INTERVAL 1 YEAR AS DATE) END AS year_end,
  date_diff('day', CAST(start_day - INTERVAL 90 DAY AS DATE), (SELECT min(last) FROM d)) <= 90 * 0.05 AS covered
FROM w""")
def comparison_windows(spark, sf):
    days = dates_of(spark, sf).select(F.to_date("date").alias("end_day")).distinct()
    rows = days.withColumn("start_day", F.date_sub("end_day", 89))
    start, end = F.col("start_day"), F.col("end_day")
    before = periods.comparison_window_columns(start, end)
    year = periods.comparison_window_columns(start, end, LAST_YEAR)
    return rows.select(
        "start_day", "end_day",
        before[0].alias("previous_start"), before[1].alias("previous_end"),
        year[0].alias("year_start"), year[1].alias("year_end"),
        periods.window_is_covered(*before, periods.data_start(dates_of(spark, sf))).alias("covered"),
    )


@query(with_sales("""SELECT 'anterior' AS mode, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales
WHERE date >= TIMESTAMP '2000-01-31' AND date < TIMESTAMP '2000-03-01'
UNION ALL SELECT 'ano_anterior', count(*), CAST(sum(revenue) AS DOUBLE) FROM sales
WHERE date >= TIMESTAMP '1999-03-01' AND date < TIMESTAMP '1999-03-31'"""))
def neighbour_periods(spark, sf):
    base = sales(spark, sf, ["date", "revenue"])
    start, end = date(2000, 3, 1), date(2000, 3, 30)
    parts = {"anterior": periods.previous_period, "ano_anterior": periods.same_period_last_year}
    frames = [
        slice_of(base, start, end).agg(F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue"))
        .withColumn("mode", F.lit(mode))
        for mode, slice_of in parts.items()
    ]
    return frames[0].unionByName(frames[1])


@query("""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders)
SELECT p AS preset, CASE WHEN n IS NULL THEN a ELSE greatest(a, CAST(z - to_days(CAST(n - 1 AS INTEGER)) AS DATE)) END AS start, z AS "end"
FROM b, (VALUES ('30d', 30), ('90d', 90), ('12m', 365), ('tudo', NULL)) t(p, n)""")
def preset_ranges(spark, sf):
    return periods.preset_ranges(dates_of(spark, sf))


@query(with_sales("SELECT 'category' AS dimension, category AS member FROM sales GROUP BY ALL "
                  "UNION ALL SELECT 'region', region FROM sales GROUP BY ALL"))  # fmt: skip
def segment_options(spark, sf):
    frames = [
        periods.segment_options(sales(spark, sf, [c]), c).select(F.lit(c).alias("dimension"), F.col(c).alias("member"))
        for c in ("category", "region")
    ]
    return frames[0].unionByName(frames[1])


@query("""SELECT (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, month(ts)::INTEGER AS month,
  CAST(date_trunc('month', ts) AS DATE) AS month_start, count(*) AS events FROM events GROUP BY ALL""")
def event_time_parts(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").alias("date"))
    parts = periods.time_parts(rows)
    return parts.groupBy("weekday", "hour", "month", "month_start").agg(F.count(F.lit(1)).alias("events"))


@query(with_sales("""SELECT date, order_id, product, CAST(revenue AS DOUBLE) AS revenue FROM sales"""))
def newest_details(spark, sf):
    """Every row, newest first."""
    return periods.detail_rows(sales(spark, sf, ["date", "order_id", "product", "revenue"]))


# ---------------------------------------------------------------- KPIs and rankings
KPI_SQL = f""", t AS (SELECT {BOTH} AS period, * FROM sales WHERE {BOTH} IS NOT NULL),
c AS (SELECT * FROM t WHERE period = 'current'), p AS (SELECT CAST(sum(revenue) AS DOUBLE) AS r FROM t WHERE period = 'previous'),
cat AS (SELECT category, CAST(sum(revenue) AS DOUBLE) AS r FROM c GROUP BY 1 ORDER BY r DESC, category LIMIT 1),
reg AS (SELECT region, CAST(sum(revenue) AS DOUBLE) AS r FROM c GROUP BY 1 ORDER BY r DESC, region LIMIT 1),
k AS (SELECT CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(profit) AS DOUBLE) AS profit, CAST(sum(units) AS BIGINT) AS units,
  count(DISTINCT order_id) AS orders FROM c)
SELECT round(k.revenue, 2) AS revenue, round(profit, 2) AS profit, round(profit / revenue * 100, 4) AS margin_pct, units, orders,
  round(revenue / orders, 4) AS avg_ticket, cat.category AS top_category, round(cat.r, 2) AS top_category_revenue,
  reg.region AS top_region, round((revenue - p.r) / p.r * 100, 4) AS growth_pct
FROM k, p, cat, reg"""


@query(with_sales(KPI_SQL))
def sales_kpis(spark, sf):
    columns = ["date", "category", "region", "units", "revenue", "cost", "profit", "order_id"]
    result = kpis.sales_kpis(sales(spark, sf, columns), HALF, dates_of(spark, sf))
    return rounded(result, 4, revenue=2, profit=2, top_category_revenue=2)


@query(with_sales("""SELECT count(DISTINCT order_id) AS orders, count(*) AS lines FROM sales"""))
def order_count(spark, sf):
    from salespark.operators.schema import order_count as counted

    base = sales(spark, sf, ["order_id"])
    return base.agg(counted(base.columns).alias("orders"), counted([]).alias("lines"))


@query(with_sales(f"SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE {CUR} GROUP BY 1"))
def revenue_by_category(spark, sf):
    current = periods.between_days(sales(spark, sf, ["date", "category", "revenue"]), HALF.start, HALF.end)
    return kpis.revenue_by(current, "category")


@query(with_sales(f"SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE {CUR} GROUP BY 1"))
def revenue_by_region(spark, sf):
    current = periods.between_days(sales(spark, sf, ["date", "region", "revenue"]), HALF.start, HALF.end)
    return kpis.revenue_by(current, "region")


@query(with_sales("""SELECT product, round(CAST(sum(revenue) AS DOUBLE), 2) AS revenue,
round(CAST(sum(revenue) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM sales) * 100, 4) AS share_pct
FROM sales GROUP BY 1 ORDER BY sum(revenue), product LIMIT 5"""))
def lowest_products(spark, sf):
    return rounded(kpis.ranking(sales(spark, sf, ["product", "revenue"]), "product", 5, descending=False), revenue=2)


@query(with_sales("SELECT product, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def top_products(spark, sf):
    return kpis.top_products(sales(spark, sf, ["product", "revenue"]))


@query(with_sales("""SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue,
round(CAST(sum(revenue) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM sales) * 100, 4) AS share_pct
FROM sales GROUP BY 1"""))
def category_shares(spark, sf):
    return rounded(kpis.revenue_shares(sales(spark, sf, ["category", "revenue"]), "category"), revenue=2)


@query(with_sales("""SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 36"""))
def monthly_revenue(spark, sf):
    return kpis.monthly_revenue(sales(spark, sf, ["date", "revenue"]))


@query(with_sales("""SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM sales WHERE year(date) = 1999 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""))
def best_month(spark, sf):
    year = periods.between_days(sales(spark, sf, ["date", "revenue"]), date(1999, 1, 1), date(1999, 12, 31))
    return kpis.best_month(year)


def _over_time_sql(unit: str) -> str:
    return with_sales(f""", g AS (SELECT CAST(date_trunc('{unit}', date) AS DATE) AS ds, CAST(sum(revenue) AS DOUBLE) AS r,
  CAST(sum(profit) AS DOUBLE) AS p FROM sales GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM g), (SELECT max(ds) FROM g), INTERVAL 1 {unit})) AS DATE) AS ds)
SELECT c.ds, coalesce(r, 0.0) AS revenue, coalesce(p, 0.0) AS profit FROM c LEFT JOIN g USING (ds)""")


def _over_time(spark, sf, granularity):
    return kpis.revenue_over_time(sales(spark, sf, ["date", "revenue", "profit"]), granularity)


@query(_over_time_sql("day"))
def revenue_by_day(spark, sf):
    return _over_time(spark, sf, "D")


@query(_over_time_sql("week"))
def revenue_by_week(spark, sf):
    return _over_time(spark, sf, "W")


@query(_over_time_sql("month"))
def revenue_by_month(spark, sf):
    return _over_time(spark, sf, "M")


@query(with_sales(f""", k AS (SELECT {BOTH} AS period, CAST(sum(revenue) AS DOUBLE) AS r, CAST(sum(profit) AS DOUBLE) AS p,
  CAST(sum(units) AS DOUBLE) AS u, CAST(count(DISTINCT order_id) AS DOUBLE) AS o FROM sales WHERE {BOTH} IS NOT NULL GROUP BY 1),
x AS (SELECT period, unnest([{{'position': 0, 'metric': 'Receita', 'v': r}}, {{'position': 1, 'metric': 'Lucro', 'v': p}},
  {{'position': 2, 'metric': 'Margem', 'v': p / r * 100}}, {{'position': 3, 'metric': 'Pedidos', 'v': o}},
  {{'position': 4, 'metric': 'Unidades', 'v': u}}, {{'position': 5, 'metric': 'Ticket médio', 'v': r / o}}], recursive := true) FROM k),
w AS (SELECT CAST(position AS INTEGER) AS position, metric, max(v) FILTER (period = 'current') AS c,
  max(v) FILTER (period = 'previous') AS b FROM x GROUP BY ALL)
SELECT position, metric, round(c, 4) AS "current", round(b, 4) AS previous,
  round(CASE WHEN metric = 'Margem' THEN c - b ELSE (c - b) / b * 100 END, 4) AS change,
  round(CASE WHEN round((c - b) / abs(b) * 100, 1) = 0 THEN 0.0 ELSE (c - b) / abs(b) * 100 END, 4) AS card_delta_pct,
  round((c - b) / abs(b) * 100, 1) = 0 AS card_neutral FROM w"""))
def kpi_comparison(spark, sf):
    columns = ["date", "units", "revenue", "cost", "profit", "order_id"]
    return rounded(kpis.kpi_comparison(sales(spark, sf, columns), HALF, dates_of(spark, sf)))


@query(with_sales(f""", k AS (SELECT CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales WHERE {CUR})
SELECT revenue, 5000000.0::DOUBLE AS goal, round(revenue / 5000000.0::DOUBLE * 100, 4) AS progress_pct,
round(least(revenue / 5000000.0::DOUBLE, 1.0), 4) AS bar, revenue >= 5000000 AS reached,
round(abs(revenue - 5000000.0::DOUBLE), 2) AS difference FROM k"""))
def goal_progress(spark, sf):
    current = periods.between_days(sales(spark, sf, ["date", "revenue"]), HALF.start, HALF.end)
    return rounded(kpis.goal_progress(current, 5_000_000), revenue=2, difference=2)


@query(with_sales("""SELECT round(a / 7, 4) AS mean_now, round(b / 7, 4) AS mean_before, round((a - b) / b * 100, 4) AS growth_pct
FROM (SELECT CAST(sum(revenue) FILTER (year(date) = 2000) AS DOUBLE) AS a, CAST(sum(revenue) FILTER (year(date) = 1999) AS DOUBLE) AS b
FROM sales WHERE month(date) <= 7)"""))
def growth_between_averages(spark, sf):
    return rounded(kpis.growth_between_averages(sales(spark, sf, ["date", "revenue"]), 2000, 1, 7))


@query(with_sales(""", g AS (SELECT CAST(year(date) AS INTEGER) AS year, category, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY ALL)
SELECT year, category, revenue, round(revenue / sum(revenue) OVER (PARTITION BY year) * 100, 4) AS share_pct FROM g"""))
def yearly_category_share(spark, sf):
    return rounded(kpis.yearly_category_share(sales(spark, sf, ["date", "category", "revenue"])), revenue=2)


@query(""" WITH f AS (SELECT o_custkey, count(DISTINCT l_orderkey) AS frequency FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT frequency, count(*) AS customers, round((SELECT sum(CASE WHEN frequency > 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) * 100 FROM f), 4) AS repeat_pct
FROM f GROUP BY 1""")
def repeat_customers(spark, sf):
    return rounded(kpis.repeat_customers(sales(spark, sf, ["customer_id", "order_id"])))


@query(""" WITH f AS (SELECT o_custkey, count(DISTINCT l_orderkey) AS frequency FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT frequency, count(*) AS customers FROM f GROUP BY 1 ORDER BY customers DESC, frequency LIMIT 4""")
def frequency_top(spark, sf):
    return kpis.frequency_top(sales(spark, sf, ["customer_id", "order_id"])).drop("repeat_pct")


@query(with_sales("""SELECT w AS "window", sum(CASE WHEN ds BETWEEN a AND b THEN orders ELSE 0 END) AS total,
CAST(count(*) FILTER (ds BETWEEN a AND b) AS BIGINT) AS days FROM daily,
(VALUES ('first quarter', DATE '1995-01-01', DATE '1995-03-31'), ('last days', DATE '2001-07-20', DATE '2001-08-05')) t(w, a, b) GROUP BY 1""",
DAILY_CTE))
def window_edges(spark, sf):
    daily = series.daily_series(sales(spark, sf, ["date", "order_id"]), "orders")
    return kpis.window_edges(
        daily, {"first quarter": ("1995-01-01", "1995-03-31"), "last days": ("2001-07-20", "2001-08-05")}
    )


@query(with_sales("""SELECT CAST(min(date) AS DATE) AS first_day, CAST(max(date) AS DATE) AS last_day,
list_sort(list(DISTINCT category)) AS categories, list_sort(list(DISTINCT region)) AS regions, count(cost) = count(*) AS has_cost,
count(customer_id) > 0 AS has_customers FROM sales"""))
def dataset_profile(spark, sf):
    return kpis.dataset_profile(sales(spark, sf, ["date", "category", "region", "cost", "customer_id"]))


# ---------------------------------------------------------------- daily series
@query(with_sales("SELECT 'total' AS series, ds, y FROM daily", DAILY_CTE))
def daily_revenue(spark, sf):
    return series.daily_series(sales(spark, sf, ["date", "revenue"]))


@query(with_sales("SELECT 'total' AS series, ds, orders AS y FROM daily", DAILY_CTE))
def daily_orders(spark, sf):
    return series.daily_series(sales(spark, sf, ["date", "order_id"]), "orders")


KEYED_SQL = with_sales(""", d AS (SELECT category || ' | ' || region AS series, CAST(date AS DATE) AS ds,
  CAST(sum(revenue) AS DOUBLE) AS y FROM sales GROUP BY ALL),
b AS (SELECT series, min(ds) AS a FROM d GROUP BY 1),
c AS (SELECT series, CAST(unnest(generate_series(a, (SELECT max(ds) FROM d), INTERVAL 1 DAY)) AS DATE) AS ds FROM b)
SELECT series, c.ds, coalesce(y, 0.0) AS y FROM c LEFT JOIN d USING (series, ds)""")


@query(KEYED_SQL)
def segment_series_to_base_end(spark, sf):
    base = sales(spark, sf, ["date", "category", "region", "revenue"])
    last = dates_of(spark, sf).agg(F.max("date").alias("last")).scalar()
    return series.daily_series(base, "revenue", ["category", "region"], end=last)


@query(with_sales("""SELECT 'total' AS series, ds, y,
round(avg(y) OVER (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM daily""", DAILY_CTE))
def moving_average(spark, sf):
    daily = series.daily_series(sales(spark, sf, ["date", "revenue"]))
    return rounded(series.moving_average(daily), 4, y=2)


@query(with_sales(""" SELECT 'total' AS series, CAST(date_trunc('week', ds) AS DATE) AS bucket, round(sum(y), 2) AS revenue, sum(orders) AS orders,
round(coalesce(sum(y) / nullif(sum(orders), 0), 0), 4) AS ticket FROM daily GROUP BY ALL HAVING count(*) = 7""", DAILY_CTE))
def weekly_sparkline(spark, sf):
    return rounded(series.sparkline(sales(spark, sf, ["date", "revenue", "order_id"])), 4, revenue=2)


@query(with_sales("""SELECT 'total' AS series, ds AS bucket, round(y, 2) AS revenue, orders,
round(coalesce(y / nullif(orders, 0), 0), 4) AS ticket FROM daily WHERE ds BETWEEN (SELECT min(ds) FROM days WHERE ds >= DATE '2000-07-01')
AND (SELECT max(ds) FROM days WHERE ds <= DATE '2000-07-31')""", DAILY_CTE))
def daily_sparkline(spark, sf):
    month = periods.between_days(sales(spark, sf, ["date", "revenue", "order_id"]), date(2000, 7, 1), date(2000, 7, 31))
    return rounded(series.sparkline(month), 4, revenue=2)


@query(with_sales(""", m AS (SELECT year(ds) AS yr, month(ds) AS mo, avg(y) AS v FROM daily GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY yr) = 12 AS whole FROM m),
k AS (SELECT * FROM f WHERE whole OR NOT (SELECT bool_or(whole) FROM f)),
s AS (SELECT mo, v / nullif(avg(v) OVER (PARTITION BY yr), 0) AS i FROM k)
SELECT 'total' AS series, CAST(mo AS INTEGER) AS month, round(avg(i), 6) AS seasonal_index FROM s WHERE i IS NOT NULL GROUP BY ALL""", DAILY_CTE))
def monthly_seasonality(spark, sf):
    daily = series.daily_series(sales(spark, sf, ["date", "revenue"]))
    return rounded(series.monthly_seasonality(daily), 6)


GRID_SQL = """WITH g AS (SELECT (isodow(ts) - 1)::INTEGER AS weekday, hour(ts) AS h, count(DISTINCT event_id) AS n FROM events GROUP BY ALL)
SELECT weekday, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (h = {h}), 0) AS BIGINT) AS h{h}" for h in range(24)) + " FROM g GROUP BY 1"


@query(GRID_SQL)
def weekday_hour_grid(spark, sf):
    return series.weekday_hour_grid(table(spark, sf, "events"), "ts", "event_id")


# ---------------------------------------------------------------- variance
BRIDGE_CTE = f""", t AS (SELECT {BOTH} AS period, product, revenue,
  CASE WHEN units > 0 THEN units WHEN revenue > 0 THEN 1 ELSE 0 END AS u FROM sales WHERE {BOTH} IS NOT NULL),
a AS (SELECT product, CAST(coalesce(sum(revenue) FILTER (period = 'current'), 0) AS DOUBLE) AS r1,
  CAST(coalesce(sum(revenue) FILTER (period = 'previous'), 0) AS DOUBLE) AS r0,
  CAST(coalesce(sum(u) FILTER (period = 'current'), 0) AS DOUBLE) AS u1,
  CAST(coalesce(sum(u) FILTER (period = 'previous'), 0) AS DOUBLE) AS u0 FROM t GROUP BY 1),
q AS (SELECT *, sum(u1) OVER () AS q1, sum(u0) OVER () AS q0, coalesce(r1 / nullif(u1, 0), r0 / nullif(u0, 0)) AS p1,
  coalesce(r0 / nullif(u0, 0), r1 / nullif(u1, 0)) AS p0 FROM a WHERE u1 > 0 OR u0 > 0),
bridge AS (SELECT product, r1, r0, (q1 - q0) * (u0 / q0) * p0 AS volume, q1 * (u1 / q1 - u0 / q0) * p0 AS mix,
  q1 * (u1 / q1) * (p1 - p0) AS price, r1 - r0 AS total FROM q)"""


def _product_bridge(spark, sf):
    return variance.bridge_by_segment(tagged(spark, sf, ["date", "product", "units", "revenue"]), "product")


@query(with_sales(BRIDGE_CTE + """ SELECT product, round(r1, 2) AS revenue_1, round(r0, 2) AS revenue_0, round(volume, 4) AS volume, round(mix, 4) AS mix,
round(price, 4) AS price, round(total, 2) AS total FROM bridge"""))
def bridge_by_product(spark, sf):
    return rounded(_product_bridge(spark, sf), 4, revenue_1=2, revenue_0=2, total=2)


TOTALS_SQL = """ SELECT round(sum(r0), 2) AS previous_revenue, round(sum(r1), 2) AS current_revenue, round(sum(volume), 3) AS volume_effect,
round(sum(price), 3) AS price_effect, round(sum(mix), 3) AS mix_effect, round(sum(r1) - sum(r0), 2) AS total_change,
round((sum(r1) - sum(r0)) / sum(r0) * 100, 4) AS change_pct FROM bridge"""


@query(with_sales(BRIDGE_CTE + TOTALS_SQL))
def bridge_totals(spark, sf):
    totals = variance.bridge_totals(_product_bridge(spark, sf))
    return rounded(totals, 3, previous_revenue=2, current_revenue=2, total_change=2, change_pct=4)


@query(with_sales(BRIDGE_CTE + """, s AS (SELECT sum(r0) AS r0, sum(r1) AS r1, sum(volume) AS v, sum(price) AS p, sum(mix) AS m FROM bridge)
SELECT CAST(step AS INTEGER) AS step, name, round(amount, 3) AS amount, round(level, 3) AS level FROM (
SELECT unnest([{'step': 0, 'name': 'Comparação', 'amount': r0, 'level': r0}, {'step': 1, 'name': 'Volume', 'amount': v, 'level': r0 + v},
{'step': 2, 'name': 'Preço', 'amount': p, 'level': r0 + v + p}, {'step': 3, 'name': 'Mix', 'amount': m, 'level': r0 + v + p + m},
{'step': 4, 'name': 'Período atual', 'amount': r1, 'level': r1}], recursive := true) FROM s)"""))
def bridge_waterfall(spark, sf):
    return rounded(variance.waterfall(variance.bridge_totals(_product_bridge(spark, sf))), 3)


# ---------------------------------------------------------------- trends
PLACED = ", placed AS (SELECT ds, y, row_number() OVER (ORDER BY ds) - 1 AS pos FROM "


@query(with_sales(PLACED + """daily)
SELECT 'total' AS series, round(regr_slope(y, pos) * count(*) / avg(y) * 100, 4) AS slope_pct, round(regr_r2(y, pos), 6) AS r2 FROM placed""", DAILY_CTE))
def linear_trend(spark, sf):
    daily = series.daily_series(sales(spark, sf, ["date", "revenue"]))
    return rounded(trends.fit_trend(daily), 4, r2=6)


MK_SQL = with_sales(""", placed AS (SELECT category AS series, CAST(date AS DATE) AS ds, CAST(sum(revenue) AS DOUBLE) AS y FROM sales GROUP BY ALL),
pairs AS (SELECT a.series, sum(CASE WHEN b.y > a.y THEN 1 WHEN b.y < a.y THEN -1 ELSE 0 END) AS s FROM placed a JOIN placed b
  ON a.series = b.series AND a.ds < b.ds GROUP BY 1),
sizes AS (SELECT series, count(*) AS n FROM placed GROUP BY 1),
ties AS (SELECT series, sum(t * (t - 1) / 2.0) AS tied, sum(t * (t - 1) * (2 * t + 5)) AS tv FROM
  (SELECT series, y, count(*) AS t FROM placed GROUP BY ALL) GROUP BY 1),
z AS (SELECT series, n, s, s / sqrt(n * (n - 1) / 2.0 * (n * (n - 1) / 2.0 - tied)) AS tau,
  abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - tv) / 18.0) AS z FROM pairs JOIN sizes USING (series) JOIN ties USING (series))
SELECT series, n, CAST(s AS BIGINT) AS s, round(tau, 6) AS tau, z > 1.959963984540054 AS significant,
CASE WHEN z <= 1.959963984540054 THEN 'sem tendência' WHEN s > 0 THEN 'alta' ELSE 'queda' END AS direction FROM z""")


@query(MK_SQL)
def mann_kendall_by_category(spark, sf):
    tested = trends.mann_kendall(series.days_with_sales(sales(spark, sf, ["date", "category", "revenue"]), ["category"]))
    return rounded(tested.drop("p_value"), 6)


@query()
def mann_kendall_p_values(spark, sf):
    return rounded(trends.mann_kendall(series.days_with_sales(sales(spark, sf, ["date", "region", "revenue"]), ["region"])), 6)


@query(with_sales(""", w AS (SELECT * FROM sales WHERE date >= TIMESTAMP '2000-07-01' AND date < TIMESTAMP '2001-01-01'),
m AS (SELECT make_timestamp((epoch_us(min(date)) + (epoch_us(max(date)) - epoch_us(min(date))) // 2)::BIGINT) AS mid FROM w),
h AS (SELECT category, CAST(coalesce(sum(revenue) FILTER (date <= mid), 0) AS DOUBLE) AS a,
  CAST(coalesce(sum(revenue) FILTER (date > mid), 0) AS DOUBLE) AS b FROM w, m GROUP BY 1)
SELECT category, round((b - a) / a * 100, 4) AS change_pct FROM h WHERE a > 0 AND (b - a) / a < 0.05"""))
def declining_categories(spark, sf):
    current = periods.between_days(sales(spark, sf, ["date", "category", "revenue"]), HALF.start, HALF.end)
    return rounded(trends.declining_categories(current, threshold=0.05))
