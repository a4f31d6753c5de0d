"""Catalogue: multi-table preparation and delivery, over the raw order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from salespark.operators import delivery, preparation
from salespark.operators.ranking import surrogate_codes as codes_of
from salespark.plans.catalog import query, rounded
from salespark.session import stage
from salespark.sources.raw_star import EXCLUDED, GROUPS, STATE_REGION, WINDOW, raw_tables, shipments

_NATION = "CAST(replace(n_name, 'NATION_', '') AS INTEGER)"
_BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)"
RAW_CTE = f"""WITH valid AS (SELECT * FROM orders WHERE o_orderstatus NOT IN ('P')
  AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31 23:59:59'),
per_order AS (SELECT l_orderkey, count(l_linenumber) AS items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS freight FROM lineitem GROUP BY 1),
reviews AS (SELECT l_orderkey, avg(1 + CAST(l_quantity AS INTEGER) % 5) AS review_score FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1),
joined AS (SELECT * FROM valid LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  JOIN per_order p ON o_orderkey = p.l_orderkey LEFT JOIN reviews r ON o_orderkey = r.l_orderkey),
codes AS (SELECT c_name, printf('C%05d', row_number() OVER (ORDER BY c_name)) AS customer FROM (SELECT DISTINCT c_name FROM joined)),
prepared AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, customer, n_name AS state,
  CASE WHEN {_NATION} >= 20 THEN NULL ELSE (['Norte', 'Nordeste', 'Sudeste', 'Sul'])[{_NATION} % 4 + 1] END AS region,
  o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS purchased_at,
  CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 45 AS INTEGER)) AS delivered_at,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 20 DAY AS estimated_at, items, round(value, 2) AS value, round(freight, 2) AS freight,
  round(review_score, 4) AS review_score FROM joined JOIN codes USING (c_name)),
kept AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_extendedprice AS price,
  CASE WHEN {_BRAND} BETWEEN 1 AND 8 THEN 'Primeira linha' WHEN {_BRAND} BETWEEN 9 AND 20 THEN 'Segunda linha' ELSE 'Outros' END AS category,
  CASE WHEN {_BRAND} BETWEEN 1 AND 20 THEN 'Marca ' || {_BRAND} ELSE 'Sem categoria' END AS product
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT order_id FROM prepared)),
by_product AS (SELECT order_id, category, product, count(*) AS n, sum(CAST(price AS DECIMAL(18,2))) AS price FROM kept GROUP BY ALL),
lines AS (SELECT order_id, category, CAST(sum(n) AS BIGINT) AS units, CAST(sum(price) AS DOUBLE) AS revenue,
  arg_max(product, (price, product)) AS product FROM by_product GROUP BY ALL),
order_codes AS (SELECT order_id, printf('P%06d', row_number() OVER (ORDER BY order_id)) AS code FROM prepared),
sales AS (SELECT code AS order_id, purchased_at AS date, category, region, product, units, round_even(revenue / units * 100, 0) / 100 AS unit_price,
  round(revenue, 2) AS revenue, customer AS customer_id FROM lines JOIN prepared USING (order_id) JOIN order_codes USING (order_id))
"""


def _orders(spark, sf):
    raw = raw_tables(spark, sf)
    return raw, stage(preparation.prepare_orders(raw, WINDOW, EXCLUDED, STATE_REGION), "prepared")


@query(RAW_CTE + "SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders FROM valid GROUP BY ALL")
def valid_orders(spark, sf):
    kept = preparation.valid_orders(raw_tables(spark, sf)["orders"], WINDOW, EXCLUDED)
    return kept.groupBy(
        F.col("order_status").alias("status"), F.year("order_purchase_timestamp").alias("year")
    ).agg(F.count(F.lit(1)).alias("orders"))


@query(RAW_CTE + """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, items, round(value, 2) AS value, round(freight, 2) AS freight FROM per_order""")
def items_per_order(spark, sf):
    return rounded(preparation.items_per_order(raw_tables(spark, sf)["order_items"]), 2)


@query(RAW_CTE + "SELECT CAST(l_orderkey AS VARCHAR) AS order_id, round(review_score, 4) AS review_score FROM reviews")
def review_per_order(spark, sf):
    return rounded(preparation.review_per_order(raw_tables(spark, sf)["order_reviews"]))


@query(RAW_CTE + "SELECT * FROM prepared")
def prepared_orders(spark, sf):
    raw = raw_tables(spark, sf)
    return rounded(preparation.prepare_orders(raw, WINDOW, EXCLUDED, STATE_REGION), 4, value=2, freight=2)


@query("SELECT p_name, printf('N%04d', row_number() OVER (ORDER BY p_name)) AS code FROM (SELECT DISTINCT p_name FROM part)")
def surrogate_codes(spark, sf):
    from salespark.sources.star import table

    return codes_of(table(spark, sf, "part"), "p_name", "N", 4)


@query(RAW_CTE + "SELECT category, product, count(*) AS items, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS price FROM kept GROUP BY ALL")
def kept_items_by_group(spark, sf):
    raw, orders = _orders(spark, sf)
    kept = preparation.items_of(raw["order_items"], orders, preparation.tasks_by_order(raw["order_items"]))
    named = preparation.categorized_items(kept, raw["products"], GROUPS)
    return named.groupBy("category", "product").agg(
        F.count(F.lit(1)).alias("items"), F.round(preparation.exact_sum("price"), 2).alias("price")
    )


@query(RAW_CTE + "SELECT order_id, category, product, units, round(revenue, 2) AS revenue FROM lines")
def order_group_lines(spark, sf):
    raw = raw_tables(spark, sf)
    tasks = preparation.tasks_by_order(raw["order_items"])
    kept = preparation.items_of(raw["order_items"], preparation.valid_orders(raw["orders"], WINDOW, EXCLUDED), tasks)
    return rounded(preparation.order_lines(preparation.categorized_items(kept, raw["products"], GROUPS), tasks), 2)


@query(RAW_CTE + "SELECT *, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS DOUBLE) AS profit FROM sales")
def prepared_sales(spark, sf):
    raw, orders = _orders(spark, sf)
    return preparation.prepare_sales(raw, orders, GROUPS)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS data, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series((SELECT min(data) FROM d), (SELECT max(data) FROM d), INTERVAL 1 DAY)) AS DATE) AS data)
SELECT data, coalesce(n, 0) AS pedidos FROM c LEFT JOIN d USING (data)""")
def raw_daily_orders(spark, sf):
    return preparation.raw_daily_orders(raw_tables(spark, sf)["orders"])


@query(f"SELECT DISTINCT p_brand AS product_category_name FROM part WHERE {_BRAND} NOT BETWEEN 1 AND 20")
def unmapped_categories(spark, sf):
    return preparation.unmapped_categories(raw_tables(spark, sf)["products"], GROUPS)


@query(RAW_CTE + """SELECT (SELECT count(*) FROM prepared) AS orders, count(*) AS lines,
(SELECT count(DISTINCT customer) FROM prepared) AS customers, min(date) AS "first", max(date) AS "last" FROM sales""")
def preparation_totals(spark, sf):
    raw, orders = _orders(spark, sf)
    return preparation.preparation_totals(preparation.prepare_sales(raw, orders, GROUPS), orders)


# ---------------------------------------------------------------- delivery
SHIP_CTE = """WITH d AS (SELECT r_name AS region, date_diff('day', o_orderdate, l_shipdate) AS delay, l_tax AS freight,
  1 + CAST(l_quantity AS INTEGER) % 5 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_linestatus = 'F') """


def _delivered(spark, sf):
    return delivery.delivered_orders(shipments(spark, sf), "F")


@query(SHIP_CTE + """SELECT CAST(delay AS INTEGER) AS delay, CAST(delay AS INTEGER) AS days, delay > 0 AS late, count(*) AS orders FROM d GROUP BY ALL""")
def delivery_delays(spark, sf):
    return _delivered(spark, sf).groupBy("delay", "days", "late").agg(F.count(F.lit(1)).alias("orders"))


@query(SHIP_CTE + """SELECT delay > 0 AS late, count(*) AS orders, round(avg(score), 6) AS mean_score, round(avg((score <= 2)::INT) * 100, 6) AS bad_pct,
round((SELECT avg((delay > 0)::INT) * 100 FROM d), 6) AS late_pct FROM d GROUP BY ALL""")
def late_summary(spark, sf):
    return rounded(delivery.late_summary(_delivered(spark, sf)), 6)


@query(SHIP_CTE + """, b AS (SELECT score, CASE WHEN delay <= -10 THEN 0 WHEN delay <= -5 THEN 1 WHEN delay <= 0 THEN 2 WHEN delay <= 5 THEN 3
  WHEN delay <= 10 THEN 4 WHEN delay <= 20 THEN 5 ELSE 6 END AS position FROM d WHERE delay IS NOT NULL)
SELECT position, (['10+ dias adiantado', '5–10 adiantado', '0–5 adiantado', '1–5 atrasado', '6–10 atrasado', '11–20 atrasado', '20+ atrasado'])[position + 1] AS bin,
round(avg(score), 6) AS mean_score, count(*) AS orders FROM b GROUP BY ALL""")
def score_by_delay(spark, sf):
    return rounded(delivery.score_by_delay(_delivered(spark, sf)), 6)


@query(SHIP_CTE + """SELECT region, count(*) AS orders, round(avg((delay > 0)::INT) * 100, 6) AS late_pct, round(avg(delay), 6) AS mean_days,
round(avg(freight), 6) AS mean_freight, round(avg(score), 6) AS mean_score FROM d GROUP BY 1""")
def region_service(spark, sf):
    return rounded(delivery.region_service(_delivered(spark, sf)), 6)
