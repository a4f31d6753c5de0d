"""Catalogue: long series, large interval tables, mergeable sketches, and facts that many answers share."""

from __future__ import annotations

from pyspark.sql import functions as F

from salespark.operators import intervals, sketches, textnum, trends
from salespark.operators.schema import order_count
from salespark.plans.catalog import query, rounded, with_sales
from salespark.plans.text_queries import SAID_CTE, answered_orders
from salespark.sources.star import sales, table


@query("""WITH shipped AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1),
w AS (SELECT k, CAST(o_orderdate AS DATE) AS a, b, o_orderpriority || ' ' || k AS name FROM orders JOIN shipped ON o_orderkey = k),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders),
m AS (SELECT ds, arg_max(name, k) AS event FROM d JOIN w ON ds BETWEEN a AND b GROUP BY 1)
SELECT ds, coalesce(event, 'outros') AS event FROM d LEFT JOIN m USING (ds)""")
def last_open_order_by_day(spark, sf):
    """Of each day with orders: the newest order that is not shipped completely. Every order is an interval."""
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("end"))
    orders = table(spark, sf, "orders")
    open_ = orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"]).select(
        F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"),
        F.to_date("o_orderdate").alias("start"), "end", F.col("o_orderkey").alias("position"),
    )
    return intervals.label_from_table(orders.select(F.to_date("o_orderdate").alias("ds")).distinct(), open_)


@query("""SELECT event_type, n, s, round(s / sqrt(pairs * (pairs - tied)), 6) AS tau FROM
(SELECT a.event_type, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id < b.event_id GROUP BY 1)
JOIN (SELECT event_type, CAST(sum(t) AS BIGINT) AS n, sum(t) * (sum(t) - 1) / 2 AS pairs, sum(t * (t - 1) / 2) AS tied
  FROM (SELECT event_type, value, count(*) AS t FROM events WHERE value IS NOT NULL GROUP BY ALL) GROUP BY 1) USING (event_type)""")
def event_value_trend(spark, sf):
    """Kendall's S and tau of all event values in order of arrival."""
    found = trends.kendall_of_long(table(spark, sf, "events"), "event_id", "value", ["event_type"])
    return rounded(found.drop("p_value"), 6)


@query(with_sales("SELECT region, CAST(year(date) AS INTEGER) AS year, count(DISTINCT order_id) AS orders, true AS within_error FROM sales GROUP BY ALL"))
def approximate_orders_by_year(spark, sf):
    """Distinct orders per region and year, and whether the estimate from united daily sketches is within its error."""
    base = sales(spark, sf, ["date", "order_id", "region"])
    daily = sketches.order_sketches(base.withColumn("ds", F.to_date("date")), ["region", "ds"])
    estimated = sketches.approx_orders(daily.withColumn("year", F.year("ds")), ["region", "year"]).withColumnRenamed("orders", "estimate")
    exact = base.groupBy("region", F.year("date").alias("year")).agg(order_count(base.columns).alias("orders"))
    close = F.abs(F.col("estimate") - F.col("orders")) <= F.greatest(F.lit(1.0), F.col("orders") * sketches.ERROR)
    return exact.join(estimated, ["region", "year"]).select("region", "year", "orders", close.alias("within_error"))


@query(SAID_CTE + """, fact AS (SELECT DISTINCT o_orderpriority, unnest([total, pct]) AS v, unnest([false, true]) AS pc FROM c),
cited AS (SELECT k, o_orderpriority, 0 AS at, round(CASE WHEN k % 7 = 0 THEN total * 2 ELSE total END, 2) AS v, false AS pc, 0.005 AS tol FROM c WHERE NOT refused
  UNION ALL SELECT k, o_orderpriority, 1, th, false, least(50, th * 0.05) FROM c WHERE NOT refused
  UNION ALL SELECT k, o_orderpriority, 2, cited_pct, true, 0.5 FROM c WHERE NOT refused),
hit AS (SELECT k, count(*) AS verified FROM cited x WHERE EXISTS (SELECT 1 FROM fact f WHERE f.o_orderpriority = x.o_orderpriority
  AND (x.pc OR NOT f.pc) AND f.v BETWEEN x.v - x.tol - 1e-9 AND x.v + x.tol + 1e-9) GROUP BY 1)
SELECT k AS o_orderkey, CASE WHEN refused THEN 0 ELSE 3 END AS checked, CAST(coalesce(verified, 0) AS INTEGER) AS verified,
refused OR coalesce(verified, 0) = 3 AS ok FROM c LEFT JOIN hit USING (k)""")
def answers_with_shared_facts(spark, sf):
    """Every order's answer against the totals and margins of all orders of its priority."""
    answers = answered_orders(spark, sf)
    pairs = F.array(F.struct(F.col("total").alias("value"), F.lit(False).alias("is_percent")), F.struct(F.col("pct").alias("value"), F.lit(True).alias("is_percent")))
    facts = answers.select("o_orderpriority", F.inline(pairs))
    checked = textnum.verify_shared(answers.select("o_orderkey", "o_orderpriority", "answer"), facts, ["o_orderpriority"])
    return checked.select("o_orderkey", "checked", "verified", "ok")
