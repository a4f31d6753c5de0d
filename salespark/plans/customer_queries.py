"""Catalogue: RFM segments, K-Means groups and customer indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum
from salespark.operators import customers
from salespark.plans.catalog import query, rounded
from salespark.session import stage
from salespark.sources.star import sales, table

RFM_COLUMNS = ["customer_id", "order_id", "date", "revenue"]
RFM_CTE = """WITH base AS (SELECT printf('C%05d', o_custkey) AS customer_id, l_orderkey, o_orderdate,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rfm AS (SELECT customer_id, date_diff('day', CAST(max(o_orderdate) AS DATE), CAST((SELECT max(o_orderdate) FROM base) AS DATE)) + 1 AS recency,
  count(DISTINCT l_orderkey) AS frequency, CAST(sum(revenue) AS DOUBLE) AS monetary FROM base GROUP BY 1),
scored AS (SELECT *, CAST((rank() OVER (ORDER BY recency DESC) * 5 + n - 1) // n AS INTEGER) AS r_score,
  CAST((rank() OVER (ORDER BY frequency) * 5 + n - 1) // n AS INTEGER) AS f_score,
  CAST((rank() OVER (ORDER BY monetary) * 5 + n - 1) // n AS INTEGER) AS m_score FROM rfm, (SELECT count(*) AS n FROM rfm)),
named AS (SELECT * EXCLUDE (n), CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Campeões' WHEN r_score >= 3 AND f_score >= 4 THEN 'Clientes fiéis'
  WHEN r_score >= 4 AND f_score >= 2 THEN 'Potenciais fiéis' WHEN r_score >= 4 AND f_score = 1 THEN 'Novos clientes'
  WHEN r_score = 3 THEN 'Precisam de atenção' WHEN r_score <= 2 AND f_score >= 3 THEN 'Em risco'
  WHEN r_score = 2 THEN 'Hibernando' ELSE 'Perdidos' END AS segment FROM scored)
"""


def rfm(spark, sf):
    base = sales(spark, sf, RFM_COLUMNS)
    return stage(customers.rfm_table(base, customers.reference_day(sales(spark, sf, ["date"]))), "rfm")


@query(RFM_CTE + "SELECT customer_id, CAST(recency AS INTEGER) AS recency, frequency, monetary FROM rfm")
def rfm_table(spark, sf):
    return customers.rfm_table(sales(spark, sf, RFM_COLUMNS))


@query(RFM_CTE + "SELECT * REPLACE (CAST(recency AS INTEGER) AS recency) FROM named")
def rfm_segments(spark, sf):
    return customers.segment_rows(rfm(spark, sf))


_ACTION_ROWS = ", ".join(f"('{n}', {i}, '{a}')" for i, (n, a) in enumerate(customers.SEGMENT_ACTIONS.items(), start=1))
SUMMARY_SQL = f""", s AS (SELECT segment, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
avg(recency) AS avg_recency, avg(frequency) AS avg_frequency FROM named GROUP BY 1)
SELECT segment, customers, round(revenue, 2) AS revenue, round(avg_recency, 4) AS avg_recency, round(avg_frequency, 4) AS avg_frequency,
round(customers / sum(customers) OVER () * 100, 4) AS customers_pct, round(revenue / sum(revenue) OVER () * 100, 4) AS revenue_pct, action, position
FROM s JOIN (VALUES {_ACTION_ROWS}) t(segment, position, action) USING (segment)"""


@query(RFM_CTE + SUMMARY_SQL)
def segment_summary(spark, sf):
    return rounded(customers.summarize_segments(customers.segment_rows(rfm(spark, sf))), 4, revenue=2)


PARETO = """(SELECT sum(monetary) FILTER (rn <= greatest(1, ceil(n * 0.2))) / sum(monetary) * 100 FROM
(SELECT CAST(monetary AS DECIMAL(18,2)) AS monetary, row_number() OVER (ORDER BY monetary DESC) AS rn, count(*) OVER () AS n FROM rfm))"""


@query(RFM_CTE + f"SELECT round({PARETO}, 4) AS pareto_pct")
def pareto_share(spark, sf):
    return rounded(customers.pareto_share(rfm(spark, sf)))


@query(RFM_CTE + f"""SELECT count(*) AS customers, round(avg((recency <= 90)::INT) * 100, 4) AS active_pct,
round(avg((frequency > 1)::INT) * 100, 4) AS repeat_pct, round({PARETO}, 4) AS pareto_pct FROM rfm""")
def customer_kpis(spark, sf):
    return rounded(customers.customer_kpis(rfm(spark, sf)))


@query(RFM_CTE + "SELECT f_score, " + ", ".join(f"count(*) FILTER (r_score = {r}) AS r{r}" for r in range(1, 6))
       + " FROM named GROUP BY 1 UNION ALL SELECT f, 0, 0, 0, 0, 0 FROM (VALUES (1), (2), (3), (4), (5)) t(f) WHERE f NOT IN (SELECT f_score FROM named)")
def rfm_heatmap(spark, sf):
    return customers.score_heatmap(customers.segment_rows(rfm(spark, sf)))


@query(RFM_CTE + """, old AS (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS fp, row_number() OVER (ORDER BY recency, customer_id) AS rp,
  count(*) OVER () AS n FROM named),
q AS (SELECT *, 1 + (fp > 1 + (n - 1) / 5.0)::INT + (fp > 1 + (n - 1) * 2 / 5.0)::INT + (fp > 1 + (n - 1) * 3 / 5.0)::INT + (fp > 1 + (n - 1) * 4 / 5.0)::INT AS f,
  5 - (rp > 1 + (n - 1) / 5.0)::INT - (rp > 1 + (n - 1) * 2 / 5.0)::INT - (rp > 1 + (n - 1) * 3 / 5.0)::INT - (rp > 1 + (n - 1) * 4 / 5.0)::INT AS r FROM old)
SELECT count(*) FILTER (r >= 4 AND f >= 4) AS old_champions, count(*) FILTER (r >= 4 AND f >= 4 AND frequency = 1) AS old_single_purchase,
count(*) FILTER (segment = 'Campeões') AS champions, count(*) FILTER (segment = 'Campeões' AND frequency = 1) AS single_purchase FROM q""")
def tie_audit(spark, sf):
    return customers.tie_audit(rfm(spark, sf))


@query(RFM_CTE + """, f AS (SELECT customer_id, ln(1 + recency) AS r, ln(1 + frequency) AS f, ln(1 + monetary) AS m FROM rfm)
SELECT customer_id, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS recency_z, round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS frequency_z,
round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS monetary_z FROM f""")
def cluster_features(spark, sf):
    scaled = customers.cluster_features(rfm(spark, sf))
    return rounded(scaled.select("customer_id", "recency_z", "frequency_z", "monetary_z"), 6)


def _groups(spark, sf):
    return customers.cluster_customers(customers.segment_rows(rfm(spark, sf)))


@query()
def customer_groups(spark, sf):
    return rounded(customers.summarize_clusters(_groups(spark, sf).customers))


@query()
def silhouette_by_k(spark, sf):
    found = _groups(spark, sf)
    return rounded(found.silhouette_by_k.withColumn("chosen", F.col("k") == found.best_k), 6)


@query(RFM_CTE + """SELECT count(*) AS customers, CAST(round(sum(monetary), 2) AS DECIMAL(38,2)) AS revenue, CAST(sum(frequency) AS BIGINT) AS orders,
CAST(100 AS DECIMAL(10,4)) AS revenue_pct, TRUE AS means_fall FROM rfm""")
def customer_group_totals(spark, sf):
    """Groups hold every customer once, all revenue and orders, and are numbered by falling mean revenue."""
    groups = customers.summarize_clusters(_groups(spark, sf).customers)
    before = F.lag("avg_monetary").over(Window.partitionBy(F.lit(0)).orderBy("cluster"))  # at most six groups
    falling = groups.withColumn("falls", F.coalesce(F.col("avg_monetary") <= before, F.lit(True)))
    return falling.agg(
        F.sum("customers").alias("customers"), exact_sum("revenue").cast("decimal(38,2)").alias("revenue"),
        F.round(F.sum(F.col("avg_frequency") * F.col("customers"))).cast("bigint").alias("orders"),
        F.sum("revenue_pct").cast("decimal(10,4)").alias("revenue_pct"), F.bool_and("falls").alias("means_fall"),
    )


@query(RFM_CTE.replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""").replace("(SELECT max(o_orderdate) FROM base)", "(SELECT max(o_orderdate) FROM orders)")
    + "SELECT segment, count(*) AS customers FROM named GROUP BY 1")
def region_segments(spark, sf):
    """One region, with recency still measured from the end of the whole base."""
    base = sales(spark, sf, [*RFM_COLUMNS, "region"]).where(F.col("region") == "ASIA")
    reference = table(spark, sf, "orders").agg(F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("r")).scalar()
    table_of_region = stage(customers.rfm_table(base, reference), "rfm")
    return customers.summarize_segments(customers.segment_rows(table_of_region)).select("segment", "customers")
