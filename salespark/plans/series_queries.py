"""Catalogue: decomposition, anomalies, planted tests and forecasts over daily series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum
from salespark.operators import anomalies, forecasting, planting, series
from salespark.plans.catalog import DAILY_CTE, query, rounded, with_sales
from salespark.sources.star import sales

PLAN = [("1997-03-05", "queda", 0.15), ("1999-06-15", "pico", 3.0), ("2000-08-07", "queda", 0.15)]


def revenue(spark, sf, keys=()):
    return series.daily_series(sales(spark, sf, ["date", "revenue", *keys]), "revenue", list(keys))


def orders(spark, sf, keys=()):
    return series.daily_series(sales(spark, sf, ["date", "order_id", *keys]), "orders", list(keys))


@query(with_sales("""SELECT series, count(*) AS days FROM (SELECT category || ' | ' || region AS series, CAST(date AS DATE) AS ds FROM sales
WHERE date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '1995-01-20' GROUP BY ALL) GROUP BY 1
HAVING max(ds) - min(ds) + 1 < 28""").replace("count(*) AS days FROM (", "CAST(max(ds) - min(ds) + 1 AS BIGINT) AS days FROM ("))  # fmt: skip
def short_series(spark, sf):
    base = sales(spark, sf, ["date", "category", "region", "revenue"])
    january = base.where(F.col("date") < F.lit("1995-01-20").cast("timestamp_ntz"))
    return anomalies.short_series(series.daily_series(january, "revenue", ["category", "region"]))


@query()
def decomposition(spark, sf):
    return rounded(anomalies.decompose(revenue(spark, sf)), 6)


@query()
def weekday_profile(spark, sf):
    return rounded(anomalies.weekday_profile(anomalies.decompose(revenue(spark, sf, ["category"]))), 4)


@query()
def order_anomalies(spark, sf):
    return rounded(anomalies.detect_anomalies(orders(spark, sf)), 4).orderBy(*anomalies.by_severity())


@query()
def revenue_anomalies_by_region(spark, sf):
    return rounded(anomalies.detect_anomalies(revenue(spark, sf, ["region"])), 4)


@query()
def anomalies_in_period(spark, sf):
    found = anomalies.detect_anomalies(revenue(spark, sf, ["category"]))
    return rounded(anomalies.top_in_period(found, "1999-01-01", "2000-12-31", 10), 4)


# The scoring step checked on a plain decomposition (61-day mean, weekday means) that SQL can repeat.
PLAIN_FIT = """, logs AS (SELECT ds, y AS value, ln(1 + y) AS l FROM daily),
t AS (SELECT *, avg(l) OVER (ORDER BY ds ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS trend FROM logs),
s AS (SELECT *, avg(l - trend) OVER (PARTITION BY isodow(ds)) AS seasonal FROM t),
r AS (SELECT *, l - trend - seasonal AS resid FROM s),
m AS (SELECT *, resid - (SELECT median(resid) FROM r) AS off FROM r),
z AS (SELECT *, off / ((SELECT median(abs(off)) FROM m) * 1.4826) AS score, exp(trend + seasonal) - 1 AS expected FROM m)
"""


def _plain_scores(spark, sf):
    daily = revenue(spark, sf)
    logs = daily.select("series", "ds", F.col("y").alias("value"), F.log1p("y").alias("l"))
    around = Window.partitionBy("series").orderBy("ds").rowsBetween(-30, 30)
    fit = logs.withColumn("trend", F.avg("l").over(around))
    by_day = Window.partitionBy("series", F.weekday("ds"))
    fit = fit.withColumn("seasonal", F.avg(F.col("l") - F.col("trend")).over(by_day))
    return anomalies.score_residuals(fit.withColumn("resid", F.col("l") - F.col("trend") - F.col("seasonal")))


@query(with_sales(PLAIN_FIT + "SELECT 'total' AS series, ds, round(value, 2) AS value, round(score, 6) AS score FROM z", DAILY_CTE))
def robust_scores(spark, sf):
    return rounded(_plain_scores(spark, sf).select("series", "ds", "value", "score"), 6, value=2)


@query(with_sales(PLAIN_FIT + """SELECT 'total' AS series, ds, round(value, 2) AS value, round(expected, 4) AS expected,
round((value - expected) / greatest(expected, 1e-9) * 100, 4) AS deviation_pct, round(score, 4) AS score,
CASE WHEN score > 0 THEN 'pico' ELSE 'queda' END AS kind FROM z
WHERE abs(score) > 2.5 AND abs((value - expected) / greatest(expected, 1e-9) * 100) >= 20""", DAILY_CTE))
def flagged_days(spark, sf):
    return rounded(anomalies.flag_days(_plain_scores(spark, sf), 2.5, 20.0), 4, value=2)


EVENTS = [
    ("Verão", "1996-12-21", "1997-03-20"), ("Ano de 1999", "1999-01-01", "1999-12-31"),
    ("Inverno de 1999", "1999-06-21", "1999-09-22"), ("Último mês", "2001-07-01", "2001-07-31"),
]
_EVENT_SQL = ", ".join(f"('{n}', DATE '{a}', DATE '{b}', {i})" for i, (n, a, b) in enumerate(EVENTS))
EVENT_CTE = f""", days_found AS (SELECT ds, y FROM daily WHERE y > (SELECT avg(y) FROM daily)),
matched AS (SELECT ds, arg_max(name, position) AS event FROM days_found JOIN (VALUES {_EVENT_SQL}) w(name, a, b, position)
  ON ds BETWEEN a AND b GROUP BY 1),
labelled AS (SELECT 'total' AS series, ds, y, coalesce(event, 'outros') AS event FROM days_found LEFT JOIN matched USING (ds))"""


def _labelled(spark, sf):
    daily = revenue(spark, sf)
    mean = daily.agg(F.avg("y").alias("m")).scalar()
    return anomalies.label_events(daily.where(F.col("y") > mean), EVENTS)


@query(with_sales(EVENT_CTE + " SELECT * FROM labelled", DAILY_CTE))
def event_labels(spark, sf):
    return _labelled(spark, sf)


@query(with_sales(EVENT_CTE + " SELECT event, count(*) AS days FROM labelled GROUP BY 1", DAILY_CTE))
def event_counts(spark, sf):
    return anomalies.event_counts(_labelled(spark, sf))


PLANT_SQL = """, placed AS (SELECT *, row_number() OVER (PARTITION BY CAST(date AS DATE) ORDER BY order_id, product, revenue) - 1 AS pos FROM sales),
planted AS (SELECT date, revenue FROM placed WHERE CAST(date AS DATE) NOT IN (DATE '1997-03-05', DATE '1999-06-15', DATE '2000-08-07')
  OR (CAST(date AS DATE) IN (DATE '1997-03-05', DATE '2000-08-07') AND pos % 7 = 0)
  UNION ALL SELECT date, revenue FROM placed, range(3) WHERE CAST(date AS DATE) = DATE '1999-06-15')
SELECT CAST(date AS DATE) AS ds, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue FROM planted GROUP BY 1"""


def _planted(spark, sf):
    base = sales(spark, sf, ["date", "order_id", "product", "revenue"])
    return planting.inject_anomalies(base, PLAN)


@query(with_sales(PLANT_SQL))
def planted_days(spark, sf):
    return _planted(spark, sf).groupBy(F.to_date("date").alias("ds")).agg(
        F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue")
    )


@query()
def planted_hits(spark, sf):
    daily = series.daily_series(_planted(spark, sf).drop("order_id"), "orders")
    plan = spark.createDataFrame([(day,) for day, _, _ in PLAN], "ds STRING").select(F.to_date("ds").alias("ds"))
    return rounded(anomalies.planted_hits(anomalies.detect_anomalies(daily), plan, daily))


# ---------------------------------------------------------------- forecasts
HORIZON = 30
FOLD_CTE = """, placed AS (SELECT ds, y, row_number() OVER (ORDER BY ds) - 1 AS pos FROM daily),
size AS (SELECT count(*) AS n, least(4, (count(*) - 56) // 30) AS n_folds, min(ds) AS first_ds FROM placed),
folds AS (SELECT CAST(f AS INTEGER) AS fold, CAST(n - f * 30 AS INTEGER) AS cutoff, first_ds, n FROM size, range(0, n_folds + 1) r(f)),
wanted AS (SELECT fold, cutoff, s AS step, cutoff + s - 1 AS pos, first_ds + CAST(cutoff + s - 1 AS INTEGER) AS ds FROM folds, range(1, 31) r(s)),
naive AS (SELECT fold, step, w.ds, a.y, greatest(p.y, 0) AS yhat, a.y - greatest(p.y, 0) AS err FROM wanted w
  JOIN placed p ON p.pos = w.cutoff - 7 + (w.step - 1) % 7 LEFT JOIN placed a ON a.pos = w.pos)"""


@query(with_sales(FOLD_CTE + " SELECT 'total' AS series, fold, cutoff FROM folds", DAILY_CTE))
def fold_plan(spark, sf):
    planned = forecasting.plan_folds(revenue(spark, sf), HORIZON)
    return forecasting.fold_table(planned, HORIZON).select("series", "fold", "cutoff")


def _naive(spark, sf):
    return forecasting.predictions(revenue(spark, sf), HORIZON, models=[forecasting.BASELINE])


@query(with_sales(FOLD_CTE + f""" SELECT 'total' AS series, '{forecasting.BASELINE}' AS model, fold, CAST(step AS INTEGER) AS step, ds,
round(y, 2) AS y, round(yhat, 2) AS yhat, round(err, 2) AS err FROM naive""", DAILY_CTE))
def baseline_backtest(spark, sf):
    return rounded(_naive(spark, sf), 2)


@query(with_sales(FOLD_CTE + f""", f AS (SELECT fold, sum(abs(err)) AS ae, sum(err) AS e, sum(err * err) AS se, sum(abs(y)) AS ay, sum(y) AS y, count(*) AS days
  FROM naive WHERE fold > 0 GROUP BY 1)
SELECT 'total' AS series, '{forecasting.BASELINE}' AS model, round(sum(ae) / sum(ay) * 100, 4) AS wape, round(sqrt(sum(se) / sum(days)), 4) AS rmse,
round(sum(e) / sum(ay) * 100, 4) AS bias, round(avg(abs(e) / y * 100) FILTER (y > 0), 4) AS total_error, count(*) AS n_folds,
0.0::DOUBLE AS improvement_vs_baseline FROM f""", DAILY_CTE))
def baseline_scores(spark, sf):
    return rounded(forecasting.score_models(_naive(spark, sf)))


INTERVAL_SQL = """, q AS (SELECT quantile_cont(err, 0.025) AS a, quantile_cont(err, 0.1) AS b, quantile_cont(err, 0.9) AS c, quantile_cont(err, 0.975) AS d
  FROM naive WHERE fold > 0)"""


@query(with_sales(FOLD_CTE + INTERVAL_SQL + f""" SELECT 'total' AS series, '{forecasting.BASELINE}' AS model, ds, round(yhat, 2) AS yhat,
round(greatest(yhat + b, 0), 6) AS lower_80, round(yhat + c, 6) AS upper_80, round(greatest(yhat + a, 0), 6) AS lower_95,
round(yhat + d, 6) AS upper_95 FROM naive, q WHERE fold = 0""", DAILY_CTE))
def baseline_intervals(spark, sf):
    made = forecasting.forecast(revenue(spark, sf), HORIZON, models=[forecasting.BASELINE])
    return rounded(made.rows, 6, yhat=2)


@query(with_sales(FOLD_CTE + """ SELECT 'total' AS series, ds, round(y, 2) AS value, 'history' AS kind FROM daily WHERE ds > (SELECT max(ds) FROM daily) - 180
UNION ALL SELECT 'total', ds, round(yhat, 2), 'forecast' FROM naive WHERE fold = 0""", DAILY_CTE))
def history_and_forecast(spark, sf):
    daily = revenue(spark, sf)
    made = forecasting.forecast(daily, HORIZON, models=[forecasting.BASELINE])
    return rounded(forecasting.history_and_forecast(daily, made.rows), 2)


@query()
def model_scores(spark, sf):
    return rounded(forecasting.forecast(revenue(spark, sf), HORIZON).scores)


@query()
def revenue_forecast(spark, sf):
    return rounded(forecasting.forecast(revenue(spark, sf), HORIZON).rows, 2)


@query()
def forecast_totals_by_category(spark, sf):
    return rounded(forecasting.forecast(revenue(spark, sf, ["category"]), 60).totals(), 2)


# ---------------------------------------------------------------- what must hold for any right model, as SQL can state it
@query(with_sales("SELECT 'total' AS series, count(*) AS days, CAST(sum(y) AS DECIMAL(38,2)) AS observed, TRUE AS adds_up FROM daily", DAILY_CTE))
def decomposition_balance(spark, sf):
    """Every day is decomposed, and its parts add up to what was observed."""
    parts = anomalies.decompose(revenue(spark, sf))
    gap = F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("observed"))
    return parts.groupBy("series").agg(
        F.count(F.lit(1)).alias("days"), exact_sum("observed").cast("decimal(38,2)").alias("observed"), (F.max(gap) < 1e-4).alias("adds_up")
    )


@query(with_sales(f"""SELECT 'total' AS series, max(ds) + 1 AS first_day, max(ds) + {HORIZON} AS last_day, CAST({HORIZON} AS BIGINT) AS days,
TRUE AS ordered, TRUE AS not_negative FROM daily""".replace("max(ds) + 1", "CAST(max(ds) + 1 AS DATE)").replace(f"max(ds) + {HORIZON}", f"CAST(max(ds) + {HORIZON} AS DATE)"), DAILY_CTE))
def forecast_shape(spark, sf):
    """The forecast covers the days after the base, inside its own intervals, and never falls below zero."""
    rows = forecasting.forecast(revenue(spark, sf), HORIZON).rows
    inside = (F.col("lower_95") <= F.col("lower_80")) & (F.col("lower_80") <= F.col("upper_80")) & (F.col("upper_80") <= F.col("upper_95"))
    return rows.groupBy("series").agg(
        F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count(F.lit(1)).alias("days"),
        F.bool_and(inside).alias("ordered"), F.bool_and((F.col("yhat") >= 0) & (F.col("lower_95") >= 0)).alias("not_negative"),
    )


@query(with_sales(
    """, d AS (SELECT category AS series, CAST(date AS DATE) AS ds FROM sales WHERE date >= TIMESTAMP '2001-05-01')
SELECT series, CAST(max(ds) - min(ds) + 1 AS BIGINT) AS days, 116 AS needed FROM d GROUP BY 1 HAVING max(ds) - min(ds) + 1 < 116"""))
def series_without_forecast(spark, sf):
    """Categories of the last weeks: too short to be tested on a horizon of 60 days."""
    rows = sales(spark, sf, ["date", "category", "revenue"]).where(F.col("date") >= F.lit("2001-05-01").cast("timestamp_ntz"))
    return forecasting.short_history(series.daily_series(rows, "revenue", keys=["category"]), 60)
