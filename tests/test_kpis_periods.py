from datetime import date

import pytest
from pyspark.sql import functions as F

from salespark.operators import kpis, periods, schema, series, variance
from salespark.operators.periods import LAST_YEAR, SalesFilters

JANUARY = SalesFilters(date(2025, 1, 1), date(2025, 1, 3))


def test_kpis_of_small_table(sales_rows):
    row = kpis.sales_kpis(sales_rows, JANUARY).first()
    assert (row.revenue, row.profit, row.units, row.orders, row.avg_ticket) == (1100.0, 400.0, 7, 4, 275.0)
    assert (row.top_category, row.top_category_revenue, row.top_region) == ("Eletrônicos", 800.0, "Sudeste")
    assert row.growth_pct is None
    assert [r.revenue for r in kpis.revenue_by(sales_rows, "category").collect()] == [800.0, 200.0, 100.0]


def test_growth_against_previous(sales_rows):
    half = sales_rows.withColumns({"revenue": F.col("revenue") / 2, "date": F.col("date") - F.expr("INTERVAL 3 DAYS")})
    both = sales_rows.unionByName(half)
    assert kpis.sales_kpis(both, JANUARY).first().growth_pct == pytest.approx(100.0)
    zero = sales_rows.unionByName(half.withColumn("revenue", F.lit(0.0)))
    assert kpis.sales_kpis(zero, JANUARY).first().growth_pct is None


def test_empty_period(sales_rows):
    after = SalesFilters(date(2025, 1, 4), date(2025, 1, 6))
    row = kpis.sales_kpis(sales_rows, after).first()
    assert (row.revenue, row.orders, row.top_category, row.growth_pct) == (0.0, 0, "N/A", -100.0)
    far = SalesFilters(date(2026, 1, 4), date(2026, 1, 6))
    assert kpis.sales_kpis(sales_rows, far).first().growth_pct is None


@pytest.mark.parametrize("which", ["one", "all"])
def test_missing_cost_hides_profit(sales_rows, which):
    lost = F.lit(True) if which == "all" else F.col("product") == "Jaqueta"
    df = sales_rows.withColumn("cost", F.when(~lost, F.col("cost")))
    row = kpis.sales_kpis(df, JANUARY).first()
    assert row.profit is None and row.margin_pct is None and row.revenue == 1100.0


def test_orders_by_code_or_row(sales_rows):
    coded = sales_rows.withColumn("order_id", F.lit("P1"))
    assert coded.agg(schema.order_count(coded.columns)).first()[0] == 1
    assert sales_rows.agg(schema.order_count(sales_rows.columns)).first()[0] == 4


def test_validation_collects_all_problems(sales_rows):
    broken = sales_rows.drop("region").withColumn("revenue", -F.col("revenue")).withColumn("extra", F.lit(1))
    with pytest.raises(schema.DataValidationError) as error:
        schema.validate(broken, "vendas")
    assert "coluna ausente: region" in str(error.value) and "revenue: greater_than_or_equal_to(0)" in str(error.value)
    kept = schema.validate(sales_rows.withColumn("extra", F.lit(1)), "vendas")
    assert "extra" not in kept.columns and kept.count() == 4


@pytest.mark.parametrize(
    ("start", "end", "mode", "expected"),
    [
        ("2025-03-01", "2025-03-31", "anterior", ("2025-01-29", "2025-02-28")),
        ("2025-03-01", "2025-03-31", LAST_YEAR, ("2024-03-01", "2024-03-31")),
        ("2025-02-01", "2025-02-28", LAST_YEAR, ("2024-02-01", "2024-02-29")),
        ("2024-02-01", "2024-02-29", LAST_YEAR, ("2023-02-01", "2023-02-28")),
        ("2024-02-29", "2024-02-29", LAST_YEAR, ("2023-02-28", "2023-02-28")),
        ("2024-02-10", "2024-02-28", LAST_YEAR, ("2023-02-10", "2023-02-28")),
    ],
)
def test_comparison_window(spark, start, end, mode, expected):
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    wanted = tuple(date.fromisoformat(d) for d in expected)
    assert periods.comparison_window(first, last, mode) == wanted
    columns = periods.comparison_window_columns(F.lit(first), F.lit(last), mode)
    assert tuple(spark.range(1).select(*columns).first()) == wanted


def test_coverage_tolerance(spark):
    def covered(start, end, first):
        lits = [F.lit(d).cast("date") for d in (start, end, first)]
        return spark.range(1).select(periods.window_is_covered(*lits)).first()[0]

    assert covered("2017-01-01", "2017-08-21", "2017-01-05")
    assert not covered("2016-09-01", "2017-08-31", "2017-01-05")


def test_whole_days_and_segments(frame):
    rows = [
        ("2025-01-04 09:00:00", 1.0, "A", "Sul"), ("2025-01-31 18:30:00", 2.0, "A", "Sul"),
        ("2025-02-01 10:00:00", 3.0, "A", "Sul"), ("2025-02-28 23:59:00", 4.0, "B", "Sul"),
    ]
    df = frame(rows, "date STRING, revenue DOUBLE, category STRING, region STRING")
    current, previous = periods.filter_sales(df, SalesFilters(date(2025, 2, 1), date(2025, 2, 28)))
    assert sorted(r.revenue for r in current.collect()) == [3.0, 4.0]
    assert sorted(r.revenue for r in previous.collect()) == [1.0, 2.0]
    only_b = SalesFilters(date(2025, 2, 1), date(2025, 2, 28), ("B",))
    current, previous = periods.filter_sales(df, only_b)
    assert current.count() == 1 and previous.count() == 0


def _bridge(frame, previous, current):
    schema_text = "category STRING, revenue DOUBLE, units BIGINT"
    return variance.revenue_bridge(frame(current, schema_text), frame(previous, schema_text))


@pytest.mark.parametrize(
    ("previous", "current", "effects"),
    [
        ([("A", 100.0, 10)], [("A", 200.0, 20)], {"volume_effect": 100.0, "price_effect": 0.0, "mix_effect": 0.0}),
        ([("A", 100.0, 10)], [("A", 120.0, 10)], {"volume_effect": 0.0, "price_effect": 20.0, "mix_effect": 0.0}),
        ([("cara", 100.0, 1), ("barata", 10.0, 1)], [("cara", 200.0, 2), ("barata", 0.0, 0)], {"mix_effect": 90.0}),
    ],
)
def test_single_effects(frame, previous, current, effects):
    totals = _bridge(frame, previous, current)[1].first().asDict()
    for name, value in effects.items():
        assert totals[name] == pytest.approx(value)


@pytest.mark.parametrize(
    ("previous", "current"),
    [
        ([("A", 80.0, 10), ("C", 40.0, 2)], [("A", 100.0, 10), ("B", 50.0, 5)]),
        ([("A", 100.0, 10), ("B", 50.0, 0)], [("A", 150.0, 10), ("B", 80.0, 0)]),
    ],
)
def test_effects_sum_to_change(frame, previous, current):
    by_segment, totals = _bridge(frame, previous, current)
    t = totals.first()
    assert t.volume_effect + t.price_effect + t.mix_effect == pytest.approx(t.total_change)
    prices = {r.category: r.price for r in by_segment.collect()}
    if "C" in prices:
        assert prices["B"] == pytest.approx(0.0)


def test_empty_side_raises(frame):
    with pytest.raises(variance.EmptyPeriodError):
        _bridge(frame, [], [("A", 1.0, 1)])


def test_daily_series_fills_and_extends(frame):
    rows = [("2025-01-01 08:00:00", 1.0), ("2025-01-01 20:00:00", 2.0), ("2025-01-03 00:00:00", 3.0)]
    df = frame(rows, "date STRING, revenue DOUBLE")
    values = lambda d: [r.y for r in d.orderBy("ds").collect()]
    assert values(series.daily_series(df, "orders")) == [2.0, 0.0, 1.0]
    assert values(series.daily_series(df)) == [3.0, 0.0, 3.0]
    assert values(series.daily_series(df, end=date(2025, 1, 4))) == [3.0, 0.0, 3.0, 0.0]
    assert values(series.daily_series(df.limit(0))) == []


def test_moving_average_counts_empty_days(frame, daily):
    ten = series.moving_average(daily(range(10))).orderBy("ds").collect()
    assert ten[-1].moving_avg == pytest.approx(sum(range(3, 10)) / 7)
    df = frame([("2025-01-01", 70.0), ("2025-01-10", 70.0)], "date STRING, revenue DOUBLE")
    gaps = series.moving_average(series.daily_series(df)).orderBy("ds").collect()
    assert len(gaps) == 10 and gaps[-1].moving_avg == 10.0


def test_monthly_buckets(frame):
    rows = [("2025-01-05", 10.0, 1.0), ("2025-01-20", 20.0, 1.0), ("2025-03-03", 5.0, 1.0)]
    months = kpis.revenue_over_time(frame(rows, "date STRING, revenue DOUBLE, profit DOUBLE"), "M").orderBy("ds")
    assert [r.revenue for r in months.collect()] == [30.0, 0.0, 5.0]


def test_seasonality_ignores_partial_years(daily):
    flat_year = [100.0] * 366 + [900.0] * 31 + [100.0] * 10
    index = series.monthly_seasonality(daily(flat_year)).collect()
    assert len(index) == 12 and all(r.seasonal_index == pytest.approx(1.0) for r in index)


def test_totals_beyond_the_range_of_ten_thousandths(spark):
    from salespark.functions.numeric import exact_sum

    rows = spark.createDataFrame([(5e14,), (5e14,), (2e15,), (None,), (0.1,), (-0.3,)] + [(1e17,)] * 10, "revenue DOUBLE")
    assert rows.agg(exact_sum("revenue").alias("t")).first().t == 1e18 + 3e15 - 0.2
    cents = spark.range(1000).selectExpr("CAST(id AS DOUBLE) / 100 AS revenue")
    assert cents.agg(exact_sum("revenue").alias("t")).first().t == 4995.0
    assert cents.where("id < 0").agg(exact_sum("revenue").alias("t")).first().t == 0.0


def test_members_without_a_name_do_not_lead(spark, frame):
    import datetime as dt

    from salespark.operators import kpis
    from salespark.operators.periods import SalesFilters

    rows = [("2025-01-05", "a", None, 5.0), ("2025-01-05", None, "Sul", 50.0)]
    df = frame([(*r, 1, r[3], None, f"o{i}") for i, r in enumerate(rows)], "date STRING, category STRING, region STRING, revenue DOUBLE, units BIGINT, profit DOUBLE, cost DOUBLE, order_id STRING")
    row = kpis.sales_kpis(df, SalesFilters(dt.date(2025, 1, 1), dt.date(2025, 1, 31))).first()
    assert (row.top_category, row.top_category_revenue, row.top_region) == ("a", 5.0, "Sul")
    assert row.revenue == 55.0 and row.orders == 2
    assert kpis.sales_kpis(df, SalesFilters(dt.date(2024, 1, 1), dt.date(2024, 1, 31))).first().top_category == "N/A"
