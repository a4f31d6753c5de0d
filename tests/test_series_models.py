import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salespark.operators import anomalies, forecasting, planting, series


def _noise(seed, n, scale):
    return np.random.default_rng(seed).normal(0, scale, n)


def _weekly(n, base, dip):
    return np.array([base - (dip if i % 7 >= 5 else 0) for i in range(n)], dtype=float)


@pytest.mark.parametrize("seed", range(5))
def test_calm_series_has_no_anomaly(daily, seed):
    assert anomalies.detect_anomalies(daily(_weekly(120, 100, 20) + _noise(seed, 120, 2))).count() == 0


def test_planted_peak_is_first(daily):
    values = _weekly(120, 100, 20) + _noise(1, 120, 3)
    values[60] = 400
    first = anomalies.detect_anomalies(daily(values)).orderBy(*anomalies.by_severity()).first()
    assert first.ds == dt.date(2024, 1, 1) + dt.timedelta(days=60)
    assert first.kind == "pico" and first.deviation_pct > 200


def test_materiality(daily):
    values = np.full(120, 100.0) + np.where(np.arange(120) % 2 == 0, 0.5, -0.5)
    values[60] = 110
    assert anomalies.detect_anomalies(daily(values)).count() == 0
    assert anomalies.detect_anomalies(daily(values), min_deviation_pct=5).count() > 0


def test_constant_series_has_no_score(daily):
    assert anomalies.detect_anomalies(daily([50.0] * 60)).count() == 0


def test_short_history(daily):
    with pytest.raises(anomalies.ShortHistoryError):
        anomalies.require_history(daily(range(10)))
    assert anomalies.decompose(daily(range(10))).count() == 0
    assert anomalies.short_series(daily(range(10))).first().days == 10


def test_decomposition_recovers_parts(daily):
    n = 210
    season = np.array([3.0, 1, 0, -1, -2, -3, 2])
    values = 50 + 0.1 * np.arange(n) + np.resize(season, n) + _noise(1, n, 0.05)
    fit = anomalies.decompose(daily(values)).orderBy("ds").toPandas()
    assert np.allclose(fit["trend"] + fit["seasonal"] + fit["resid"], values)
    assert np.abs(fit["seasonal"] - np.resize(season, n)).max() < 0.15
    assert np.abs(fit["trend"] - 50 - 0.1 * np.arange(n)).max() < 0.15
    profile = anomalies.weekday_profile(anomalies.decompose(daily(values))).collect()
    assert [r.weekday for r in profile] == list(range(7)) and profile[0].effect == pytest.approx(3.0, abs=0.05)


def test_loess_reproduces_a_line_and_follows_trust():
    x = np.arange(40, dtype=float)
    smooth = anomalies._Loess(40, 9, np.arange(40))
    assert np.allclose(smooth(2 * x + 1), 2 * x + 1)
    spoiled = 2 * x + 1
    spoiled[20] += 500
    trust = np.ones(40)
    trust[20] = 0
    assert np.allclose(smooth(spoiled, trust), 2 * x + 1)
    ends = anomalies._Loess(12, 31, np.arange(-1, 13))
    assert np.allclose(ends(3 * np.arange(12.0)), 3 * np.arange(-1, 13))


def test_planting(frame):
    rows = [("2025-01-01", f"o{i:02d}", 10.0) for i in range(20)] + [("2025-01-02", "x", 1.0)] * 2 + [("2025-01-03", "y", 2.0)]
    df = frame(rows, "date STRING, order_id STRING, revenue DOUBLE")
    out = planting.inject_anomalies(df, [("2025-01-01", "queda", 0.15), ("2025-01-02", "pico", 3.0)])
    counts = {str(r.d): r.n for r in out.groupBy(F.to_date("date").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert counts == {"2025-01-01": 3, "2025-01-02": 6, "2025-01-03": 1}
    copies = frame([("2025-01-01", "same", 10.0)] * 20 + [("2025-01-01", "zz", 1.0)], "date STRING, order_id STRING, revenue DOUBLE")
    kept = planting.inject_anomalies(copies, [("2025-01-01", "queda", 0.2)]).groupBy("order_id").count().collect()
    assert {r.order_id: r["count"] for r in kept} == {"same": 4, "zz": 1}


def test_planted_days_are_found(daily):
    values = np.maximum(_weekly(400, 60, 12) + _noise(5, 400, 3), 0)
    plan = {100: 0.15, 200: 3.0, 300: 0.15}
    for day, factor in plan.items():
        values[day] *= factor
    made = daily(values)
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=d),) for d in plan]
    planted = made.sparkSession.createDataFrame(days, "ds DATE")
    row = anomalies.planted_hits(anomalies.detect_anomalies(made), planted, made).first()
    assert (row.hits, row.planted) == (3, 3) and row.false_alarm_pct < 1


def test_event_labels(daily):
    windows = [("a", dt.date(2024, 1, 1), dt.date(2024, 1, 5)), ("b", dt.date(2024, 1, 4), dt.date(2024, 1, 6))]
    labels = [r.event for r in anomalies.label_events(daily(range(7)), windows).orderBy("ds").collect()]
    assert labels == ["a", "a", "a", "b", "b", "b", "outros"]


def _trending(n, seed=0):
    t = np.arange(n)
    return 200 + 0.2 * t + np.where(t % 7 >= 5, -30, 10) + _noise(seed, n, 5)


def test_forecast_beats_baseline(daily):
    made = forecasting.forecast(daily(_trending(400)), 30)
    rows = made.rows.orderBy("ds").collect()
    assert len(rows) == 30
    for r in rows:
        assert 0 <= r.lower_95 <= r.lower_80 <= r.yhat <= r.upper_80 <= r.upper_95
    best = made.best.first()
    assert best.best_model != forecasting.BASELINE
    gain = made.scores.where(F.col("model") == best.best_model).first()
    assert gain.improvement_vs_baseline > 0 and gain.n_folds == 4
    assert made.totals().first().total == pytest.approx(sum(r.yhat for r in rows))
    t = np.arange(400, 430)
    assert np.mean([abs(r.yhat - v) / v for r, v in zip(rows, 200 + 0.2 * t + np.where(t % 7 >= 5, -30, 10))]) < 0.05


def test_folds(daily):
    planned = forecasting.plan_folds(daily(_trending(116)), 30)
    assert planned.first().n_folds == 2
    assert forecasting.plan_folds(daily(_trending(66)), 30).count() == 0
    with pytest.raises(forecasting.InsufficientDataError):
        forecasting.require_history(daily(_trending(66)), 30)


def test_calendar_regression_equals_direct_solution(daily):
    values, horizon = _trending(400, 2), 30
    start = dt.date(2024, 1, 1)
    planned = forecasting.plan_folds(daily(values), horizon)
    out = forecasting.calendar_regression(planned, forecasting.targets(planned, horizon), horizon)
    got = out.where("fold = 0").orderBy("step").toPandas()["yhat"].to_numpy()

    def features(first, count):
        days = [start + dt.timedelta(days=first + i) for i in range(count)]
        x = np.zeros((count, 20))
        x[:, 0] = (first + np.arange(count)) / 365
        for i, d in enumerate(days):
            x[i, 1 + d.weekday()] = x[i, 7 + d.month] = 1
        return x

    x = features(0, 400)
    xc, yc = x - x.mean(axis=0), values - values.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(20), xc.T @ yc)
    expected = values.mean() + (features(400, horizon) - x.mean(axis=0)) @ w
    assert np.allclose(got, expected)


def test_holt_winters_follows_season_and_trend(daily):
    t = np.arange(300)
    values = 100 + np.resize([5.0, 0, 0, 0, 0, -10, 5], 300)
    planned = forecasting.plan_folds(daily(values), 30)
    out = forecasting.holt_winters(planned, forecasting.targets(planned, 30), 30).where("fold > 0").toPandas()
    assert np.abs(out["y"] - out["yhat"]).max() < 1.0
    assert len(t) == 300


def test_total_error_rule(spark):
    rows = [("s", forecasting.BASELINE, f, 1, y, e) for f, y, e in [(1, 0.0, 5.0), (2, 30.0, 3.0)]]
    made = spark.createDataFrame(rows, "series STRING, model STRING, fold INT, step INT, y DOUBLE, err DOUBLE")
    assert forecasting.score_models(made).first().total_error == pytest.approx(10.0)
    zero = forecasting.score_models(made.withColumn("y", F.lit(0.0))).first()
    assert math.isnan(zero.total_error)


def test_many_series_in_one_job(daily):
    many = daily(_trending(200), name="a").unionByName(daily(_trending(200, 1), name="b")).unionByName(daily(range(40), name="short"))
    found = {r.series for r in forecasting.forecast(many, 30).best.collect()}
    assert found == {"a", "b"}


def test_sparkline_weeks(frame):
    rows = [(str(dt.date(2025, 1, 1) + dt.timedelta(days=i)), 1.0) for i in range(40)]
    points = series.sparkline(frame(rows, "date STRING, revenue DOUBLE")).orderBy("bucket").collect()
    assert [p.revenue for p in points] == [7.0] * 5 and points[0].bucket == dt.date(2025, 1, 6)
