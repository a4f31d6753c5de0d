import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from salespark.operators import customers, ranking, trends


def test_linear_trend(daily):
    rows = {r.series: r for r in trends.fit_trend(
        daily([10, 20, 30, 40], name="up").unionByName(daily([5] * 6, name="flat")).unionByName(daily([7], name="one"))
    ).collect()}
    assert rows["up"].slope_pct == pytest.approx(160.0) and rows["up"].r2 == pytest.approx(1.0)
    assert rows["flat"].slope_pct == pytest.approx(0.0)
    assert (rows["one"].slope_pct, rows["one"].r2) == (0.0, 0.0)


def test_mann_kendall_directions(daily):
    up, down = list(range(30)), [100 - i + (5 if i % 2 else -5) for i in range(40)]
    flat = [10, 12, 9, 11] * 3
    frames = [daily(v, name=n) for n, v in {"up": up, "down": down, "flat": flat, "short": [1, 2], "same": [5] * 10}.items()]
    rows = {r.series: r for r in trends.mann_kendall(frames[0].unionByName(frames[1]).unionByName(frames[2])
            .unionByName(frames[3]).unionByName(frames[4])).collect()}
    assert rows["up"].tau == pytest.approx(1.0) and rows["up"].direction == "alta"
    assert rows["down"].direction == "queda"
    assert rows["flat"].direction == "sem tendência"
    assert (rows["short"].tau, rows["short"].p_value) == (0.0, 1.0)
    assert (rows["same"].tau, rows["same"].p_value) == (0.0, 1.0)


def test_kendall_counts_against_all_pairs():
    rng = random.Random(7)
    for _ in range(30):
        values = np.array([rng.randint(0, 6) for _ in range(rng.randint(4, 40))], dtype=float)
        expected = sum(np.sign(b - a) for a, b in itertools.combinations(values, 2))
        if (values == values[0]).all():
            continue
        assert trends.kendall_row(values)[0] == expected


def test_exact_p_value_against_all_orders():
    n = 6
    balances = [trends.kendall_row(np.array(p, dtype=float))[0] for p in itertools.permutations(range(n))]
    for values in ([0, 1, 2, 3, 5, 4], [3, 1, 2, 0, 5, 4], [5, 4, 3, 2, 1, 0]):
        s, _, p = trends.kendall_row(np.array(values, dtype=float))
        share = sum(abs(b) >= abs(s) for b in balances) / len(balances)
        assert p == pytest.approx(share)


def test_declining_categories(frame):
    rows = [
        ("2025-01-01", "Moda", 100.0), ("2025-01-31", "Moda", 50.0),
        ("2025-01-01", "Beleza", 100.0), ("2025-01-31", "Beleza", 95.0),
    ]
    df = frame(rows, "date STRING, category STRING, revenue DOUBLE")
    assert [tuple(r) for r in trends.declining_categories(df).collect()] == [("Moda", pytest.approx(-50.0))]
    assert trends.declining_categories(df.where("date < '2025-01-02'")).count() == 0


def test_rfm_values(frame):
    rows = [("a", "2025-01-01", 10.0), ("a", "2025-01-10", 30.0), ("b", "2025-01-05", 5.0), (None, "2025-01-10", 9.0)]
    df = frame(rows, "customer_id STRING, date STRING, revenue DOUBLE")
    found = {r.customer_id: (r.recency, r.frequency, r.monetary) for r in customers.rfm_table(df).collect()}
    assert found == {"a": (1, 2, 40.0), "b": (6, 1, 5.0)}


def test_recency_ignores_time_of_day(frame):
    rows = [("a", "2025-01-10 23:00:00", 10.0), ("b", "2025-01-05 01:00:00", 5.0)]
    df = frame(rows, "customer_id STRING, date STRING, revenue DOUBLE")
    table = customers.rfm_table(df, dt.date(2025, 1, 31)).orderBy("customer_id")
    assert [r.recency for r in table.collect()] == [21, 26]


def test_pareto(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([80.0, 10.0, 5.0, 3.0, 2.0])], "customer_id STRING, monetary DOUBLE")
    assert customers.pareto_share(df).first()[0] == pytest.approx(80.0)


def test_too_few_customers(frame):
    df = frame([("a", "2025-01-01", 1.0), ("b", "2025-01-02", 1.0)], "customer_id STRING, date STRING, revenue DOUBLE")
    with pytest.raises(customers.TooFewCustomersError):
        customers.segment_customers(df)


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(3)
    rows = [
        (f"c{rng.randint(0, 59)}", dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 300)), round(rng.expovariate(0.01), 2))
        for _ in range(400)
    ]
    return spark.createDataFrame(rows, "customer_id STRING, date TIMESTAMP, revenue DOUBLE")


def test_segments_without_clusters(shop):
    found = customers.segment_customers(shop, with_clusters=False)
    assert found.best_k == 0 and found.clusters is None
    shares = found.segments.agg(F.sum("customers_pct"), F.sum("revenue_pct")).first()
    assert shares[0] == pytest.approx(100.0) and shares[1] == pytest.approx(100.0)


def test_scores_against_ranks(shop):
    scored = customers.add_scores(customers.rfm_table(shop)).toPandas()
    n = len(scored)
    for column, score, sign in (("recency", "r_score", -1), ("frequency", "f_score", 1), ("monetary", "m_score", 1)):
        rank = (sign * scored[column]).rank(method="min")
        assert (np.ceil(rank * 5 / n).astype(int) == scored[score]).all()


def test_clusters(shop):
    found = customers.segment_customers(shop, restarts=1)
    assert 3 <= found.best_k <= 6
    groups = found.clusters.collect()
    assert len(groups) == found.best_k and groups[0]["name"] == "Grupo 1"
    means = [g.avg_monetary for g in groups]
    assert means == sorted(means, reverse=True)
    assert sum(g.revenue_pct for g in groups) == pytest.approx(100.0)
    assert all(-1 <= r.silhouette <= 1 for r in found.silhouette_by_k.collect())


def test_heatmap_counts(spark):
    df = spark.createDataFrame([(5, 5), (5, 5), (1, 2)], "r_score INT, f_score INT")
    grid = {r.f_score: r for r in customers.score_heatmap(df).collect()}
    assert len(grid) == 5 and grid[5]["r5"] == 2 and grid[2]["r1"] == 1 and grid[1]["r1"] == 0


def test_positions_with_one_dominant_group(spark):
    """A third of the rows share one group, and ranges still give every position once."""
    rows = [("hot" if i % 3 == 0 else f"g{i % 11}", (i * 7919) % 100003) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, v BIGINT")
    placed = ranking.row_positions(df, ["v"], within=["g"]).toPandas()
    for _, part in placed.groupby("g"):
        ordered = part.sort_values("pos")
        assert list(ordered["pos"]) == list(range(1, len(part) + 1))
        assert ordered["v"].is_monotonic_increasing


def test_running_totals_with_repeated_values(spark):
    df = spark.createDataFrame([(i % 40, 1 + i % 3) for i in range(500)], "v INT, w INT").groupBy("v").agg(F.sum("w").alias("w"))
    out = ranking.running_total(df, ["v"], F.col("w"), total="all").orderBy("v").toPandas()
    assert list(out["upto"]) == list(out["w"].cumsum()) and set(out["all"]) == {out["w"].sum()}


def test_surrogate_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k STRING")
    assert {r.k: r.code for r in ranking.surrogate_codes(df, "k", "C", 5).collect()} == {"a": "C00001", "b": "C00002"}
