"""Joint K-Means against MLlib, Euclidean silhouettes against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from salespark.operators import clustering, customers
from salespark.plans import customer_queries

COLUMNS = ["recency_z", "frequency_z", "monetary_z"]


@pytest.fixture(scope="module")
def points(spark):
    found = customers.cluster_features(customers.segment_rows(customer_queries.rfm(spark, SMALL)))
    return found.select(*COLUMNS).persist()


@pytest.fixture(scope="module")
def models(points):
    return clustering.fit_all(points, COLUMNS, (2, 3, 4, 5, 6), 10, 42)


def groups(x, model):
    return ((x[:, None] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def silhouette(x, labels):
    if len(set(labels)) < 2:
        return 0.0
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, same].sum() / (same.sum() - 1)
        b = min(far[i, labels == g].mean() for g in set(labels) if g != own)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def test_costs_equal_those_of_mllib(points, models):
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(points).persist()
    for k in (2, 4):
        best = min(KMeans(k=k, seed=s, maxIter=100, tol=1e-6).fit(vectors).summary.trainingCost for s in range(4))
        assert models[k].cost <= best * (1 + 1e-6)


def test_rounds_share_one_job(spark, points):
    context = spark.sparkContext
    context.setJobGroup("joint", "joint fits")
    try:
        clustering.fit_all(points, COLUMNS, (2, 3, 4, 5, 6), 10, 7, max_iter=3)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # the sample, three rounds and the costs; adaptive execution runs each round's two stages as jobs of their own
    assert len(context.statusTracker().getJobIdsForGroup("joint")) <= 2 * 5


def test_silhouettes_equal_all_distances(points, models):
    x = np.array([tuple(r) for r in points.collect()])
    want = {k: silhouette(x, groups(x, m)) for k, m in models.items()}
    for block in (16384, 40):
        found = clustering.euclidean_silhouettes(points, COLUMNS, models, block=block)
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)
    rough = clustering.euclidean_silhouettes(points, COLUMNS, models, grain=1 / 128)
    assert all(abs(rough[k] - want[k]) < 0.01 for k in want)


def test_copies_single_groups_and_one_place(spark):
    rows = [(0.0, 0.0), (0.0, 0.0), (0.0, 0.1), (5.0, 5.0), (9.0, -3.0)]
    table = spark.createDataFrame(rows, "a double, b double")
    models = {k: clustering.Model(k, np.array([(0.0, 0.0), (5.0, 5.0), (9.0, -3.0)])[:k]) for k in (1, 2, 3)}
    found = clustering.euclidean_silhouettes(table, ["a", "b"], models)
    x = np.array(rows)
    assert all(abs(found[k] - silhouette(x, groups(x, m))) < 1e-12 for k, m in models.items())
    same = spark.createDataFrame([(1.0, 1.0)] * 20, "a double, b double")
    fitted = clustering.fit_all(same, ["a", "b"], (2, 3), restarts=2)
    assert fitted[3].cost == 0 and clustering.euclidean_silhouettes(same, ["a", "b"], fitted) == {2: 0.0, 3: 0.0}


def test_equal_points_are_one_with_a_weight(spark, monkeypatch):
    """a round reads each place once, however many points lie there; centres are the same."""
    rows = [(float(i % 3) * 5, float(i % 7) / 10) for i in range(210)]
    points = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE")
    read, sums = [], clustering._sums
    monkeypatch.setattr(clustering, "_sums", lambda p, *rest: read.append(p.count()) or sums(p, *rest))
    model = clustering.fit_all(clustering.equal_as_one(points, ["x", "y"]), ["x", "y"], [3], restarts=5)[3]
    assert set(read) == {21}
    assert sorted(model.centres[:, 0].round(6)) == [0.0, 5.0, 10.0]
    assert model.centres[:, 1].round(6).tolist() == [0.3] * 3
    assert abs(model.cost - 210 * 0.04) < 1e-6
