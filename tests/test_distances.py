"""Summed distances by cell against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from salespark.operators import clustering, distances


def silhouette(x, labels):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1 or len(set(labels)) < 2:
            scores.append(0.0)
            continue
        a = far[i, same].sum() / (same.sum() - 1)
        b = min(far[i, labels == g].mean() for g in set(labels) if g != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("dimensions", [1, 2, 3])
def test_far_sums_equal_all_distances(dimensions):
    pick = np.random.default_rng(dimensions)
    x = np.concatenate([pick.normal(size=(400, dimensions)), pick.normal(size=(200, dimensions)) * 0.2 - 9])
    weight, edge = pick.integers(1, 5, len(x)).astype(float), 0.5
    weight[:50] = 0  # their cells need sums, but may hold no source
    at = np.floor(x / edge).astype(int)
    cells, place = np.unique(at, axis=0, return_inverse=True)
    place = place.reshape(-1)
    values = distances.basis((x / edge - at - 0.5) * 2)
    assert np.allclose(values.sum(axis=1), 1)
    moments = np.zeros((len(cells), distances.ORDER**dimensions))
    np.add.at(moments, place, values * weight[:, None])
    held = np.bincount(place, weight) > 0
    sums = distances.far_sums(cells, cells[held], moments[held], edge)
    found = (values * sums[place]).sum(axis=1)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    touch = (abs(at[:, None] - at[None]) <= 1).all(axis=2)
    assert np.allclose(found, np.where(touch, 0, apart) @ weight, rtol=1e-6)
    near = np.stack([distances.near_sums(x[i : i + 1], x[touch[i]], weight[touch[i], None])[0, 0] for i in range(len(x))])
    assert np.allclose(found + near, apart @ weight, rtol=1e-7)


def test_silhouettes_by_cell_equal_all_distances(spark, monkeypatch):
    """beyond `all_pairs` places the distances of all pairs of places are no longer computed."""
    pick = np.random.default_rng(4)
    x = np.concatenate([pick.normal(size=(500, 3)), pick.normal(size=(150, 3)) * 0.3 + 4, [[-30.0, 2.0, 0.0]]])
    x = np.concatenate([x, x[:40], x[:40]])  # places with several points
    points = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    centres = np.array([(0.0, 0.0, 0.0), (4.0, 4.0, 4.0), (-30.0, 2.0, 0.0), (1.0, 1.0, 0.0), (90.0, 0.0, 0.0)])
    models = {k: clustering.Model(k, centres[:k]) for k in (1, 2, 3, 4, 5)}  # a group of one point, and one without
    label = {k: ((x[:, None] - m.centres[None]) ** 2).sum(axis=2).argmin(axis=1) for k, m in models.items()}
    want = {k: silhouette(x, label[k]) for k in models}
    pairs = clustering.euclidean_silhouettes(points, ["a", "b", "c"], models, block=200)
    monkeypatch.setattr(clustering, "_scores_of_pairs", None)
    for crowd in (4, 1000):
        found = clustering.euclidean_silhouettes(points, ["a", "b", "c"], models, all_pairs=100, crowd=crowd)
        assert all(abs(found[k] - want[k]) < 1e-8 and abs(pairs[k] - want[k]) < 1e-12 for k in models), (crowd, found, want)


def test_places_without_a_number_are_not_dealt_into_cells(spark):
    rows = [(float(i % 9), float(i % 7)) for i in range(63)] + [(None, 1.0)]
    points = spark.createDataFrame(rows, "a double, b double")
    models = {2: clustering.Model(2, np.array([(1.0, 1.0), (7.0, 4.0)]))}
    found = clustering.euclidean_silhouettes(points, ["a", "b"], models, all_pairs=10)
    assert np.isnan(found[2])
