"""Rounds of K-Means: one job of one stage each, sums as from all distances."""

from __future__ import annotations

import numpy as np

from salespark.operators import clustering


def test_a_round_is_one_job(spark):
    """tasks hand their sums to the driver, without a shuffle; before, each round was two jobs."""
    points = clustering.equal_as_one(spark.createDataFrame([(float(i % 97), float(i * 7 % 89)) for i in range(3000)], "a double, b double"), ["a", "b"]).persist()
    points.count()
    context, jobs = spark.sparkContext, []
    for rounds in (2, 5):
        context.setJobGroup(f"rounds {rounds}", "rounds")
        try:
            clustering.fit_all(points, ["a", "b"], (4, 5), 6, 3, max_iter=rounds, tol=-1.0)  # never settled
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    assert jobs[1] - jobs[0] == 3
    points.unpersist()


def test_sums_of_a_batch():
    pick = np.random.default_rng(1)
    x = np.round(pick.normal(size=(2500, 3)), 1)
    weight = pick.integers(1, 4, len(x)).astype(float)
    models = [clustering.Model(k, np.round(pick.normal(size=(k, 3)), 1)) for k in (3, 2, 3, 6)]
    models[0].centres[1] = models[0].centres[0]  # ties go to the first
    found = np.split(clustering._add_up(x, weight, models), np.cumsum([m.k for m in models])[:-1])
    for m, part in zip(models, found, strict=True):
        squared = ((x[:, None] - m.centres[None]) ** 2).sum(axis=2)
        # of equal squares up to rounding either centre may be the nearest; the twin centre never is
        assert abs(part[:, 1].sum() - squared.min(axis=1) @ weight) < 1e-6 and part[:, 0].sum() == weight.sum()
        assert np.allclose(part[:, 2:].sum(axis=0), weight @ x)
    assert found[0][1, 0] == 0
    apart = x + pick.normal(size=x.shape) * 1e-3
    found = np.split(clustering._add_up(apart, weight, models), np.cumsum([m.k for m in models])[:-1])
    for m, part in zip(models, found, strict=True):
        group = ((apart[:, None] - m.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.array_equal(part[:, 0], np.bincount(group, weight, m.k))
        assert np.allclose(part[:, 2:], [weight[group == g] @ apart[group == g] for g in range(m.k)])
    x[7, 2] = np.nan  # goes to the first group and spoils its centre only
    found = clustering._add_up(x, weight, models[3:])
    assert np.isnan(found[0, 2:]).any() and np.isfinite(found[1:, 2:]).all() and found[:, 0].sum() == weight.sum()
