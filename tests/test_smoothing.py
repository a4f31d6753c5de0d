"""Start states and parameters of the smoothing model against plain recursions and least squares."""

from __future__ import annotations

import numpy as np

from salespark.operators.forecasting import SEASON, Smoothing, search_smoothing


def run(values, alpha, beta, gamma, phi, level, trend, seasons):
    """The textbook recursion, one value at a time."""
    seasons, errors = list(seasons), []
    for i, y in enumerate(values):
        ahead, season = level + phi * trend, seasons[i % SEASON]
        errors.append(y - ahead - season)
        new = alpha * (y - season) + (1 - alpha) * ahead
        trend = beta * (new - level) + (1 - beta) * phi * trend
        seasons[i % SEASON] = gamma * (y - ahead) + (1 - gamma) * season
        level = new
    return np.array(errors), level, trend, seasons


def least_squares(values, *parameters):
    """The best start state, from explicit columns."""
    states = [(1, 0, [0] * 7), (0, 1, [0] * 7)] + [(0, 0, [int(i == j) - int(i == 6) for i in range(7)]) for j in range(6)]
    data = run(values, *parameters, 0, 0, [0] * 7)[0]
    columns = np.stack([run(np.zeros(len(values)), *parameters, *state)[0] for state in states], axis=1)
    x = np.linalg.lstsq(columns, -data, rcond=None)[0]
    seasons = sum(x[k] * np.array(states[k][2]) for k in range(8))
    return run(values, *parameters, x[0], x[1], seasons)


def series(seed, n=180):
    pick = np.random.default_rng(seed)
    day = np.arange(n)
    return 100 + 0.3 * day * (seed % 3) + 20 * np.sin(day * 2 * np.pi / 7) + np.cumsum(pick.normal(0, seed % 4, n)) + pick.normal(0, 5, n)


def test_start_states_are_the_least_squares_ones():
    sets = np.array([(0.3, 0.1, 0.2, 0.9), (0.02, 0.01, 0.05, 0.99), (0.9, 0.5, 0.05, 0.8)])
    values = series(5)
    for cutoffs in ([180, 180, 180], [100, 180, 57]):
        sse, level, trend, seasons = Smoothing(values, np.array(cutoffs)).fit(*sets.T)
        for i, (cutoff, of_set) in enumerate(zip(cutoffs, sets, strict=True)):
            errors, want_level, want_trend, want_seasons = least_squares(values[:cutoff], *of_set)
            assert np.isclose(sse[i], (errors**2).sum(), rtol=1e-8)
            ahead = [want_level + want_trend * of_set[3] + s for s in want_seasons]  # level and seasons may trade a constant
            assert np.allclose([level[i] + trend[i] * of_set[3] + s for s in seasons[:, i]], ahead, rtol=1e-7)


def test_a_plain_week_is_continued():
    """No noise: every week adds 14 units to the same seven values; nothing is left to explain."""
    week = np.array([10.0, 12, 9, 15, 20, 30, 5])
    flat = np.tile(week, 12)
    sse, points, level, trend, seasons = search_smoothing(flat, [84])
    assert sse[0] < 1e-6 and np.allclose(level[0] + seasons[:, 0] + trend[0] * (1 - points[0, 3]), week, atol=1e-3)


def heuristic_error(values, a, b, g, p):
    """Start state from the first weeks, as simple implementations have it."""
    first, second = values[:7].mean(), values[7:14].mean()
    cycles = min(len(values) // 7, 8)
    blocks = values[: cycles * 7].reshape(cycles, 7)
    pattern = (blocks - blocks.mean(axis=1, keepdims=True)).mean(axis=0)
    return (run(values, a, a * b, (1 - a) * g, p, first, (second - first) / 7, pattern)[0] ** 2).sum()


def test_error_is_below_every_set_of_a_grid():
    for seed in range(6):
        values = series(seed)
        sse, points, *_ = search_smoothing(values, [len(values), len(values) - 60])
        grid = [heuristic_error(values, a, b, g, p) for a in (0.005, 0.05, 0.2, 0.7) for b in (1e-4, 0.2) for g in (1e-4, 0.08, 0.5) for p in (0.8, 0.97, 0.995)]
        assert sse[0] <= min(grid) * (1 + 1e-9) and sse[1] <= sse[0]
        assert ((points >= [1e-4, 1e-5, 1e-5, 0.005 - 1e-12]) & (points <= [0.9999, 1, 1, 0.2 + 1e-12])).all()


def test_constant_and_short_series():
    for values in (np.zeros(60), np.full(60, 7.0)):
        sse, _, level, trend, seasons = search_smoothing(values, [60])
        assert sse[0] < 1e-9 and np.allclose(level[0] + trend[0] + seasons[:, 0], values[0], atol=1e-6)
