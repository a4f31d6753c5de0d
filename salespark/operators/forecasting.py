"""Daily forecasts: three models compared on past windows, intervals from their real errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.functions.numeric import ratio
from salespark.operators.series import SEASON, WHOLE, with_positions
from salespark.session import ship_package, stage

# Shortest training history, number of test windows, model names.
MIN_TRAIN_DAYS = 56
MAX_FOLDS = 4
HORIZONS = (30, 60, 90)
BASELINE = "Ingênuo sazonal (baseline)"
HOLT_WINTERS = "Holt-Winters"
CALENDAR = "Regressão com calendário"
RIDGE_PENALTY = 1.0
DAMPING = (0.8, 0.995)
QUANTILES = (0.025, 0.1, 0.9, 0.975)


class InsufficientDataError(ValueError):
    """The history is too short to train and test."""


def plan_folds(daily: DataFrame, horizon: int, max_folds: int = MAX_FOLDS) -> DataFrame:
    """Add pos, n and n_folds to every series long enough for at least one test window."""
    placed = with_positions(daily)
    folds = F.least(F.lit(max_folds), F.floor((F.col("n") - MIN_TRAIN_DAYS) / F.lit(horizon))).cast("int")
    return placed.withColumn("n_folds", folds).where(F.col("n_folds") >= 1)


def short_history(daily: DataFrame, horizon: int) -> DataFrame:
    """(series, days, needed) of the series that are too short to be tested once, and so get no forecast."""
    needed = MIN_TRAIN_DAYS + horizon
    return daily.groupBy("series").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") < needed).withColumn("needed", F.lit(needed))


def fold_table(planned: DataFrame, horizon: int) -> DataFrame:
    """(series, fold, cutoff): fold f trains on the days before n − f·horizon; fold 0 is the forecast itself."""
    sizes = planned.groupBy("series").agg(
        F.max("n").alias("n"), F.max("n_folds").alias("n_folds"), F.min("ds").alias("first_ds")
    )
    folds = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("n_folds"))))
    return folds.withColumn("cutoff", (F.col("n") - F.col("fold") * horizon).cast("int"))


def targets(planned: DataFrame, horizon: int) -> DataFrame:
    """(series, fold, cutoff, step, ds, y): the days to predict; y is null for the future (fold 0)."""
    wanted = fold_table(planned, horizon).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    wanted = wanted.withColumn("pos", F.col("cutoff") + F.col("step") - 1)
    wanted = wanted.withColumn("ds", F.date_add("first_ds", F.col("pos").cast("int")))
    actual = planned.select("series", "pos", "y")
    return wanted.join(actual, ["series", "pos"], "left").select("series", "fold", "cutoff", "step", "pos", "ds", "y")


def training_rows(planned: DataFrame, horizon: int) -> DataFrame:
    """Every training day once per fold that may use it (at most five copies of a series' days)."""
    copies = planned.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("n_folds"))))
    cutoff = (F.col("n") - F.col("fold") * horizon).cast("int")
    return copies.withColumn("cutoff", cutoff).where(F.col("pos") < F.col("cutoff"))


# ------------------------------------------------------------------ models
def seasonal_naive(planned: DataFrame, wanted: DataFrame, horizon: int) -> DataFrame:
    """Repeat the last seven training days."""
    source = F.col("cutoff") - SEASON + F.pmod(F.col("step") - 1, F.lit(SEASON))
    past = planned.select("series", F.col("pos").alias("source"), F.col("y").alias("yhat"))
    return wanted.withColumn("source", source.cast("int")).join(past, ["series", "source"]).drop("source")


def _solve_calendar(cells: pd.DataFrame) -> pd.DataFrame:
    """Ridge with a free intercept, from the sums of each weekday × month cell (at most 84 rows)."""
    n, t, tt = (cells[c].to_numpy(dtype=float) for c in ("n", "t", "tt"))
    y, ty = cells["y"].to_numpy(dtype=float), cells["ty"].to_numpy(dtype=float)
    dummies = np.hstack([np.eye(7)[cells["weekday"].to_numpy()], np.eye(12)[cells["month"].to_numpy() - 1]])
    gram = np.zeros((20, 20))
    gram[0, 0] = tt.sum()
    gram[0, 1:] = gram[1:, 0] = t @ dummies
    gram[1:, 1:] = dummies.T @ (n[:, None] * dummies)
    target = np.concatenate([[ty.sum()], y @ dummies])
    total = n.sum()
    x_mean, y_mean = np.concatenate([[t.sum()], n @ dummies]) / total, y.sum() / total
    gram -= total * np.outer(x_mean, x_mean)
    weights = np.linalg.solve(gram + RIDGE_PENALTY * np.eye(20), target - total * x_mean * y_mean)
    return pd.DataFrame(
        {
            "series": [cells["series"].iloc[0]],
            "fold": [int(cells["fold"].iloc[0])],
            "base": [float(y_mean - x_mean @ weights)],
            "slope": [float(weights[0])],
            "by_weekday": [weights[1:8].tolist()],
            "by_month": [weights[8:].tolist()],
        }
    )


def calendar_regression(planned: DataFrame, wanted: DataFrame, horizon: int) -> DataFrame:
    """Linear trend plus weekday and month effects.

    The normal equations only need sums per weekday and month, which Spark aggregates; each
    (series, fold) then solves a 20 × 20 system from at most 84 rows.
    """
    years = F.col("pos") / F.lit(365.0)
    cells = training_rows(planned, horizon).groupBy(
        "series", "fold", F.weekday("ds").alias("weekday"), F.month("ds").alias("month")
    )
    cells = cells.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(years).alias("t"),
        F.sum(years * years).alias("tt"),
        F.sum("y").alias("y"),
        F.sum(years * F.col("y")).alias("ty"),
    )
    schema = "series STRING, fold INT, base DOUBLE, slope DOUBLE, by_weekday ARRAY<DOUBLE>, by_month ARRAY<DOUBLE>"
    ship_package(planned.sparkSession)
    fitted = cells.groupBy("series", "fold").applyInPandas(_solve_calendar, schema)
    yhat = (
        F.col("base")
        + F.col("slope") * years
        + F.element_at("by_weekday", F.weekday("ds") + 1)
        + F.element_at("by_month", F.month("ds"))
    )
    return wanted.join(fitted, ["series", "fold"]).withColumn("yhat", yhat).select(*wanted.columns, "yhat")


class Smoothing:
    """Additive smoothing with damped trend and weekly season, for many parameter sets at once.

    One-step errors are linear in the start state (level, trend, seven seasons that add up to zero), so the best start
    state of a parameter set follows from normal equations. The recursion runs once for what the data contribute and
    once for each unit of the start state, side by side; only the four smoothing parameters are left to a search.
    """

    STATES = 2 + SEASON - 1
    _BLOCK = 64  # days whose errors are multiplied at once

    def __init__(self, values: np.ndarray, cutoffs: np.ndarray):
        """A set of parameters learns from the first `cutoff` values."""
        self.values, self.cutoffs = values, cutoffs

    def fit(self, alpha, beta, gamma, phi):
        """Per set: least squared error, and level, trend and seasons after its last day."""
        order = np.argsort(-self.cutoffs, kind="stable")  # sets still learning are the first ones
        cutoffs = self.cutoffs[order]
        by_level, by_trend, by_season, damp = (p[order, None] for p in (alpha, alpha * beta, gamma, phi))
        width = 1 + self.STATES
        level, trend = np.zeros((len(order), width)), np.zeros((len(order), width))
        seasons = np.zeros((SEASON, len(order), width))
        level[:, 1] = trend[:, 2] = 1.0
        for slot in range(SEASON - 1):
            seasons[slot, :, 3 + slot], seasons[-1, :, 3 + slot] = 1.0, -1.0
        products = np.zeros((len(order), width, width))
        day = 0
        for stop in sorted(set(cutoffs.tolist())):
            active = int((cutoffs >= stop).sum())
            held, factors = (level[:active], trend[:active]), (by_level[:active], by_trend[:active], by_season[:active], damp[:active])
            while day < stop:
                upto = min(stop, day + self._BLOCK)
                errors = np.empty((active, width, upto - day))
                for i in range(day, upto):
                    errors[:, :, i - day] = self._step(self.values[i], *held, seasons[i % SEASON, :active], *factors)
                products[:active] += errors @ errors.transpose(0, 2, 1)
                day = upto
        start = -np.linalg.pinv(products[:, 1:, 1:], rcond=1e-12, hermitian=True) @ products[:, 1:, :1]
        mix = np.concatenate([np.ones((len(order), 1)), start[:, :, 0]], axis=1)
        sse = np.einsum("si,sij,sj->s", mix, products, mix)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        of = lambda state: (state * mix).sum(axis=-1)
        return np.maximum(sse, 0.0)[back], of(level)[back], of(trend)[back], np.stack([of(s) for s in seasons])[:, back]

    @staticmethod
    def _step(value, level, trend, season, by_level, by_trend, by_season, damp):
        trend *= damp
        level += trend
        error = -level - season
        error[:, 0] += value
        level += by_level * error
        trend += by_trend * error
        season += by_season * error
        return error


# Bounds: beta is a share of alpha, gamma of 1 - alpha; each in its open interval.
_SMALLEST, _LARGEST = np.array([1e-4, 1e-5, 1e-5, 1 - DAMPING[1]]), np.array([0.9999, 1.0, 1.0, 1 - DAMPING[0]])
_COARSE = ([0.005, 0.03, 0.1, 0.3, 0.7], [1e-4, 0.05, 0.4], [1e-4, 0.03, 0.15, 0.5], [0.005, 0.03, 0.2])
_FINEST = 0.01


def _parameters(points: np.ndarray) -> list[np.ndarray]:
    a, b, g, undamped = points.T
    return [a, a * b, (1 - a) * g, 1 - undamped]


def search_smoothing(values: np.ndarray, cutoffs: list[int]):
    """Per cutoff: least squared error found, its parameters, and level, trend and seasons at the cutoff.

    A coarse grid gives the starting points. From there one factor up and down in each parameter, and the last step
    once more, are tried together; the best becomes the centre, or the factors shrink, until they are within 1%.
    """
    folds = np.arange(len(cutoffs))
    grid = np.stack([m.ravel() for m in np.meshgrid(*_COARSE, indexing="ij")], axis=1)
    moves = np.concatenate([np.zeros((2, 4)), np.eye(4), -np.eye(4)])
    ends = np.array(cutoffs)

    def best_of(points: np.ndarray):
        """points: folds × choices × 4."""
        choices = points.shape[1]
        sse, level, trend, seasons = Smoothing(values, np.repeat(ends, choices)).fit(*_parameters(points.reshape(-1, 4)))
        at = folds * choices + sse.reshape(-1, choices).argmin(axis=1)
        return sse[at], points.reshape(-1, 4)[at], level[at], trend[at], seasons[:, at]

    found = best_of(np.tile(grid, (len(folds), 1, 1)))
    width, last = np.full(len(folds), np.log(2.0)), found[1]
    while (width > _FINEST).any():
        near = found[1][:, None, :] * np.exp(moves[None] * width[:, None, None])  # the first is the centre: nothing gets worse
        near[:, 1] *= found[1] / last
        moved = best_of(np.clip(near, _SMALLEST, _LARGEST))
        width = np.where(moved[0] < found[0] * (1 - 1e-9), width, width / 2)
        last, found = found[1], moved
    return found


def _fit_holt_winters(horizon: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        values = rows["y"].to_numpy(dtype=float)
        cutoffs = [len(values) - fold * horizon for fold in range(int(rows["n_folds"].iloc[0]) + 1)]
        _, points, level, trend, seasons = search_smoothing(values, cutoffs)
        steps = np.arange(1, horizon + 1)
        parts = []
        for fold, cutoff in enumerate(cutoffs):
            drift = trend[fold] * np.cumsum((1 - points[fold, 3]) ** steps)
            yhat = level[fold] + drift + seasons[(cutoff + steps - 1) % SEASON, fold]
            parts.append(pd.DataFrame({"series": rows["series"].iloc[0], "fold": fold, "step": steps.astype("int32"), "yhat": yhat}))
        return pd.concat(parts)

    return fit


def holt_winters(planned: DataFrame, wanted: DataFrame, horizon: int) -> DataFrame:
    """Additive smoothing with damped trend and weekly season; parameters and start state by least squared error.

    Each series is one group of at most one row per calendar day, which learns all its folds side by side.
    """
    train = planned.select("series", "pos", "y", "n_folds")
    ship_package(planned.sparkSession)
    fitted = train.groupBy("series").applyInPandas(
        _fit_holt_winters(horizon), "series STRING, fold INT, step INT, yhat DOUBLE"
    )
    return wanted.join(fitted, ["series", "fold", "step"]).select(*wanted.columns, "yhat")


MODELS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    BASELINE: seasonal_naive,
    HOLT_WINTERS: holt_winters,
    CALENDAR: calendar_regression,
}


# ------------------------------------------------------------------ backtest
def predictions(
    daily: DataFrame, horizon: int = 30, max_folds: int = MAX_FOLDS, models: list[str] | None = None
) -> DataFrame:
    """(series, model, fold, step, ds, y, yhat, err) for every model; err only where y is known."""
    planned = plan_folds(daily, horizon, max_folds)
    wanted = targets(planned, horizon)
    parts = None
    for name in models or list(MODELS):
        part = MODELS[name](planned, wanted, horizon).withColumn("model", F.lit(name))
        part = part.select("series", "model", "fold", "step", "ds", "y", "yhat")
        parts = part if parts is None else parts.unionByName(part)
    clipped = parts.withColumn("yhat", F.greatest(F.col("yhat"), F.lit(0.0)))
    return clipped.withColumn("err", F.col("y") - F.col("yhat"))


def _model_order() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))


def score_models(predicted: DataFrame) -> DataFrame:
    """Daily error (WAPE), RMSE, bias, error of window totals and gain over the baseline, per series and model."""
    per_fold = predicted.where(F.col("fold") > 0).groupBy("series", "model", "fold").agg(
        F.sum(F.abs("err")).alias("abs_err"),
        F.sum("err").alias("err"),
        F.sum(F.col("err") * F.col("err")).alias("sq_err"),
        F.sum(F.abs("y")).alias("abs_y"),
        F.sum("y").alias("y"),
        F.count(F.lit(1)).alias("days"),
    )
    total = F.avg(F.when(F.col("y") > 0, F.abs("err") / F.col("y") * 100))
    scores = per_fold.groupBy("series", "model").agg(
        (ratio(F.sum("abs_err"), F.sum("abs_y")) * 100).alias("wape"),
        F.sqrt(F.sum("sq_err") / F.sum("days")).alias("rmse"),
        (ratio(F.sum("err"), F.sum("abs_y")) * 100).alias("bias"),
        F.coalesce(total, F.lit(float("nan"))).alias("total_error"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    baseline = F.max(F.when(F.col("model") == BASELINE, F.col("wape"))).over(Window.partitionBy("series"))
    return scores.withColumn("improvement_vs_baseline", ratio(baseline - F.col("wape"), baseline) * 100)


def best_models(scores: DataFrame) -> DataFrame:
    """(series, best_model, total_error): least daily error, the simpler model on ties."""
    order = F.struct(F.coalesce(F.col("wape"), F.lit(float("inf"))), _model_order())
    return scores.groupBy("series").agg(
        F.min_by("model", order).alias("best_model"), F.min_by("total_error", order).alias("total_error")
    )


def forecast_rows(predicted: DataFrame, best: DataFrame) -> DataFrame:
    """The chosen model's future days with 80% and 95% intervals from its own past errors."""
    chosen = predicted.join(best.select("series", F.col("best_model").alias("model")), ["series", "model"])
    errors = chosen.where(F.col("fold") > 0).groupBy("series").agg(
        F.percentile("err", F.array(*[F.lit(q) for q in QUANTILES])).alias("q")
    )
    future = chosen.where(F.col("fold") == 0).join(errors, "series")
    yhat, q = F.col("yhat"), F.col("q")
    floor = F.lit(0.0)
    return future.select(
        "series",
        "model",
        "ds",
        "yhat",
        F.greatest(yhat + q[1], floor).alias("lower_80"),
        (yhat + q[2]).alias("upper_80"),
        F.greatest(yhat + q[0], floor).alias("lower_95"),
        (yhat + q[3]).alias("upper_95"),
    )


@dataclass(frozen=True)
class Forecast:
    scores: DataFrame
    best: DataFrame
    rows: DataFrame
    skipped: DataFrame  # series without a forecast, with the days they have and need

    def totals(self) -> DataFrame:
        """(series, total, total_error, best_model, horizon)."""
        sums = self.rows.groupBy("series").agg(F.sum("yhat").alias("total"), F.count(F.lit(1)).alias("horizon"))
        return sums.join(self.best, "series")


def forecast(
    daily: DataFrame, horizon: int = 30, max_folds: int = MAX_FOLDS, models: list[str] | None = None
) -> Forecast:
    """Scores, chosen model and forecast for every series with enough history.

    The predictions are written once: scores, errors and the forecast all read that small table.
    """
    predicted = stage(predictions(daily, horizon, max_folds, models), "predictions")
    scores = score_models(predicted)
    best = best_models(scores)
    return Forecast(scores, best, forecast_rows(predicted, best), short_history(daily, horizon))


def require_history(daily: DataFrame, horizon: int) -> None:
    """Raise when the single requested series cannot be tested on one window."""
    days = daily.where(F.col("series") == WHOLE).count()
    needed = MIN_TRAIN_DAYS + horizon
    if days < needed:
        raise InsufficientDataError(
            f"São necessários pelo menos {needed} dias de histórico para prever {horizon} dias (a base tem {days})."
        )


def history_and_forecast(daily: DataFrame, rows: DataFrame, history_days: int = 180) -> DataFrame:
    """The last observed days followed by the forecast days, marked by `kind`."""
    newest = F.max("ds").over(Window.partitionBy("series"))
    recent = daily.withColumn("_last", newest).where(F.col("ds") > F.date_sub("_last", history_days))
    past = recent.select("series", "ds", F.col("y").alias("value"), F.lit("history").alias("kind"))
    ahead = rows.select("series", "ds", F.col("yhat").alias("value"), F.lit("forecast").alias("kind"))
    return past.unionByName(ahead)
