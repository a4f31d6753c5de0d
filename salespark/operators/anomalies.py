"""Seasonal decomposition (STL) and unusual days.

A day stands out when its residual on the log scale is extreme by the robust score
(residual − median) / (1.4826 · MAD) and its deviation from the expected value is material.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.operators.series import SEASON, WHOLE
from salespark.session import ship_package

# Shortest history, score limit, materiality (%), and the two smoother settings.
MIN_DAYS = 28
SCORE_LIMIT = 3.5
MIN_DEVIATION_PCT = 20.0
MAD_SCALE = 1.4826
VIEW_WINDOWS = {"seasonal": 7, "trend": 15}
DETECTION_WINDOWS = {"seasonal": 31, "trend": 61}
LOW_PASS = 9
INNER_PASSES, ROBUST_PASSES = 2, 15
PEAK, DROP = "pico", "queda"
OTHER_EVENT = "outros"


class ShortHistoryError(ValueError):
    """The series is too short to decompose."""


class _Loess:
    """Local linear smoother on evenly spaced values, set up once per length and window."""

    def __init__(self, length: int, window: int, at: np.ndarray) -> None:
        size = min(window, length)
        left = np.clip(at - (window - 1) // 2, 0, length - size) if window < length else np.zeros(len(at), int)
        self.index = left[:, None] + np.arange(size)[None, :]
        distance = np.abs(self.index - at[:, None])
        reach = np.maximum(at - left, left + size - 1 - at).astype(float)
        if window > length:
            reach += (window - length) // 2
        scaled = distance / np.maximum(reach, 1e-12)[:, None]
        weight = (1 - np.minimum(scaled, 1) ** 3) ** 3
        weight[scaled <= 0.001] = 1.0
        weight[scaled > 0.999] = 0.0
        self.weight, self.at, self.length = weight, at, length

    def __call__(self, values: np.ndarray, trust: np.ndarray | None = None) -> np.ndarray:
        """Smooth the last axis; `trust` holds the robustness weight of every value."""
        x = self.index.astype(float)
        weight = self.weight if trust is None else self.weight * trust[..., self.index]
        mass = weight.sum(axis=-1, keepdims=True)
        weight = weight / np.where(mass > 0, mass, 1.0)
        center = (weight * x).sum(axis=-1, keepdims=True)
        spread = (weight * (x - center) ** 2).sum(axis=-1, keepdims=True)
        sloped = np.sqrt(spread) > 0.001 * (self.length - 1)
        slope = np.where(sloped, (self.at[:, None] - center) / np.where(spread > 0, spread, 1.0), 0.0)
        smooth = (weight * (1 + slope * (x - center)) * values[..., self.index]).sum(axis=-1)
        own = values[..., np.clip(self.at, 0, self.length - 1)]
        return np.where(mass[..., 0] > 0, smooth, own)


def _mean_filter(values: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], values]))
    return (total[width:] - total[:-width]) / width


def _trust_weights(residual: np.ndarray) -> np.ndarray:
    size = np.abs(residual)
    limit = 6 * np.median(size)
    if limit == 0:
        return np.ones_like(size)
    scaled = size / limit
    trust = (1 - np.minimum(scaled, 1) ** 2) ** 2
    trust[scaled <= 0.001] = 1.0
    trust[scaled > 0.999] = 0.0
    return trust


def stl(values: np.ndarray, seasonal: int, trend: int, period: int = SEASON) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) of the robust seasonal-trend decomposition by Loess (Cleveland et al., 1990)."""
    n = len(values)
    phases = [np.arange(p, n, period) for p in range(period)]
    by_length: dict[int, list[int]] = {}
    for phase, places in enumerate(phases):
        by_length.setdefault(len(places), []).append(phase)
    cycle = {k: _Loess(k, seasonal, np.arange(-1, k + 1)) for k in by_length}
    low, level_fit = _Loess(n, LOW_PASS, np.arange(n)), _Loess(n, trend, np.arange(n))

    level, season, trust = np.zeros(n), np.zeros(n), None
    for outer in range(ROBUST_PASSES + 1):
        for _ in range(INNER_PASSES):
            detrended = values - level
            extended = np.empty(n + 2 * period)
            for k, members in by_length.items():
                places = np.array([phases[p] for p in members])
                smooth = cycle[k](detrended[places], None if trust is None else trust[places])
                for row, phase in enumerate(members):
                    extended[phase : phase + period * (k + 2) : period] = smooth[row]
            passed = _mean_filter(_mean_filter(_mean_filter(extended, period), period), 3)
            season = extended[period : period + n] - low(passed)
            level = level_fit(values - season, trust)
        if outer < ROBUST_PASSES:
            trust = _trust_weights(values - level - season)
    return level, season


def _enough_days(daily: DataFrame) -> DataFrame:
    counted = daily.withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy("series")))
    return counted.where(F.col("_days") >= MIN_DAYS).drop("_days")


def short_series(daily: DataFrame) -> DataFrame:
    """(series, days) of the series without the required history."""
    return daily.groupBy("series").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") < MIN_DAYS)


def require_history(daily: DataFrame) -> None:
    """Raise when a single requested series is too short."""
    days = daily.where(F.col("series") == WHOLE).count()
    if days < MIN_DAYS:
        raise ShortHistoryError(
            f"São necessários pelo menos {MIN_DAYS} dias de histórico (a base tem {days})."
        )


def decompose(daily: DataFrame, seasonal: int = VIEW_WINDOWS["seasonal"], trend: int = VIEW_WINDOWS["trend"]) -> DataFrame:
    """(series, ds, observed, trend, seasonal, resid) of every gap-filled series with enough days.

    Series run in parallel; a group is one aggregated series, at most one row per calendar day.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        values = rows["y"].to_numpy(dtype=float)
        level, season = stl(values, seasonal, trend)
        return pd.DataFrame(
            {
                "series": rows["series"].to_numpy(),
                "ds": rows["ds"].to_numpy(),
                "observed": values,
                "trend": level,
                "seasonal": season,
                "resid": values - level - season,
            }
        )

    schema = "series STRING, ds DATE, observed DOUBLE, trend DOUBLE, seasonal DOUBLE, resid DOUBLE"
    ship_package(daily.sparkSession)
    return _enough_days(daily).select("series", "ds", "y").groupBy("series").applyInPandas(fit, schema)


def weekday_profile(decomposition: DataFrame) -> DataFrame:
    """Mean seasonal effect per weekday (0 = Monday), in the unit of the series."""
    by_day = decomposition.groupBy("series", F.weekday("ds").alias("weekday"))
    return by_day.agg(F.avg("seasonal").alias("effect")).orderBy("series", "weekday")


def score_residuals(fit: DataFrame) -> DataFrame:
    """Add `score` to (series, …, resid): distance from the series' median in robust deviations; null when MAD is 0."""
    whole = Window.partitionBy("series")
    centered = fit.withColumn("_off", F.col("resid") - F.median("resid").over(whole))
    spread = F.median(F.abs("_off")).over(whole)
    return centered.withColumn("_mad", spread).withColumn(
        "score", F.col("_off") / (F.nullif(F.col("_mad"), F.lit(0.0)) * MAD_SCALE)
    ).drop("_off", "_mad")


def flag_days(
    scored: DataFrame, threshold: float = SCORE_LIMIT, min_deviation_pct: float = MIN_DEVIATION_PCT
) -> DataFrame:
    """Unusual days from a scored log-scale fit with columns value, trend, seasonal and score."""
    expected = F.expm1(F.col("trend") + F.col("seasonal"))
    deviation = (F.col("value") - F.col("expected")) / F.greatest(F.col("expected"), F.lit(1e-9)) * 100
    rows = scored.withColumn("expected", expected).withColumn("deviation_pct", deviation)
    flagged = rows.where((F.abs("score") > threshold) & (F.abs("deviation_pct") >= min_deviation_pct))
    kind = F.when(F.col("score") > 0, PEAK).otherwise(DROP)
    return flagged.select("series", "ds", "value", "expected", "deviation_pct", "score", kind.alias("kind"))


def by_severity() -> list[Column]:
    return [F.desc(F.abs("score")), F.col("ds")]


def detect_anomalies(
    daily: DataFrame, threshold: float = SCORE_LIMIT, min_deviation_pct: float = MIN_DEVIATION_PCT
) -> DataFrame:
    """(series, ds, value, expected, deviation_pct, score, kind) of unusual days; order with `by_severity`."""
    logs = daily.withColumn("y", F.log1p(F.greatest(F.col("y"), F.lit(0.0))))
    fit = decompose(logs, **DETECTION_WINDOWS)
    scored = score_residuals(fit).join(daily.select("series", "ds", F.col("y").alias("value")), ["series", "ds"])
    return flag_days(scored, threshold, min_deviation_pct)


def top_in_period(found: DataFrame, start, end, limit: int) -> DataFrame:
    """The most extreme days inside a period (detection itself uses the whole history)."""
    return found.where(F.col("ds").between(F.lit(start), F.lit(end))).orderBy(*by_severity()).limit(limit)


def label_events(days: DataFrame, windows: list[tuple[str, date, date]]) -> DataFrame:
    """Add `event`: the last matching window of (name, start, end), or "outros".

    The windows are a short list written by a person, so each day looks them up in a constant array:
    the interval match needs no join.
    """
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
            for name, start, end in windows
        ]
    )
    matching = F.filter(known, lambda w: F.col("ds").between(w["start"], w["end"]))
    return days.withColumn("event", F.coalesce(F.try_element_at(matching, F.lit(-1))["name"], F.lit(OTHER_EVENT)))


def event_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("event").agg(F.count(F.lit(1)).alias("days")).orderBy(F.desc("days"), "event")


def planted_hits(found: DataFrame, planted: DataFrame, daily: DataFrame) -> DataFrame:
    """Per series: planted days found, alerts, and false alarms as % of all days."""
    days = planted.select("ds").distinct()
    marked = found.join(days.withColumn("planted", F.lit(True)), "ds", "left")
    counts = marked.groupBy("series").agg(F.count("planted").alias("hits"), F.count(F.lit(1)).alias("alerts"))
    sizes = daily.groupBy("series").agg(F.count(F.lit(1)).alias("days"))
    total = days.agg(F.count(F.lit(1)).alias("n")).scalar()
    table = sizes.join(counts, "series", "left").fillna({"hits": 0, "alerts": 0})
    return table.select(
        "series", "hits", "alerts", "days", total.alias("planted"),
        ((F.col("alerts") - F.col("hits")) / F.col("days") * 100).alias("false_alarm_pct"),
    )
