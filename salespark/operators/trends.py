"""Linear trend, Mann-Kendall test and declining categories."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum
from salespark.operators.series import with_positions
from salespark.session import ship_package, stage

ALPHA = 0.05
DECLINE_THRESHOLD = -0.15
UP, DOWN, FLAT = "alta", "queda", "sem tendência"
# up to this many tie-free values the p-value comes from the exact distribution
EXACT_UP_TO = 33


def fit_trend(daily: DataFrame) -> DataFrame:
    """(series, slope_pct, r2): least-squares line over the position in time, as % change over the period."""
    placed = with_positions(daily)
    fitted = placed.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "pos").alias("slope"),
        F.regr_r2("y", "pos").alias("fit"),
        F.avg("y").alias("mean"),
    )
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    enough = F.col("n") >= 2
    return fitted.select(
        "series",
        F.when(enough, F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("n") / mean * 100).otherwise(0.0).alias("slope_pct"),
        F.when(enough, F.coalesce(F.col("fit"), F.lit(1.0))).otherwise(0.0).alias("r2"),
    )


def _rise_minus_fall(values: np.ndarray) -> int:
    """Pairs that rise minus pairs that fall, counted by merging sorted halves."""
    _, ranks = np.unique(values, return_inverse=True)
    balance, width = 0, 1
    n = len(ranks)
    work = ranks.astype(np.int64)
    while width < n:
        for low in range(0, n, 2 * width):
            left, right = work[low : low + width], work[low + width : low + 2 * width]
            if len(right):
                below = np.searchsorted(left, right, side="left").sum()
                above = len(left) * len(right) - np.searchsorted(left, right, side="right").sum()
                balance += int(below) - int(above)
                work[low : low + 2 * width] = np.sort(work[low : low + 2 * width], kind="stable")
        width *= 2
    return balance


def _exact_p(n: int, fewest: int) -> float:
    """Two-sided chance of at most `fewest` inversions (or as many rises) in a random order of n values."""
    chance = np.zeros(fewest + 1)
    chance[0] = 1.0
    for size in range(2, n + 1):
        padded = np.concatenate([np.zeros(size), np.cumsum(chance)])
        chance = (padded[size:] - padded[: fewest + 1]) / size
    return min(1.0, 2 * float(chance.sum()))


def kendall_row(values: np.ndarray, exact_up_to: int = EXACT_UP_TO) -> tuple[int, float, float]:
    """(S, tau-b, two-sided p) of the values against their order; (0, 0, 1) when there is nothing to test."""
    values = values[~np.isnan(values)]
    n = len(values)
    if n < 4 or (values == values[0]).all():
        return 0, 0.0, 1.0
    s = _rise_minus_fall(values)
    pairs = n * (n - 1) // 2
    ties = np.unique(values, return_counts=True)[1].astype(float)
    tied = float((ties * (ties - 1) / 2).sum())
    tau = s / math.sqrt(pairs * (pairs - tied))
    falls = (pairs - int(tied) - s) // 2
    fewest = min(falls, pairs - falls)
    if tied == 0 and (n <= exact_up_to or fewest <= 1):
        p = 1.0 if 2 * fewest == pairs else _exact_p(n, fewest)
    else:
        spread = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
        p = math.erfc(abs(s) / math.sqrt(spread) / math.sqrt(2))
    return s, tau, p


def mann_kendall(daily: DataFrame, alpha: float = ALPHA, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """(series, n, s, tau, p_value, significant, direction) per series.

    A group is one aggregated series, so it holds at most one row per calendar day. Up to `exact_up_to` values without
    ties the p-value is exact; the normal approximation with tie correction gives it beyond.
    """

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("ds")["y"].to_numpy(dtype=float)
        s, tau, p = kendall_row(values, exact_up_to)
        return pd.DataFrame({"series": [rows["series"].iloc[0]], "n": [len(values)], "s": [s], "tau": [tau], "p_value": [p]})

    ship_package(daily.sparkSession)
    tested = daily.select("series", "ds", "y").groupBy("series")
    tested = tested.applyInPandas(test, "series STRING, n BIGINT, s BIGINT, tau DOUBLE, p_value DOUBLE")
    significant = F.col("p_value") < alpha
    direction = F.when(~significant, FLAT).when(F.col("tau") > 0, UP).otherwise(DOWN)
    return tested.withColumns({"significant": significant, "direction": direction})


def kendall_of_long(df: DataFrame, order: str, value: str, by: list[str], parts: int = 64) -> DataFrame:
    """(by…, n, s, tau, p_value) of series of any length; null and NaN values don't count.

    Rows are cut by quantiles of `order` into blocks and by quantiles of `value` into layers; a value equal to a
    quantile is a layer of its own, so frequent values hold only ties. Pairs of different blocks and layers follow from
    the table of cell sizes, pairs inside a block and pairs of one layer across blocks are counted by merging in tasks
    of about n / parts rows. `order` should be unique in a series; equal ones are taken by value. p-values are those
    of the normal approximation with tie correction; fewer than four values or a constant give (0, 0, 1).
    """
    rows = df.select(*by, F.col(order).alias("o"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    edges = stage(rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("o", steps, 100 * parts)).alias("o_edges"), F.array_distinct(F.percentile_approx("v", steps, 100 * parts)).alias("v_edges")), "kendall-edges")
    above = lambda edges, x: F.size(F.filter(edges, lambda e: e < F.col(x)))
    layer = 2 * above("v_edges", "v") + F.array_contains("v_edges", F.col("v")).cast("int")
    placed = stage(rows.join(edges, by).select(*by, "o", "v", above("o_edges", "o").alias("block"), layer.alias("layer")), "kendall-rows")
    ship_package(df.sparkSession)
    keys = ", ".join(f"`{c}` {t}" for c, t in df.select(*by).dtypes)

    def in_block(group: pd.DataFrame) -> pd.DataFrame:
        s = _rise_minus_fall(group.sort_values(["o", "v"])["v"].to_numpy())
        return group[by].iloc[:1].assign(s=s)

    def in_layer(group: pd.DataFrame) -> pd.DataFrame:
        """Of one layer, only what its blocks have not counted."""
        group = group.sort_values(["o", "v"])
        s = _rise_minus_fall(group["v"].to_numpy()) - sum(_rise_minus_fall(part.to_numpy()) for _, part in group.groupby("block")["v"])
        return group[by].iloc[:1].assign(s=s)

    def across(cells: pd.DataFrame) -> pd.DataFrame:
        """At most parts * (2 * parts) cells."""
        sizes = np.zeros((int(cells["block"].max()) + 1, int(cells["layer"].max()) + 1), dtype=object)
        for block, where, n in zip(cells["block"], cells["layer"], cells["n"], strict=True):
            sizes[block, where] = int(n)
        earlier = np.cumsum(sizes, axis=0) - sizes
        below = np.cumsum(earlier, axis=1) - earlier
        s = (sizes * (below - (earlier.sum(axis=1, keepdims=True) - below - earlier))).sum()
        return cells[by].iloc[:1].assign(s=int(s))

    cells = placed.groupBy(*by, "block", "layer").agg(F.count(F.lit(1)).alias("n"))
    parts_of_s = placed.groupBy(*by, "block").applyInPandas(in_block, f"{keys}, s long")
    parts_of_s = parts_of_s.unionByName(placed.where("layer % 2 = 0").groupBy(*by, "layer").applyInPandas(in_layer, f"{keys}, s long"))
    parts_of_s = parts_of_s.unionByName(cells.groupBy(*by).applyInPandas(across, f"{keys}, s long"))
    t = F.col("t").cast("double")
    ties = placed.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum(t * (t - 1) / 2).alias("tied"), F.sum(t * (t - 1) * (2 * t + 5)).alias("correction"), F.count(F.lit(1)).alias("distinct")
    )
    told = ties.join(parts_of_s.groupBy(*by).agg(F.sum("s").alias("s")), by)

    def tested(batches):
        for rows in batches:
            p = []
            for n, s, correction, plain in zip(rows["n"], rows["s"], rows["correction"], rows["plain"], strict=True):
                spread = (n * (n - 1.0) * (2.0 * n + 5) - correction) / 18
                p.append(1.0 if plain else math.erfc(abs(s) / math.sqrt(spread) / math.sqrt(2)))
            yield rows.assign(p_value=p)[[*by, "n", "s", "tau", "p_value"]]

    n, plain = F.col("n").cast("double"), (F.col("n") < 4) | (F.col("distinct") == 1)
    pairs = n * (n - 1) / 2
    tau = F.when(plain, F.lit(0.0)).otherwise(F.col("s") / F.sqrt(pairs * (pairs - F.col("tied"))))
    ready = told.select(*by, "n", F.when(plain, F.lit(0)).otherwise(F.col("s")).cast("long").alias("s"), tau.alias("tau"), "correction", plain.alias("plain"))
    return ready.mapInPandas(tested, f"{keys}, n long, s long, tau double, p_value double")


def declining_categories(df: DataFrame, threshold: float = DECLINE_THRESHOLD, by: list[str] | None = None) -> DataFrame:
    """(category, change_pct) of categories whose second half fell by more than the threshold.

    The halves meet at the time midpoint between the first and last sale (of each `by` group).
    """
    by = by or []
    bounds = df.groupBy(*by).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    # with a single moment there is no second half: the null midpoint then leaves nothing to compare
    middle = F.when(F.col("last") > F.col("first"), F.expr("first + (last - first) / 2"))
    if by:
        # sums per moment meet the groups' midpoints, so that no single row is joined on a group of many
        moments = df.where(F.col("category").isNotNull()).groupBy(*by, "category", "date").agg(exact_sum("revenue").alias("revenue"))
        marked = moments.join(bounds.select(*by, middle.alias("middle")), by)
        mid = F.col("middle")
    else:
        marked, mid = df, bounds.select(middle.alias("middle")).scalar()
    halves = marked.where(F.col("category").isNotNull()).groupBy(*by, "category").agg(
        exact_sum(F.when(F.col("date") <= mid, F.col("revenue"))).alias("first_half"),
        exact_sum(F.when(F.col("date") > mid, F.col("revenue"))).alias("second_half"),
    )
    change = (F.col("second_half") - F.col("first_half")) / F.col("first_half")
    rows = halves.where(F.col("first_half") > 0).where(change < threshold)
    return rows.select(*by, "category", (change * 100).alias("change_pct"))
