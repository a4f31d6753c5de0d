"""Exact order statistics without a sort: a quantile sketch brackets each rank, and only the bracket is counted out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.session import stage

ACCURACY = 10_000  # a sketched quantile's rank is off by at most one part in so many
_ENDLESS = float("inf")


def order_statistics(
    df: DataFrame,
    values: dict[str, Column],
    fractions: Sequence[float],
    rank: Callable[[Column, float], Column],
    by: list[str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """(by…, metric, total, stats): per group and metric the values at `rank(total, fraction)` for each fraction.

    `total` counts the metric's values (nulls don't count); a rank below 1 has -infinity as its value. `rank` may differ
    from total * fraction by one. The first scan sketches all quantiles wanted, the second counts what lies below
    each bracket, the third the distinct values inside, some ten thousandths of all. Groups of fewer than eight times
    `accuracy` values are counted out as a whole, which is as small.
    """
    by, names = list(by or []), list(values)
    wide = df.select(*by, *[values[m].cast("double").alias(f"v_{m}") for m in names])
    margin = 3 / accuracy
    ends = [p for f in fractions for p in (max(0.0, f - margin), min(1.0, f + margin))]
    sketched = wide.groupBy(*by).agg(
        *[F.struct(F.count(f"v_{m}").alias("total"), F.percentile_approx(f"v_{m}", F.array(*[F.lit(p) for p in ends]), accuracy).alias("near")).alias(f"s_{m}") for m in names]
    )
    sketched = stage(sketched, "selection-sketches")
    if by:
        joined = wide.join(sketched, by)
    else:
        told = sketched.select(F.struct(*sketched.columns).alias("all")).scalar()
        joined = wide.select("*", told.alias("_all")).select("*", "_all.*")
    small = lambda m: F.col(f"s_{m}.total") < 8 * accuracy
    low = lambda m, i: F.when(small(m), -_ENDLESS).otherwise(F.col(f"s_{m}.near")[2 * i])
    high = lambda m, i: F.when(small(m), _ENDLESS).otherwise(F.col(f"s_{m}.near")[2 * i + 1])
    every = [(m, i) for m in names for i in range(len(fractions))]
    below = joined.groupBy(*by).agg(*[F.count_if(F.col(f"v_{m}") < low(m, i)).alias(f"below_{m}_{i}") for m, i in every])
    marked = F.array(*[F.when(F.col(f"v_{m}").between(low(m, i), high(m, i)), F.struct(F.lit(m).alias("metric"), F.lit(i).alias("i"), F.col(f"v_{m}").alias("value"))) for m, i in every])
    inside = joined.select(*by, F.explode(F.filter(marked, lambda x: x.isNotNull())).alias("x")).groupBy(*by, "x.metric", "x.i", "x.value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "metric", "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(i).alias("i"), F.col(f"s_{m}.total").alias("total"), F.col(f"below_{m}_{i}").alias("below"), rank(F.col(f"s_{m}.total"), fractions[i]).cast("long").alias("rank"))
            for m, i in every
        ]
    )
    both = below.join(sketched, by) if by else below.select("*", told.alias("_all")).select("*", "_all.*")  # one row per group
    ranks = both.select(*by, F.inline(wanted))
    placed = ranks.join(inside.withColumn("upto", upto), [*by, "metric", "i"], "left")
    found = placed.groupBy(*by, "metric", "i").agg(
        F.first("total").alias("total"), F.first("rank").alias("rank"), F.min(F.when(F.col("below") + F.col("upto") >= F.col("rank"), F.col("value"))).alias("value")
    )
    value = F.when(F.col("rank") < 1, -_ENDLESS).otherwise(F.col("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("value")))), lambda x: x["value"])
    return found.groupBy(*by, "metric").agg(F.first("total").alias("total"), listed.alias("stats"))
