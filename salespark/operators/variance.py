"""Why revenue changed: volume, price and mix effects between two periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum, ratio
from salespark.operators.periods import CURRENT_TAG, PREVIOUS_TAG


class EmptyPeriodError(ValueError):
    """One of the two periods has no usable sales."""


def counted_units() -> Column:
    """A sale without units counts as one unit; a row without revenue and units counts as none."""
    return F.when(F.col("units") > 0, F.col("units")).otherwise(F.when(F.col("revenue") > 0, 1).otherwise(0))


def tag_pair(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Two period tables as one tagged table."""
    now = current.withColumn("period", F.lit(CURRENT_TAG))
    return now.unionByName(previous.withColumn("period", F.lit(PREVIOUS_TAG)), allowMissingColumns=True)


def segment_totals(tagged: DataFrame, segment: str, by: list[str] | None = None) -> DataFrame:
    """Revenue and units of both periods per segment; a side counts only with units above zero.

    The outer join of the two periods is one conditional aggregate over the tagged rows.
    """
    sides = {"1": F.col("period") == CURRENT_TAG, "0": F.col("period") == PREVIOUS_TAG}
    sums = []
    for side, is_side in sides.items():
        sums.append(exact_sum(F.when(is_side, F.col("revenue"))).alias(f"revenue_{side}"))
        sums.append(F.coalesce(F.sum(F.when(is_side, counted_units())), F.lit(0)).cast("double").alias(f"units_{side}"))
    grouped = tagged.where(F.col(segment).isNotNull()).groupBy(*(by or []), segment).agg(*sums)
    return grouped.where((F.col("units_1") > 0) | (F.col("units_0") > 0))


def bridge_by_segment(tagged: DataFrame, segment: str = "category", by: list[str] | None = None) -> DataFrame:
    """Volume, mix and price effect of every segment, and its total change.

    With `by`, each group has its own bridge. A price missing on one side is taken from the other, so
    a new or discontinued segment shows up as mix. Unit totals come from the same grouping: as a
    scalar subquery for the whole base, as a window over segments within `by` groups.
    """
    table = segment_totals(tagged, segment, by)
    if by:
        within = Window.partitionBy(*by)
        q1, q0 = F.sum("units_1").over(within), F.sum("units_0").over(within)
        table = table.select("*", q1.alias("q1"), q0.alias("q0"))
    else:
        sums = [F.sum(c).alias(c) for c in ("units_1", "units_0", "revenue_1", "revenue_0")]
        totals = table.agg(F.struct(*sums).alias("totals")).scalar()
        table = table.select("*", totals.alias("totals"))
        table = table.select("*", F.col("totals.units_1").alias("q1"), F.col("totals.units_0").alias("q0"))
    table = table.where((F.col("q1") > 0) & (F.col("q0") > 0))  # both periods need sales
    own1, own0 = ratio("revenue_1", "units_1"), ratio("revenue_0", "units_0")
    p1, p0 = F.coalesce(own1, own0), F.coalesce(own0, own1)
    q1, q0 = F.col("q1"), F.col("q0")
    s1, s0 = F.col("units_1") / q1, F.col("units_0") / q0
    return table.select(
        *(by or []),
        segment,
        "revenue_1",
        "revenue_0",
        ((q1 - q0) * s0 * p0).alias("volume"),
        (q1 * (s1 - s0) * p0).alias("mix"),
        (q1 * s1 * (p1 - p0)).alias("price"),
        (F.col("revenue_1") - F.col("revenue_0")).alias("total"),
    )


def bridge_totals(by_segment: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summed effects, total change and change in % of the earlier revenue."""
    sums = by_segment.groupBy(*(by or [])).agg(
        exact_sum("revenue_0").alias("previous_revenue"),
        exact_sum("revenue_1").alias("current_revenue"),
        *[F.sum(name).alias(f"{name}_effect") for name in ("volume", "price", "mix")],
        F.count(F.lit(1)).alias("segments"),
    )
    change = F.col("current_revenue") - F.col("previous_revenue")
    found = sums.where(F.col("segments") > 0).drop("segments")
    return found.withColumns(
        {"total_change": change, "change_pct": ratio(change, F.col("previous_revenue")) * 100}
    )


def revenue_bridge(current: DataFrame, previous: DataFrame, segment: str = "category") -> tuple[DataFrame, DataFrame]:
    """(per segment, totals); raises when either period has no usable sales."""
    tagged = tag_pair(current, previous)
    usable = tagged.groupBy("period").agg(F.sum(counted_units()).alias("units"))
    if usable.where(F.col("units") > 0).count() < 2:
        raise EmptyPeriodError("Os dois períodos precisam ter vendas para a análise de variação.")
    by_segment = bridge_by_segment(tagged, segment)
    return by_segment.orderBy("total", segment), bridge_totals(by_segment)


def waterfall(totals: DataFrame) -> DataFrame:
    """Five steps from the earlier to the current revenue with the level after each."""
    # Step names in drawing order.
    steps = [
        ("Comparação", "previous_revenue"),
        ("Volume", "volume_effect"),
        ("Preço", "price_effect"),
        ("Mix", "mix_effect"),
        ("Período atual", "current_revenue"),
    ]
    cells = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(c).alias("amount"))
          for i, (n, c) in enumerate(steps)]
    )
    rows = totals.select("current_revenue", F.inline(cells))
    so_far = Window.partitionBy("current_revenue").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("step") == 4, F.col("amount")).otherwise(F.sum("amount").over(so_far))
    return rows.select("step", "name", "amount", level.alias("level")).orderBy("step")
