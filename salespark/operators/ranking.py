"""Exact global positions and order statistics without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.session import stage

def running_total(
    df: DataFrame,
    order: list[str],
    weight: Column | None = None,
    within: list[str] | None = None,
    name: str = "upto",
    total: str | None = None,
) -> DataFrame:
    """Add the inclusive running total of `weight` (default: rows) in the given order, per `within` group.

    Rows are sorted into Spark's range partitions and written once, so that every later step sees the same
    partitions. Each is totalled on its own and shifted by the totals of those before it (one row per partition
    and group), so a group holding most rows is spread out. `total` names an extra column with the group's whole
    weight.
    """
    within = list(within or [])
    weight = F.lit(1) if weight is None else weight
    dealt = df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(*[F.col(c) for c in (*within, *order)])
    keyed = stage(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = keyed.groupBy(*within, "_range").agg(F.sum("_weight").alias("_sum"))
    group = Window.partitionBy(*(within or [F.lit(0)]))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        *within,
        "_range",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(group).alias("_all"),
    )
    inside = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("_local", F.sum("_weight").over(inside))
    joined = local.join(shifts, [*within, "_range"])
    extra = [F.col("_all").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name), *extra)


def row_positions(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "pos") -> DataFrame:
    """1-based position of every row in the given order."""
    return running_total(df, order, within=within, name=name)


def surrogate_codes(df: DataFrame, column: str, prefix: str, width: int, name: str = "code") -> DataFrame:
    """(`column`, code): `C00001` is the first of the sorted distinct values."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = row_positions(distinct, [column])
    return coded.select(column, F.format_string(f"{prefix}%0{width}d", F.col("pos")).alias(name))


def value_distribution(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, metric, value, n, upto, total): distinct values per column, their counts, cumulative and total counts."""
    by = list(by or [])
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*by, F.inline(pairs)).where(F.col("value").isNotNull())
    counts = rows.groupBy(*by, "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, ["value"], F.col("n"), within=[*by, "metric"], total="total")
