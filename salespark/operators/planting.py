"""Plant known anomalies into a sales table, to measure what the detector finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.operators.anomalies import PEAK
from salespark.operators.ranking import running_total


def inject_anomalies(df: DataFrame, plan: list[tuple[str, str, float]]) -> DataFrame:
    """Apply (day, kind, factor): a peak repeats the day's rows, a drop keeps every round(1/factor)-th row.

    Positions within a dropped day are counted over sorted ranges of its distinct rows. The plan is a constant list, folded into the projection.
    """
    copies = {day: round(factor) for day, kind, factor in plan if kind == PEAK}
    keep_every = {day: round(1 / factor) for day, kind, factor in plan if kind != PEAK}

    def per_day(values: dict[str, int]):
        pairs = [part for day, n in values.items() for part in (F.lit(day).cast("date"), F.lit(n))]
        return F.try_element_at(F.create_map(*pairs), F.to_date("date")) if pairs else F.lit(None).cast("int")

    columns = df.columns
    dropped = [F.lit(day).cast("date") for day in keep_every]
    is_dropped = F.to_date("date").isin(dropped) if dropped else F.lit(False)
    repeated = df.where(~is_dropped).withColumn("_n", F.coalesce(per_day(copies), F.lit(1)))
    result = repeated.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*columns)
    if dropped:
        # equal rows are counted once, so neither a large day nor a mass of copies ends in one task
        rows = df.where(is_dropped).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.withColumn("_day", F.to_date("date"))
        placed = running_total(rows, sorted(columns), F.col("_n"), within=["_day"], name="_upto")
        every = per_day(keep_every)
        up_to = F.floor((F.col("_upto") - 1) / every)
        before = F.floor((F.col("_upto") - F.col("_n") - 1) / every)
        kept = placed.withColumn("_kept", up_to - before).where(F.col("_kept") > 0)
        copies = kept.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_kept").cast("int"))))
        result = result.unionByName(copies.select(*columns))
    return result
