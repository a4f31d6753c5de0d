"""Days against a table of intervals: the last matching one, by an equi-join on dyadic blocks of days.

An interval of days is cut into at most two blocks per power of two, each aligned to its own length, and a day lies in
one block of each length. So "inside" becomes equality of (level, block), and of all intervals that hold a block only
the last one matters: the table shrinks to one row per block before it meets the days, however many intervals overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.operators.anomalies import OTHER_EVENT

TOP = 16  # blocks of 65,536 days; longer intervals take several of them


def _block(level: int, block: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), block.alias("block"))


def cover(start: Column, end: Column) -> Column:
    """Disjoint blocks that make up the days from start to end; none where the interval is empty or has a null end."""
    first, after = F.unix_date(start), F.unix_date(end) + 1
    found = []
    for level in range(TOP + 1):
        left, right = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(after, level)
        if level == TOP:
            whole = F.transform(F.sequence(left, right - 1), lambda b: _block(TOP, b))
            rest = F.when(left < right, whole)
        else:
            found.append(F.when((left < right) & (left.bitwiseAND(1) == 1), _block(level, left)))
            found.append(F.when((left < right) & (right.bitwiseAND(1) == 1), _block(level, right - 1)))
    return F.concat(F.filter(F.array(*found), lambda b: b.isNotNull()), F.coalesce(rest, F.array().cast("array<struct<level:int,block:int>>")))


def label_from_table(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add `event` to the days (column ds): the name of the matching interval of largest position, or "outros".

    intervals has name, start, end (dates, both included) and position; equal positions are settled by the larger name.
    Empty intervals and null names match nothing. Each distinct day is looked up once.
    """
    named = intervals.where("name IS NOT NULL")
    last = F.struct(F.col("position"), F.col("name"))
    blocks = named.select(last.alias("last"), F.explode(cover(F.col("start").cast("date"), F.col("end").cast("date"))).alias("b"))
    blocks = blocks.groupBy("b.level", "b.block").agg(F.max("last").alias("last"))
    distinct = days.where("ds IS NOT NULL").select("ds").distinct()
    number = F.unix_date(F.col("ds").cast("date"))
    held = distinct.select("ds", F.explode(F.array(*[_block(k, F.shiftright(number, k)) for k in range(TOP + 1)])).alias("b"))
    found = held.select("ds", "b.*").join(blocks, ["level", "block"]).groupBy("ds").agg(F.max("last")["name"].alias("event"))
    return days.join(found, "ds", "left").select(*days.columns, F.coalesce("event", F.lit(OTHER_EVENT)).alias("event"))
