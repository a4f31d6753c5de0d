"""Small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Runs of anything but ASCII white space, as Java and Python patterns read it alike.
BLANK_SEPARATED = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII takes the fast path, where `lower` does nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Of an array of lengths: the sum of all lengths before each entry.

    Sums run inside blocks, then over blocks, so that ten thousands of entries stay cheap.
    """
    zero = F.array(F.lit(0).cast("long"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / block), F.lit(0)).cast("int")),
        lambda b: F.slice(lengths, b * block + 1, block),
    )
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    offsets = F.aggregate(blocks, zero, lambda sums, part: add(sums, F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)))
    inner = F.zip_with(
        blocks,
        F.slice(offsets, F.lit(1), F.size(blocks)),
        lambda part, offset: F.transform(F.slice(F.aggregate(part, zero, add), F.lit(1), F.size(part)), lambda x: x + offset),
    )
    return F.flatten(inner)
