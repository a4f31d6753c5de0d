"""Order statistics against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from salespark.operators.selection import order_statistics

FRACTIONS = [0.2, 0.5, 0.99, 1.0]


def rank(total, fraction):
    return F.ceil(total * F.lit(fraction))


@pytest.mark.parametrize("accuracy", [20, 200])  # small ones take the bracketed way
def test_equals_sorting(spark, accuracy):
    pick = random.Random(accuracy)
    rows = [(pick.choice("ab"), float(pick.choice([pick.randrange(50), pick.gauss(0, 1e6), 7])), pick.choice([None, 1.0, 2.0])) for _ in range(20_000)]
    rows += [("one", 3.5, None)]
    table = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    for by in ([], ["g"]):
        found = order_statistics(table, {"x": F.col("x"), "y": F.col("y")}, FRACTIONS, rank, by, accuracy)
        told = {((r["g"],) if by else (), r["metric"]): (r["total"], r["stats"]) for r in found.collect()}
        for group in {(r[0],) for r in rows} if by else {()}:
            for at, metric in ((1, "x"), (2, "y")):
                values = sorted(r[at] for r in rows if r[at] is not None and (not by or r[0] == group[0]))
                ranks = [math.ceil(len(values) * f) for f in FRACTIONS]
                assert told[group, metric] == (len(values), [values[k - 1] if k else -math.inf for k in ranks])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert order_statistics(empty, {"x": F.col("x")}, [0.5], rank, ["g"]).collect() == []
