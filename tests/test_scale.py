"""Intervals, long Kendall series, sketches and shared facts against plain versions."""

from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from salespark.operators import intervals, sketches, textnum, trends
from salespark.plans.text_queries import answered_orders

DAY0 = dt.date(1950, 1, 1)


def test_intervals_equal_looking_at_each(spark):
    pick = random.Random(6)
    rows = []
    for i in range(3000):
        start = DAY0 + dt.timedelta(days=pick.randrange(30_000))
        rows.append((f"e{i}", start, start + dt.timedelta(days=pick.choice([-1, 0, 1, 6, 90, 5000, 70_000])), pick.randrange(500)))
    rows += [("always", dt.date(1800, 1, 1), dt.date(2400, 1, 1), -1), (None, DAY0, DAY0, 9999), ("no end", DAY0, None, 9999)]
    table = spark.createDataFrame(rows, "name string, start date, end date, position int")
    days = [DAY0 + dt.timedelta(days=d) for d in range(-50, 40_000, 37)]
    given = spark.createDataFrame([(d, 1) for d in days] + [(days[0], 2), (None, 3)], "ds date, event_no int")
    found = {r["ds"]: r["event"] for r in intervals.label_from_table(given, table).collect()}
    for day in days:
        held = [(p, n) for n, a, b, p in rows if n and b and a <= day <= b]
        assert found[day] == (max(held)[1] if held else "outros")
    assert found[None] == "outros" and intervals.label_from_table(given, table).count() == len(days) + 2
    assert {r["event"] for r in intervals.label_from_table(given, table.limit(0)).collect()} == {"outros"}


def test_many_intervals(spark):
    start = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 9000).cast("int"))
    many = spark.range(100_000).select(F.concat(F.lit("w"), "id").alias("name"), start.alias("start"), F.date_add(start, 30).alias("end"), F.col("id").alias("position"))
    days = spark.range(9000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("ds"))
    found = intervals.label_from_table(days, many).where("event <> 'outros'")
    assert found.count() == 9000


def test_long_kendall_equals_one_task(spark):
    pick = np.random.default_rng(8)
    rows = []
    for series, values in {
        "up": np.arange(3000) + pick.normal(0, 900, 3000),
        "ties": pick.integers(0, 5, 2500).astype(float),
        "hot": np.where(pick.random(2000) < 0.6, 7.0, pick.normal(7, 1, 2000)),
        "flat": np.full(40, 2.0),
        "short": np.array([3.0, 1.0, 2.0]),
        "holes": np.where(pick.random(500) < 0.1, np.nan, -np.arange(500.0)),
    }.items():
        rows += [(series, i, float(v)) for i, v in enumerate(values)] + [(series, 10**6, None)]
    table = spark.createDataFrame(rows, "series string, i long, y double").repartition(9)
    for parts in (2, 7, 64):
        found = {r["series"]: r for r in trends.kendall_of_long(table, "i", "y", ["series"], parts).collect()}
        for series in {r[0] for r in rows}:
            values = np.array([y for s, _, y in sorted(rows, key=lambda r: r[1]) if s == series and y is not None])
            s, tau, p = trends.kendall_row(values, exact_up_to=0)
            got = found[series]
            assert (got["n"], got["s"]) == ((~np.isnan(values)).sum(), s)
            assert abs(got["tau"] - tau) < 1e-12 and abs(got["p_value"] - p) < 1e-9


def test_sketches_unite(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("shop"), (F.col("id") % 20_000).cast("string").alias("order_id"))
    daily = sketches.order_sketches(rows, ["day", "shop"])
    for by in (["day"], ["shop"], []):
        exact = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*by).agg(F.countDistinct("order_id")).collect()}
        for row in sketches.approx_orders(daily, by).collect():
            assert abs(row["orders"] - exact[tuple(row[:-1])]) <= exact[tuple(row[:-1])] * sketches.ERROR


def test_shared_facts_equal_the_row_version(spark):
    """With facts of its own as key, every answer is judged as by the version inside the row."""
    answers = answered_orders(spark, SMALL)
    own = textnum.verify(answers).select("o_orderkey", "checked", "verified", "ok", "unverified")
    facts = answers.select("o_orderkey", F.inline(textnum.extract_numbers(F.col("facts")))).select("o_orderkey", "value", "is_percent")
    shared = textnum.verify_shared(answers, facts, ["o_orderkey"]).select("o_orderkey", "checked", "verified", "ok", "unverified")
    assert sorted(map(tuple, shared.collect()), key=str) == sorted(map(tuple, own.collect()), key=str)


def test_shared_facts_equal_trying_all(spark):
    pick = random.Random(9)
    facts = [("k", round(pick.choice([1, 100, 1e6]) * pick.uniform(-1, 1), 2), pick.random() < 0.3) for _ in range(400)]
    texts = [f"R$ {abs(v):.2f}".replace(".", ",") if i % 2 else f"{v:.1f}%".replace(".", ",") for i, (_, v, _) in enumerate(facts)]
    texts += [f"R$ {pick.uniform(0, 200):.2f}".replace(".", ",") for _ in range(200)] + ["R$ 1 mil", "R$ 2,5 milhões", "nada", None]
    answers = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)] + [(9999, None, "R$ 5,00")], "id int, key string, answer string")
    table = spark.createDataFrame(facts, "key string, value double, is_percent boolean")
    listed = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(p).alias("is_percent")) for _, v, p in facts])
    missing = F.size(F.filter(textnum.extract_numbers(F.col("answer")), lambda c: ~textnum._supported(c, listed)))
    want = {r["id"]: r["ok"] for r in answers.select("id", ((missing == 0) | F.col("answer").isNull()).alias("ok")).collect()}
    found = {r["id"]: r["ok"] for r in textnum.verify_shared(answers, table, ["key"]).collect()}
    del want[9999]
    assert found.pop(9999) is False and found == want and 50 < sum(not ok for ok in found.values()) < 500


def test_shared_facts_look_every_number_up_once(spark):
    """F8: no number is dealt out once per bucket of its band and per sign, and facts are not dealt out by key alone."""
    answers = answered_orders(spark, SMALL)
    facts = answers.select("o_orderpriority", F.col("total").alias("value"), F.lit(False).alias("is_percent"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        checked = textnum.verify_shared(answers.select("o_orderkey", "o_orderpriority", "answer"), facts, ["o_orderpriority"])
        plan = checked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(o_orderpriority#\d+, \d+\)", plan)
    assert not re.search(r"Generate explode\(CASE WHEN signed", plan)


def test_shared_facts_in_far_buckets(spark):
    """F8: facts at all places of a band, and facts beyond the range of bucket numbers."""
    values = [round(99.0 + i / 64, 6) for i in range(129)] + [1e300, -1e300, -100.25]
    answers = spark.createDataFrame([(i, f"k{i}", t) for i in range(len(values)) for t in ("R$ 100,00 e 100%", "−R$ 100,00")], "id int, key string, answer string")
    facts = spark.createDataFrame([(f"k{i}", v, None) for i, v in enumerate(values)], "key string, value double, is_percent boolean")
    found = sorted((r["id"], r["verified"]) for r in textnum.verify_shared(answers, facts, ["key"]).collect())
    close = lambda v, limit: abs(abs(v) - 100) <= limit + textnum.SLACK
    want = [(i, close(v, 0.005) + close(v, 0.5)) for i, v in enumerate(values)] + [(i, 0) for i in range(len(values))]
    assert found == sorted(want)
