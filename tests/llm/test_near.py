"""Near copies of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

MIDDLE = "/root/testdata/sf0.01"


def kept(spark, table):
    return sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, table, MIDDLE).collect())


def test_near_copies_equal_brute_force(spark):
    table = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("text rlike '[^ \\\\s]'")
    docs = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert kept(spark, table) == sorted(brute.near_survivors(docs))


def test_changed_words_and_chains(spark):
    pick = random.Random(5)
    word = lambda: f"w{pick.randrange(10**6)}"
    docs = []
    for base in range(12):
        words = [word() for _ in range(120)]
        docs.append((base * 100, " ".join(words)))
        for i in range(1, 12):  # each differs from the one before by one word, so chains leave the first one's reach
            words[pick.randrange(120)] = word()
            docs.append((base * 100 + i, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert kept(spark, table) == sorted(brute.near_survivors(docs))


def test_a_large_group_of_drifting_copies(spark):
    """300 copies with 0 to 4 changed words of 120: most are linked to the base only, some to nobody."""
    pick = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for d in range(300):
        words = list(base)
        for at in pick.sample(range(120), d % 5):
            words[at] = f"c{pick.randrange(10**6)}"
        docs.append((d + 1, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    left = brute.near_survivors(docs)
    assert 1 < len(left) < 200
    assert kept(spark, table) == sorted(left)


def test_awkward_rows(spark):
    rows = [*brute.AWKWARD, brute.AWKWARD[0]]
    table = brute.awkward(spark, rows)
    assert kept(spark, table) == sorted(brute.near_survivors([(r[0], r[1]) for r in rows]))
    assert kept(spark, table.limit(0)) == []
