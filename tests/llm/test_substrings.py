"""Substring removal and its sorting, against plain Python."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from salespark.llm import catalog, substrings  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def answers(df):
    import hashlib

    out = {}
    for r in df.collect():
        cut = sum(s["end"] - s["start"] for s in r["removed"])
        assert cut + len(r["kept"]) == r["n_bytes"]
        out[r["doc_id"]] = (r["n_bytes"], cut, len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
    return out


def test_small_table_equals_brute_force(spark):
    docs = brute.documents(spark, SMALL)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in catalog.op9_substring_dedup(spark, SMALL).collect()}
    assert found == brute.removed(docs)


@pytest.mark.parametrize(("chunk", "bucket", "size"), [(300, 200, 50), (1 << 20, 1 << 20, 50), (2000, 500, 24)])
def test_random_overlaps_equal_brute_force(spark, chunk, bucket, size):
    pick = random.Random(size + chunk)
    letters = "abé "
    pieces = ["".join(pick.choice(letters) for _ in range(pick.randrange(10, 90))) for _ in range(12)] + ["a" * 70, "ab" * 45]
    docs = [(i * 3 % 41, "".join(pick.choice(pieces) + "".join(pick.choice(letters) for _ in range(pick.randrange(4))) for _ in range(pick.randrange(5)))) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert answers(substrings.remove_repeats(table, size, chunk, bucket)) == brute.removed(docs, size)


def test_awkward_rows(spark):
    found = answers(substrings.remove_repeats(brute.awkward(spark)))
    assert found == brute.removed([r[:2] for r in brute.AWKWARD])
    assert found[5][1] == found[5][0] and found[1][1] == 0
    assert substrings.remove_repeats(brute.awkward(spark).limit(0)).count() == 0
    text = "some text that is long enough to be a string of fifty bytes " * 2
    twice = spark.createDataFrame([(3, text), (3, text), (None, text), (None, "other")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], len(r["kept"])) for r in substrings.remove_repeats(twice).collect()), key=str)
    assert rows == [(3, len(text)), (3, len(text)), (None, 0), (None, 5)]


def test_pieces_of_a_long_chunk_agree(monkeypatch):
    pick = random.Random(3)
    data = np.frombuffer(bytes(pick.choice(b"abcd") for _ in range(3000)), np.uint8)
    ends = np.array([0, 40, 90, 91, 1500, 1549, 1599, 3000])
    whole = substrings.anchor_runs(data, ends, 50)
    starts = {s for a, b in zip(whole.first, whole.last, strict=True) for s in range(a, b + 1)}
    assert starts == {s for low, high in zip([0, *ends[:-1]], ends, strict=True) for s in range(low, high - 49)}
    assert ((whole.at >= whole.first - 0) & (whole.at <= whole.first + 34) & (whole.at >= whole.last)).all()


@pytest.mark.parametrize("width", [3, 16, 34])
def test_deep_shallow_sorts(width):
    pick = random.Random(width)
    rows = np.array([[pick.choice([0, 97, 98]) if pick.random() < 0.1 else 97 for _ in range(width)] for _ in range(400)], dtype=np.uint8)
    group = np.array([pick.randrange(5) for _ in range(400)])
    order = substrings.deep_shallow_order(rows, group)
    listed = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert listed == sorted(listed) and sorted(order.tolist()) == list(range(400))
    shared = substrings.common_prefixes(rows, order)
    for i in range(1, 400):
        a, b = rows[order[i - 1]], rows[order[i]]
        assert shared[i] == next((k for k in range(width) if a[k] != b[k]), width)
    assert substrings.deep_shallow_order(rows[:0], group[:0]).tolist() == []
