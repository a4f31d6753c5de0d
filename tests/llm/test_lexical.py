"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from salespark.llm import catalog, lexical  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    cut = lambda text: TERM.findall((text or "").translate(brute.LOWER))
    bags = [(d, Counter(t), len(t)) for d, text in docs if (t := cut(text))]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for d, bag, n in bags:
            m = 25 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in cut(text) if t in bag)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_query_equals_plain_scoring(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert told(catalog.op12_lexical_search(spark, SMALL)) == ranked(brute.documents(spark, SMALL), items)


def test_small_segments_blocks_and_ties(spark):
    pick = random.Random(4)
    texts = [" ".join(pick.choice("abcdefgh") * pick.randrange(1, 3) for _ in range(pick.randrange(1, 30))) for _ in range(300)]
    docs = list(enumerate(texts + texts[:50]))
    items = [(i, " ".join(pick.choices("abcdefgh", k=6))) for i in range(12)] + [(3, "a a zz"), (3, "a a zz"), (99, "nowhere"), (98, None)]
    want = ranked(docs, sorted({(i, t or "") for i, t in items}))
    for segment, block in ((64, 30), (1 << 20, 10**6)):
        found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block, segment_postings=segment)
        assert told(found) == want


def test_reading_stops_early():
    n = 40_000
    tf = np.ones(2 * n, np.int64)
    tf[:20] = 1000 - np.arange(20)
    rows, numbers = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    tf[n : n + 20] = 500
    segment = lexical.Segment(np.arange(n), np.full(n, 100, np.int64), rows, numbers, tf, np.array([900, 700]), n, 100 * n)
    found, read = segment.best([(0, 1), (1, 2)], 10)
    assert [row for _, row in found] == list(range(10)) and read < n / 4


def test_awkward_rows(spark):
    rows = [*brute.AWKWARD, brute.AWKWARD[0], (None, "alpha beta gamma " * 30, None, None)]
    docs = brute.awkward(spark, rows)
    items = spark.createDataFrame([(1, "ALPHA é 漢字 12345", 0), (2, "", 0), (3, None, 0), (4, "word x", 0)], "item_id long, text string, rank int")
    assert told(lexical.search(docs, items)) == ranked([(r[0], r[1]) for r in rows], [(r[0], r[1]) for r in items.collect()])
    assert told(lexical.search(docs.limit(0), items)) == told(lexical.search(docs, items.limit(0))) == []
