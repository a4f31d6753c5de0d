"""Spelling variants against plain Python."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from salespark.llm import catalog, spelling  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def words_of(docs):
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            yield run


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, shortest=6):
    n = {w: c for w, c in Counter(words).items() if c >= 5 and len(w) >= shortest}
    by_length, out = {}, {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best is not None and n[best] >= 5 * n[w] else None, None, n[w], len(others)]
    for w in n:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return sorted((w, f, r, c, k, None if f is None else n[f]) for w, (f, r, c, k) in out.items())


def told(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_equals_brute_force(spark):
    want = grouped(words_of(brute.documents(spark, SMALL)))
    assert any(r[1] for r in want) and told(catalog.op11_spelling_variants(spark, SMALL)) == want


def test_dense_words_repeated_letters_and_chains(spark):
    pick = random.Random(3)
    words = ["".join(pick.choice("abÿ") for _ in range(pick.randrange(1, 6))) for _ in range(4000)]
    chain = ["aaaaaaa"] * 4000 + ["aaaaaab"] * 700 + ["aaaaabb"] * 120 + ["aaaabbb"] * 24 + ["aaabbbb"] * 5
    for some in (words, chain, words + chain, ["x" * 70_000] * 5 + ["x" * 69_999] * 25, []):
        table = spark.createDataFrame([(w, 1) for w in some], "word string, n int")
        assert told(spelling.group_variants(table)) == grouped(some, 1)


def test_awkward_rows(spark):
    rows = [*brute.AWKWARD * 6, (None, "Ähnlich ähnlich ÄHNLICH " * 9, None, None)]
    docs = brute.awkward(spark, rows)
    want = grouped(words_of([(r[0], r[1]) for r in rows]))
    assert want and told(spelling.group_variants(spelling.typed_words(docs))) == want
    assert told(spelling.group_variants(spelling.typed_words(docs.limit(0)))) == []
