"""Language and mixing queries against plain versions written from their descriptions alone."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from salespark.llm import catalog  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plain_language(docs, entries=120_000):
    """(language, score) per text: known words first, unseen ones by the mean of their longest known n-grams."""
    words_of = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    grams = lambda word, n: [f" {word} "[i : i + n] for i in range(len(word) + 3 - n)]
    counts = defaultdict(Counter)  # (language, length; 0 are whole words)
    for doc, text, lang in docs:
        if zlib.crc32(str(doc).encode()) % 3 != 1 and lang is not None:
            for word in words_of(text):
                if len(word) <= 40:
                    counts[lang, 0][word] += 1
    languages = sorted({lang for lang, _ in counts})
    for lang in languages:
        for word, times in list(counts[lang, 0].items()):
            for n in range(1, 6):
                for gram in grams(word, n):
                    counts[lang, n][gram] += times
    share = max(1, entries // (6 * len(languages)))
    kept = [set().union(*({w for w, _ in sorted(counts[lang, n].items(), key=lambda x: (-x[1], x[0].encode()))[:share]} for lang in languages)) for n in range(6)]
    sums = {key: (sum(c.values()), len(c)) for key, c in counts.items()}

    def logs(n, item):
        return [math.log((counts[lang, n][item] + 0.5) / (sums[lang, n][0] + 0.5 * (sums[lang, n][1] + 1))) for lang in languages]

    def of_word(word):
        if word in kept[0]:
            return logs(0, word)
        for n in range(min(5, len(word) + 2), 0, -1):
            if known := [g for g in grams(word, n) if g in kept[n]]:
                rows = [logs(n, g) for g in known]
                return [sum(column) / len(known) for column in zip(*rows, strict=True)]
        return [0.0] * len(languages)

    seen, out = {}, {}
    for doc, text, _ in docs:
        found = Counter(words_of(text))
        if not found:
            out[doc] = ("und", 0.0)
            continue
        totals = [0.0] * len(languages)
        for word, times in found.items():
            if word not in seen:
                seen[word] = of_word(word)
            totals = [t + times * x for t, x in zip(totals, seen[word], strict=True)]
        best = max(range(len(languages)), key=lambda i: totals[i])
        out[doc] = (languages[best], 1 / sum(math.exp(t - totals[best]) for t in totals))
    return out


def test_language_equals_the_plain_version(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = plain_language([tuple(r) for r in rows])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in catalog.op3_language_id(spark, SMALL).collect()}
    assert found.keys() == want.keys()
    for doc, (lang, score) in want.items():
        assert found[doc][0] == lang and abs(found[doc][1] - score) < 1e-6, doc


def test_mix_targets_equal_a_water_level(spark):
    """Targets are min(2 * size, level * weight) for the one level at which they add up to 150% of all sizes."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes, longest = Counter(), Counter()
    for r in rows:
        n = len(brute.PLAIN.findall(r["text"] or ""))
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        short = sum(min(2 * sizes[s], level * weights[s]) for s in order) < 1.5 * sum(sizes.values())
        low, high = (level, high) if short else (low, level)
    taken = Counter()
    for r in catalog.op10_mixing(spark, SMALL).collect():
        source = next(x["source"] for x in rows if x["doc_id"] == r["doc_id"])
        assert r["source_size"] == sizes[source] and abs(r["target"] - min(2 * sizes[source], high * weights[source])) < 1e-3
        taken[source] += r["taken"]
    assert all(abs(taken[s] - min(2 * sizes[s], high * weights[s])) <= longest[s] / 2 + 1 for s in order)
