"""Plain Python versions of what the operators answer, and small tables full of awkward rows."""

from __future__ import annotations

import hashlib
import re

import xxhash

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contaminated(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    lengths, out = {len(w) for w in windows}, {}
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (window := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[window]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def fingerprint(text):
    words = PLAIN.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size=5):
    words = PLAIN.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_survivors(docs, least=0.8):
    """The smallest id of each group of documents that pairs of at least this Jaccard similarity connect."""
    sets = {d: shingles(t) for d, t in docs}
    ids, pairs, having = sorted(sets), set(), {}
    empty = [d for d in ids if not sets[d]]
    pairs |= {(empty[0], d) for d in empty[1:]}
    for d in ids:
        shared = {}
        for s in sets[d]:
            for other in having.get(s, ()):
                shared[other] = shared.get(other, 0) + 1
            having.setdefault(s, []).append(d)
        pairs |= {(o, d) for o, n in shared.items() if n >= least * (len(sets[o]) + len(sets[d]) - n) - 1e-9}
    roots = components(pairs, ids)
    return {d for d in ids if roots[d] == d}


def simhash(docs, radius=2):
    prints = {doc: fingerprint(text) for doc, text in docs}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    roots = components(pairs, ids)
    return {doc: (f"{prints[doc]:016x}", roots[doc]) for doc in ids}


def removed(docs, size=50):
    owner, out = {}, {}
    data = {doc: (text or "").encode() for doc, text in docs}
    for doc in sorted(data, reverse=True):
        for i in range(len(data[doc]) - size + 1):
            owner[data[doc][i : i + size]] = doc
    for doc, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if owner[b[i : i + size]] < doc:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


AWKWARD = [
    (1, "alpha beta gamma " * 30, "en", "a"),
    (2, None, None, None),
    (3, "", "fr", ""),
    (4, "   \t\n ", "en", "b"),
    (5, "alpha beta gamma " * 30, "en", "a"),
    (6, "Éa 漢字 \U0001f600 ÉA", "fr", "b"),
    (7, "x" * 70_000, "de", "a"),
    (8, "one two", "en", None),
    (9, "word " * 30_000, "en", "a"),
    (10, "12345 67890 !!! ???", None, "c"),
]


def awkward(spark, rows=AWKWARD):
    """The rows above, with extra columns named like things the operators use inside."""
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    extra = ("words", "w", "n_words", "at", "gram", "start", "end", "size", "pattern", "fp", "key", "hash", "order", "kind", "span", "score", "lang_pred", "component_id", "n", "id")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(0).alias(c) for c in extra])


def documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]
