"""Decontamination, SimHash, mixing: against plain Python, on the small tables and on awkward rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from salespark.llm import catalog, mixing, simhash  # noqa: E402
from salespark.llm.decontamination import decontaminate  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def answers(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


CONTAMINATION = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_equals_brute_force(spark):
    docs = brute.documents(spark, SMALL)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert answers(catalog.op1_decontamination(spark, SMALL), *CONTAMINATION) == brute.contaminated(docs, items)


@pytest.mark.parametrize("chars", [16_000_000, 0])
def test_decontamination_of_awkward_rows(spark, chars):
    items = [(1, "alpha beta gamma alpha beta gamma alpha beta gamma alpha beta"), (2, "One"), (3, None), (4, ""), (10, "one two"), (20, "ONE-two"), (5, "word " * 12), (6, "éa 漢字")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as window", "2 as length")
    found = decontaminate(brute.awkward(spark), table, broadcast_chars=chars)
    docs = [r[:2] for r in brute.AWKWARD]
    assert answers(found, *CONTAMINATION) == brute.contaminated(docs, items)
    assert brute.contaminated(docs, items)[8][2] == 3


def test_decontamination_of_nothing_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b"), (None, "b c")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate(docs, items).collect()}
    assert rows == {(1, 2, 2, ("7",)), (None, 3, 3, ("7",))}
    assert decontaminate(docs.limit(0), items).count() == 0
    assert [r["n_hit"] for r in decontaminate(docs, items.limit(0)).collect()] == [0, 0]


def test_simhash_equals_brute_force(spark):
    docs = brute.documents(spark, SMALL)
    assert answers(catalog.op5_simhash(spark, SMALL), "fingerprint", "component_id") == brute.simhash(docs)


def test_simhash_of_awkward_rows(spark):
    found = answers(simhash.near_duplicates(brute.awkward(spark)), "fingerprint", "component_id")
    assert found == brute.simhash([r[:2] for r in brute.AWKWARD])
    assert found[3] == found[2] == ("0" * 16, 2)
    assert simhash.near_duplicates(brute.awkward(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(twice).collect()), key=str)
    assert rows == [(3, 3), (3, 3), (None, 3), (None, None)]


def test_masks_cover_every_pair_within_the_radius():
    made = simhash.masks(2)
    assert len(made) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not mask >> i & 1 and not mask >> j & 1 for mask in made)


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_links_join_all_classes_within_two_bits(spark, limit):
    import random

    pick = random.Random(5)
    base = [pick.getrandbits(64) for _ in range(6)]
    prints = {b ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) ^ (pick.random() < 0.5) * (1 << pick.randrange(64)) for b in base for _ in range(60)}
    signed = sorted(simhash._signed(p) for p in prints)
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(table, pair_limit=limit).collect()]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert {e for e in edges} <= set(near)
    assert brute.components(edges, signed) == brute.components(near, signed)
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: roots.get(n, n) for n in signed} == brute.components(near, signed)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 999: 999, 1000: 999}


def check_mix(rows, docs):
    by = {}
    for doc, size, source_size, target, taken in rows:
        source = docs[doc][1]
        assert size == docs[doc][0] and 0 <= taken <= 2 * size and taken % max(size, 1) == 0
        total = by.setdefault(source, [source_size, target, 0, 0, 0])
        assert total[:2] == [source_size, target]
        total[2] += taken
        total[3] += size
        total[4] = max(total[4], size)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    targets = mixing.source_targets([by[s][3] for s in order])
    for source, target in zip(order, targets, strict=True):
        size, stated, taken, summed, largest = by[source]
        assert size == summed and abs(stated - target) < 1e-6
        assert abs(taken - target) <= largest / 2 + 1, source


def test_mix_meets_targets(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    docs = {r["doc_id"]: (len(brute.PLAIN.findall(r["text"] or "")), r["source"]) for r in rows}
    columns = ("doc_id", "size", "source_size", "target", "taken")
    first = [tuple(r[c] for c in columns) for r in catalog.op10_mixing(spark, SMALL).collect()]
    assert len(first) == len(docs)
    check_mix(first, docs)
    assert sorted(first) == sorted(tuple(r[c] for c in columns) for r in catalog.op10_mixing(spark, SMALL).collect())


def test_mix_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    found = mixing.mix(brute.awkward(spark), F.array("source"))
    rows = [(r["doc_id"], r["size"], r["sources"][0]["size"], r["sources"][0]["target"], r["taken"]) for r in found.collect()]
    check_mix(rows, {r[0]: (len(brute.PLAIN.findall(r[1] or "")), r[3]) for r in brute.AWKWARD})
    assert mixing.mix(brute.awkward(spark).limit(0), F.array("source")).count() == 0
    nowhere = mixing.mix(brute.awkward(spark), F.lit(None).cast("array<string>"))
    assert {r["taken"] for r in nowhere.collect()} == {0}


def test_targets_stop_at_twice_the_size_and_reshare():
    assert mixing.source_targets([10, 10, 10]) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert mixing.source_targets([1, 100, 0]) == [2.0, pytest.approx(149.5), 0.0]
    assert mixing.source_targets([]) == []


def test_routing_prefers_fresh_words_and_fills_quotas():
    shared = [((0,), 10), ((0, 1), 10), ((1,), 2)]
    flow = mixing.route(shared, [12, 12])
    assert sum(map(sum, flow)) == 24 and [f[0] for f in flow] == [10, 10, 2]
    assert mixing.route([((0,), 5)], [50]) == [[5, 5]]
    assert mixing.route([((), 5)], []) == [[0, 0]]


# --- nearest neighbours


def exact(rows, every=20, k=20):
    import numpy as np

    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        score = np.einsum("d,jd->j", x[i], x)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(found, truth):
    hits = total = 0
    for query, best in truth.items():
        mine = found.get(query, [])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert sorted(mine, key=lambda r: (-r[2], r[1])) == mine
        scores = dict(best)
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in mine if v in scores)
        hits += len({v for _, v, _ in mine} & set(scores))
        total += len(best)
    return hits / max(total, 1)


def grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_neighbours_recall(spark):
    from salespark.llm import neighbours

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    truth = exact([tuple(r) for r in vectors.collect()])
    assert recall(grouped(catalog.op8_neighbours(spark, "/root/testdata/sf0.1")), truth) >= 0.9
    assert recall(grouped(neighbours.nearest(vectors, cell_rows=200, query_rows=30)), truth) >= 0.9


def test_neighbours_of_awkward_rows(spark):
    from salespark.llm import neighbours

    bad = [(40, None), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 0.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (140, [1.0, 2.0])]
    good = [(i, [1.0, float(i % 7), -float(i % 3)]) for i in range(150) if i not in (40, 60, 80, 100, 120, 140)] + [(1000 + i, [2.0, 2.0, 2.0]) for i in range(60)]
    table = spark.createDataFrame([*bad, *good, good[3]], "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as entry", "3 as ids", "4 as cell", "5 as score")
    found = grouped(neighbours.nearest(table, cell_rows=16, query_rows=3, confidence=0.9999))
    truth = exact(good)
    assert found.keys() == truth.keys()
    assert recall(found, truth) > 0.97
    few = grouped(neighbours.nearest(table.where("vec_id in (0, 1, 2)")))
    assert {k: [(v, s) for _, v, s in r] for k, r in few.items()} == exact([g for g in good if g[0] in (0, 1, 2)])
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_chi_square_quantiles():
    from salespark.llm.neighbours import chi_square_quantile

    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 0.001
    assert abs(chi_square_quantile(0.5, 2) - 1.3863) < 0.001
