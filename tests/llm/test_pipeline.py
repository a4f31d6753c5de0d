"""The pipeline against plain Python, stage by stage, and on awkward rows."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from salespark.llm import pii  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def survivors(docs, items):
    docs = {d: t for d, t in docs if t and any(map(str.isalpha, t))}
    left = brute.near_survivors(docs.items())
    docs = {d: t for d, t in docs.items() if d in left}
    hit = brute.contaminated(docs.items(), items)
    return {d: t for d, t in docs.items() if not hit[d][-1]}


def test_stages_are_the_listed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "source_mix"]


def test_pipeline_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    left = survivors(brute.documents(spark, SMALL), items)
    assert 0 < len(left) < table.count()
    kept = table.where(table["doc_id"].isin(list(left)))
    texts = {r["doc_id"]: r["text"] for r in pii.pseudonymize(kept, corpus_pipeline.PII_KEY).collect()}
    sources = {r["doc_id"]: r["source"] for r in kept.collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    by = {}
    for r in rows:
        assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["source"] == sources[r["doc_id"]]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (1, 2)
        by.setdefault(r["source"], []).append(r)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    sizes = {}
    for d, text in texts.items():
        sizes.setdefault(sources[d], []).append(len(brute.PLAIN.findall(text)))
    for source, group in by.items():
        assert group[0]["source_size"] == sum(sizes[source])
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(sizes[source]) / 2 + 1


def test_awkward_documents_pass_all_stages(spark):
    docs = brute.awkward(spark, [*brute.AWKWARD, brute.AWKWARD[0], (None, "a null id", "en", "z"), (None, "a null id", "en", "z")]).drop("size")
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, docs, SMALL)
        if i < 4:
            assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        if i == 1:
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 6, 7, 8, 9]
        assert step(spark, docs.limit(0), SMALL).count() == 0 if i < 4 else True
    assert {r["doc_id"] for r in docs.collect()} <= {None, 1, 6, 7, 8, 9}
