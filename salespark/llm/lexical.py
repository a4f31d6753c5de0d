"""Ranked lexical search by NRA ("no random access") over segments of documents with impact-sorted lists.

1. Every document is cut into terms once; its length and the frequencies of the terms that items use are written down.
2. Document frequencies, the number of documents and their total length come from that table, over all documents.
3. Each task cuts its documents into segments of about `segment_postings` entries. A segment holds one list per
   term, sorted by falling impact (a term's share of a document's score). Items read their lists in parallel, block
   by block. A document's score lies between `low`, the sum of the impacts read, and `low` plus the next impact of
   each list in which it was not met yet. Reading goes on until no document outside the best can reach the last of
   them and the scores of all that can reach it are final, ties included. A task's best of earlier segments is a
   threshold that later segments start with.
4. The best of all segments are merged by Spark, which keeps `k` per item in each task first.

What a task holds is a segment; what is sent to tasks is one block of items, cut by their length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salespark.llm.common import LOWER, UPPER
from salespark.operators.ranking import running_total
from salespark.session import ship_package, stage

NO_ID = np.iinfo(np.int64).max  # of a null doc_id: last among equal scores
_BREAKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_TERMS = bytes.maketrans((UPPER + _BREAKS).encode(), (LOWER + " " * len(_BREAKS)).encode())


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _term_counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): length and the listed terms of each document that has any term."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, listed, often = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                counts = [(number, tf) for term, tf in Counter(found).items() if (number := numbers.get(term)) is not None]
                ids.append(doc)
                lengths.append(len(found))
                listed.append([c[0] for c in counts])
                often.append([c[1] for c in counts])
            made = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(listed, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(answer, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


class Segment:
    """Impact-sorted lists over some documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, rows: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int):
        self.ids = ids
        norm = 25 + (75 * lengths * documents) // total
        impacts = weights[numbers] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * norm[rows]))
        order = np.lexsort((-impacts, numbers))
        self.rows, self.impacts = rows[order], impacts[order]
        self.starts = np.searchsorted(numbers[order], np.arange(len(weights) + 1))

    def best(self, query: list[tuple[int, int]], k: int, floor: int = 1, block: int = 1024) -> tuple[list[tuple[int, int]], int]:
        """((score, row) of the k best documents that reach `floor`, entries read); equal scores by id."""
        lists = [(int(self.starts[t]), int(self.starts[t + 1]), times) for t, times in query if self.starts[t] < self.starts[t + 1]]
        low, read = np.zeros(len(self.ids), np.int64), [start for start, _, _ in lists]
        while True:
            ahead = []  # of each list: the most that an unread entry adds
            for i, (_, end, times) in enumerate(lists):
                upto = min(end, read[i] + block)
                low[self.rows[read[i] : upto]] += times * self.impacts[read[i] : upto]
                read[i] = upto
                ahead.append(times * int(self.impacts[upto]) if upto < end else 0)
            block *= 4
            unseen = sum(ahead)
            last = max(floor, int(np.partition(low, -k)[-k]) if len(low) >= k else 0)
            if unseen >= last:
                continue
            possible = np.flatnonzero(low + unseen >= last)
            if unseen:
                high = low + unseen  # less what the next impacts of the lists in which it was met can't add
                for (start, _, _), upto, most in zip(lists, read, ahead, strict=True):
                    if most:
                        high[self.rows[start:upto]] -= most
                possible = possible[high[possible] >= last]
                if (high[possible] > low[possible]).any():
                    continue
            ranked = possible[np.lexsort((self.ids[possible], -low[possible]))][:k]
            return [(int(low[row]), int(row)) for row in ranked], sum(read) - sum(start for start, _, _ in lists)


def _segments(batches: Iterator[pa.RecordBatch], size: int, weights: np.ndarray, documents: int, total: int) -> Iterator[Segment]:
    ids, lengths, counts, numbers, tfs, held = [], [], [], [], [], 0

    def made() -> Segment:
        rows = np.repeat(np.arange(sum(map(len, ids))), np.concatenate(counts))
        return Segment(np.concatenate(ids), np.concatenate(lengths), rows, np.concatenate(numbers), np.concatenate(tfs), weights, documents, total)

    for batch in batches:
        ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
        lengths.append(batch.column("n").to_numpy())
        counts.append(np.diff(batch.column("terms").offsets.to_numpy()))
        numbers.append(batch.column("terms").flatten().to_numpy())
        tfs.append(batch.column("tfs").flatten().to_numpy())
        held += len(numbers[-1])
        if held >= size:
            yield made()
            ids, lengths, counts, numbers, tfs, held = [], [], [], [], [], 0
    if ids:
        yield made()


def _search_block(docs: DataFrame, queries: dict[int, Counter[bytes]], k: int, segment_postings: int) -> DataFrame:
    """(item, doc_id, score): for each numbered item the best k documents of every task."""
    numbers = {term: i for i, term in enumerate(sorted(set().union(*queries.values())))}
    counted = stage(_term_counts(docs, numbers), "lexical-terms")
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(numbers), np.int64)
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
        having[row["t"]] = row["count"]
    weights = np.array([weight(documents, int(n)) for n in having], np.int64)
    asked = [(item, [(numbers[t], n) for t, n in sorted(query.items())]) for item, query in sorted(queries.items())]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {item: [] for item, _ in asked}  # (-score, doc_id)
        for segment in _segments(batches, segment_postings, weights, documents, total):
            for item, query in asked:
                so_far = best[item]
                found, _ = segment.best(query, k, -so_far[-1][0] if len(so_far) == k else 1)
                if found:
                    best[item] = sorted(so_far + [(-score, int(segment.ids[row])) for score, row in found])[:k]
        rows = [(item, doc, -score) for item, found in best.items() for score, doc in found]
        columns = [pa.array([r[i] if r[i] != NO_ID else None for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return counted.mapInArrow(answer, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 4_000_000, segment_postings: int = 1 << 22) -> DataFrame:
    """(item_id, rank, doc_id, score): per item the k documents of largest score above 0, equal scores by doc_id.

    docs needs doc_id and text, items item_id and text; other columns are ignored. Null and empty texts have no terms:
    such documents don't count, such items find nothing. Repeated document rows are documents of their own; a null
    doc_id comes last among equal scores. Item rows equal in id and text are one item, those of one id with
    different texts are answered each. Items are asked in blocks of about `block_chars` characters.
    """
    ship_package(docs.sparkSession)
    own = items.select("item_id", "text").distinct().withColumn("_at", F.xxhash64("item_id", "text")).withColumn("_chars", F.coalesce(F.char_length("text"), F.lit(0)) + 1)
    placed = running_total(running_total(own, ["item_id", "_at"], name="item"), ["item"], F.col("_chars"), name="_upto")
    placed = stage(placed.select("item", "item_id", "text", F.floor(F.col("_upto") / block_chars).alias("_block")), "lexical-items")
    found = None
    for block in sorted(r["_block"] for r in placed.select("_block").distinct().collect()):
        queries = {r["item"]: Counter(terms(r["text"])) for r in placed.where(F.col("_block") == block).select("item", "text").collect()}
        part = _search_block(docs, queries, k, segment_postings)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return placed.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(placed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
