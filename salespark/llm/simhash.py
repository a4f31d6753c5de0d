"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are compared under `masks(radius)`, 2^(radius+1) - 1 bit masks made from one vector of
radius+1 bits for each bit position: mask v keeps the positions whose vector has an odd inner product with v. The
vectors of any `radius` positions span too little to exclude all v, so some mask drops every position in which a
pair within the radius differs: the pair is equal under that mask and meets in that table. No link is missed.

Equal fingerprints are one class from the start, so copies never form pairs. In a table, a bucket of at most
`pair_limit` classes is compared pair by pair. A larger bucket is linked without pairs, and just as exactly:
each member visits itself and its one-bit neighbours, and those that share such a meeting point are at most two
bits apart; chains of those links give the same components. Links become components by large-star and small-star
rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.session import ship_package, stage

BITS = 64
SEED = 42  # of XXH64, by contract
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit set if it is set in over half the shingle hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    width = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))
    digest, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(BITS, dtype=np.int64)
    while hashes := [digest(s, SEED) for s in islice(shingles, _CHUNK)]:
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(radius: int) -> list[int]:
    """One mask for each non-zero vector v; bit i is kept if v and the vector of i have an odd inner product."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]  # all non-zero vectors, evenly
    return [sum(1 << i for i, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(text, shingle)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(answer, kept.select("doc_id").schema.add("fp", "long"))


def links(classes: DataFrame, radius: int = 2, pair_limit: int = 32) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints (column fp) that join all classes within the radius."""
    if radius != 2:
        raise ValueError("Large buckets are linked by meeting points, which stand for two bits exactly.")
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    keyed = classes.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", "t.key")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = keyed.join(sizes, ["table", "key"])
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    few = shared.where(F.col("members") <= pair_limit)
    listed = few.groupBy("table", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = listed.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & near(b, F.col("a")))).alias("b"))
    # All members agree on the kept bits, so only dropped bits can differ.
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks(radius)])
    met = (
        shared.where(F.col("members") > pair_limit)
        .select("table", "fp", F.explode(F.transform(F.get(flips, F.col("table")), lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
        .groupBy("table", "point")
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))  # at most 65: neighbours of one fingerprint and itself
        .where(F.size("fps") > 1)
    )
    stars = met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (a, b); nodes without edges don't appear."""
    current, before = stage(edges.select("a", "b").where("a <> b"), "components-links"), None
    while True:
        # large star: larger neighbours move to the smallest neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        current = stage(small.where("a <> b").distinct(), "components-round")
        # a fixed point is a set of stars; their number and sums don't change any more
        now = current.agg(F.count("*"), F.countDistinct("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, pair_limit: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id that links of at most `radius` bits reach, the own one included. Null texts
    and texts without words have fingerprint zero, which is linked like any other. A null doc_id is never the
    smallest; a component of null ids only has a null component_id. Repeated rows are answered one by one.
    Columns other than doc_id and text are ignored.
    """
    marked = stage(fingerprints(docs, shingle), "simhash-fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes, radius, pair_limit))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first_id")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    moved = linked.join(firsts, "root").select("fp", "linked_id")
    ids = stage(classes.join(moved, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id")), "simhash-ids")
    return marked.join(ids, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
