"""Near copies by exact Jaccard similarity of word shingles, with SimHash links and MinHash bands as candidates.

Documents with equal shingle sets are one class from the start. Candidates come from two sources: classes whose
SimHash fingerprints are within two bits (`simhash.links`), and classes that share one of `BANDS` keys, each made from
`ROWS` minima of the shingle hashes. A pair with similarity s shares none of the keys with probability
(1 - s^ROWS)^BANDS: 3e-6 at 0.8, less above. Every link is verified on the full sets.

No bucket is compared in all pairs. Each member meets the bucket's centre first, the member whose own buckets are
the fullest; the links make components. Buckets that still hold several components are settled by a set join over
their members: a member's shingles are put in order of rarity, and a pair of at least the wanted similarity must
share one of the first few. A length bound and the positions of the shared shingle exclude nearly all other pairs:
what a changed copy has of its own is rare, fills these first places and meets nobody.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salespark.llm.simhash import BITS, SEED, components
from salespark.llm.simhash import links as simhash_links
from salespark.session import ship_package, stage

BANDS, ROWS = 32, 5
_CHUNK = 1 << 12
_HEAD = 64  # shingles of a prefix that tell whether a pair has met before; the rest is left to `distinct`
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; a shorter text is one shingle; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in simhash.fingerprint
    if not words:
        return np.empty(0, np.uint64)
    width = min(shingle, len(words))
    joined = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in joined), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key per band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (_FACTORS * hashes[i : i + _CHUNK] + _SHIFTS).min(axis=1))
    data, size = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(data[i * size : (i + 1) * size], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(own_id, text_key, node, fp, keys): node names the shingle set."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, shingle)
                nodes.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                prints.append(set_fingerprint(hashes))
                keys.append(band_keys(hashes))
            made = [pa.array(nodes, pa.string()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), batch.column("text_key"), *made], names=["own_id", "text_key", "node", "fp", "keys"])

    return docs.select("own_id", "text_key", "text").mapInArrow(answer, "own_id long, text_key long, node string, fp long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, held = [], None, None
            for a, first, second in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if a != last:
                    last, held = a, shingle_set(first, shingle)
                good.append(alike(held, shingle_set(second, shingle), least))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(answer, "a string, b string")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, members): band keys of at least two nodes; keys with the same members count once."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    own = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), *own).where("members > 1")
    once = sizes.groupBy("members", "mark0", "mark1").agg(F.min("key").alias("key"))
    return keyed.join(once.select("key", "members"), "key").select("key", "node", "members")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): one node of each fingerprint with the others of it and with one of each linked fingerprint."""
    classes = stage(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    same = nodes.join(classes, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    of = lambda side: classes.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}"))
    met = simhash_links(classes).join(of("a"), "a").join(of("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.unionByName(met)


def _needed(n: Column, m: Column, least: float) -> Column:
    """The least overlap with which sets of n and m shingles are similar."""
    return F.ceil((n + m) * (least / (1 + least)) - 1e-9)


def _prefix_pairs(placed: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """(a, b): pairs of nodes with different roots that may be similar; placed has (node, root)."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle) for text in batch.column("text").to_pylist()]
            listed = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), listed], names=["node", "root", "shingles"])

    sets = stage(placed.join(texts, "node").select("node", "root", "text").mapInArrow(answer, "node string, root string, shingles array<long>"), "near-sets")
    tokens = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("having"))
    by_node = Window.partitionBy("node")
    lone = F.sum((F.col("having") == 1).cast("int")).over(by_node)  # shingles that no other node has can't be shared
    ordered = tokens.join(counted, "token").withColumn("at", F.row_number().over(by_node.orderBy("having", "token")) - 1).withColumn("most", F.col("n") - lone)
    first = stage(ordered.where(F.col("having") > 1).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9)).drop("having"), "near-prefixes")
    # pairs inside a component need no proof, so of each token's members those of its largest component are only met
    owners = first.groupBy("token", "root").agg(F.count("*").alias("members")).groupBy("token")
    split = owners.agg(F.max(F.struct("members", "root"))["root"].alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    heads = first.where(F.col("at") < _HEAD).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("head"))
    heads = heads.select("node", F.transform("head", lambda t: t["token"]).alias("head"))
    place = F.array_position("head", F.col("token")).cast("int")
    earlier = F.when(place > 0, F.slice("head", F.lit(1), F.greatest(place - 1, F.lit(0)))).otherwise(F.col("head")).alias("earlier")
    columns = ("node", "root", "n", "at", "most", "earlier")
    shared = first.join(split.select("token", "largest"), "token").join(heads, "node", "left").withColumn("head", F.coalesce("head", F.array().cast("array<long>")))
    shared = stage(shared.select("token", "largest", *columns[:-1], earlier), "near-shared")
    other = shared.select("token", *[F.col(c).alias(f"{c}_b") for c in columns])
    # a similar pair also meets at the first shingle that both hold, and there all they share lies behind
    rest = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"), F.col("most"), F.col("most_b"))
    met_before = F.arrays_overlap("earlier", "earlier_b")
    possible = (
        (F.col("root") != F.col("root_b"))
        & ((F.col("root_b") == F.col("largest")) | (F.col("node") < F.col("node_b")))
        & (F.least("n", "n_b") >= F.greatest("n", "n_b") * least - 1e-9)
        & (rest >= _needed(F.col("n"), F.col("n_b"), least))
        & ~met_before
    )
    met = shared.where("root <> largest").join(other, "token").where(possible)
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(own_id, text_key) of one document of each group: the smallest.

    docs needs own_id, text_key (a hash of the text) and text; other columns are ignored. Groups are connected by
    pairs with a Jaccard similarity of at least `least`; null texts and texts without words are one group, repeated
    rows one document. An empty table gives no rows. Texts are compared whole, whatever their length.
    """
    ship_package(docs.sparkSession)
    first = lambda own="own_id", key="text_key": F.struct(F.col(own).alias("own_id"), F.col(key).alias("text_key"))
    marked = stage(_sketched(docs, shingle), "near-sketches")
    nodes = stage(marked.groupBy("node").agg(F.min(first()).alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "near-nodes")
    shared = stage(_buckets(nodes), "near-buckets")
    weights = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    centres = shared.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    stars = shared.join(centres, "key").where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    pairs = stage(stars.unionByName(_simhash_pairs(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "near-stars")
    wanted = shared.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    reps = nodes.join(wanted, "node", "left_semi").select("node", "first.*")
    texts = stage(docs.join(reps, ["own_id", "text_key"]).dropDuplicates(["node"]).select("node", "text"), "near-texts")
    links = stage(_verified(pairs, texts, least, shingle), "near-links")
    placed = shared.join(_roots(shared, links), "node")
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_ = placed.join(split.select("key"), "key", "left_semi").select("node", "root").distinct()
    crossed = stage(_prefix_pairs(open_, texts, least, shingle), "near-crossed")
    links = links.unionByName(stage(_verified(crossed, texts, least, shingle), "near-crossed-links"))
    found = nodes.join(_roots(nodes, links), "node").groupBy("root").agg(F.min("first").alias("first"))
    return found.select("first.*")


def _roots(table: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the table; root is the own node without links."""
    found = components(links)
    return table.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
