"""Nearest neighbours by inner product through low-dimensional stable projections.

Inner products become distances by one more coordinate: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. A Gaussian projection to m dimensions is 2-stable: projected over
true squared distance follows a chi-square law with m degrees of freedom. The projections are indexed by a
kd-tree; a query takes projected neighbours in order of distance, leaf by leaf, verifies them on the original
vectors, and stops when a true neighbour that is still unseen would have to lie further out in the projection than
the chi-square quantile of `confidence` allows. So each true neighbour is found with at least that probability.

The upper levels of the tree deal the vectors to cells, the lower ones are built inside a cell's task. Queries first
search their own cell; the distance they reach decides, by the same test, which other cells they visit. The split
points of the upper levels come from a bounded sample; every vector is indexed.

Equal vectors are one entry that lists the k+1 smallest ids: with ties going to smaller ids, no other copy can be
among the k nearest of anything. Equal queries are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salespark.session import ship_package, stage

LEAF = 32


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom, where the distribution has a closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Cells:
    """The upper levels of the kd-tree: node i has children 2i+1 and 2i+2; the last level are the cells."""

    depth: int
    axis: np.ndarray
    split: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.split[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def build_cells(sample: np.ndarray, depth: int) -> Cells:
    inner = (1 << depth) - 1
    axis, split = np.zeros(max(inner, 1), dtype=np.int64), np.zeros(max(inner, 1))
    groups = {0: sample}
    for node in range(inner):
        points = groups.pop(node)
        if len(points):
            axis[node] = int((points.max(axis=0) - points.min(axis=0)).argmax())
            split[node] = float(np.median(points[:, axis[node]]))
        right = points[:, axis[node]] > split[node]
        groups[2 * node + 1], groups[2 * node + 2] = points[~right], points[right]
    return Cells(depth, axis, split)


def leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    if len(rows) <= LEAF:
        return [rows]
    own = points[rows]
    axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
    order = np.argsort(own[:, axis], kind="stable")
    half = len(rows) // 2
    return leaves(points, rows[order[:half]]) + leaves(points, rows[order[half:]])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


def search(queries: np.ndarray, placed: np.ndarray, reach: np.ndarray, vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, norm2: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, rows), each with k columns, best first and missing ones at -inf and -1.

    placed and points are projections; reach is the squared distance that each query has reached elsewhere.
    """
    scores, rows = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    parts = leaves(points, np.arange(len(points)))
    low, high = np.array([points[p].min(axis=0) for p in parts]), np.array([points[p].max(axis=0) for p in parts])
    far = box_distances(placed, low, high)
    order = np.argsort(far, axis=1, kind="stable")
    own2 = np.einsum("ij,ij->i", queries, queries)
    known_ids = np.append(ids, np.iinfo(np.int64).max)  # of missing rows, at -1
    active = np.arange(len(queries))
    for step in range(len(parts)):
        leaf = order[active, step]
        kth = np.minimum(np.maximum(own2[active] + norm2 - 2 * scores[active, -1], 0), reach[active])
        going = far[active, leaf] <= factor * kth  # the stopping test; boxes come in order of distance
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        for part in np.unique(leaf):
            who, what = active[leaf == part], parts[part]
            found = np.einsum("id,jd->ij", queries[who], vectors[what])
            all_scores = np.hstack([scores[who], found])
            all_rows = np.hstack([rows[who], np.broadcast_to(what, found.shape)])
            best = np.lexsort((known_ids[all_rows], -all_scores), axis=1)[:, :k]
            scores[who], rows[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_rows, best, 1)
    return scores, rows


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), pa.float64()))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): one row per id, without null, zero or non-finite vectors, of the most common length."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    kept = vectors.select("vec_id", F.transform(x, lambda v: v + F.lit(0.0)).alias("embedding")).where("vec_id is not null and embedding is not null").where(fine)  # -0.0 becomes 0.0
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, dimensions: int = 12, confidence: float = 0.97, cell_rows: int = 4096, query_rows: int = 2048, most_cells: int = 4096, sample_rows: int = 32_768, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`.

    vectors needs vec_id and embedding; other columns are ignored. Null, zero and non-finite vectors and null ids take
    no part, nor do vectors of another length than the most common one; of rows that repeat an id the smallest vector
    counts. Without two usable vectors there are no rows. `sample_rows` bounds the sample behind the upper splits.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stage(usable(vectors), "neighbours-rows")
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return empty
    d = length["d"]
    rows = rows.where(F.size("embedding") == d)
    copies = W.partitionBy("embedding").orderBy("vec_id")
    entries = (
        rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("entry", F.col("ids")[0])
    )
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    entries = stage(entries, "neighbours-entries")
    asking = stage(asked.join(entries.select("embedding", "entry"), "embedding").select("query_id", "entry"), "neighbours-queries")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)).alias("norm2")).first()
    norm2 = facts["norm2"]
    matrix = np.random.default_rng(seed).standard_normal((d + 1, dimensions))
    factor = chi_square_quantile(confidence, dimensions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                last = np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", x, x), 0))
                points, asks = x @ matrix[:-1] + np.outer(last, matrix[-1]), x @ matrix[:-1]
                yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("ids"), batch.column("embedding"), _lists(points), _lists(asks)], names=["entry", "ids", "embedding", "point", "ask"])

    schema = "entry long, ids array<long>, embedding array<double>, point array<double>, ask array<double>"
    placed = stage(entries.select("entry", "ids", "embedding").mapInArrow(place, schema), "neighbours-placed")
    depth = min(max(0, math.ceil(math.log2(max(1, facts["n"] / cell_rows)))), int(math.log2(most_cells)))
    sample = placed.select("entry", "point").orderBy(F.xxhash64("entry"), "entry").limit(sample_rows).collect() if depth else []
    cells = build_cells(np.array([r["point"] for r in sample]).reshape(-1, dimensions), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                where = cells.of(_matrix(batch.column("point")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int64())], names=[*batch.schema.names, "cell"])

    dealt = stage(placed.select("entry", "ids", "embedding", "point").mapInArrow(deal, "entry long, ids array<long>, embedding array<double>, point array<double>, cell long"), "neighbours-cells")
    corners = [f(F.col("point")[i]).alias(f"{n}{i}") for i in range(dimensions) for n, f in (("low", F.min), ("high", F.max))]
    boxes = sorted(dealt.groupBy("cell").agg(F.count("*").alias("n"), *corners).collect(), key=lambda r: r["cell"])  # at most most_cells
    names = np.array([r["cell"] for r in boxes])
    low, high = (np.array([[r[f"{side}{i}"] for i in range(dimensions)] for r in boxes]) for side in ("low", "high"))
    split_of = {r["cell"]: max(1, math.ceil(r["n"] / (2 * cell_rows))) for r in boxes}  # uneven cells are searched in pieces

    def choose(first: bool):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = box_distances(_matrix(batch.column("ask")), low, high)
                nearest_box = far.argmin(axis=1)
                if first:
                    who, which = np.arange(len(far)), nearest_box
                else:
                    reach = np.asarray(batch.column("reach"))
                    far[np.arange(len(far)), nearest_box] = np.inf  # searched in the first round
                    who, which = np.nonzero(far <= factor * np.nan_to_num(reach, posinf=1e300)[:, None])
                taken = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names[which], pa.int64())], names=[*taken.schema.names, "cell"])

        return visit

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("entry", pa.int64()), ("ids", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        right = right.sort_by("entry")
        ids = right.column("entry").to_numpy()
        scores, found = search(_matrix(left.column("embedding")), _matrix(left.column("ask")), left.column("reach").to_numpy(), _matrix(right.column("embedding")), _matrix(right.column("point")), ids, k + 1, norm2, factor)
        who, rank = np.nonzero(found >= 0)
        hit = found[who, rank]
        return pa.table([left.column("query").take(pa.array(who)), pa.array(scores[who, rank]), pa.array(ids[hit]), right.column("ids").take(pa.array(hit))], schema=out)

    def round_of(searching: DataFrame, first: bool, label: str) -> DataFrame:
        visits = stage(searching.mapInArrow(choose(first), "query long, embedding array<double>, ask array<double>, reach double, cell long"), f"neighbours-visits-{label}")
        crowd = {r["cell"]: math.ceil(r["n"] / query_rows) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not crowd:
            return spark.createDataFrame([], "query long, score double, entry long, ids array<long>")
        plan = F.broadcast(spark.createDataFrame([(c, n, split_of[c]) for c, n in sorted(crowd.items())], "cell long, blocks int, pieces int"))  # at most most_cells rows
        every_piece = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
        every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        left = visits.join(plan, "cell").select("query", "embedding", "ask", "reach", "cell", F.pmod(F.xxhash64("query"), "blocks").cast("int").alias("block"), every_piece)
        right = dealt.join(plan, "cell").select("entry", "ids", "embedding", "point", "cell", F.pmod(F.xxhash64("entry"), "pieces").cast("int").alias("piece"), every_block)
        by = ["cell", "block", "piece"]
        return stage(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(look, "query long, score double, entry long, ids array<long>"), f"neighbours-found-{label}")

    asks = asking.select("entry").distinct().join(placed, "entry").select(F.col("entry").alias("query"), "embedding", "ask", F.lit(float("inf")).alias("reach"))
    asks = stage(asks, "neighbours-asks")
    best = W.partitionBy("query").orderBy(F.desc("score"), "entry")
    one = round_of(asks, True, "one")
    own2 = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    kth = one.withColumn("n", F.row_number().over(best)).where(F.col("n") == k + 1).select("query", "score")
    reached = asks.drop("reach").join(kth, "query", "left").select("query", "embedding", "ask", F.coalesce(F.greatest(own2 + norm2 - 2 * F.col("score"), F.lit(0.0)), F.lit(float("inf"))).alias("reach"))
    found = one.unionByName(round_of(reached, False, "two"))
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "score", F.explode("ids").alias("vec_id"))
    nearest_rows = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = top.withColumn("n", F.row_number().over(nearest_rows)).where(F.col("n") <= k + 1).select("query", "score", "vec_id")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asking.join(top, asking["entry"] == top["query"]).where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
