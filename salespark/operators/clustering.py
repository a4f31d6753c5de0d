"""K-Means with many restarts in one pass per round, and mean silhouettes in plain Euclidean distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.operators.distances import basis, far_sums, near_sums
from salespark.session import ship_package, stage


@dataclass
class Model:
    k: int
    centres: np.ndarray
    cost: float = math.inf
    settled: bool = False


def _spread_out(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting centres from a sample, each chosen in proportion to its squared distance from those before (k-means++)."""
    pick = np.random.default_rng(seed)
    centres = [sample[pick.integers(len(sample))]]
    nearest = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = nearest.sum()
        chosen = pick.choice(len(sample), p=nearest / total) if total > 0 else pick.integers(len(sample))
        centres.append(sample[chosen])
        nearest = np.minimum(nearest, ((sample - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _add_up(x: np.ndarray, weight: np.ndarray, models: list[Model], piece: int = 1024) -> np.ndarray:
    """Per centre of the models: the weight and the weighted sums of the points nearest to it, and its share of the cost.

    Squared distances to all centres come from one product of matrices per piece, models with the same number of groups
    are compared at once, and sums are a product with the marks of who belongs where. What all centres share of the
    distances, the point's own square, is only added to the cost.
    """
    centres = np.concatenate([m.centres for m in models])
    starts = np.cumsum([0, *[m.k for m in models]])[:-1]
    of_k = {k: np.array([start for start, m in zip(starts, models, strict=True) if m.k == k]) for k in sorted({m.k for m in models})}
    order = np.concatenate([firsts + group for k, firsts in of_k.items() for group in range(k)])
    factors = np.column_stack([-2 * centres, (centres**2).sum(axis=1)])[order]
    valued = np.column_stack([x, np.ones(len(x))])
    weighted, own_square = valued * weight[:, None], weight @ (x**2).sum(axis=1)
    missing = ~np.isfinite(x).all(axis=1)
    weighted[missing, :-1] = 0
    sums, costs = np.zeros((len(centres), x.shape[1] + 1)), np.zeros(len(centres))
    for start in range(0, len(x), piece):
        these = slice(start, start + piece)
        squared = factors @ valued[these].T
        marks, at = np.empty(squared.shape), 0
        for k, firsts in of_k.items():
            own = squared[at : at + k * len(firsts)].reshape(k, len(firsts), -1)
            least = own[0]
            for group in range(1, k):
                least = np.minimum(least, own[group])
            hit = own == least
            if np.count_nonzero(hit) != least.size:  # ties, or no number
                hit = own.argmin(axis=0) == np.arange(k)[:, None, None]
            marks[at : at + k * len(firsts)] = hit.reshape(-1, own.shape[2])
            costs[firsts] += least @ weight[these]
            at += k * len(firsts)
        sums[order] += marks @ weighted[these]
        if missing[these].any():  # such a point spoils the group it is put in, and no other
            sums[order[marks[:, missing[these]].any(axis=1)], :-1] = np.nan
    costs[starts] += own_square
    return np.column_stack([sums[:, -1], costs, sums[:, :-1]])


def _packed(points: DataFrame, columns: list[str]) -> DataFrame:
    """The points as one row of plain numbers per batch, which costs less to hand to Python again and again than rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*columns, "weight"]])
            yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], names=["numbers"])

    return points.select(*columns, "weight").mapInArrow(pack, "numbers binary")


def _sums(points: DataFrame, columns: list[str], models: dict[int, Model], packed: DataFrame | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per model: points and coordinate sums of each group, and the cost. One job of one stage; one small row per task.

    Points have a weight; they are read from `packed` where the caller keeps them.
    """
    listed = list(models.values())
    shape = (sum(m.k for m in listed), len(columns) + 2)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for numbers in batch.column("numbers"):
                held = np.frombuffer(numbers.as_buffer()).reshape(len(columns) + 1, -1)
                total += _add_up(held[:-1].T, held[-1], listed)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = (packed or _packed(points, columns)).mapInArrow(answer, "sums binary").collect()  # as many rows as tasks
    total = sum((np.frombuffer(part["sums"]).reshape(shape) for part in parts), np.zeros(shape))
    split = np.split(total, np.cumsum([m.k for m in listed])[:-1])
    return {number: (part[:, 0], part[:, 2:], float(part[:, 1].sum())) for number, part in zip(models, split, strict=True)}


def equal_as_one(points: DataFrame, columns: list[str]) -> DataFrame:
    """One row per place with the number of its points as `weight`, dealt out to all cores."""
    dealt = points.select(*columns).repartition(points.sparkSession.sparkContext.defaultParallelism, *columns)
    return dealt.groupBy(*columns).agg(F.count(F.lit(1)).alias("weight"))


def fit_all(points: DataFrame, columns: list[str], k_values, restarts: int = 10, seed: int = 0, max_iter: int = 100, tol: float = 1e-4, start_points: int = 4096) -> dict[int, Model]:
    """The cheapest of `restarts` models for each k. All models that still move advance in the same job.

    Starting centres are chosen among `start_points` points (those of smallest hash); everything else covers all
    points. A column `weight` (see `equal_as_one`) makes a row count that often. A model has settled when no centre moves by
    more than `tol`; a group that lost its points keeps its centre.
    """
    ship_package(points.sparkSession)
    hashed = F.xxhash64(*columns)
    weighted = points if "weight" in points.columns else points.withColumn("weight", F.lit(1).cast("bigint"))
    first = weighted.select(*columns, "weight").orderBy(hashed, *columns).limit(start_points).collect()
    sample = np.repeat([[r[c] for c in columns] for r in first], [r["weight"] for r in first], axis=0)[:start_points]
    models = dict(enumerate(Model(k, _spread_out(sample, k, seed + i)) for k in k_values for i in range(restarts)))
    packed = _packed(weighted, columns).persist()
    try:
        for _ in range(max_iter):
            moving = {number: m for number, m in models.items() if not m.settled}
            if not moving:
                break
            for number, (counts, sums, _) in _sums(weighted, columns, moving, packed).items():
                m = models[number]
                moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], m.centres)
                m.settled = bool((np.sqrt(((moved - m.centres) ** 2).sum(axis=1)) <= tol).all())
                m.centres = moved
        for number, (_, _, cost) in _sums(weighted, columns, models, packed).items():
            models[number].cost = cost
    finally:
        packed.unpersist()
    return {k: min((m for m in models.values() if m.k == k), key=lambda m: m.cost) for k in k_values}


def nearest(model: Model, columns: list[str]) -> Column:
    """The number of the nearest centre (the first one on ties)."""
    far = [sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in model.centres]
    return F.array_min(F.array(*[F.struct(d.alias("far"), F.lit(i).alias("group")) for i, d in enumerate(far)]))["group"]


def euclidean_silhouettes(points: DataFrame, columns: list[str], models: dict[int, Model], grain: float | None = None, block: int = 16384, all_pairs: int = 65536, crowd: int = 1024) -> dict[int, float]:
    """Per k: the mean of (b - a) / max(a, b) over all points; 0 where all points are in one group.

    a is a point's mean distance to the others of its group, b the smallest mean distance to another group; a point
    alone in its group counts 0. Points at the same place are one place with a weight; `grain` rounds coordinates to its
    multiples, which bounds the number of places by the extent of the data, whatever the number of points, and moves no
    distance by more than grain * sqrt(dimensions).

    Up to `all_pairs` places every distance is computed: places are dealt into blocks of about `block`, and a task adds up
    the distances of each place of one block to the groups of another. Beyond, the same sums are taken cell by cell
    (`_scores_by_cell`, to about ten digits of the mean), so that the work does not grow with the square of the places.
    """
    ship_package(points.sparkSession)
    rounded = [F.col(c) if grain is None else (F.round(F.col(c) / grain) * grain).alias(c) for c in columns]
    places = points.select(*rounded).groupBy(*columns).agg(F.count(F.lit(1)).alias("weight"))
    labels = {f"group_{k}": nearest(m, columns) for k, m in models.items()}
    places = stage(places.select("*", *[label.alias(name) for name, label in labels.items()], F.xxhash64(*columns).alias("place")), "silhouette-places")
    offsets = dict(zip(models, np.cumsum([0, *models]).tolist(), strict=False))
    sizes = {k: {} for k in models}
    for row in places.groupBy(*labels).agg(F.sum("weight").alias("n")).collect():  # as many rows as groups that meet
        for k in models:
            sizes[k][row[f"group_{k}"]] = sizes[k].get(row[f"group_{k}"], 0) + row["n"]
    numbers = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf) for c in columns]
    extent = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in columns]
    told = places.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~ok).alias(f"not_{c}") for ok, c in zip(numbers, columns, strict=True)], *extent).first()
    by_cell = told["n"] > all_pairs and not any(told[f"not_{c}"] for c in columns)
    if by_cell:
        scored = _scores_by_cell(places, columns, offsets, sizes, told["n"], max(told[f"max_{c}"] - told[f"min_{c}"] for c in columns), crowd)
    else:
        scored = _scores_of_pairs(places, columns, offsets, sizes, max(1, math.ceil(told["n"] / block)))
    means = scored.agg(*[(F.sum(f"score_{k}") / F.sum("weight")).alias(f"score_{k}") for k in models]).first()
    return {k: means[f"score_{k}"] if len(sizes[k]) > 1 else 0.0 for k in models}


def _shares(table: pa.Table, offsets: dict[int, int]) -> np.ndarray:
    """The weight of each place, in the column of its group for each k."""
    share = np.zeros((len(table), sum(offsets)))
    for k, offset in offsets.items():
        share[np.arange(len(table)), offset + table.column(f"group_{k}").to_numpy()] = table.column("weight").to_numpy()
    return share


def _scores_of_pairs(places: DataFrame, columns: list[str], offsets: dict[int, int], sizes: dict[int, dict[int, int]], blocks: int) -> DataFrame:
    """Per place: its weight and weighted score for each k, from the distances to all places."""
    width = sum(offsets)
    placed = places.withColumn("own", F.pmod("place", F.lit(blocks)))
    ids = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = placed.withColumn("other", ids).withColumn("row", F.lit(True))
    against = placed.withColumnRenamed("own", "mine").withColumn("own", ids).withColumnRenamed("mine", "other").withColumn("row", F.lit(False))

    def add_up(table: pa.Table) -> pa.Table:
        is_row = table.column("row").to_numpy()
        x = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        sums = near_sums(x[is_row], x[~is_row], _shares(table.filter(pa.array(~is_row)), offsets))
        return pa.table({"place": table.filter(table.column("row")).column("place"), **{f"s{i}": pa.array(sums[:, i]) for i in range(width)}})

    met = rows.unionByName(against).groupBy("own", "other").applyInArrow(add_up, "place long, " + ", ".join(f"s{i} double" for i in range(width)))
    totals = met.groupBy("place").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    scores = {}
    for k, offset in offsets.items():
        if len(sizes[k]) < 2:
            scores[k] = F.lit(0.0)
            continue
        own = F.col(f"group_{k}")
        inside = F.coalesce(*[F.when(own == g, F.col(f"s{offset + g}") / (n - 1) if n > 1 else F.lit(None)) for g, n in sizes[k].items()])
        outside = F.least(*[F.when(own != g, F.col(f"s{offset + g}") / n) for g, n in sizes[k].items()], F.lit(None).cast("double"))
        larger = F.greatest(inside, outside)
        scores[k] = F.coalesce(F.when(larger > 0, (outside - inside) / larger).otherwise(0.0), F.lit(0.0))
    return totals.join(places, "place").select("weight", *[(score * F.col("weight")).alias(f"score_{k}") for k, score in scores.items()])


def _scores_by_cell(places: DataFrame, columns: list[str], offsets: dict[int, int], sizes: dict[int, dict[int, int]], n: int, extent: float, crowd: int, most_cells: int = 16384) -> DataFrame:
    """Per cube of cells: the weight of its places and their weighted scores for each k.

    Cells are halved until a place shares its cell with `crowd` others or there are about `most_cells`. Places share their
    weight out to the nodes of their cell; a task per group takes these to the nodes of all cells that do not touch
    (`far_sums`); a task per cube of cells has its places and those of the cells around, whose distances it computes.
    If the places crowd so closely that cells cannot be made small enough, only the time grows.
    """
    width, side = sum(offsets), 2
    cell, cube = [f"cell_{c}" for c in columns], [f"cube_{c}" for c in columns]
    level = max(0, math.ceil(math.log(n / crowd, 2 ** len(columns))))
    edge = 2.0 ** (math.ceil(math.log2(extent)) - level)
    while True:
        placed = places.withColumns({name: F.floor(F.col(c) / edge) for name, c in zip(cell, columns, strict=True)})
        counted = placed.groupBy(*cell).count()
        found = counted.agg(F.count(F.lit(1)).alias("cells"), (F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("crowd")).first()
        if found["crowd"] <= crowd or 4 * found["cells"] > most_cells or extent / edge > 2 ** (60 // len(columns) - 1):  # keys of 63 bits
            break
        edge /= 2
    occupied = np.array([tuple(row) for row in counted.select(*cell).collect()])  # as many rows as cells
    numbers = lambda table, names: np.stack([table.column(c).to_numpy() for c in names], axis=1)
    within = lambda x, cells: basis((x / edge - cells - 0.5) * 2)

    def apart(cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each cell with the rows that lie there."""
        names, place = np.unique(cells, axis=0, return_inverse=True)
        order, counts = np.argsort(place.reshape(-1), kind="stable"), np.bincount(place.reshape(-1))
        yield from zip(names, np.split(order, np.cumsum(counts)[:-1]), strict=True)

    def share_out(table: pa.Table) -> pa.Table:
        x, share, made = numbers(table, columns), _shares(table, offsets), []
        for name, rows in apart(numbers(table, cell)):
            moments = sum(within(x[part], name).T @ share[part] for part in np.array_split(rows, math.ceil(len(rows) / 2048)))
            made += [(i, *name.tolist(), moments[:, i].tobytes()) for i in np.flatnonzero(share[rows].any(axis=0)).tolist()]
        return pa.table(dict(zip(["sums", *cell, "moments"], map(list, zip(*made, strict=True)), strict=True)))

    def carry(table: pa.Table) -> pa.Table:
        moments = np.frombuffer(b"".join(table.column("moments").to_pylist())).reshape(len(table), -1)
        sums = far_sums(occupied, numbers(table, cell), moments, edge)
        names = {name: occupied[:, d] for d, name in enumerate(cell)}
        return pa.table({**names, "sums": np.full(len(sums), table.column("sums")[0].as_py()), "far": [row.tobytes() for row in sums]})

    def score(key: tuple, table: pa.Table, carried: pa.Table) -> pa.Table:
        cells, x, share = numbers(table, cell), numbers(table, columns), _shares(table, offsets)
        rows_of = {tuple(name): rows for name, rows in apart(cells)}
        far = {}
        for name, i, sums in zip(numbers(carried, cell), carried.column("sums").to_pylist(), carried.column("far").to_pylist(), strict=True):
            far.setdefault(tuple(name), {})[i] = np.frombuffer(sums)
        total = np.zeros(1 + len(offsets))
        for name, rows in rows_of.items():
            if any(at // side != own.as_py() for at, own in zip(name, key, strict=True)):
                continue
            around = np.concatenate([rows_of[other] for step in product((-1, 0, 1), repeat=len(name)) if (other := tuple(np.add(name, step))) in rows_of])
            used = np.flatnonzero(share[around].any(axis=0))
            for part in np.array_split(rows, math.ceil(len(rows) / 2048)):
                sums = np.zeros((len(part), width))
                sums[:, used] = near_sums(x[part], x[around], share[around][:, used])
                carried_here = far.get(name, {})
                sums[:, list(carried_here)] += within(x[part], np.array(name)) @ np.array([*carried_here.values()]).T.reshape(-1, len(carried_here))
                weight = table.column("weight").to_numpy()[part]
                total[0] += weight.sum()
                for i, (k, offset) in enumerate(offsets.items(), start=1):
                    total[i] += weight @ _scores(sums[:, offset : offset + k], table.column(f"group_{k}").to_numpy()[part], sizes[k])
        return pa.table({name: [value] for name, value in zip(["weight", *[f"score_{k}" for k in offsets]], total.tolist(), strict=True)})

    long = ", ".join(f"{c} long" for c in cell)
    in_cube = {own: F.floor(F.col(c) / side) for own, c in zip(cube, cell, strict=True)}
    shared = stage(placed.withColumns(in_cube).groupBy(*cube).applyInArrow(share_out, f"sums long, {long}, moments binary"), "silhouette-moments")
    carried = shared.repartitionByRange(2 * width, "sums").groupBy("sums").applyInArrow(carry, f"{long}, sums long, far binary").withColumns(in_cube)
    around = placed
    for own, c in zip(cube, cell, strict=True):
        around = around.withColumn(own, F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / side), F.floor((F.col(c) + 1) / side)))))
    parts = 16 * places.sparkSession.sparkContext.defaultParallelism
    pairs = around.repartition(parts, *cube).groupBy(*cube).cogroup(carried.repartition(parts, *cube).groupBy(*cube))
    return pairs.applyInArrow(score, "weight double, " + ", ".join(f"score_{k} double" for k in offsets))


def _scores(sums: np.ndarray, label: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Per place: (b - a) / max(a, b) from its summed distances to each group."""
    n, each = np.array([sizes.get(g, 0) for g in range(sums.shape[1])]), np.arange(len(sums))
    inside = sums[each, label] / np.maximum(n[label] - 1, 1)
    outside = sums / np.where(n > 0, n, 1)
    outside[:, n == 0], outside[each, label] = np.inf, np.inf
    outside = outside.min(axis=1)
    larger = np.maximum(inside, outside)
    scored = (n[label] > 1) & np.isfinite(outside) & (larger > 0)
    return np.where(scored, (outside - inside) / np.where(scored, larger, 1), 0.0)
