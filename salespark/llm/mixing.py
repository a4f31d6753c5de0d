"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources that claim them): words per pattern.
2. The patterns are routed to the sources. An arc carries a pattern's words once at no cost, a second time at a
   price, and so on up to `repeats`: convex repetition costs, so no document repeats while fresh words are left.
   Successive shortest paths solve this small graph exactly; it has one node per pattern and source.
3. Each pattern's routed words become whole passes over its documents plus a part of one pass. The part is made of
   the documents with the smallest seeded hashes; when one does not fit, later ones that do go on filling it. Where
   to cut is found from sums over hash ranges, five levels of 256 ranges, so nothing is sorted and no group is collected.

The pattern table is the only thing that reaches the driver; it is refused beyond `most_patterns` rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.llm.common import BLANK_SEPARATED
from salespark.session import stage

WEIGHTS = (5, 2, 1)
RESULT = ("size", "pattern", "sources", "taken", "copies")
_LEVEL_BITS, _LEVELS = 8, 5
_RANGES = "array<struct<after:long,upto:long,room:long>>"
_IN_RANGES = "exists(ranges, r -> `order` between r.after and r.upto and size <= r.room)"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_SEPARATED)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets in the order of the sources: weights in turn, `share` of all words, none above `most` times its size."""
    limits = [float(most * size) for size in sizes]
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(own[i] for i in free)
        full = {i for i in free if left * own[i] / total > limits[i]}
        if not full:
            for i in free:
                targets[i] = left * own[i] / total
            break
        for i in full:
            targets[i] = limits[i]
            left -= limits[i]
        free -= full
    return targets


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = 2) -> list[list[int]]:
    """words[p][r]: words of pattern p taken in its pass r, by a min-cost flow from patterns to source quotas.

    patterns: (member sources, words). Pass r costs r for each word, so costs are convex in repetition.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    arcs: list[list[int]] = []  # to, capacity, cost; the reverse arc follows its arc

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        graph[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        graph[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    passes = [[arc(start, p, words, r) for r in range(repeats)] for p, (_, words) in enumerate(patterns)]
    for p, (members, words) in enumerate(patterns):
        for s in members:
            arc(p, n + s, words * repeats, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0)
    height = [0] * len(graph)
    while True:
        best: list[float] = [float("inf")] * len(graph)
        came: list[int] = [-1] * len(graph)
        best[start], queue = 0, [(0, start)]
        while queue:
            cost, node = heapq.heappop(queue)
            if cost > best[node]:
                continue
            for k in graph[node]:
                to, capacity, price = arcs[k]
                new = cost + price + height[node] - height[to]
                if capacity and new < best[to]:
                    best[to], came[to] = new, k
                    heapq.heappush(queue, (new, to))
        if came[end] < 0:
            return [[arcs[k + 1][1] for k in of] for of in passes]
        for node in range(len(graph)):
            if best[node] < float("inf"):
                height[node] += int(best[node])
        flow, node = float("inf"), end
        while node != start:
            flow, node = min(flow, arcs[came[node]][1]), arcs[came[node] ^ 1][0]
        node = end
        while node != start:
            arcs[came[node]][1] -= int(flow)
            arcs[came[node] ^ 1][1] += int(flow)
            node = arcs[came[node] ^ 1][0]


def _filled(sized: DataFrame, wanted: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int, int | None]]:
    """By pattern, with wanted (after, room): (words, upto, next).

    The documents of at most `room` words with hashes in [after, upto] fit into it, with `words`; the one behind
    does not. The search for those left over begins at `next`; None if all fit. Each level adds words over 256 ranges of
    the hash inside the range that the last level left open.
    """
    prior, left = {key: 0 for key in wanted}, {key: room for key, (_, room) in wanted.items()}
    ends: dict[str, tuple[int, int | None]] = {}
    for level in range(1, _LEVELS + 1):
        keys = sorted(wanted.keys() - ends.keys())
        if not keys:
            break
        below = 63 - _LEVEL_BITS * level
        asked = sized.sparkSession.createDataFrame([(key, prior[key], *wanted[key]) for key in keys], "pattern string, prior long, after long, room long")
        inside = sized.withColumn("prior", F.shiftright("order", below + _LEVEL_BITS)).join(F.broadcast(asked), ["pattern", "prior"]).where("`order` >= after and size <= room")
        sums = inside.groupBy("pattern", F.shiftright("order", below).alias("place")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        found: dict[str, list] = {}
        for row in sums.collect():  # at most 256 ranges a pattern
            found.setdefault(row["pattern"], []).append((row["place"], row["words"], row["docs"]))
        for key in keys:
            for place, words, docs in sorted(found.get(key, [])):
                if words <= left[key]:
                    left[key] -= words
                    continue
                prior[key] = place
                if docs == 1 or level == _LEVELS:
                    ends[key] = ((place << below) - 1, (place + 1) << below)
                break
            else:
                ends[key] = ((1 << 63) - 1, None)
    return {key: (wanted[key][1] - left[key], *ends[key]) for key in wanted}


def _cuts(sized: DataFrame, parts: dict[str, int]) -> dict[str, tuple[list[tuple[int, int, int]], int | None]]:
    """By pattern: (ranges, last); documents with at most `room` words and a hash from `after` to `upto` make up the part.

    One range (after, upto, room) is filled until a document does not fit; then those behind it that fit into what is left
    follow, and so on until none fits. What is left then goes to one more document (rows of one hash), that of the
    nearest size, whose hash is `last`; none if that is no gain.
    """
    left = {key: words for key, words in parts.items() if words > 0}
    ranges: dict[str, list[tuple[int, int, int]]] = {key: [] for key in left}
    wanted = {key: (0, words) for key, words in left.items()}
    while wanted:
        rest = {}
        for key, (words, upto, following) in _filled(sized, wanted).items():
            after, room = wanted[key]
            if words:
                ranges[key].append((after, upto, room))
                left[key] -= words
            if following is not None and following < 1 << 63 and left[key]:
                rest[key] = (following, left[key])
        wanted = rest
    short = [(key, left[key], ranges[key]) for key in sorted(left) if left[key] > 0]
    last = {}
    if short:
        rest = sized.join(F.broadcast(sized.sparkSession.createDataFrame(short, f"pattern string, left long, ranges {_RANGES}")), "pattern").where(~F.expr(_IN_RANGES))
        blocks = rest.groupBy("pattern", "order").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        miss = F.abs(F.col("size") - F.col("left"))
        best = blocks.where(miss < F.col("left")).groupBy("pattern").agg(F.min(F.struct(miss.alias("miss"), F.col("order"))).alias("best"))
        last = {r["pattern"]: r["best"]["order"] for r in best.collect()}
    return {key: (found, last.get(key)) for key, found in ranges.items()}


def mix(docs: DataFrame, members: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 17, most_patterns: int = 10_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns in `keep`, size, pattern, sources (with size and target), taken, copies.

    `members` is an array of source names; a null element is the source without a name, which comes last. An empty
    or null array belongs to no source and is never taken. Sizes count runs without ASCII white space; null and empty texts
    have size 0 and are never taken. Rows that repeat a doc_id share its hash and are taken alike if their
    sizes agree; rows without one have a hash of their text. Without rows, or without words, nothing is taken. Other columns are ignored; those in `keep` that are named
    like one of the result's (RESULT) give way to it.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(members))  # by code point, null last
    key = F.coalesce(F.to_json(F.struct(names.alias("m")), {"ignoreNullFields": "false"}), F.lit("{}"))
    order = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("text"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id"))).bitwiseAND(F.lit((1 << 63) - 1))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep if c not in RESULT]).alias("kept")
    wide = docs.select(kept, size_of(F.col("text")).alias("size"), names.alias("members"), key.alias("pattern"), order.alias("order"))
    sized = stage(wide.drop("kept"), "mixing-sizes")
    table = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.first("members").alias("members"))
    rows = table.limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"More than {most_patterns} membership patterns; group sources first.")
    rows.sort(key=lambda r: r["pattern"])
    sources = sorted({s for r in rows for s in r["members"] or ()}, key=lambda s: (s is None, (s or "").encode()))
    place = {s: i for i, s in enumerate(sources)}
    sizes = _sizes(rows, place)
    targets = source_targets(sizes, weights, share, repeats)
    flows = route([(tuple(place[s] for s in r["members"] or ()), r["words"]) for r in rows], [round(t) for t in targets], repeats)
    taken = {r["pattern"]: sum(flow) for r, flow in zip(rows, flows, strict=True)}
    full = {r["pattern"]: taken[r["pattern"]] // r["words"] if r["words"] else 0 for r in rows}
    cuts = _cuts(sized.where("size > 0"), {r["pattern"]: taken[r["pattern"]] - full[r["pattern"]] * r["words"] for r in rows})
    plan = spark.createDataFrame(
        [(r["pattern"], full[r["pattern"]], *cuts.get(r["pattern"], ([], None)), [(s, sizes[place[s]], targets[place[s]]) for s in r["members"] or ()]) for r in rows],
        f"pattern string, passes long, ranges {_RANGES}, last long, sources array<struct<source:string,size:long,target:double>>",
    )
    copies = F.col("passes") + F.when(F.expr(_IN_RANGES) | F.col("order").eqNullSafe(F.col("last")), 1).otherwise(0)
    return (
        wide.join(F.broadcast(plan), "pattern")  # bounded by most_patterns
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
        .select("kept.*", "size", "pattern", "sources", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )


def _sizes(rows: list, place: dict) -> list[int]:
    sizes = [0] * len(place)
    for r in rows:
        for s in set(r["members"] or ()):
            sizes[place[s]] += r["words"]
    return sizes
