"""Benchmark decontamination: an exact containment join of document words with item-sized windows.

A window is a run of consecutive item words; it occurs in a document when the same words follow each other
there. The join goes through short shingles:

1. One scan of the documents looks every shingle up among the benchmark's shingles and keeps only hits.
2. Shingles are ordered by rarity, counted over these hits of the whole corpus. Containment asks for all
   shingles of a window, so a prefix of one shingle, its rarest, is necessary; windows with a shingle that
   never occurs are dropped at once.
3. A hit of the prefix fixes the only start the window can have (positional bound), which must leave room for
   the whole window (length bound).
4. The candidate is verified: shingles that cover the window must all be hits at their positions. Shingles
   are compared as text, so the answer is exact.

Everything is DataFrame code. The number of shingle look-ups equals the number of words; hits and windows are
joined on shingle text, and no pairs of documents and items are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salespark.llm.common import ascii_lower
from salespark.session import stage

#: What parts words after lower-casing A-Z: all of ASCII but digits and letters a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    parts = F.filter(F.split(ascii_lower(text), BETWEEN_WORDS, -1), lambda word: word != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def _hash(array: Column, start: Column | int, length: int) -> Column:
    return F.xxhash64(*[F.get(array, start + i if isinstance(start, Column) else F.lit(start + i)) for i in range(length)])


def item_windows(items: DataFrame, size: int, gram: int) -> DataFrame:
    """(item_id, window, length, gram_length): distinct windows of each item; items without words have none."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    length = F.least("n", F.lit(size))
    return (
        listed.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.col("n") - length + 1)).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), F.col("length")).alias("parts"), "length")
        .select("item_id", F.array_join("parts", " ").alias("window"), "length", F.least("length", F.lit(gram)).alias("gram_length"), "parts")
        .dropDuplicates(["item_id", "window"])
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, gram: int = 5, broadcast_chars: int = 16_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    docs needs doc_id and text, items needs item_id and text; other columns are ignored, whatever their names.
    Null text has no words. Rows equal in doc_id and text are one document; a null doc_id is a document like
    others. Items without words, an empty benchmark or no documents give no hits or no rows. An item shorter than
    `size` is one window. The benchmark's shingles are broadcast only if its texts hold at most
    `broadcast_chars` characters, which bounds them; a larger one is joined by shuffling.
    """
    windows = stage(item_windows(items.select("item_id", "text"), size, gram), "decontaminate-windows")
    sizes = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    small = sizes["chars"] <= broadcast_chars
    lengths = sorted(r["gram_length"] for r in windows.select("gram_length").distinct().collect())  # at most `gram` values
    hits = stage(_hits(docs, windows, lengths or [gram], small), "decontaminate-hits")

    found = hits.where("gram is not null").select("doc_id", "text_key", "n_words", "at", "gram")
    known = windows.dropDuplicates(["window"])
    grams = known.select(
        "window", "length", "gram_length",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.col("length") - F.col("gram_length") + 1), lambda i: F.array_join(F.slice("parts", i, F.col("gram_length")), " "))).alias("shift", "gram"),
    )
    by_rarity = W.partitionBy("window")
    prefix = (
        grams.join(found.groupBy("gram").agg(F.count("*").alias("frequency")), "gram")
        .withColumn("present", F.count("*").over(by_rarity))
        .where(F.col("present") == F.col("length") - F.col("gram_length") + 1)
        .withColumn("rank", F.row_number().over(by_rarity.orderBy("frequency", "shift")))
        .where("rank = 1")
        .select("window", "length", F.col("shift").alias("prefix_shift"), "gram")
    )
    hint = F.broadcast if small else (lambda df: df)
    candidates = (
        found.join(hint(prefix), "gram")
        .select("doc_id", "text_key", "n_words", (F.col("at") - F.col("prefix_shift")).alias("start"), "window", "length")
        .where("start >= 0 and start + length <= n_words")
    )
    cover = grams.where("shift % gram_length = 0 or shift = length - gram_length").select(
        "window", "shift", "gram", F.count("*").over(by_rarity).alias("needed")
    )
    expected = candidates.join(hint(cover), "window").select(
        "doc_id", "text_key", "n_words", "start", "window", "length", "needed", (F.col("start") + F.col("shift")).alias("at"), "gram"
    )
    there = found.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_key", "at", "gram")]).distinct()
    verified = (
        expected.join(
            there,
            F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("at") == F.col("_at")) & (F.col("gram") == F.col("_gram")),
            "left_semi",
        )
        .distinct()
        .groupBy("doc_id", "text_key", "n_words", "start", "window", "length", "needed")
        .agg(F.count("*").alias("got"))
        .where("got = needed")
    )
    owners = windows.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("owners"))
    marked = verified.join(hint(owners), "window").select("doc_id", "text_key", "n_words", F.struct("start", "length").alias("span"), "owners")
    blank = hits.where("at = -1").select("doc_id", "text_key", "n_words", F.lit(None).cast(marked.schema["span"].dataType).alias("span"), F.lit(None).cast("array<string>").alias("owners"))
    grouped = (
        blank.unionByName(marked)
        .groupBy("doc_id", "text_key", "n_words")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"))
    )
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate(
        "spans", empty,
        lambda s, x: F.struct(
            F.greatest(s["end"], (x["start"] + x["length"]).cast("long")).alias("end"),
            (s["hit"] + F.greatest(F.lit(0).cast("long"), (x["start"] + x["length"]).cast("long") - F.greatest(s["end"], x["start"].cast("long")))).alias("hit"),
        ),
    )["hit"]
    return grouped.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "text_key",
    )


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(doc_id, text_key, n_words, at, gram): a row at -1 for each document, and one for each benchmark shingle in it.

    Documents are cut into words once; positions are generated, hashed and looked up in one generated stage, and
    only hits leave it.
    """
    texts = windows.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("length") - F.col("gram_length") + 1), lambda i: F.slice("parts", i, F.col("gram_length")))).alias("g"))
    size = F.size("g")
    key = F.coalesce(*[F.when(size == k, _hash(F.col("g"), 0, k)) for k in lengths])
    wanted = texts.select(key.alias("hash"), F.array_join("g", " ").alias("gram")).distinct()

    m = len(lengths)
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    steps = cut.select("doc_id", "text_key", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("w") * m - 1)).alias("step"))
    at = F.when(F.col("step") < 0, F.lit(-1)).otherwise((F.col("step") / m).cast("int") if m > 1 else F.col("step"))
    placed = steps.withColumn("at", at)
    turn = F.pmod("step", F.lit(m))
    fits = lambda i, k: (F.col("at") >= 0) & (turn == i) & (F.col("at") + k <= F.col("n_words"))
    hashed = F.coalesce(*[F.when(fits(i, k), _hash(F.col("w"), F.col("at"), k)) for i, k in enumerate(lengths)])
    text = F.coalesce(*[F.when(fits(i, k), F.concat_ws(" ", *[F.get("w", F.col("at") + j) for j in range(k)])) for i, k in enumerate(lengths)])
    columns = ["doc_id", "text_key", "n_words", "at"]
    if small:
        joined = placed.withColumn("hash", hashed).join(F.broadcast(wanted), "hash", "left")
        return joined.where((F.col("at") < 0) | (F.col("gram") == text)).select(*columns, "gram")
    plain = placed.select(*columns, hashed.alias("hash"), text.alias("here"))
    marks = plain.where("at < 0").select(*columns, F.lit(None).cast("string").alias("gram"))
    return plain.where("hash is not null").join(wanted, "hash").where("gram = here").select(*columns, "gram").unionByName(marks)
