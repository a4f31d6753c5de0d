"""Spelling variants: words one edit apart, found by pairs of trie nodes.

All words form two tries, one read forwards and one read backwards, and every node of each has a number. A word cut
at any place is then a pair (prefix node, suffix node), and so is a word with one character skipped; pairs stand for
strings without holding them, and are equal exactly if the strings are. Words that differ by one replaced character
share a skipping pair at the same place. A word that is another without one character has that one's skipping pair
among its own cuts. So one shuffle on two integers finds all neighbours exactly; what shares a skipping pair differs
in one character only, which bounds a group by the alphabet.

Numbering takes no strings apart into prefixes: words are sorted into ranges, a word adds as many nodes as it goes
beyond what it shares with the word before, and the ranges (one row each) are chained on the driver. A word's last
forward node is its number from there on, and numbers are in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salespark.llm.common import ascii_lower
from salespark.session import ship_package, stage

CUT, FIRST_SKIP, SKIP = 0, 1, 2  # kinds of pairs: of equal characters in a row, only the first one's skip is a deletion
_NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"


def typed_words(docs: DataFrame, every: int = 199, shortest: int = 6) -> DataFrame:
    """(word): one row per run of letters, A-Z lower-cased, that has at least `shortest` code points.

    Where `every` divides the crc32 of `<doc_id>:<run>`, one character of the run is left out, as typing errors do.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(ascii_lower(F.col("text")), _NOT_LETTERS)).alias("run"))
    long_enough = runs.where(F.char_length("run") >= shortest).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = long_enough.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest)


def _numbers(words: Iterator[str]) -> Iterator[tuple[str, list[int]]]:
    """Of sorted words: the node number at each depth, from 1 on in order of appearance (0 is the root)."""
    before, nodes, count = "", [0], 0
    for word in words:
        shared = len(commonprefix((before, word)))
        added = len(word) - shared
        nodes = nodes[: shared + 1] + list(range(count + 1, count + added + 1))
        before, count = word, count + added
        yield word, nodes


def _sorted_ranges(df: DataFrame, key: str) -> DataFrame:
    """df with a column `_range`, written once: all keys of a range are smaller than those of the next."""
    return stage(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "spelling-ranges")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[tuple[str, list[int], dict]]]]:
    """Per range: its number and an iterator of (key, local nodes, row) that must be used up."""

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    held = rows()
    row = next(held, None)
    while row is not None:
        current, seen = row["_range"], []

        def of_range() -> Iterator[str]:
            nonlocal row
            while row is not None and row["_range"] == current:
                seen.append(row)
                yield row[key]
                row = next(held, None)

        yield current, ((word, nodes, seen.pop()) for word, nodes in _numbers(of_range()))


def _chain(ranges: DataFrame, key: str) -> dict[int, tuple[int, list[int], int]]:
    """Per range: how many nodes its first key shares with the range before, their numbers, and where its own begin."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words in _runs(batches, key):
            first = last = None
            count, nodes = 0, [0]
            for word, nodes, _ in words:
                first = word if first is None else first
                last, count = word, max(count, nodes[-1])
            made = [pa.array([number], pa.int32()), pa.array([first]), pa.array([last]), pa.array([count], pa.int64()), pa.array([nodes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["_range", "first", "last", "count", "nodes"])

    ordered = ranges.select(key, "_range").repartition("_range").sortWithinPartitions("_range", key)
    summaries = ordered.mapInArrow(answer, "_range int, first string, last string, count long, nodes array<long>").collect()  # one row per range
    chained, before, nodes, total = {}, "", [0], 0
    for row in sorted(summaries, key=lambda r: r["_range"]):
        shared = len(commonprefix((before, row["first"])))
        link = chained[row["_range"]] = (shared, nodes[: shared + 1], total)
        nodes, before = [_absolute(k, link) for k in row["nodes"]], row["last"]
        total += row["count"] - shared
    return chained


def _absolute(node: int, link: tuple[int, list[int], int]) -> int:
    shared, carried, total = link
    return carried[node] if node <= shared else total + node - shared


def _with_nodes(ranges: DataFrame, chained: dict[int, tuple[int, list[int], int]]) -> DataFrame:
    """(id, word, n, back, prefixes): back is the reversed word, prefixes the forward node at each depth."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words in _runs(batches, "word"):
            link, rows = chained[number], []
            for word, nodes, row in words:
                prefixes = [_absolute(k, link) for k in nodes]
                rows.append({"id": prefixes[-1], "word": word, "n": row["n"], "back": word[::-1], "prefixes": prefixes})
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("back", pa.string()), ("prefixes", pa.list_(pa.int64()))])
    ordered = ranges.select("word", "n", "_range").repartition("_range").sortWithinPartitions("_range", "word")
    return ordered.mapInArrow(answer, "id long, word string, n long, back string, prefixes array<long>")


def _pairs(ranges: DataFrame, chained: dict[int, tuple[int, list[int], int]]) -> DataFrame:
    """(p, s, kind, id, n): every cut of every word, and every skip of one character."""

    def emit(made: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*made, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "s", "kind", "id", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words in _runs(batches, "back"):
            link, made, size = chained[number], [], 0
            for back, nodes, row in words:
                p = np.array(row["prefixes"], np.int64)
                s = np.array([_absolute(k, link) for k in nodes], np.int64)[::-1]  # from the whole word down to nothing
                letters = np.array([ord(c) for c in reversed(back)])
                again = np.append(False, letters[1:] == letters[:-1])
                kind = np.append(np.full(len(p), CUT), np.where(again, SKIP, FIRST_SKIP)).astype(np.int8)
                made.append((np.append(p, p[:-1]), np.append(s, s[1:]), kind, np.full(len(kind), row["id"]), np.full(len(kind), row["n"])))
                size += len(kind)
                if size > 1 << 16:
                    yield emit(made)
                    made, size = [], 0
            if made:
                yield emit(made)

    ordered = ranges.select("id", "n", "back", "prefixes", "_range").repartition("_range").sortWithinPartitions("_range", "back")
    return ordered.mapInArrow(answer, "p long, s long, kind byte, id long, n long")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): the number of near words, and of the one with the largest n (then smallest id): n and -id."""
    own = F.struct("n", "kind", (-F.col("id")).alias("back"))
    # sorted by Spark and told group by group: a pair shared by nobody costs no memory, a shared one at most an alphabet
    members = pairs.select("p", "s", own.alias("a")).withColumn("m", F.collect_list("a").over(Window.partitionBy("p", "s"))).where("size(m) > 1")

    def near(a: Column, b: Column) -> Column:
        replaced = (a["kind"] != CUT) & (b["kind"] != CUT)
        shortened = (F.least(a["kind"], b["kind"]) == CUT) & (F.greatest(a["kind"], b["kind"]) == FIRST_SKIP)
        return (a["back"] != b["back"]) & (replaced | shortened)

    met = members.select("a.back", F.filter("m", lambda b: near(F.col("a"), b)).alias("others")).where("size(others) > 0")
    some = met.select(
        (-F.col("back")).alias("id"), F.size("others").alias("others"),
        F.array_max(F.transform("others", lambda b: F.struct(b["n"].alias("n"), b["back"].alias("back")))).alias("best"),
    )
    return some.groupBy("id").agg(F.sum("others").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last word that the forms (id, form) lead to. Each round doubles the steps taken."""
    current = stage(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = current.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stage(current.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("id", "root")
        current = moved.select("id", "root")


def group_variants(words: DataFrame, least: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per distinct word that occurs at least `least` times.

    words has one row per occurrence (column word; nulls and empty words don't count, other columns are ignored).
    n_near counts the words that differ by exactly one inserted, deleted or replaced code point. form is the near
    word of largest n (ties: smallest in code-point order) if that is at least `factor` * n, else null, like form_n;
    root is the word at the end of the chain of forms, the word itself without one. No words give no rows.
    """
    ship_package(words.sparkSession)
    counted = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    forward = _sorted_ranges(counted, "word")
    numbered = stage(_with_nodes(forward, _chain(forward, "word")), "spelling-numbered")
    backward = _sorted_ranges(numbered.select("id", "n", "back", "prefixes"), "back")
    near = stage(_neighbours(_pairs(backward, _chain(backward, "back"))), "spelling-near")
    names = numbered.select("id", "word", "n")
    told = names.join(near, "id", "left").withColumn("has", F.coalesce(F.col("best.n") >= factor * F.col("n"), F.lit(False)))
    told = stage(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("best.back")).alias("form_id"), F.when(F.col("has"), F.col("best.n")).alias("form_n")), "spelling-told")
    roots = _roots(told.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    led = told.where("form_id is not null").join(roots, "id").select("word", "n", "n_near", "form_n", "form_id", "root")
    named = led.join(names.select(F.col("id").alias("form_id"), F.col("word").alias("form_word")), "form_id").join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    own = told.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return own.unionByName(named.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))
