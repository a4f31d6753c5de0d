"""Chat formatting in budgeted windows.

Each conversation becomes training windows of at most `budget` tokens. Prefix sums of the turn tokens choose
turn-aligned spans: turns whose start falls into the same half of the room left by system turn and history form
one span, and a turn of half the room or more is a span of its own, so spans keep to the budget unless one turn
alone exceeds it. A window shows the system turn, up to `history` tokens of the turns before its span, and the
span. Only assistant texts of the span itself are targets; repeated turns are context and masked.

Prefix sums run in chunks of turn numbers first and over the chunks' totals then, so a conversation with a large
share of all turns is spread over tasks. A window's turns are bounded by the budget.

Template of a turn: `### role: text</turn>` and a line feed. Inside texts and roles `\\`, `#` and the closing mark
are escaped with a backslash (`:` too in roles), so control strings occur only where the template puts them, and
reading back restores every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salespark.llm.common import partitions, running_starts
from salespark.session import ship_package, stage

OPEN, CLOSE = "### ", "</turn>"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
LEAST_ROOM = 64
CHUNK = 256
_END = CLOSE + "\n"


def tokens_of(text: Column) -> Column:
    """Words and other characters, and one for the turn itself."""
    return (F.regexp_count(text, F.lit(TOKEN)) + 1).cast("long")


def escape(text: Column, more: tuple[str, ...] = ()) -> Column:
    done = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    done = F.replace(F.replace(done, F.lit("#"), F.lit("\\#")), F.lit(CLOSE), F.lit(CLOSE[0] + "\\" + CLOSE[1:]))
    for mark in more:
        done = F.replace(done, F.lit(mark), F.lit("\\" + mark))
    return done


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with idx (from 1), tokens, first (of the conversation), start (tokens before) and room."""
    cleaned = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    cleaned = cleaned.withColumn("tokens", tokens_of(F.col("text"))).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 50))).cast("long"))
    return cleaned


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, conv, first_idx, text, n_context, loss.

    turns needs conv_id, turn, role and text; other columns are ignored. Null texts and roles are empty; turns of a
    null conv_id form one conversation; equal turn numbers go by role, then text, and repeated rows stay. `n_context`
    leading turns of a window repeat earlier ones; `loss` lists start and end (code points, end exclusive) of the
    targets in `text`.
    """
    placed = _placed(turns)
    # texts are ordered and written here, and met again only when it is settled which windows show them
    chunked = W.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    within = F.sum("tokens").over(chunked.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")
    numbered = stage(placed.select("conv", "conv_id", "chunk", "role", "text", "tokens", F.row_number().over(chunked).alias("n"), within.alias("within")), "chat-numbered")
    light = numbered.select("conv", "chunk", "n", "role", "tokens", "within")
    leading = light.groupBy("conv").agg(F.min(F.struct("chunk", "n", "role", "tokens")).alias("top"))
    leading = leading.select("conv", F.when(F.col("top.role") == "system", F.col("top.tokens")).otherwise(F.lit(0)).alias("system_tokens"))
    leading = leading.withColumn("half", F.greatest(F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2), F.lit(LEAST_ROOM)).cast("long"))
    # the system turn is shown in every window and takes no room of its own
    chunks = light.groupBy("conv", "chunk").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    before = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(
        "conv", "chunk", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0")
    )
    located = (
        light.join(leading, "conv").join(chunks, ["conv", "chunk"])
        .withColumn("idx", F.col("c0") + F.col("n"))
        .withColumn("system", (F.col("idx") == 1) & (F.col("system_tokens") > 0))
        .withColumn("start", F.greatest(F.col("t0") + F.col("within") - F.col("system_tokens"), F.lit(0)))
        .withColumn("big", (F.col("tokens") >= F.col("half")) & ~F.col("system"))
        .select("conv", "chunk", "n", "idx", "start", "system", "big", F.floor(F.col("start") / F.col("half")).alias("bucket"))
    )
    located = stage(located, "chat-located")
    chunked = W.partitionBy("conv", "chunk").orderBy("idx")
    bigs = located.groupBy("conv", "chunk").agg(F.sum(F.col("big").cast("long")).alias("b"))
    bigs = bigs.select("conv", "chunk", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    spans = (
        located.withColumn("b", F.sum(F.col("big").cast("long")).over(chunked.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(bigs, ["conv", "chunk"])
        .withColumn("run", 2 * (F.col("b0") + F.col("b")) - F.col("big").cast("long"))
        .select("conv", "chunk", "n", "idx", "start", "system", "bucket", "run")
    )
    spans = stage(spans, "chat-spans")
    starts = spans.groupBy("conv", "bucket", "run").agg(F.min("start").alias("s"), F.min("idx").alias("first_idx"))
    key, turn = ["conv", "bucket", "run", "first_idx"], ["chunk", "n", "idx"]
    own = spans.join(starts, ["conv", "bucket", "run"]).select(*key, F.lit(2).alias("kind"), *turn)
    later = starts.where("first_idx > 1")
    # a turn is history of the spans that start up to `history` tokens after the turn does
    block = lambda c: F.floor(F.col(c) / max(history, 1))
    reach = spans.where("not system").select("conv", *turn, "start", F.explode(F.array(block("start"), block("start") + 1)).alias("block"))
    past = (
        reach.join(later.withColumn("block", block("s")), ["conv", "block"])
        .where(f"idx < first_idx and s - start <= {int(history)}")
        .select(*key, F.lit(1).alias("kind"), *turn)
    )
    system = spans.where("system").select("conv", *turn).join(later, "conv").select(*key, F.lit(0).alias("kind"), *turn)
    shown = own.unionByName(past).unionByName(system)
    texts = numbered.select("conv", "chunk", "n", "conv_id", "role", "text")
    windows = (
        shown.join(texts, ["conv", "chunk", "n"])
        .groupBy(*key)
        .agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("kind", "idx", "role", "text"))).alias("turns"))
    )
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], (":",)), F.lit(": "))
    pieces = F.transform("turns", lambda t: F.struct(t["kind"].alias("kind"), t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    made = windows.select("conv_id", "conv", "first_idx", pieces.alias("p"))
    lengths = F.transform("p", lambda t: (F.char_length(t["head"]) + F.char_length(t["body"]) + len(_END)).cast("long"))
    targets = F.filter(
        F.zip_with("p", running_starts(lengths), lambda t, at: F.struct(
            (at + F.char_length(t["head"])).alias("start"), (at + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end"),
            ((t["kind"] == 2) & (t["role"] == "assistant")).alias("target"))),
        lambda s: s["target"],
    )
    return made.select(
        "conv_id", "conv", "first_idx",
        F.array_join(F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit(_END))), "").alias("text"),
        F.size(F.filter("p", lambda t: t["kind"] < 2)).alias("n_context"),
        F.transform(targets, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Windows with `turns` (role and text of the turns that are not repeated) and `targets` (texts under the mask)."""
    header = r"(?s)^### ((?:[^:\\]|\\.)*): "
    parts = F.split("text", _END, -1)
    parts = F.slice(parts, F.col("n_context") + 1, F.greatest(F.size(parts) - 1 - F.col("n_context"), F.lit(0)))
    turns = F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, header, 1)).alias("role"), unescape(F.regexp_replace(p, header, "")).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("*", turns.alias("turns"), targets.alias("targets"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and window; hashes go on from batch to batch."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, done, state = None, [], None

    def close() -> None:
        if state:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def emit() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if row["conv"] != conv or state is None:
                close()
                conv, state = row["conv"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += row["n"]
            state[2].update(row["shown"].encode())
            state[3] += len(row["target"])
            state[4].update(row["target"].encode())
            state[5] += row["chars"]
        if done:
            yield emit()
    close()
    if done:
        yield emit()


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    SHA-256 is sequential, so the windows of one conversation pass through one task, one after another.
    """
    ship_package(windows.sparkSession)
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(windows).select(
        "conv_id", "conv", "first_idx", F.size("turns").alias("n"), shown.alias("shown"), F.array_join("targets", "").alias("target"), F.char_length("text").alias("chars")
    )
    ordered = rows.repartition(partitions(windows), "conv").sortWithinPartitions("conv", "first_idx")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
