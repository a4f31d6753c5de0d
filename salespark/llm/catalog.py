"""Named queries over the corpus tables, one for each operator, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespark.llm import chat, extraction, language, lexical, mixing, neighbours, oracles, pii, secrets, simhash, spelling, substrings, warc
from salespark.llm.common import table
from salespark.llm.decontamination import decontaminate

#: Of this catalogue only; a user passes a secret one.
PII_KEY = "catalogue"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_windows(told.unionByName(added)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(language.training_rows(docs))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymize(docs, PII_KEY)
    return found.select("doc_id", "text", *[F.coalesce(F.col("entities")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in pii.KINDS])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_records(warc.read_archives(files))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, F.array("source"))
    only = F.col("sources")[0]
    return mixed.select("doc_id", "size", only["size"].alias("source_size"), only["target"].alias("target"), "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.typed_words(table(spark, sf_dir, "documents"))
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), extraction.learn(spark))


_QUERIES = [op1_decontamination, op2_chat_formatting, op3_language_id, op4_secret_scan, op5_simhash, op6_pii, op7_warc, op8_neighbours, op9_substring_dedup, op10_mixing, op11_spelling_variants, op12_lexical_search, op13_main_text]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
