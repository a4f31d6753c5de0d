"""From raw documents to a training mix: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again. All but
the last return the columns of documents; the last adds how often a document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespark.llm import language, mixing, near, pii
from salespark.llm.common import table
from salespark.llm.decontamination import decontaminate
from salespark.session import drop_stages, stage, stages_written

#: The pseudonyms of this pipeline's test runs; real runs pass a secret key to `pii.pseudonymize`.
PII_KEY = "corpus-pipeline"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    model = language.learn(language.training_rows(docs))
    return language.identify(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard similarity of 0.8 or more): that with the smallest id, once.

    SimHash links are candidates here as MinHash bands are; every link is verified on the full shingle sets.

    A document without an id gets one from its text here, larger than real ids are.
    """
    own = F.coalesce("doc_id", (F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)))
    tagged = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"))
    kept = near.near_copies(tagged.select("own_id", "text_key", F.col("row.text").alias("text")))
    return tagged.join(kept, ["own_id", "text_key"], "left_semi").dropDuplicates(["own_id", "text_key"]).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    hit = stage(found.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")), "pipeline-contaminated")
    same = docs["doc_id"].eqNullSafe(hit["_doc_id"]) & (F.xxhash64(docs["text"]) == hit["_text_key"])
    return docs.join(hit, same, "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    replaced = pii.pseudonymize(docs, PII_KEY)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return replaced.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size in words and the words taken, repeats counted."""
    taken = mixing.mix(docs, F.array("source"), keep=tuple(docs.columns))
    only = F.col("sources")[0]
    added = {"size": F.col("size"), "source_size": only["size"], "target": only["target"], "copies": F.col("copies"), "taken": F.col("taken")}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in {*added, *mixing.RESULT}]
    return taken.where("copies > 0").select(*own, *[value.alias(name) for name, value in added.items()])


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii_surrogates", without_personal_data),
    ("source_mix", mixed),
]

#: Fingerprints, language scores and surrogates have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage wrote in between, and its input, are deleted once its result is written."""
    docs, start = table(spark, sf_dir, "documents"), stages_written(spark)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stages(spark, start, but_last=1)
    return docs
