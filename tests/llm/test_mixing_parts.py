"""A part of a source goes on behind a document that does not fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from salespark.llm import mixing


def test_a_very_long_document_met_early_does_not_end_the_part(spark):
    ids = spark.range(301)
    hashed = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(400))).alias("seed")).withColumn("order", F.xxhash64("seed", "id").bitwiseAND(F.lit((1 << 63) - 1)))
    early = hashed.where("id >= 100").groupBy("seed").agg(F.min_by("id", "order").alias("first")).where("first = 300").agg(F.min("seed")).first()[0]
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), F.when(F.col("id") == 300, 200_000).otherwise(1000 + F.col("id") % 7)).alias("text"))
    taken = mixing.mix(docs, F.array("source"), share=0.3, seed=early).groupBy(F.col("sources")[0]["source"]).agg(F.first(F.col("sources")[0]["target"]), F.sum("taken")).collect()
    assert len(taken) == 2
    for _, target, words in taken:
        assert abs(words - target) <= 510


def test_rows_without_ids_are_no_block(spark):
    docs = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("w "), 99), F.col("id").cast("string")).alias("text"))
    rows = mixing.mix(docs, F.array(F.lit("a")), share=0.4).collect()
    assert abs(sum(r["taken"] for r in rows) - 0.4 * 200 * 100) <= 50
