"""From raw documents to shards: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes nulls in any column, texts of any length, repeated rows and empty tables, and further columns of any names (but for those that the last
stage adds). Rows without text or letters go at the first stage; of repeated rows one stays at the second; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontamination, langid, mixing, neardup, sharding
from reelspark.llm.common import quoted, table, work_dir


#: Texts of which a smaller share of trigrams is in the profile of any learned language go. Of held-out documents of the learned languages, junk and a single
#: word among them, the least had 0.54; texts in Finnish, Italian, Turkish, Polish and Vietnamese had 0.30 or less, random letters under 0.1.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no learned language: null, without a letter, or under LEAST_SCORE."""
    others = [c for c in docs.columns if c != "text"]
    got = langid.predict(docs.select(F.struct(*map(quoted, others)).alias("others"), "text"), langid.learn(docs), ["others", "text"])
    got = got.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return got.select(*("text" if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (words in fives, similarity 0.8 or more) stays, that of the least doc_id."""
    return neardup.deduplicated(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts; n_chars follows the text."""
    got = decontamination.clean(docs, table(spark, sf_dir, "benchmark"))
    return got.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else got


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies each document none to three times, so that the sources' words come to their targets; documents without words stay once."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the columns of documents, texts included."""
    return sharding.shard_by_bytes(docs, shards=16, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained filters and hashed draws aren't SQL: tests/llm compares run() and each stage with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
