"""Cleans a corpus and encodes it: quality rules, near copies, repeated passages, mixing, BPE.

In every stage: columns of the input other than those of documents are not read, whatever their
names; an empty table gives an empty one; a null source is a source of its own, a null language a
language of its own. Each stage's docstring states the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.llm import bpe, jaccard_join, mixing, quality, substring_dedup
from sweepline.llm.common import table
from sweepline.llm.queries import tokenizer_path
from sweepline.runtime import shared_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows told apart by id and text, so that rows that repeat an id do not share a decision."""
    return docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose perplexity lies in their language's band.

    Null and empty texts have no words and go. Very long texts are judged by the median of their
    passages. Rows that repeat an id are judged each by its text; equal rows stay or go together,
    null ids are ids like any other.
    """
    keyed = _keyed(docs)
    passed = quality.verdicts(keyed, carry=("text_hash",)).where("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    return keyed.join(passed, same, "left_semi").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id.

    Rows that repeat an id are dropped with it or stay with it, and of those equal in text as well
    one stays. Null and empty texts, and rows with a null id, are like nothing and stay.
    """
    kept = written(jaccard_join.join_similar(docs).where("kept").select(F.col("doc_id").alias("id")))
    once = kept.where("id is not null").distinct()
    out = docs.select(*COLUMNS).join(once, F.col("doc_id") == F.col("id"), "left_semi")
    if once.count() < kept.count():  # ids that repeat, or are null
        out = out.dropDuplicates(["doc_id", "text"]).unionByName(docs.select(*COLUMNS).where("doc_id is null"))
    return out


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that one of a smaller id has, or that it had before itself.

    Every row stays, if with an empty text; a null text stays null. Rows of one id take nothing from
    one another; null ids rank last. n_chars is counted anew.
    """
    out = substring_dedup.dedup_passages(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it once for every pass that takes words of it, as a whole.

    Null and empty texts have no words and are never taken. Rows are told apart by id and text;
    equal rows stand for each other and share their passes. A null id is an id.
    """
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.concat_ws(":", "doc_id", F.xxhash64("text")))
    mixed = mixing.mix(keyed, id_col="row_key").where("taken > 0")
    times = mixed.groupBy(F.col("doc_id").alias("key")).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("times"), F.count("*").alias("rows"))
    met = keyed.join(times, F.col("row_key") == F.col("key"))
    # equal rows stand for each other: each brings its share of their passes
    share = F.ceil(F.col("times") / F.col("rows")).cast("int")
    return met.withColumn("pass", F.explode(F.sequence(F.lit(1), share))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row of the mix; null and empty texts have no tokens."""
    return bpe.encode(docs, tokenizer_path(), remembered=80_000)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("substring dedup", repeated_passages), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: A perplexity model and BPE are beyond SQL: tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
