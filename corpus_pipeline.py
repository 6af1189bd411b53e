"""A corpus pipeline of five stages over `documents`; each stage's table is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import bpe, jaccard_join, mixing, substring_dedup, toxicity
from tallyglass.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a passage that counts as repeated.
PASSAGE = 50


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects (0.5 or more) go.

    Null and empty texts have the score of no evidence, and so stay where labels are
    mostly clean. Repeated rows are judged alike; without labels none goes. Columns other
    than those of documents are dropped; an empty table stays empty.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), net, score_col="__score").where("__score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with alike sets of five words, that with the smallest id stays; documents without an id stay.

    Null and empty texts are alike to nothing and stay. Rows that repeat an id stay or go
    together. Columns other than those of documents are dropped; an empty table stays empty.
    """
    groups = jaccard_join.jaccard_groups(docs.select("doc_id", "text"), k=5, similarity=(4, 5))
    gone = stored(groups.where("component != id").select(F.col("id").alias("doc_id")), "copies")
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*COLUMNS)
    return named.unionByName(docs.where("doc_id is null"))  # null keys would all go to one task of the join


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of PASSAGE words that also start earlier go; texts without any stay as they are.

    Null and empty texts stay; no row goes. Rows without an id come after all others.
    Columns other than those of documents are dropped; an empty table stays empty.
    """
    x = substring_dedup.dedup_substrings(docs.select(*COLUMNS), window=PASSAGE)
    return _as_documents(x.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix takes of a document; a pass in part has the document's first words.

    Null and empty texts hold no words, so nothing is taken of them. A null source is a
    source of its own. Columns other than those of documents are dropped; an empty table stays empty.
    """
    x = mixing.mix_sources(docs.select(*COLUMNS)).where("taken > 0")
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1))
    left = (F.col("taken") - F.col("__pass") * F.col("size")).cast("int")
    part = F.array_join(F.slice(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), F.lit(1), left), " ")
    return _as_documents(x.withColumn("__pass", passes).withColumn("text", F.when(left < F.col("size"), part).otherwise(F.col("text"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text. A null text is an empty one; repeated rows stay; an empty table stays empty."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    x = bpe.bpe_encode(docs.select(*COLUMNS), path, outputs=("n_tokens", "ids", "decoded_sha256"))
    same = F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("decoded_sha256")
    return x.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeated_passages", drop_repeated_passages), ("mix", mix), ("encode", encode)]
#: No SQL can say what the network rejects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
