"""Corpus pipeline: documents in, mixed and encoded training text out.

Each stage calls one operator of stringmill.llm on all that the stage before it kept, and its
decisions take effect: rejected and repeated documents are gone in the next stage. Stages take and
return the columns of documents; the last one returns ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stringmill.llm import bpe_codec, chunks, minhash, mixture, quality
from stringmill.llm.base import free_names, stored, text_or_empty

LEAST_SCORE = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves documents that the classifier scores at 0.3 or more. It learns from all labels.

    Every row is judged alone, repeated rows alike; a null text counts as empty, and all texts
    without words have the score of the bias. An empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = free_names(docs.columns, "score")
    return quality.score(docs, model, into=score).where(F.col(score) >= LEAST_SCORE).select(docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of those with equal texts: the one with the largest id.

    Null and empty texts are equal. A null id comes after all others. Of rows equal in id and text
    the one with the smallest hash of all columns stays, in every run the same.
    """
    key_in, digest_in, rank_in = free_names(docs.columns, "key", "digest", "rank")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key_in)
    kept = chunks.exact_groups(docs).where("kept").select(key, F.col("text_sha256").alias(digest_in))
    digest = F.sha2(text_or_empty("text").cast("binary"), 256).alias(digest_in)
    chosen = docs.select("*", key, digest).join(kept, [key_in, digest_in], "left_semi")
    twins = Window.partitionBy(key_in, digest_in).orderBy(F.xxhash64(*docs.columns))
    return chosen.withColumn(rank_in, F.row_number().over(twins)).where(F.col(rank_in) == 1).select(docs.columns)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each near-duplicate group: the one with the smallest id.

    Rows are numbered in order of their ids and removed by number, so that different texts under one
    id are judged apart. Rows with a null id have no number and stay; so do texts without words.
    """
    (row,) = free_names(docs.columns, "row")
    order = [F.col("doc_id").cast("long").asc_nulls_first(), F.xxhash64("text")]
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias(row)
    rows = stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).select("*", number), "numbered")
    dropped = minhash.near_groups(rows, key=row).where("not kept").select(F.col("doc_id").alias(row))
    return rows.join(dropped, row, "left_anti").select(docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mix draws them, one row per document and pass.

    Null and blank texts have no words, so no pass holds them. Repeated rows count one by one.
    """
    rows, _, drawn = mixture.mix_sources(docs)
    return mixture.mixed_texts(docs, rows, drawn, length="n_chars")


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the digest of the bytes that they decode to: a row for each row.

    Null and empty texts have no ids and the digest of no bytes.
    """
    coded = bpe_codec.decode(bpe_codec.encode(docs.select("doc_id", "source", "text")))
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("MinHash near-dedup", unlike_documents),
    ("mixing sources to target weights", mixed_documents),
    ("byte-level BPE encoding and decoding", encoded_documents),
]
#: A trained classifier and pseudorandom draws: SQL cannot say them; a brute-force version tests it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
