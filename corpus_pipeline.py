"""The training-data pipeline: toxic documents, near copies and repeated passages go, sources are mixed, pieces come out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantry.llm import mixing, pieces, simhash, suffix_dedup, toxicity
from vantry.llm.common import read
from vantry.session import shared_folder

ORACLE_SQL = None  # learned scores and merges have no SQL form; tests hold every stage against plain Python


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; clean and unlabelled ones stay whole."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id, null ones last."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that occur twice; n_chars is counted anew.

    Strings of 256 bytes are searched, as words are short; a text that is one such
    passage stays as an empty text.
    """
    cleaned = suffix_dedup.dedup(docs, span=suffix_dedup.PASSAGE, more_words_than=suffix_dedup.PASSAGE_WORDS)
    kept = cleaned.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice; rows equal in id, source and text alike."""
    taken = mixing.mix(docs, text_md5="_md5").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_md5")).agg(F.max("copies").alias("copies"))
    named = taken.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    same = docs["doc_id"].eqNullSafe(named["_id"]) & docs["source"].eqNullSafe(named["_source"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == named["_md5"])
    return docs.join(named, same).select([docs[c] for c in docs.columns])


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return pieces.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ids", "n_pieces", "n_bytes", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
