"""From raw documents to token ids: filter, deduplicate, decontaminate, encode.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next stage's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labreports.llm.common import new_folder, remove_folder, table
from labreports.llm.decontaminate import without_leaks
from labreports.llm.line_windows import dedup_lines
from labreports.llm.quality import fit_quality, score_quality
from labreports.llm.sentencepieces import encode_pieces
from labreports.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the labelled ones of ``docs``, rejects."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of three lines or more that an earlier document, or place, has."""
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.col("n_removed") > 0
        size = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", size)
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that the SimHash operator finds:
    fingerprints over three-word shingles that differ in two bits at most."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark item leaks."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the decoded text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(docs.select("doc_id", "text"), model)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

#: A fitted classifier and a merge vocabulary are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written is removed once the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
