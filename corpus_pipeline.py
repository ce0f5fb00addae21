"""The training-data pipeline: stages over the documents table, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import crf, packing, pii, quality_rules, simhash
from postmill.llm.common import cut, small_batches, table
from postmill.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line field scores at least 0.5.

    Null, empty and blank texts are scored as one blank line and very long ones over all lines; null ids are kept or not by
    their text; repeated rows share their score, so all stay or all go; where labels teach nothing every score is 0.5 and
    every row stays; an empty table stays empty; only the columns of documents are read and returned."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    field = crf.fit_documents(docs, table(spark, sf_dir, "labels"))
    return crf.score_documents(docs, field).where(F.col("score") >= 0.5).select(COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rule and the risk-controlled cutoffs.

    Null, empty and blank texts fail the base rule (under 50 words); very long ones are judged whole; a null id has no label
    and is judged by its text, a null language in the stratum of other languages; repeated rows share their verdict; rows at
    a cutoff go; an empty table stays empty; only the columns of documents are read and returned."""
    docs = docs.select(COLUMNS)
    return quality_rules.keep(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints: the one of smallest (doc_id, hash of the text), null ids first.

    Null, empty and blank texts have one fingerprint, so one of them stays; very long texts count whole; rows of null ids
    are told apart by their texts; of rows equal in id and text one stays; an empty table stays empty; only the columns of
    documents are read and returned."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    return simhash.keep_one(docs).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by tags; n_chars follows the text.

    Every row stays, repeated ones and those of null ids too; null texts stay null (n_chars null) and empty ones empty; very
    long texts are searched whole; of overlapping spans the first gives the tag; an empty table stays empty; only the columns
    of documents are read and returned."""
    docs = docs.select(COLUMNS)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in context windows.

    Null and empty texts are their end token; very long texts are many windows; null ids are kept; repeated rows are packed
    each; ties of length go by order in the task; an empty table gives no pieces; only the columns of documents are read."""
    small_batches(spark)
    docs = docs.select(COLUMNS)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]

#: The classifier and the packing have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    small_batches(spark)
    out = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = cut(out, name.replace(" ", "-"))
    return out
