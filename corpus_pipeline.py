"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage works on the documents that the one before it kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import decontam, line_rules, secret_scan, sentencepiece_codec, simhash
from claimlens.llm.common import drop_stored, scratch, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do lines above the limits in the others.

    Null and blank texts go, as they have too few words; rows with a null doc_id or source and repeated rows are judged like others.
    All columns stay. An empty table gives an empty one.
    """
    return line_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays.

    A null doc_id comes after all others; of rows with one id the text with the smallest hash stays. Null and empty texts are one
    component. All columns stay. An empty table gives an empty one.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; rows without a doc_id stay.

    Null texts hold nothing. All columns stay. Empty tables on either side take nothing away.
    """
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents and columns stay, n_chars follows the text, a null text stays null."""
    return secret_scan.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every document; a null text has no ids, a null doc_id stays null."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("sentencepiece", tokenise),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against the stages done by hand on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage gives is written as Parquet and reread by the next.

    A stage's own tables and the one that it read are deleted once its result is written; what the last stage reads stays, as its
    rows are made when they are read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as made:
            kept = stored(stage(spark, docs, sf_dir))
        drop_stored(docs, *(x for x in made if x is not kept))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
