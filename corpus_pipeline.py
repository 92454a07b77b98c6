"""A corpus pipeline: documents in, encoded training documents out.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame and works on all that
the stage before it kept. ``run`` writes every stage as Parquet to the shared folder and reads it
back as the next one's documents. All stages but the last return the columns of documents.

Rows a stage does not judge are kept: near duplicates keep rows without an id, secret scans
and encoding keep every row. Mixing leaves out documents it does not take and repeats those it
takes more than once, so a document can have several rows in the result. An empty table passes
through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from homeward.llm import chosen_path, mixing, quality_rules, secrets
from homeward.llm.common import stored, table
from homeward.llm.queries import token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return chosen_path.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digest of every row."""
    return token_digest(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", mix),
    ("byte-level BPE", encode),
]

# The hashes, models and merges of the stages have no counterpart in DuckDB; the tests run the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
