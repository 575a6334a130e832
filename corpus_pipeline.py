"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the last
returns a document's piece ids, their number and the hash of the text that they decode to.

Null, empty and blank texts are rejected by the first stage, as are texts of fewer than 50 words. Rows of one id with equal texts
leave one; with different texts they are different documents. Rows without an id stay, each by itself. Further columns, whatever
their names, go along up to the last stage. Empty tables give no rows; without test items nothing is decontaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm import decontaminate, pieces, quality, secrets, simhash
from stockwright.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the least id stays."""
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go; a document that mostly consists of them goes."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256) of every document."""
    done = pieces.encode_documents(docs)
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", encoding),
]
#: Fingerprints and piece encodings aren't expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
