"""From documents to packed training sequences, in five stages of the ``llm`` operators.

Each stage is written as Parquet below the shared folder and read again as the next one's documents.

All stages but the last return the columns of the documents they get, whatever else these hold and however it
is named; needed are doc_id, text, lang and source.  A null or empty text has no perplexity and goes in the
first stage; a null language or source is one of its own; repeated rows are documents of their own until
near copies are looked for; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillpanel.llm import kneser_ney, minhash, mixing, packing, secrets
from quillpanel.llm.queries import table, tokenizer_path
from quillpanel.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text their language allows."""
    return kneser_ney.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.without_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark."""
    return secrets.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes, by document."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Perplexities, MinHash, structural scans and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on all documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
