"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillpanel.llm import cosine, kneser_ney, language, lattice, minhash, mixing, packing, repair, resampling, rules, secrets, templates, token_orc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Names of the tokenizer file that the token queries use, and of the vocabulary that scoring uses.
TOKENIZER = "word_bpe_49k.json"
VOCABULARY = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity and verdict of every document under a model of the trusted ones."""
    return kneser_ney.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query
def op3_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every document over all segmentations, learned from four fifths of them."""
    return lattice.score(table(spark, folder, "documents"), tokenizer_path(VOCABULARY))


@query
def op4_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and verdict of every document."""
    return rules.judge(table(spark, folder, "documents"))


@query
def op5_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of all vectors with equal labels."""
    return cosine.near_vectors(table(spark, folder, "embeddings"))


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_report(table(spark, folder, "documents"))


@query
def op7_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all documents' ids as read back from the ORC files."""
    return token_orc.tokenised(table(spark, folder, "documents"), tokenizer_path())


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    return language.identify(table(spark, folder, "documents"))


@query
def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near copies of all documents."""
    return minhash.near_copies(table(spark, folder, "documents"))


@query
def op11_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return templates.judged(table(spark, folder, "pages"))


@query
def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every damaged conversation."""
    conversations = table(spark, folder, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


@query
def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Score and rank of every document, drawn towards the benchmark's texts."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
