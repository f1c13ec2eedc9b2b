"""Corpus pipeline: toxicity, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the
columns of documents. ``run`` writes each stage as Parquet to the shared folder and reads it again for the next.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplens.llm.best_fit import pack_documents
from stoplens.llm.common import WORD, read, written
from stoplens.llm.line_windows import drop_repeated_lines
from stoplens.llm.queries import BYTES
from stoplens.llm.secret_scan import redact_secrets
from stoplens.llm.similar_sets import drop_similar_sets
from stoplens.llm.toxicity_grades import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model fitted on ``labels``."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return _documents(score_toxicity(docs, model).where(~F.col("toxic")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those of which nothing but repeats was there go."""
    left = drop_repeated_lines(docs)
    return _documents(left.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: pairs by SimHash fingerprints of five-word shingles, then those that
    SimHash misses by shared shingles, all confirmed by a Jaccard similarity of 0.8 or more."""
    return _documents(drop_similar_sets(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return _documents(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack_documents(docs, BYTES).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing),
]
#: SQL can't express the fitted model, the chains of near copies or the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
