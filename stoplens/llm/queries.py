"""Registered queries opN_<name>: each dealt operator over its whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplens.llm import oracles
from stoplens.llm.best_fit import pack_documents
from stoplens.llm.bit_whitening import whiten
from stoplens.llm.common import read
from stoplens.llm.filter_audit import audit, document_masks
from stoplens.llm.line_windows import drop_repeated_lines
from stoplens.llm.passage_attention import fit_quality, held_out, score_quality
from stoplens.llm.quality_ledger import ledger, with_policy
from stoplens.llm.secret_scan import joined, secret_spans
from stoplens.llm.sentencepiece_bpe import encode_texts
from stoplens.llm.simhash_blocks import near_copies
from stoplens.llm.subspace_join import vector_links
from stoplens.llm.token_attribution import attribute_tokens
from stoplens.llm.toxicity_grades import fit_toxicity, score_toxicity
from stoplens.llm.url_filter import judge_urls

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_policy(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"), "text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(read(spark, sf_dir, "documents"), PIECES)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents"), BYTES)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(read(spark, sf_dir, "documents"), BYTES).select(
        F.col("id").alias("doc_id"), "document_tokens", "section", "start", "end", F.col("tokens").cast("long").alias("n_tokens"), "crossing")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", "score", "severity", "toxic", F.col("grade_chances")[1].alias("p_toxic"), F.col("grade_chances")[2].alias("p_severe"))


def op11_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")), carry=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "focus")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_ledger, op3_line_windows, op4_sentencepiece, op5_best_fit, op6_simhash,
                                   op7_subspace_join, op8_url_filter, op9_token_attribution, op10_toxicity,
                                   op11_bit_whitening, op12_filter_audit, op13_passage_attention)}
ORACLES = oracles.ORACLES
