"""Queries over the driver's tables: each applies one operator to a whole table and returns a digest of its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import class_model, decontaminate, filter_audit, licenses, line_dedup, ngram_join, pieces, quality, resample, token_files, toxicity, transport_stream, url_filter
from kelpline.llm import oracles

#: Files of the tokenizers that the queries are asked to use.
WORD_MODEL, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _read(spark, sf_dir, "documents", "benchmark")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), benchmark, window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents", "labels")
    found = quality.classify(docs.select("doc_id", "text", "lang"), labels, drop=("text",))
    return found.select("doc_id", "lang", "perplexity", "max_perplexity", "keep")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents", "labels")
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    return ngram_join.join_near(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = _read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    written = token_files.write_tokens(docs, public_tokenizers.path(WORD_MODEL), end_id=2)
    return token_files.read_tokens(spark, written)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    found = line_dedup.split_lines(docs.select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    media = transport_stream.store_media(docs.select("doc_id", "text")).drop("text")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return transport_stream.read_media(media).select("doc_id", *names)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    found = pieces.encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _read(spark, sf_dir, "documents")
    found = class_model.score_texts(docs.select("doc_id", "text"), class_model.learned_from(F.col("doc_id")), drop=("text",))
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents", "labels")
    return filter_audit.audit_filters(docs.select("doc_id", "text", "source"), labels)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _read(spark, sf_dir, "documents", "benchmark")
    return resample.resample(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontaminate, op2_quality, op3_toxicity, op4_ngram_join, op5_licenses, op6_url_filter, op7_token_files, op8_line_dedup, op9_transport_stream, op10_pieces)
    ops += (op11_class_model, op12_filter_audit, op13_resample)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the result."""
    sql = {"op1_decontaminate": oracles.decontaminate(), "op5_licenses": oracles.licenses(), "op6_url_filter": oracles.url_filter(), "op8_line_dedup": oracles.line_dedup()}
    return sql | {"op12_filter_audit": oracles.filter_audit(), "op13_resample": oracles.resample()}
