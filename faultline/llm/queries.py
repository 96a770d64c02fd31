"""The registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import (
    op1_url_filter, op2_license_scan, op3_topk, op4_pii, op5_jaccard, op6_quality, op7_sharding,
    op8_html, op9_packing, op10_decontamination, op11_whitening, op12_centroids, op13_token_files,
)
from faultline.llm.common import shared_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_license_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = op2_license_scan.known_digests(spark)
    return op2_license_scan.scan(table(spark, sf_dir, "documents"), known)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii.digests(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_jaccard.components(table(spark, sf_dir, "documents"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_html.main_text(table(spark, sf_dir, "pages"))


def op9_packing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, PATTERN)


def op10_decontamination_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontamination.judged(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


def op11_whitening_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_whitening.whiten(table(spark, sf_dir, "embeddings"), count=16)


def op12_centroids_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_centroids.cluster(table(spark, sf_dir, "embeddings"), centroids=16, rounds=3)


def op13_token_files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return op13_token_files.write_and_read(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def named(f: Callable) -> str:
        for of_table in ("_pages", "_documents", "_embeddings"):
            f_name = f.__name__.removesuffix(of_table)
            if f_name != f.__name__:
                return f_name
        return f.__name__

    return {named(f): f for f in (
        op1_url_filter_pages, op2_license_scan_documents, op3_exact_topk, op4_pii_spans,
        op5_ngram_jaccard, op6_quality_scores, op7_shards, op8_html_text,
        op9_packing_documents, op10_decontamination_documents,
        op11_whitening_embeddings, op12_centroids_embeddings, op13_token_files_documents,
        pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2_license_scan.oracle(),
            "op12_centroids": op12_centroids.oracle()}
