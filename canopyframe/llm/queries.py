"""The operators as queries over the test tables, with production parameters and check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopyframe.llm import (contamination, dimscan, language, manifest, neardup, quality, recount,
                             repeats, toxicity, urls, vectorcodes)
from canopyframe.llm.common import table
from canopyframe.llm.pieces import encode_pieces
from canopyframe.llm.repair import token_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"))


@query
def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark")).drop("text_hash")


SQL["op4_winnowing"] = contamination.SQL


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"), urls.rule_frame(spark, urls.RULES))


SQL["op6_url_rules"] = urls.SQL


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data is masked."""
    return recount.edited_counts(recount.with_mask_edits(table(spark, sf_dir, "documents")))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


@query
def op10_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


SQL["op11_vector_codes"] = vectorcodes.SQL


@query
def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimscan.neighbours(table(spark, sf_dir, "embeddings"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_manifest(table(spark, sf_dir, "documents"))


SQL["op13_manifest"] = manifest.SQL
