"""Registered queries of the operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pluvia.llm import divergence, line_dedup, spelling, substring_dedup, url_filters
from pluvia.llm.common import table
from pluvia.llm.decontamination import leak_report
from pluvia.llm.lm_scoring import ctw_scores
from pluvia.llm.packing import pack_documents
from pluvia.llm.pii import find_pii
from pluvia.llm.quality_rules import quality_report
from pluvia.llm.simhash_dedup import simhash_components
from pluvia.llm.suffix_dedup import suffix_dedup_report
from pluvia.llm.warc import capture_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_line_dedup", line_dedup.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", substring_dedup.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup_report(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_warc_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(table(spark, sf_dir, "pages"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_report(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants", spelling.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_url_filters", url_filters.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op13_divergence_audit", divergence.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))
