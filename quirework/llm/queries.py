"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import class_lm, decontaminate, jaccard, line_crf, line_dedup, mixing, quality_rules, secrets, substrings, toxicity

from .oracles import ORACLES  # noqa: F401


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(substrings.repeated_bytes(_texts(spark, sf_dir)))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_texts(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.decontaminate(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("host_rate")


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(_texts(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return toxicity.report(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_texts(spark, sf_dir), **line_dedup.WHOLE)


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return line_crf.report(line_crf.score(docs, line_crf.fit(docs, table(spark, sf_dir, "labels"))))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_jaccard": op2_jaccard,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_quality_rules": op5_quality_rules,
    "op6_class_lm": op6_class_lm,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_line_crf": op9_line_crf,
    "op10_mix": op10_mix,
}
