"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, licences, line_dedup, packing, quality_classifier, quality_rules, sanitise, sharding, token_files
from .tokens import vocabulary


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_documents(spark, sf_dir).select("doc_id", "text"), report=True, whole=True)


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find(_documents(spark, sf_dir))
    every = F.concat_ws(",", F.when(F.size("base") > 0, sanitise.joined("base")), F.when(F.size("terms") > 0, sanitise.joined("terms")))
    return found.select("doc_id", *[f"n_{k}" for k in sanitise.KINDS], F.sha2(sanitise.joined("base"), 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_documents(_documents(spark, sf_dir), n=4, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), n_shards=16)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_sanitise": op3_sanitise,
    "op4_licences": op4_licences,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op4_licences": licences.oracle(),
}
