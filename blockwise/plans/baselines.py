"""Baseline strategies, as windows over a request's candidates. Those that rank stop at the first that doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def full_context(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("request_id").agg(F.sum("tokenCount").alias("tokens"), F.count("*").alias("blocks"))


def _prefix(candidates: DataFrame, order: list[Column]) -> DataFrame:
    so_far = F.sum("tokenCount").over(W.partitionBy("request_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return candidates.withColumn("running", so_far)


def truncation(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """Input order, cut at the budget: `kept_tokens` of the last block may be a part of it."""
    ranked = _prefix(candidates, order)
    kept = F.least(F.col("tokenCount"), F.greatest(F.lit(0), F.col("available") - (F.col("running") - F.col("tokenCount"))))
    return ranked.withColumn("kept_tokens", kept).where("kept_tokens > 0").drop("running")


def until_full(candidates: DataFrame, order: list[Column]) -> DataFrame:
    return _prefix(candidates, order).where(F.col("running") <= F.col("available")).drop("running")


def top_k(candidates: DataFrame) -> DataFrame:
    return until_full(candidates, [F.col("score").desc(), F.col("id")])


def recent_only(candidates: DataFrame, turn: str = "turn") -> DataFrame:
    return until_full(candidates, [F.col(turn).desc(), F.col("id")])


def required_top_k(candidates: DataFrame) -> DataFrame:
    return until_full(candidates, [F.col("required").desc(), F.col("score").desc(), F.col("id")])
