"""Evaluation metrics as aggregates; exact ones only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"critical": 3, "important": 2, "supporting": 1}


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """part / whole; `empty` where there is nothing to find."""
    return F.when(whole > 0, part / whole).otherwise(empty)


def selection(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """By request: recalls of required and relevant blocks, irrelevant exclusion, redundancy. truth: request_id, id, label."""
    taken = F.col("reason") == "INCLUDED"
    both = decisions.join(truth, ["request_id", "id"], "left")

    def share(label: str, wanted: Column) -> Column:
        of = F.col("label") == label
        return ratio(F.count_if(of & wanted), F.count_if(of))

    return both.groupBy("request_id").agg(
        share("required", taken).alias("required_recall"), share("relevant", taken).alias("relevant_recall"), share("irrelevant", ~taken).alias("irrelevant_exclusion"),
        ratio(F.count_if(F.col("reason") == "EXCLUDED_DUPLICATE"), F.count("*"), 0.0).alias("duplicate_share"), F.count_if(taken & F.col("sourceDocumentId").isNull()).alias("without_provenance"),
    )


def facts(included: DataFrame, required: DataFrame) -> DataFrame:
    """By request: coverage of facts, weighted by importance, and of critical ones. required: request_id, fact_id, block_id, importance."""
    hit = required.join(included.select("request_id", F.col("id").alias("block_id")).distinct().withColumn("hit", F.lit(1)), ["request_id", "block_id"], "left")
    each = hit.groupBy("request_id", "fact_id", "importance").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("importance"))
    critical = F.col("importance") == "critical"
    return each.groupBy("request_id").agg(
        F.avg("hit").alias("fact_coverage"), ratio(F.sum(weight * F.col("hit")), F.sum(weight)).alias("weighted_fact_coverage"), ratio(F.sum(F.when(critical, F.col("hit")).otherwise(0)), F.count_if(critical)).alias("critical_fact_coverage")
    )


def retrieval(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """By query: recall at each k and the reciprocal rank of the first hit. ranked: query_id, id, rank; relevant: query_id, id."""
    hits = relevant.join(ranked, ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(*[ratio(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"recall_at_{k}") for k in ks], F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(df: DataFrame, metric: str, *by: str) -> DataFrame:
    """Median, mean, p10, p90, least and greatest of a metric; percentiles are exact."""
    points = [F.percentile(metric, F.lit(q)).alias(n) for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))]
    return df.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), *points, F.min(metric).alias("least"), F.max(metric).alias("greatest"))


def by_tag(df: DataFrame, metric: str, tags: str = "tags") -> DataFrame:
    """The mean of a metric by tag, and over all rows where tag is null."""
    return df.select(F.explode(tags).alias("tag"), metric).rollup("tag").agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))


def latency(df: DataFrame, metric: str = "ms") -> DataFrame:
    return df.agg(*[F.percentile(metric, F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max(metric).alias("max"), F.avg(metric).alias("mean"))


def cost(df: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Prices are for a million tokens; savings are against all candidates."""
    paid = F.col("compiled_tokens") * input_price / 1e6
    return df.withColumn("input_cost", paid).withColumn("output_cost", F.col("output_tokens") * output_price / 1e6).withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).withColumn("savings", F.col("reduction_tokens") * input_price / 1e6)


def same(left: DataFrame, right: DataFrame) -> bool:
    """Whether two results hold the same rows, whatever their order."""
    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()

    return digest(left) == digest(right)


def gates(results: DataFrame, recalls: DataFrame) -> DataFrame:
    """Acceptance: no budget is exceeded, recalls and reduction reach their targets."""
    return results.join(recalls, "request_id").agg(
        (F.count_if(F.col("compiled_tokens") > F.col("available_tokens")) == 0).alias("no_violation"), (F.avg("required_recall") >= 0.95).alias("required_recall"), (F.percentile("reduction_ratio", F.lit(0.5)) >= 0.35).alias("reduction")
    )


def write_report(folder: str, manifest: dict, aggregate: DataFrame, cases: DataFrame, failures: DataFrame) -> None:
    """cases and failures as JSON lines by the executors; the manifest and the aggregate, a few rows, as one file each, and a Markdown report."""
    spark = aggregate.sparkSession
    cases.write.mode("overwrite").json(f"{folder}/cases.jsonl")
    failures.write.mode("overwrite").json(f"{folder}/failures.json")
    aggregate.coalesce(1).write.mode("overwrite").json(f"{folder}/aggregate.json")
    rows = aggregate.limit(100).collect()
    lines = ["# Report", "", *[f"- {k}: {v}" for k, v in sorted(manifest.items())], "", "| " + " | ".join(aggregate.columns) + " |", "|" + "---|" * len(aggregate.columns), *["| " + " | ".join(map(str, r)) + " |" for r in rows]]
    for name, text in (("run-manifest.json", json.dumps(manifest, sort_keys=True)), ("report.md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
