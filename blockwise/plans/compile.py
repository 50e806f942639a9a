"""The compile plan: requests and candidates to contexts, with one decision for every candidate."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import budget, validate
from ..operators import select
from ..operators.select import INCLUDED, Policy

ENGINE_VERSION = "1"


@dataclass(frozen=True)
class Compiled:
    decisions: DataFrame  #: one row a candidate: request_id, id, reason, rank, canonical_id, scores, tokenCount
    results: DataFrame  #: one row a request: context, usage, fingerprint, versions
    rejected: DataFrame  #: requests that are invalid, with their issues


def compile_requests(requests: DataFrame, candidates: DataFrame, policy: Policy = Policy(), tokenizer=None) -> Compiled:
    """Validate, scope, dedup, score, allocate, render. Input order never matters: every order is stated.

    Every candidate gets a decision, also one of an unknown or invalid request, and every valid
    request a result, also one without candidates. With a tokenizer the counts of candidates are
    taken anew (`recounted` tells where they differ), and the rendered context as a whole is counted:
    optional blocks are taken out, the last decided first, until it fits; if required blocks alone
    don't fit, the request fails.
    """
    good, rejected = validate.split(requests, [validate.filled("tenantId"), validate.filled("workspaceId"), validate.filled("projectId", optional=True), *validate.budget_rules()])
    good = good.withColumn("available", budget.available())
    known = select.recount(candidates, tokenizer) if tokenizer else candidates.withColumn("recounted", F.lit(False))
    scopes = good.withColumn("issues", F.lit(None).cast("string")).unionByName(rejected.withColumn("available", F.lit(None).cast("long")).withColumn("issues", F.lit("invalid")))
    decided = select.in_scope(known, scopes)
    decided = select.score(select.dedup(select.valid(decided, policy)), policy)
    decided = select.allocate(decided, policy)
    if tokenizer:
        decided = fitted(decided, tokenizer)
    else:
        decided = decided.withColumn("rendered_tokens", F.lit(None).cast("long"))
    context = select.render(decided)
    taken = F.col("reason") == INCLUDED
    usage = decided.groupBy("request_id").agg(
        F.sum("tokenCount").alias("candidate_tokens"), F.sum(F.when(taken, F.col("tokenCount"))).alias("compiled_tokens"), F.max("rendered_tokens").alias("rendered_tokens"), F.count("*").alias("n_candidates"),
        F.count_if(taken).alias("n_included"), F.max(F.when(F.col("reason") == select.REASONS[7], F.lit(select.REASONS[7]))).alias("error"),
    )
    results = good.select("request_id", F.col("available").alias("available_tokens")).join(usage, "request_id", "left")
    results = results.fillna(0, ["candidate_tokens", "compiled_tokens", "n_candidates", "n_included"])
    used = F.coalesce("rendered_tokens", "compiled_tokens")
    results = results.withColumn("unused_tokens", F.col("available_tokens") - used).withColumn("overhead_tokens", F.col("rendered_tokens") - F.col("compiled_tokens"))
    results = results.withColumn("utilisation", F.when(F.col("available_tokens") > 0, used / F.col("available_tokens")).otherwise(0.0)).withColumn("reduction_tokens", F.col("candidate_tokens") - F.col("compiled_tokens"))
    results = results.withColumn("reduction_ratio", F.when(F.col("candidate_tokens") > 0, F.col("reduction_tokens") / F.col("candidate_tokens")).otherwise(0.0))
    results = results.join(context, "request_id", "left").join(select.fingerprint(known, good, policy), "request_id", "left")
    results = results.withColumn("engine_version", F.lit(ENGINE_VERSION)).withColumn("policy_version", F.lit(policy.version))
    results = results.withColumn("tokenizer", F.lit(f"{tokenizer.id}/{tokenizer.version}" if tokenizer else None).cast("string"))
    return Compiled(decided.drop("rendered_tokens"), results, rejected)


def fitted(decided: DataFrame, tokenizer) -> DataFrame:
    """decided with rendered_tokens, the count of the whole rendered context, and without the optional blocks that it has no room for.

    A request's included blocks, which its budget bounds, are rendered and counted in one task. Required
    blocks never leave: if they don't fit by themselves, they carry the error and the request has no context.
    """
    shown = decided.where(F.col("reason") == INCLUDED).select("request_id", "id", "sourceDocumentId", F.coalesce("required", F.lit(False)).alias("required"), "rank", "available", select.block_text().alias("block"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["sourceDocumentId"] or "", r["id"]))
        out = dict.fromkeys((r["id"] for r in rows), INCLUDED)

        def count() -> int:
            return tokenizer.count("\n".join(r["block"] for r in rows if out[r["id"]] == INCLUDED))

        optional = sorted((r for r in rows if not r["required"]), key=lambda r: r["rank"])
        tokens = count()
        while tokens > rows[0]["available"] and optional:
            out[optional.pop()["id"]] = select.REASONS[6]
            tokens = count()
        if tokens > rows[0]["available"]:
            out = {r["id"]: select.REASONS[7] if r["required"] else select.REASONS[6] for r in rows}
            tokens = 0
        return pa.table({"request_id": pa.array([r["request_id"] for r in rows], table.schema.field("request_id").type), "key": list(out), "fits": list(out.values()), "rendered_tokens": pa.array([tokens] * len(out), pa.int64())})

    kind = decided.schema["request_id"].dataType.simpleString()
    found = shown.groupBy("request_id").applyInArrow(run, f"request_id {kind}, key string, fits string, rendered_tokens long")
    joined = decided.withColumn("key", F.when(F.col("reason") == INCLUDED, F.col("id"))).join(found, ["request_id", "key"], "left")
    return joined.withColumn("reason", F.coalesce("fits", "reason")).drop("key", "fits")


def reconciled(compiled: Compiled) -> DataFrame:
    """By request, whether decisions and totals agree: every candidate decided once, and tokens that add up."""
    per = compiled.decisions.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("reason").isNull()).alias("undecided"), F.sum(F.when(F.col("reason") == INCLUDED, F.col("tokenCount")).otherwise(0)).alias("tokens"))
    both = per.join(compiled.results, "request_id")
    return both.select("request_id", ((F.col("undecided") == 0) & (F.col("tokens") == F.col("compiled_tokens")) & (F.col("n") == F.col("n_candidates"))).alias("reconciles"))
