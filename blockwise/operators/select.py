"""Choosing blocks for a request: scope, dedup, score, allocation and rendering as DataFrame operators.

A candidate is a row (request_id, id, scope columns, sourceDocumentId, content,
normalizedContentHash, tokenCount, required, priority, category, relevance, updatedAt). Nothing is
ever dropped silently: a candidate that is out carries its reason in `reason`, null while it is in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity, validate

# Reason codes of decisions.
INCLUDED = "INCLUDED"
REASONS = ("EXCLUDED_SCOPE_MISMATCH", "EXCLUDED_INVALID", "EXCLUDED_POLICY", "EXCLUDED_DUPLICATE", "EXCLUDED_BUDGET", "EXCLUDED_CATEGORY_LIMIT", "EXCLUDED_RENDER_OVERFLOW", "REQUIRED_CONTENT_EXCEEDS_BUDGET", "EXCLUDED_UNKNOWN_REQUEST", "EXCLUDED_INVALID_REQUEST")


@dataclass(frozen=True)
class Policy:
    """What the reference leaves open, stated; `version` is stamped on every result."""

    version: str = "1"
    priority_weight: float = 0.4
    relevance_weight: float = 0.5
    recency_weight: float = 0.1
    max_priority: int = 4
    reference_time: str = "2026-01-01T00:00:00Z"
    recency_days: float = 365.0
    excluded_categories: tuple[str, ...] = ()
    category_max: dict[str, int] = field(default_factory=dict)
    category_min: dict[str, int] = field(default_factory=dict)
    wrapper_tokens: int = 0  #: tokens that rendering adds to each block


def out(df: DataFrame, when: Column, reason: str) -> DataFrame:
    """Sets the reason where a candidate that is still in meets the condition."""
    return df.withColumn("reason", F.when(F.col("reason").isNull() & F.coalesce(when, F.lit(True)), F.lit(reason)).otherwise(F.col("reason")))


def in_scope(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates with their request's budget; those of another scope, of no request or of an invalid one (`issues` isn't null) are out.

    Comparison is exact, an absent project equals an absent one only.
    """
    issues = F.col("issues").isNotNull() if "issues" in requests.columns else F.lit(False)
    scope = requests.select("request_id", *[F.col(c).alias(f"r_{c}") for c in ("tenantId", "workspaceId", "projectId")], "available", issues.alias("r_bad"))
    joined = candidates.join(scope, "request_id", "left").withColumn("reason", F.lit(None).cast("string"))
    joined = out(out(joined, F.col("r_bad").isNull(), REASONS[8]), F.col("r_bad"), REASONS[9])
    return out(joined, ~validate.scopes_equal("", "r_"), REASONS[0]).drop("r_tenantId", "r_workspaceId", "r_projectId", "r_bad")


def valid(df: DataFrame, policy: Policy) -> DataFrame:
    """Invalid candidates (bad counts, repeated ids, priorities or relevance out of range, NaN, no source) and excluded categories are out."""
    repeated = F.row_number().over(W.partitionBy("request_id", "id").orderBy("normalizedContentHash", "sourceDocumentId")) > 1
    bad = repeated | ~F.coalesce(F.col("tokenCount") >= 0, F.lit(False)) | validate.filled("id").isNotNull() | validate.filled("content").isNotNull() | ~F.coalesce(F.col("priority"), F.lit(0)).between(0, policy.max_priority)
    bad = bad | F.isnan(F.coalesce("relevance", F.lit(0.0))) | ~F.coalesce("relevance", F.lit(0.0)).between(0.0, 1.0) | validate.filled("sourceDocumentId").isNotNull()
    df = out(df.withColumn("bad", bad), F.col("bad"), REASONS[1]).drop("bad")
    return out(df, F.coalesce(F.col("category").isin(*policy.excluded_categories), F.lit(False)), REASONS[2]) if policy.excluded_categories else df


def canonical_order() -> list[Column]:
    """Which of several copies stays: required, of higher priority, newer, of better provenance, least id."""
    return [F.coalesce("required", F.lit(False)).desc(), F.coalesce("priority", F.lit(0)).desc(), F.col("updatedAt").desc_nulls_last(), F.col("sourceDocumentId").isNotNull().desc(), F.col("id").asc()]


def dedup(df: DataFrame) -> DataFrame:
    """Candidates with canonical_id; those in whose normalised content equals an earlier one's are out."""
    by = W.partitionBy("request_id", F.col("reason").isNotNull(), "normalizedContentHash").orderBy(*canonical_order())
    df = df.withColumn("canonical_id", F.when(F.col("reason").isNull(), F.first("id").over(by)))
    return out(df, F.col("canonical_id") != F.col("id"), REASONS[3])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """What each canonical candidate stands for: the provenance of its copies."""
    copies = df.where(F.col("reason") == REASONS[3]).groupBy("request_id", "canonical_id")
    return copies.agg(F.array_sort(F.collect_list(F.struct("id", "sourceDocumentId"))).alias("duplicates"))


def score(df: DataFrame, policy: Policy) -> DataFrame:
    """The components of the score, each between 0 and 1, and their weighted sum. The reference time is an input."""
    days = (F.unix_seconds(F.to_timestamp(F.lit(policy.reference_time))) - F.unix_seconds(F.to_timestamp("updatedAt"))) / 86400.0
    df = df.withColumn("priority_score", F.coalesce(F.col("priority"), F.lit(0)) / float(policy.max_priority))
    df = df.withColumn("relevance_score", F.coalesce(F.when(~F.isnan("relevance"), F.col("relevance")), F.lit(0.0)))
    df = df.withColumn("recency_score", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / policy.recency_days)), F.lit(0.0)))
    return df.withColumn("score", F.col("priority_score") * policy.priority_weight + F.col("relevance_score") * policy.relevance_weight + F.col("recency_score") * policy.recency_weight)


def allocate(df: DataFrame, policy: Policy) -> DataFrame:
    """Greedy allocation by request: required candidates first, then by score; one that doesn't fit is skipped.

    Skipping makes the choice sequential, so a request's candidates, which its provider bounds, are
    decided in one task; only ids and numbers go there. A category's minimum is filled before other
    optional candidates, its maximum is never passed. Sets reason, and rank, the order of decision.
    """
    slim = df.where("reason IS NULL").select("request_id", "id", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("category", F.lit("")).alias("category"), "score", "tokenCount", "available")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (not r["required"], -r["score"], r["id"]))
        budget, used, counts, reasons = rows[0]["available"], 0, {}, {}
        need = sum(r["tokenCount"] + policy.wrapper_tokens for r in rows if r["required"])
        first = [r for r in rows if r["required"]]
        for category, least in sorted(policy.category_min.items()):
            first += [r for r in rows if not r["required"] and r["category"] == category][:least]
        chosen = {r["id"] for r in first}
        rows = first + [r for r in rows if r["id"] not in chosen]
        for r in rows:
            size, most = r["tokenCount"] + policy.wrapper_tokens, policy.category_max.get(r["category"])
            if need > budget:
                reasons[r["id"]] = REASONS[7]
            elif most is not None and not r["required"] and counts.get(r["category"], 0) >= most:
                reasons[r["id"]] = REASONS[5]
            elif used + size > budget:
                reasons[r["id"]] = REASONS[4]
            else:
                used += size
                counts[r["category"]] = counts.get(r["category"], 0) + 1
                reasons[r["id"]] = INCLUDED
        return pa.table({"request_id": pa.array([r["request_id"] for r in rows], table.schema.field("request_id").type), "id": [r["id"] for r in rows], "decided": [reasons[r["id"]] for r in rows], "rank": pa.array(range(1, len(rows) + 1), pa.int64())})

    kind = df.schema["request_id"].dataType.simpleString()
    decided = slim.groupBy("request_id").applyInArrow(run, f"request_id {kind}, id string, decided string, rank long")
    undecided = F.col("reason").isNull()
    joined = df.withColumn("key", F.when(undecided, F.col("id"))).join(decided.withColumnRenamed("id", "key"), ["request_id", "key"], "left").drop("key")
    return joined.withColumn("reason", F.coalesce("reason", "decided")).drop("decided")


def escaped(column: str) -> Column:
    text = F.col(column)
    for this, that in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(this), F.lit(that))
    return text


def block_text() -> Column:
    """An included block as the context shows it."""
    return F.concat(F.lit('<block id="'), escaped("id"), F.lit('" source="'), F.coalesce(escaped("sourceDocumentId"), F.lit("")), F.lit('">\n'), F.col("content"), F.lit("\n</block>"))


def render(df: DataFrame) -> DataFrame:
    """One context by request: included blocks in order of document and id, each in a tagged wrapper with escaped labels; the content as it is."""
    parts = df.where(F.col("reason") == INCLUDED).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("sourceDocumentId", "id", block_text().alias("block")))).alias("parts"))
    return parts.select("request_id", F.array_join(F.transform("parts", lambda p: p["block"]), "\n").alias("context"))


def fingerprint(df: DataFrame, requests: DataFrame, policy: Policy) -> DataFrame:
    """A digest by request over its scope and budget, the policy and all candidates, whatever their order.

    Candidates come in as a count and two sums of 64-bit hashes, which are added up partially.
    """
    row = [F.col(c) for c in ("id", "normalizedContentHash", "tokenCount", "required", "priority", "category", "relevance", "updatedAt", "sourceDocumentId")]
    sums = [F.sum(F.xxhash64(F.lit(salt), *row).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
    told = df.groupBy("request_id").agg(F.concat_ws("/", F.count("*"), *sums).alias("candidates"))
    own = requests.select("request_id", F.to_json(F.struct("tenantId", "workspaceId", "projectId", "available")).alias("own")).join(told, "request_id", "left")
    return own.select("request_id", identity.digest(F.concat_ws("\n", "own", F.lit(repr(policy)), F.coalesce("candidates", F.lit("0")))).alias("fingerprint"))


def recount(df: DataFrame, tokenizer) -> DataFrame:
    """Exact counts in place of the candidates' own, with recounted true where they differ."""
    kept = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = pa.array([tokenizer.count(t or "") for t in batch.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, exact], names=[*kept, "exact"])

    counted = df.mapInArrow(run, _with_long(df, "exact"))
    return counted.withColumn("recounted", ~F.col("tokenCount").eqNullSafe(F.col("exact"))).withColumn("tokenCount", F.col("exact")).drop("exact")


def _with_long(df: DataFrame, name: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
