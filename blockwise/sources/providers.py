"""Candidate providers: requests in, candidate rows out, always within the request's scope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validate

TERMS = r"[^\p{L}\p{N}]+"


class CandidateProvider(Protocol):
    id: str
    version: str

    def candidates(self, requests: DataFrame) -> DataFrame: ...


def _scoped(blocks: DataFrame, requests: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Blocks with request_id, where scopes are equal; `pairs` (request_id, id, relevance) narrows what is joined."""
    scope = requests.select("request_id", *[F.col(c).alias(f"r_{c}") for c in ("tenantId", "workspaceId", "projectId")])
    if pairs is None:
        same = validate.scopes_equal("", "r_")
        return blocks.join(scope, same).drop("r_tenantId", "r_workspaceId", "r_projectId").withColumn("relevance", F.lit(0.0))
    return pairs.join(blocks, "id").join(scope, "request_id").where(validate.scopes_equal("", "r_")).drop("r_tenantId", "r_workspaceId", "r_projectId")


@dataclass
class Static:
    """All blocks of the request's scope."""

    blocks: DataFrame
    id: str = "static"
    version: str = "1"

    def candidates(self, requests: DataFrame) -> DataFrame:
        return _scoped(self.blocks, requests).withColumn("providerId", F.lit(self.id)).withColumn("providerVersion", F.lit(self.version))


@dataclass
class Lexical:
    """The blocks that BM25 ranks first for a request's query; relevance is the score over the request's best one."""

    blocks: DataFrame
    most: int = 50
    k1: float = 1.2
    b: float = 0.75
    id: str = "lexical-bm25"
    version: str = "1"

    def scores(self, requests: DataFrame) -> DataFrame:
        """(request_id, id, score) of all blocks in scope that share a term with the query."""
        terms = lambda c: F.filter(F.split(F.lower(c), TERMS), lambda t: t != "")
        sized = self.blocks.select("id", "tenantId", "workspaceId", "projectId", terms("content").alias("terms"))
        n, mean = sized.agg(F.count("*"), F.avg(F.size("terms"))).first()
        asked = requests.select("request_id", *[F.col(c).alias(f"r_{c}") for c in ("tenantId", "workspaceId", "projectId")], F.explode(F.array_distinct(terms("query"))).alias("term"))
        held = sized.select("id", "tenantId", "workspaceId", "projectId", F.size("terms").alias("length"), F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
        postings = held.groupBy("term", "id", "tenantId", "workspaceId", "projectId", "length").agg(F.count("*").alias("tf"))
        rarity = postings.groupBy("term").agg(F.log(1 + (n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
        part = F.col("idf") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("length") / (mean or 1.0)))
        met = postings.join(rarity, "term").join(asked, "term").where(validate.scopes_equal("", "r_"))
        return met.groupBy("request_id", "id").agg(F.sum(part).alias("score"))

    def candidates(self, requests: DataFrame) -> DataFrame:
        by = W.partitionBy("request_id")
        ranked = self.scores(requests).withColumn("rank", F.row_number().over(by.orderBy(F.col("score").desc(), "id"))).withColumn("relevance", F.col("score") / F.max("score").over(by))
        found = _scoped(self.blocks, requests, ranked.where(F.col("rank") <= self.most).select("request_id", "id", "relevance"))
        return found.withColumn("providerId", F.lit(self.id)).withColumn("providerVersion", F.lit(self.version))


class ModelProvider(Protocol):
    """What answers from a compiled context; it is never called while compiling."""

    id: str

    def answer(self, query: str, context: str) -> str: ...


@dataclass
class FakeModel:
    """A model for tests: it answers with what a function makes of query and context."""

    reply: Callable[[str, str], str]
    id: str = "fake-model"

    def answer(self, query: str, context: str) -> str:
        return self.reply(query, context)
