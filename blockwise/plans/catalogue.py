"""Registered queries of the engine's own operators, each beside the SQL that states its result.

Requests and candidates are made from the tables by plain arithmetic: a source is a request, its
documents are candidates, their languages the categories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import budget, identity, validate
from ..functions.text import WHITESPACE, utf16_length
from ..operators import select
from ..operators.chunk import chunk, lines
from ..operators.select import Policy
from ..operators.tokenizers import CodePoints, Words
from ..sources import ingest as sources
from . import baselines, metrics
from .compile import compile_requests

BUDGET = 20_000
_CLASS = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in WHITESPACE) + "]"  # Java and RE2 read it alike


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sources(spark: SparkSession, sf_dir: str, source_type: str = "markdown") -> DataFrame:
    """Documents as ingestion input."""
    return table(spark, sf_dir, "documents").select(
        F.lit("local").alias("tenantId"), F.lit("default").alias("workspaceId"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("projectId"), F.lit(source_type).alias("sourceType"),
        F.lit("documents").alias("namespace"), F.concat(F.lit('a"\\\x01/'), "doc_id").alias("key"), F.col("text").alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("createdAt"),
        F.lit(None).cast("string").alias("updatedAt"), F.to_json(F.struct("doc_id")).alias("metadata"), "doc_id",
    )


def word_count(column: str = "text"):
    return F.size(F.filter(F.split(column, _CLASS + "+"), lambda x: x != "")).cast("long")


_WORDS = f"len(list_filter(string_split_regex(text, '{_CLASS}+'), lambda x: x != ''))"
_DOC_ID = f"""'source-document:sha256:' || sha256(json_array('{identity.DOCUMENT_KIND}', {identity.ALGORITHM}, 'local', 'default', {{project}}, '{{kind}}', '{{namespace}}', {{key}})::VARCHAR)"""


def ingest_documents(spark, sf_dir):
    rows = document_sources(spark, sf_dir)
    return sources.ingest(rows).select(F.get_json_object("metadata", "$.doc_id").cast("long").alias("doc_id"), "id", "contentHash", utf16_length("content").cast("long").alias("utf16_units"))


def ingest_conversations(spark, sf_dir):
    return sources.conversations(table(spark, sf_dir, "conversations")).select("sourceDocumentId", "messageId", "messageIndex", "role", "normalizedContentHash")


def scan_lines(spark, sf_dir):
    found = lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "line", F.col("startOffset").alias("start_offset"), (F.col("endOffset") - F.col("startOffset")).alias("length"))


def line_kinds(spark, sf_dir):
    return lines(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", F.col("lineKind").alias("kind")).agg(F.count("*").alias("n"))


#: A note with every construct, @ standing for its customer: (path of the block, or None if it is no block, text).
STRUCTURE = (
    (None, "---\ntitle: @\n---\n"), ("", "Before any heading 😀 @."), (None, "\n\n# Customer @ ##\n"), ("Customer @", 'A paragraph of\ntwo lines, "@".'), (None, "\r\n\r\n"),
    ("Customer @", "```py\n# no heading @\n\n| no | table |\n```"), (None, "\n\n"), ("Customer @", "| a | b |\n|---|:-:|\n| @ | 😀 |"), (None, "\n\n"), ("Customer @", "> quoted @\n> # still quoted"), (None, "\n\n"),
    ("Customer @", "<div>\n# html @\n</div>"), (None, "\n\n"), ("Customer @", "- item @\n  goes on\n\n  - nested\n- next"), (None, "\n\n"), ("Customer @", "1. numbered\n2) again"), (None, "\n\n### Deep  @\n\n"),
    ("Customer @/Deep @", "same @"), (None, "\n\n"), ("Customer @/Deep @", "same @"), (None, "\n## Flat\n"), ("Customer @/Flat", "~~~\nnever closed @"),
)


def md_structure(spark, sf_dir):
    """The blocks of each customer's note, none merged, with offsets, lines, occurrences and identities."""
    text = F.concat(*[F.replace(F.lit(t), F.lit("@"), F.col("c_custkey").cast("string")) for _, t in STRUCTURE])
    none = F.lit(None).cast("string")
    notes = table(spark, sf_dir, "customer").select(F.lit("local").alias("tenantId"), F.lit("default").alias("workspaceId"), none.alias("projectId"), F.lit("markdown").alias("sourceType"), F.lit("structure").alias("namespace"), F.col("c_custkey").cast("string").alias("key"),
                                                    text.alias("content"), none.alias("title"), none.alias("createdAt"), none.alias("updatedAt"), F.to_json(F.struct("c_custkey")).alias("metadata"))
    blocks = chunk(sources.ingest(notes), CodePoints(), validate.ChunkOptions(1, 100000))
    return blocks.select(F.get_json_object("metadata", "$.source.c_custkey").cast("long").alias("custkey"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(F.array_join("headingPath", "/"), F.lit("")).alias("path"), "content", F.col("startOffset").alias("start_offset"), F.col("endOffset").alias("end_offset"),
                         F.col("startLine").cast("long").alias("first_line"), F.col("endLine").cast("long").alias("last_line"), F.col("tokenCount").alias("tokens"), F.col("occurrence").cast("long").alias("occurrence"), "id")


def token_counts(spark, sf_dir):
    """The counts of both tokenizers, by the operator that recounts candidates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(0).cast("long").alias("tokenCount"))
    counted = select.recount(select.recount(docs, CodePoints()).select("doc_id", "content", F.col("tokenCount").alias("code_points"), F.lit(0).cast("long").alias("tokenCount")), Words())
    return counted.select("doc_id", "code_points", F.col("tokenCount").alias("words"))


def _synthetic(spark, sf_dir):
    """A Markdown note by customer: a heading for the customer and one for each order, with its lines as a list."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit("- part "), "l_partkey", F.lit(" x"), F.col("l_linenumber"))
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    each = orders.join(body, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.concat(F.lit("## Order "), "o_orderkey", F.lit("\n"), "body").alias("part"))
    notes = each.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "part"))), lambda x: x["part"]), "\n\n").alias("parts"))
    return notes.select(F.lit("local").alias("tenantId"), F.lit("default").alias("workspaceId"), F.lit(None).cast("string").alias("projectId"), F.lit("markdown").alias("sourceType"), F.lit("orders").alias("namespace"), F.col("o_custkey").cast("string").alias("key"),
                        F.concat(F.lit("# Customer "), "o_custkey", F.lit("\n\n"), "parts", F.lit("\n")).alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("createdAt"), F.lit(None).cast("string").alias("updatedAt"), F.to_json(F.struct("o_custkey")).alias("metadata"))


def md_sections(spark, sf_dir):
    blocks = chunk(sources.ingest(_synthetic(spark, sf_dir)), CodePoints(), validate.ChunkOptions(5000, 100000))
    return blocks.select(F.get_json_object("metadata", "$.source.o_custkey").cast("long").alias("custkey"), F.array_join("headingPath", "/").alias("path"), "content", "tokenCount", "normalizedContentHash")


def chunk_documents(spark, sf_dir):
    """By document: the characters other than white space that its blocks hold, and whether every block keeps the limit."""
    rows = document_sources(spark, sf_dir)
    blocks = chunk(sources.ingest(rows), Words(), validate.ChunkOptions(200, 400))
    solid = F.char_length(F.regexp_replace("content", _CLASS, ""))
    return blocks.groupBy(F.get_json_object("metadata", "$.source.doc_id").cast("long").alias("doc_id")).agg(F.sum(solid).alias("solid_characters"), (F.max("tokenCount") <= 400).alias("within_limit"))


def block_ids(spark, sf_dir):
    """Every text as one block of a document that stands for its language."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", F.concat(F.lit("source-document:"), identity.digest("lang")).alias("document"), identity.normalised_hash("text").alias("content_hash"))
    rows = rows.withColumn("occurrence", F.row_number().over(W.partitionBy("document", "content_hash").orderBy("doc_id")) - 1)
    return rows.select("doc_id", "content_hash", F.col("occurrence").cast("long").alias("occurrence"), identity.block_id("document", F.to_json(F.array("lang")), "content_hash", "occurrence").alias("id"))


def budget_arith(spark, sf_dir):
    price = F.floor("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("totalTokens"), (F.col("o_orderkey") % 200000).alias("reservedOutputTokens"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("reservedSystemTokens"), F.when(F.col("o_orderkey") % 3 == 0, -F.lit(1)).cast("long").alias("reservedToolTokens"), F.lit(None).cast("long").alias("reservedProtocolTokens"))
    return validate.checked(rows, validate.budget_rules()).select("o_orderkey", budget.reserved().cast("long").alias("reserved"), budget.available().alias("available"), F.array_join(F.transform("issues", lambda i: i["pointer"]), ",").alias("issues"))


def validate_split(spark, sf_dir):
    rows = document_sources(spark, sf_dir)
    k = F.col("doc_id") % 11
    faulty = rows.withColumn("tenantId", F.when(k == 1, " \t").otherwise(F.col("tenantId"))).withColumn("sourceType", F.when(k == 2, "pdf").otherwise(F.col("sourceType"))).withColumn("createdAt", F.when(k == 3, "2026-02-31T00:00:00Z").when(k == 4, "2024-02-29T23:59:59.123456789Z").when(k == 5, "0050-01-01T00:00:00Z"))
    faulty = faulty.withColumn("metadata", F.when(k == 6, "[1]").when(k == 7, "{").otherwise(F.col("metadata"))).withColumn("content", F.when(k == 8, None).otherwise(F.col("content")))
    good, bad = validate.split(faulty, validate.ingestion_rules())
    told = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["pointer"])), ",")
    return good.select("doc_id", F.lit("").alias("issues")).unionByName(bad.select("doc_id", told.alias("issues")))


def scope_filter(spark, sf_dir):
    """Messages as candidates of one request by role; a message's project is that of its conversation, if it has one."""
    talk = table(spark, sf_dir, "conversations")
    of = lambda n: F.when(F.col("conv_id") % n == 0, F.concat(F.lit("p"), F.col("conv_id") % 4))
    candidates = talk.select(F.col("role").alias("request_id"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 5 == 0, "t1").otherwise("t0").alias("tenantId"), F.lit("w").alias("workspaceId"), of(2).alias("projectId"))
    requests = talk.select("role").distinct().select(F.col("role").alias("request_id"), F.lit("t0").alias("tenantId"), F.lit("w").alias("workspaceId"), F.when(F.col("role") == "user", "p2").alias("projectId"), F.lit(0).cast("long").alias("available"))
    return select.in_scope(candidates, requests).select("request_id", "id", F.coalesce("reason", F.lit("")).alias("reason"))


def candidates_of(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = docs.join(labels, "doc_id", "left")
    day = (F.col("doc_id") * 7 % 500).cast("int")
    return joined.select(
        F.col("source").alias("request_id"), F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("local").alias("tenantId"), F.lit("default").alias("workspaceId"), F.lit(None).cast("string").alias("projectId"), F.concat(F.lit("s"), "doc_id").alias("sourceDocumentId"),
        F.col("text").alias("content"), identity.normalised_hash("text").alias("normalizedContentHash"), word_count().alias("tokenCount"), ((F.coalesce("quality", F.lit(0)) == 1) & (F.col("doc_id") % 17 == 0)).alias("required"), (F.col("doc_id") % 5).alias("priority"),
        F.col("lang").alias("category"), (F.col("doc_id") * 37 % 101 / 101.0).alias("relevance"), F.date_format(F.date_sub(F.lit("2026-01-01").cast("date"), day), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"), "doc_id",
    )


def requests_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("request_id")).distinct().select(
        "request_id", F.lit("local").alias("tenantId"), F.lit("default").alias("workspaceId"), F.lit(None).cast("string").alias("projectId"), F.lit(BUDGET + 1000).cast("long").alias("totalTokens"), F.lit(1000).cast("long").alias("reservedOutputTokens"), *[F.lit(None).cast("long").alias(c) for c in budget.RESERVES[1:]]
    )


def dedup_canonical(spark, sf_dir):
    rows = select.dedup(candidates_of(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")))
    return rows.select("request_id", "id", "canonical_id", F.coalesce("reason", F.lit("")).alias("reason"))


def score_components(spark, sf_dir):
    rows = select.score(candidates_of(spark, sf_dir), Policy())
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("priority_score", "relevance_score", "recency_score", "score")])


def compiled(spark, sf_dir):
    return compile_requests(requests_of(spark, sf_dir), candidates_of(spark, sf_dir))


def alloc_greedy(spark, sf_dir):
    return compiled(spark, sf_dir).decisions.select("request_id", "id", "reason", "rank")


def render_trace(spark, sf_dir):
    r = compiled(spark, sf_dir).results
    return r.select("request_id", F.md5("context").alias("context_md5"), "candidate_tokens", "compiled_tokens", "unused_tokens", "n_included", F.round("reduction_ratio", 6).alias("reduction_ratio"))


def decision_totals(spark, sf_dir):
    """Messages as candidates of orders' requests: valid, invalid and unknown ones, and relevance out of range; decisions by request and reason."""
    talk = table(spark, sf_dir, "conversations")
    asked = table(spark, sf_dir, "orders").where("o_orderkey <= 300").select(F.col("o_orderkey").alias("request_id"), F.lit("t").alias("tenantId"), F.lit("w").alias("workspaceId"), F.lit(None).cast("string").alias("projectId"),
        F.lit(120).cast("long").alias("totalTokens"), F.when(F.col("o_orderkey") % 7 == 3, 500).otherwise(20).cast("long").alias("reservedOutputTokens"), *[F.lit(None).cast("long").alias(c) for c in budget.RESERVES[1:]])
    said = talk.select(F.col("conv_id").alias("request_id"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.lit("t").alias("tenantId"), F.lit("w").alias("workspaceId"), F.lit(None).cast("string").alias("projectId"), F.concat(F.lit("c"), "conv_id").alias("sourceDocumentId"),
        F.concat_ws(" ", "turn", "text").alias("content"), F.concat_ws("/", "conv_id", "turn").alias("normalizedContentHash"), (F.char_length("text") % 60).cast("long").alias("tokenCount"), F.lit(False).alias("required"), F.lit(0).cast("long").alias("priority"),
        F.col("role").alias("category"), F.when(F.col("turn") % 5 == 4, 7.5).otherwise(1.0 / (F.col("turn") + 1)).alias("relevance"), F.lit(None).cast("string").alias("updatedAt"))
    done = compile_requests(asked, said, Policy(category_max={"user": 1}))
    return done.decisions.groupBy("request_id", "reason").agg(F.count("*").alias("n"), F.sum("tokenCount").alias("tokens"))


def results_of_all(spark, sf_dir):
    """Every request of `decision_totals` that is valid has a result, with or without candidates."""
    asked = table(spark, sf_dir, "orders").where("o_orderkey <= 300").select(F.col("o_orderkey").alias("request_id"), F.lit("t").alias("tenantId"), F.lit("w").alias("workspaceId"), F.lit(None).cast("string").alias("projectId"),
        F.lit(120).cast("long").alias("totalTokens"), F.when(F.col("o_orderkey") % 7 == 3, 500).otherwise(20).cast("long").alias("reservedOutputTokens"), *[F.lit(None).cast("long").alias(c) for c in budget.RESERVES[1:]])
    none = candidates_of(spark, sf_dir).where("false").withColumn("request_id", F.lit(0).cast("long"))
    return compile_requests(asked, none).results.select("request_id", "available_tokens", "n_candidates", "compiled_tokens", "unused_tokens", "utilisation")


def _scored(spark, sf_dir):
    return select.score(candidates_of(spark, sf_dir), Policy()).withColumn("available", F.lit(BUDGET).cast("long"))


def baseline_full(spark, sf_dir):
    return baselines.full_context(_scored(spark, sf_dir))


def baseline_truncate(spark, sf_dir):
    return baselines.truncation(_scored(spark, sf_dir), [F.col("doc_id")]).select("request_id", "id", "kept_tokens")


def baseline_topk(spark, sf_dir):
    return baselines.top_k(_scored(spark, sf_dir)).select("request_id", "id")


def baseline_recent(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").cast("string").alias("id"), "turn", word_count().alias("tokenCount"), F.lit(100).cast("long").alias("available"))
    return baselines.recent_only(talk).select(F.col("request_id").alias("conv_id"), "turn")


def baseline_required_topk(spark, sf_dir):
    return baselines.required_top_k(_scored(spark, sf_dir)).select("request_id", "id")


def metrics_report(spark, sf_dir):
    return metrics.summary(compiled(spark, sf_dir).results, "reduction_ratio").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90", "least", "greatest")])


def recall_report(spark, sf_dir):
    """Recalls by request, a document's quality label being its relevance."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    truth = table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("source").alias("request_id"), F.concat(F.lit("d"), "doc_id").alias("id"), F.when(F.col("q") == 1, "relevant").otherwise("irrelevant").alias("label"))
    out = metrics.selection(compiled(spark, sf_dir).decisions, truth)
    return out.select("request_id", *[F.round(c, 6).alias(c) for c in ("required_recall", "relevant_recall", "irrelevant_exclusion", "duplicate_share")])


def retrieval_metrics(spark, sf_dir):
    """A language asks for its documents of good quality; what is retrieved is ranked by length."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "id")))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    out = metrics.retrieval(ranked.select("query_id", "id", "rank"), docs.join(good, "id").select("query_id", "id"))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "reciprocal_rank")])


def language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents ingested and chunked, blocks and tokens by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    blocks = chunk(sources.ingest(document_sources(spark, sf_dir)), CodePoints(), validate.ChunkOptions(200, 400))
    of = blocks.groupBy(F.get_json_object("metadata", "$.source.doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("blocks"), F.sum("tokenCount").alias("tokens"))
    return of.join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("blocks").alias("blocks"), F.sum("tokens").alias("tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        ingest_documents, ingest_conversations, scan_lines, line_kinds, token_counts, md_sections, md_structure, chunk_documents, block_ids, budget_arith, validate_split, scope_filter, dedup_canonical,
        score_components, alloc_greedy, decision_totals, results_of_all, render_trace, baseline_full, baseline_truncate, baseline_topk, baseline_recent, baseline_required_topk, metrics_report, recall_report, retrieval_metrics, language_report,
    )
}

_HASH = "'sha256:' || sha256(regexp_replace({0}, '\\r\\n?', chr(10), 'g'))"
_CANDIDATES = f"""
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
cand AS (
  SELECT source AS request_id, 'd' || d.doc_id AS id, {_HASH.format('text')} AS h, {_WORDS} AS tokens, coalesce(quality, 0) = 1 AND d.doc_id % 17 = 0 AS required, d.doc_id % 5 AS priority, lang AS category,
    (d.doc_id * 37 % 101) / 101.0::DOUBLE AS relevance, DATE '2026-01-01' - (d.doc_id * 7 % 500)::INT AS updated, (d.doc_id * 7 % 500)::DOUBLE AS days, d.doc_id, text
  FROM documents d LEFT JOIN q USING (doc_id)),
parts AS (SELECT *, priority / 4.0::DOUBLE AS ps, relevance AS rs, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - days / 365.0::DOUBLE)) AS ys FROM cand),
scored AS (SELECT *, ps * 0.4::DOUBLE + rs * 0.5::DOUBLE + ys * 0.1::DOUBLE AS score FROM parts),
dedup AS (SELECT *, first_value(id) OVER (PARTITION BY request_id, h ORDER BY required DESC, priority DESC, updated DESC, id) AS canonical FROM scored)"""
_ALLOCATED = f"""WITH RECURSIVE {_CANDIDATES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY required DESC, score DESC, id) AS rank, sum(CASE WHEN required THEN tokens ELSE 0 END) OVER (PARTITION BY request_id) AS need FROM dedup WHERE id = canonical),
walk AS (
  SELECT request_id, id, rank, need > {BUDGET} AS over, need <= {BUDGET} AND tokens <= {BUDGET} AS taken, CASE WHEN need <= {BUDGET} AND tokens <= {BUDGET} THEN tokens ELSE 0 END AS used FROM ranked WHERE rank = 1
  UNION ALL
  SELECT r.request_id, r.id, r.rank, w.over, NOT w.over AND w.used + r.tokens <= {BUDGET}, w.used + CASE WHEN NOT w.over AND w.used + r.tokens <= {BUDGET} THEN r.tokens ELSE 0 END FROM walk w JOIN ranked r ON r.request_id = w.request_id AND r.rank = w.rank + 1),
decided AS (
  SELECT d.*, w.rank AS rank, CASE WHEN d.id <> canonical THEN 'EXCLUDED_DUPLICATE' WHEN w.over THEN 'REQUIRED_CONTENT_EXCEEDS_BUDGET' WHEN w.taken THEN 'INCLUDED' ELSE 'EXCLUDED_BUDGET' END AS reason
  FROM dedup d LEFT JOIN walk w ON w.request_id = d.request_id AND w.id = d.id)"""
_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_USAGE = _ALLOCATED + """,
usage AS (SELECT request_id, sum(tokens)::BIGINT AS candidate_tokens, coalesce(sum(tokens) FILTER (reason = 'INCLUDED'), 0)::BIGINT AS compiled_tokens, count(*) FILTER (reason = 'INCLUDED') AS n_included FROM decided GROUP BY 1)"""
_PREFIX = f"WITH {_CANDIDATES} SELECT request_id, id FROM (SELECT *, sum(tokens) OVER (PARTITION BY request_id ORDER BY @order ROWS UNBOUNDED PRECEDING) AS running FROM scored) WHERE running <= {BUDGET}"
_BODY = """WITH item AS (SELECT l_orderkey, string_agg('- part ' || l_partkey || ' x' || l_linenumber, chr(10) ORDER BY l_linenumber, l_partkey) AS body FROM lineitem GROUP BY 1)
SELECT o_custkey AS custkey, 'Customer ' || o_custkey || '/Order ' || o_orderkey AS path, body AS content, length(body) AS "tokenCount", 'sha256:' || sha256(body) AS "normalizedContentHash" FROM orders JOIN item ON o_orderkey = l_orderkey"""


# What a line is, as RE2 patterns in the order in which they are tried.
_KINDS = {
    "code": r"^ {0,3}(`{3,}[^`]*|~{3,}.*)$", "heading": r"^ {0,3}#{1,6}([ \t].*)?$", "list": r"^ {0,3}([-+*]|[0-9]+[.)])[ \t]+", "quote": r"^ {0,3}>", "html": r"^ {0,3}<(!--|/?[A-Za-z][A-Za-z0-9_-]*(\s|>|/))",
    "delimiter": r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$",
}


def _kind_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}')" + " AND contains(line, '|')" * (n == "delimiter") + f" THEN '{n}'" for n, p in _KINDS.items()) + " ELSE 'text' END"


def _structure_sql() -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"({i}, {quoted(path)}, {quoted(text)})" for i, (path, text) in enumerate(STRUCTURE))
    document = _DOC_ID.format(project="NULL", kind="markdown", namespace="structure", key="k::VARCHAR")
    return f"""WITH t AS (SELECT c_custkey AS k, i, replace(path, '@', c_custkey::VARCHAR) AS path, replace(body, '@', c_custkey::VARCHAR) AS content FROM customer, (VALUES {rows}) AS v(i, path, body)),
u AS (SELECT *, length(content) + length(regexp_replace(content, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units, length(content) - length(replace(content, chr(10), '')) AS breaks FROM t),
w AS (SELECT *, coalesce(sum(units) OVER before, 0)::BIGINT AS start_offset, (1 + coalesce(sum(breaks) OVER before, 0))::BIGINT AS first_line FROM u WINDOW before AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS ordinal, row_number() OVER (PARTITION BY k, path, content ORDER BY i) - 1 AS occurrence, {_HASH.format('content')} AS h, {document} AS document FROM w WHERE path IS NOT NULL)
SELECT k AS custkey, ordinal, path, content, start_offset, start_offset + units AS end_offset, first_line, first_line + breaks AS last_line, length(content) AS tokens, occurrence,
'context-block:sha256:' || sha256(json_array('{identity.BLOCK_KIND}', {identity.ALGORITHM}, document, CASE WHEN path <> '' THEN to_json(string_split(path, '/')) END, h, occurrence)::VARCHAR) AS id FROM x"""


ORACLES: dict[str, str] = {
    "ingest_documents": "SELECT doc_id, " + _DOC_ID.format(project="CASE WHEN doc_id % 3 = 0 THEN lang END", kind="markdown", namespace="documents", key="'a\"\\' || chr(1) || '/' || doc_id") + " AS id, 'sha256:' || sha256(text) AS \"contentHash\", length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS utf16_units FROM documents",
    "ingest_conversations": "SELECT " + _DOC_ID.format(project="NULL", kind="conversation", namespace="conversations", key="conv_id::VARCHAR") + " AS \"sourceDocumentId\", conv_id || '/' || turn AS \"messageId\", turn AS \"messageIndex\", role, " + _HASH.format("text") + ' AS "normalizedContentHash" FROM conversations',
    "scan_lines": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, length(text) AS whole, unnest(a) AS raw, generate_subscripts(a, 1) AS line FROM l),
m AS (SELECT *, length(raw) + length(regexp_replace(raw, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
s AS (SELECT *, coalesce(sum(units + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)
SELECT doc_id, line::BIGINT AS line, start::BIGINT AS start_offset, units - CASE WHEN ends_with(raw, chr(13)) THEN 1 ELSE 0 END AS length FROM s WHERE place < whole""",
    "line_kinds": f"SELECT page_id, {_kind_sql()} AS kind, count(*) AS n FROM (SELECT page_id, regexp_replace(unnest(string_split(regexp_replace(html, '\\n\\z', ''), chr(10))), '\\r\\z', '') AS line FROM pages WHERE html <> '') GROUP BY 1, 2",
    "md_structure": _structure_sql(),
    "token_counts": f"SELECT doc_id, length(text) AS code_points, {_WORDS} AS words FROM documents",
    "md_sections": _BODY,
    "chunk_documents": f"SELECT doc_id, length(regexp_replace(text, '{_CLASS}', '', 'g')) AS solid_characters, true AS within_limit FROM documents WHERE length(regexp_replace(text, '{_CLASS}', '', 'g')) > 0",
    "block_ids": f"""WITH r AS (SELECT doc_id, lang, 'source-document:sha256:' || sha256(lang) AS document, {_HASH.format('text')} AS content_hash FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY document, content_hash ORDER BY doc_id) - 1 AS occurrence FROM r)
SELECT doc_id, content_hash, occurrence, 'context-block:sha256:' || sha256(json_array('{identity.BLOCK_KIND}', {identity.ALGORITHM}, document, json_array(lang), content_hash, occurrence)::VARCHAR) AS id FROM o""",
    "budget_arith": """WITH r AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS t, o_orderkey % 200000 AS a, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS b, CASE WHEN o_orderkey % 3 = 0 THEN -1 END AS c FROM orders)
SELECT o_orderkey, (a + coalesce(b, 0) + coalesce(c, 0))::BIGINT AS reserved, (t - a - coalesce(b, 0) - coalesce(c, 0))::BIGINT AS available,
concat_ws(',', CASE WHEN c < 0 THEN 'reservedToolTokens' END, CASE WHEN a + coalesce(b, 0) + coalesce(c, 0) > t THEN 'totalTokens' END) AS issues FROM r""",
    "validate_split": """SELECT doc_id, CASE doc_id % 11 WHEN 1 THEN 'invalid_value:tenantId' WHEN 2 THEN 'invalid_enum_value:sourceType' WHEN 3 THEN 'invalid_value:createdAt' WHEN 5 THEN 'invalid_value:createdAt'
WHEN 6 THEN 'invalid_value:metadata' WHEN 7 THEN 'invalid_value:metadata' WHEN 8 THEN 'invalid_value:content' ELSE '' END AS issues FROM documents""",
    "scope_filter": """SELECT role AS request_id, conv_id || '/' || turn AS id, CASE WHEN conv_id % 5 <> 0 AND (CASE WHEN conv_id % 2 = 0 THEN 'p' || conv_id % 4 END) IS NOT DISTINCT FROM (CASE WHEN role = 'user' THEN 'p2' END)
THEN '' ELSE 'EXCLUDED_SCOPE_MISMATCH' END AS reason FROM conversations""",
    "dedup_canonical": f"WITH {_CANDIDATES} SELECT request_id, id, canonical AS canonical_id, CASE WHEN id = canonical THEN '' ELSE 'EXCLUDED_DUPLICATE' END AS reason FROM dedup",
    "score_components": f"WITH {_CANDIDATES} SELECT id, round(ps, 6) AS priority_score, round(rs, 6) AS relevance_score, round(ys, 6) AS recency_score, round(score, 6) AS score FROM scored",
    "alloc_greedy": _ALLOCATED + " SELECT request_id, id, reason, rank FROM decided",
    "render_trace": _USAGE + f""", shown AS (SELECT request_id, string_agg('<block id="' || {_ESC.format('id')} || '" source="s' || doc_id || '">' || chr(10) || text || chr(10) || '</block>', chr(10) ORDER BY 's' || doc_id, id) AS context FROM decided WHERE reason = 'INCLUDED' GROUP BY 1)
SELECT request_id, md5(context) AS context_md5, candidate_tokens, compiled_tokens, {BUDGET} - compiled_tokens AS unused_tokens, n_included, round(CASE WHEN candidate_tokens > 0 THEN (candidate_tokens - compiled_tokens) / candidate_tokens::DOUBLE ELSE 0 END, 6) AS reduction_ratio FROM usage LEFT JOIN shown USING (request_id)""",
    "decision_totals": """WITH RECURSIVE c AS (SELECT conv_id AS request_id, turn, conv_id || '/' || turn AS id, role, length(text) % 60 AS tokens, turn % 5 = 4 AS wild, o_orderkey IS NULL AS unknown, coalesce(conv_id % 7 = 3, false) AS bad
  FROM conversations LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey <= 300) ON o_orderkey = conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY 1.0::DOUBLE / (turn + 1) DESC, id) AS k FROM c WHERE NOT unknown AND NOT bad AND NOT wild),
walk AS (SELECT request_id, k, id, tokens <= 100 AS taken, CASE WHEN tokens <= 100 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 100 AND role = 'user' THEN 1 ELSE 0 END AS users, false AS limited FROM r WHERE k = 1
  UNION ALL SELECT r.request_id, r.k, r.id, NOT (role = 'user' AND users >= 1) AND used + tokens <= 100, used + CASE WHEN NOT (role = 'user' AND users >= 1) AND used + tokens <= 100 THEN tokens ELSE 0 END,
    users + CASE WHEN role = 'user' AND users < 1 AND used + tokens <= 100 THEN 1 ELSE 0 END, role = 'user' AND users >= 1 FROM walk w JOIN r ON r.request_id = w.request_id AND r.k = w.k + 1)
SELECT c.request_id, CASE WHEN unknown THEN 'EXCLUDED_UNKNOWN_REQUEST' WHEN bad THEN 'EXCLUDED_INVALID_REQUEST' WHEN wild THEN 'EXCLUDED_INVALID' WHEN limited THEN 'EXCLUDED_CATEGORY_LIMIT' WHEN taken THEN 'INCLUDED' ELSE 'EXCLUDED_BUDGET' END AS reason,
  count(*) AS n, sum(tokens)::BIGINT AS tokens FROM c LEFT JOIN walk w ON w.request_id = c.request_id AND w.id = c.id GROUP BY 1, 2""",
    "results_of_all": "SELECT o_orderkey AS request_id, 100::BIGINT AS available_tokens, 0::BIGINT AS n_candidates, 0::BIGINT AS compiled_tokens, 100::BIGINT AS unused_tokens, 0.0::DOUBLE AS utilisation FROM orders WHERE o_orderkey <= 300 AND o_orderkey % 7 <> 3",
    "baseline_full": f"WITH {_CANDIDATES} SELECT request_id, sum(tokens)::BIGINT AS tokens, count(*) AS blocks FROM scored GROUP BY 1",
    "baseline_truncate": f"WITH {_CANDIDATES} SELECT request_id, id, kept::BIGINT AS kept_tokens FROM (SELECT request_id, id, least(tokens, greatest(0, {BUDGET} - (sum(tokens) OVER (PARTITION BY request_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - tokens))) AS kept FROM scored) WHERE kept > 0",
    "baseline_topk": _PREFIX.replace("@order", "score DESC, id"),
    "baseline_recent": f"SELECT conv_id, turn FROM (SELECT conv_id, turn, sum({_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn DESC, turn::VARCHAR ROWS UNBOUNDED PRECEDING) AS running FROM conversations) WHERE running <= 100",
    "baseline_required_topk": _PREFIX.replace("@order", "required DESC, score DESC, id"),
    "metrics_report": _USAGE + ", r AS (SELECT (candidate_tokens - compiled_tokens) / candidate_tokens::DOUBLE AS x FROM usage) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90, round(min(x), 6) AS least, round(max(x), 6) AS greatest FROM r",
    "recall_report": _ALLOCATED + """, t AS (SELECT d.*, CASE WHEN q.quality = 1 THEN 'relevant' WHEN q.doc_id IS NOT NULL THEN 'irrelevant' END AS label FROM decided d LEFT JOIN q USING (doc_id))
SELECT request_id, 1.0::DOUBLE AS required_recall, round(coalesce(count(*) FILTER (label = 'relevant' AND reason = 'INCLUDED') / nullif(count(*) FILTER (label = 'relevant'), 0)::DOUBLE, 1), 6) AS relevant_recall,
round(coalesce(count(*) FILTER (label = 'irrelevant' AND reason <> 'INCLUDED') / nullif(count(*) FILTER (label = 'irrelevant'), 0)::DOUBLE, 1), 6) AS irrelevant_exclusion, round(count(*) FILTER (reason = 'EXCLUDED_DUPLICATE') / count(*)::DOUBLE, 6) AS duplicate_share FROM t GROUP BY 1""",
    "retrieval_metrics": """WITH k AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1)
SELECT query_id, round(count(*) FILTER (rank <= 5) / count(*)::DOUBLE, 6) AS recall_at_5, round(count(*) FILTER (rank <= 10) / count(*)::DOUBLE, 6) AS recall_at_10, round(1.0::DOUBLE / min(rank), 6) AS reciprocal_rank FROM k JOIN g USING (id) GROUP BY 1""",
}
