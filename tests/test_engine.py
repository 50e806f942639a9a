"""Validation, identities, sources, selection, streaming, and the direction of imports."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from blockwise.functions import identity, validate
from blockwise.functions.text import json_string, json_text, utf16_length
from blockwise.operators import select
from blockwise.operators.select import Policy
from blockwise.operators.tokenizers import CodePoints, Words
from blockwise.plans import baselines, metrics
from blockwise.plans.compile import compile_requests, reconciled
from blockwise.sources import ingest

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_the_training_data_subpackage():
    for path in ROOT.glob("blockwise/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import) .*\bllm\b", path.read_text()), path


def test_layers():
    allowed = {"functions": {"functions"}, "operators": {"functions", "operators"}, "sources": {"functions", "sources"}, "streaming": {"functions", "operators", "sources"}, "plans": {"functions", "operators", "sources", "plans"}}
    for layer, may in allowed.items():
        for path in (ROOT / "blockwise" / layer).glob("*.py"):
            assert set(re.findall(r"from \.\.(\w+)", path.read_text())) <= may, path


@pytest.mark.parametrize(
    "text,good",
    [("2026-01-31T09:15:00.000Z", True), ("2024-02-29T23:59:59Z", True), ("2026-01-01T00:00:00.123456789Z", True), ("2026-02-29T00:00:00Z", False), ("2026-02-31T00:00:00Z", False), ("2026-04-31T00:00:00Z", False), ("2026-13-01T00:00:00Z", False), ("2026-01-01T24:00:00Z", False),
     ("2026-01-01T00:60:00Z", False), ("2026-01-01T00:00:60Z", False), ("2026-01-01T00:00:00", False), ("2026-01-01T00:00:00+00:00", False), ("2026-01-01", False), ("0050-01-01T00:00:00Z", False), ("2026-01-01T00:00:00.1234567890Z", False), ("2026-01-01T00:00:00Z\n", False)],
)
def test_instants(spark, text, good):
    assert spark.createDataFrame([(text,)], "t string").select(F.coalesce(validate.is_instant("t"), F.lit(False))).first()[0] is good


def test_json_strings_and_lengths(spark):
    texts = ['plain"\\', "\x00\x1f\x0b\x0f\b\f\n\r\t", "é😀 \x7f", "\\u000B", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string("t").alias("j"), utf16_length("t").alias("n")).collect()
    assert [(r.j, r.n) for r in rows] == [(json_text(t), len(t.encode("utf-16-le")) / 2) for t in texts]


def test_rules_of_records(spark):
    blank = spark.createDataFrame([(" \t﻿　",), ("x",), (None,), ("\x85",)], "id string")
    assert [r[0] is None for r in blank.select(validate.filled("id")).collect()] == [False, True, False, True]
    kinds = "kind string, startOffset long, endOffset long, startLine int, endLine int, messageId string, messageIndex long"
    rows = [("text-range", 0, 5, 1, 1, None, None), ("text-range", 5, 4, None, None, None, None), ("text-range", 0, 1, 0, 1, None, None), ("text-range", 0, 1, None, None, "m", None), ("conversation-message", None, None, None, None, "m", 0),
            ("conversation-message", None, None, None, None, " ", None), ("conversation-message", 1, None, None, None, "m", None), ("other", None, None, None, None, None, None), ("text-range", -1, 1, None, None, None, None)]
    got = validate.checked(spark.createDataFrame(rows, kinds), validate.location_rules()).collect()
    assert [len(r.issues) == 0 for r in got] == [True, False, False, False, True, False, False, False, False]
    budgets = [(1000, 200, None, None, None), (1000, 1000, None, None, None), (1000, 900, 101, None, None), (None, 1, None, None, None), (2**53, 1, None, None, None), (10, -1, None, None, None)]
    names = "totalTokens long, reservedOutputTokens long, reservedSystemTokens long, reservedToolTokens long, reservedProtocolTokens long"
    assert [len(r.issues) == 0 for r in validate.checked(spark.createDataFrame(budgets, names), validate.budget_rules()).collect()] == [True, True, False, False, False, False]
    keys = spark.createDataFrame([('{"a":1}',), ('{"a":1,"z":2}',)], "j string").select(validate.only_keys("j", ("a",)).alias("i")).collect()
    assert keys[0].i is None and keys[1].i.path == ["z"]
    assert validate.pointer(["a", "b", 0, "c"]) == "a.b[0].c"
    with pytest.raises(Exception, match="must not be empty"):
        validate.require(blank, [validate.filled("id")]).collect()


def test_unknown_fields_and_surrogates():
    with pytest.raises(validate.IngestionError):
        ingest.from_rows(None, [{"content": "x", "overlap": 1}])
    with pytest.raises(validate.IngestionError) as error:
        ingest.from_rows(None, [{"namespace": "\ud800", "key": "k", "content": "a\udc00"}])
    assert [i.pointer for i in error.value.issues] == ["identity.namespace", "content"]


def test_files_and_vaults(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/Note one.md").write_bytes("# T\r\nSee [[Other|x]] and #tag/a.".encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.txt").write_text("no")
    rows, bad = ingest.read_files(spark, str(tmp_path), "t", "w", "files")
    assert [r.content for r in rows.collect()] == ["# T\r\nSee [[Other|x]] and #tag/a."] and bad.count() == 1
    note = ingest.vault(spark, str(tmp_path), "t", "w", "v1").first()
    assert note.title == "Note one" and note.metadata == '{"vaultId":"v1","path":"sub/Note%20one.md","tags":["tag/a"],"links":["Other"]}'.replace("%20", "%20" if "%20" in note.key else " ")
    good, rejected = ingest.ingest_checked(rows)
    assert good.first().contentHash == identity.digest_text("# T\r\nSee [[Other|x]] and #tag/a.") and rejected.count() == 0
    store = ingest.ParquetStore(spark, str(tmp_path / "store"))
    store.save(good)
    assert store.get("t", "id", good.first().id).count() == 1 and store.get("other", "id", good.first().id).count() == 0


CANDIDATE = "request_id string, id string, tenantId string, workspaceId string, projectId string, sourceDocumentId string, content string, normalizedContentHash string, tokenCount long, required boolean, priority long, category string, relevance double, updatedAt string"
REQUEST = "request_id string, tenantId string, workspaceId string, projectId string, totalTokens long, reservedOutputTokens long, reservedSystemTokens long, reservedToolTokens long, reservedProtocolTokens long"


def candidate(id, tokens, required=False, priority=0, category="a", relevance=0.0, request="r", tenant="t", content=None, updated=None):
    content = content or id
    return (request, id, tenant, "w", None, f"s{id}", content, content, tokens, required, priority, category, relevance, updated)


def run(spark, rows, total=10, policy=Policy(), tokenizer=None):
    requests = spark.createDataFrame([("r", "t", "w", None, total, 0, None, None, None), ("bad", " ", "w", None, 5, 9, None, None, None)], REQUEST)
    return compile_requests(requests, spark.createDataFrame(rows, CANDIDATE), policy, tokenizer)


def test_greedy_skips_what_does_not_fit(spark):
    rows = [candidate("a", 5, relevance=0.9), candidate("b", 3, relevance=0.8), candidate("c", 9, relevance=0.7), candidate("d", 2, relevance=0.6), candidate("e", 1, tenant="x"), candidate("f", 1, content="a", priority=-0), candidate("g", 1, priority=9)]
    done = run(spark, rows)
    assert {r.id: r.reason for r in done.decisions.collect()} == {"a": "INCLUDED", "b": "INCLUDED", "c": "EXCLUDED_BUDGET", "d": "INCLUDED", "e": "EXCLUDED_SCOPE_MISMATCH", "f": "EXCLUDED_DUPLICATE", "g": "EXCLUDED_INVALID"}
    r = done.results.first()
    assert (r.compiled_tokens, r.unused_tokens, r.n_included, r.error) == (10, 0, 3, None) and r.context.count("<block") == 3
    assert [x.reconciles for x in reconciled(done).collect()] == [True] and [len(x.issues) for x in done.rejected.collect()] == [2]
    again = run(spark, rows[::-1])
    assert metrics.same(done.decisions.drop("content"), again.decisions.drop("content")) and again.results.first().fingerprint == r.fingerprint


def test_required_come_first_or_fail(spark):
    done = run(spark, [candidate("a", 8, required=True), candidate("b", 5, relevance=1.0), candidate("c", 2)])
    assert {r.id: r.reason for r in done.decisions.collect()} == {"a": "INCLUDED", "b": "EXCLUDED_BUDGET", "c": "INCLUDED"}
    failed = run(spark, [candidate("a", 8, required=True), candidate("b", 5, required=True)])
    assert failed.results.first().error == "REQUIRED_CONTENT_EXCEEDS_BUDGET" and failed.results.first().compiled_tokens == 0


def test_canonical_copies(spark):
    rows = [candidate("c", 1, content="x", priority=3), candidate("b", 1, content="x", required=True), candidate("a", 1, content="x", priority=4), candidate("e", 1, content="y", updated="2025-01-01T00:00:00Z"), candidate("d", 1, content="y", updated="2024-01-01T00:00:00Z")]
    done = run(spark, rows)
    assert {r.id: r.canonical_id for r in done.decisions.collect()} == {"a": "b", "b": "b", "c": "b", "d": "e", "e": "e"}
    groups = select.duplicate_groups(done.decisions).collect()
    assert {g.canonical_id: [d.id for d in g.duplicates] for g in groups} == {"b": ["a", "c"], "e": ["d"]}


def test_categories(spark):
    rows = [candidate(x, 2, category=c, relevance=r) for x, c, r in (("a", "p", 0.9), ("b", "p", 0.8), ("c", "p", 0.7), ("d", "q", 0.1), ("e", "no", 1.0))]
    done = run(spark, rows, total=6, policy=Policy(category_max={"p": 2}, category_min={"q": 1}, excluded_categories=("no",)))
    assert {r.id: r.reason for r in done.decisions.collect()} == {"a": "INCLUDED", "b": "INCLUDED", "c": "EXCLUDED_CATEGORY_LIMIT", "d": "INCLUDED", "e": "EXCLUDED_POLICY"}


def test_recount_and_eviction(spark):
    done = run(spark, [candidate("a", 1, content="x" * 30, relevance=0.9), candidate("b", 1, content="y" * 30, relevance=0.5)], total=100, tokenizer=CodePoints())
    assert {r.id: (r.reason, r.tokenCount) for r in done.decisions.collect()} == {"a": ("INCLUDED", 30), "b": ("EXCLUDED_RENDER_OVERFLOW", 30)}
    assert len(done.results.first().context) <= 100 and done.results.first().compiled_tokens == 30


def test_required_blocks_never_leave(spark):
    """Two required blocks of three words fit by their counts, but not rendered: the request fails, and says so."""
    rows = [candidate(x, 3, required=True, content=f"{x} two three") for x in ("a", "b")]
    done = run(spark, [*rows, candidate("c", 1)], total=8, tokenizer=Words())
    assert {r.id: r.reason for r in done.decisions.collect()} == {"a": "REQUIRED_CONTENT_EXCEEDS_BUDGET", "b": "REQUIRED_CONTENT_EXCEEDS_BUDGET", "c": "EXCLUDED_RENDER_OVERFLOW"}
    r = done.results.first()
    assert (r.error, r.compiled_tokens, r.context, r.rendered_tokens) == ("REQUIRED_CONTENT_EXCEEDS_BUDGET", 0, None, 0)
    done = run(spark, [*rows, candidate("c", 1)], total=18, tokenizer=Words())
    r = done.results.first()
    assert r.error is None and r.rendered_tokens == Words().count(r.context) <= 18 and (r.n_included, r.overhead_tokens, r.unused_tokens) == (2, r.rendered_tokens - 6, 18 - r.rendered_tokens)


def test_every_candidate_and_request_is_answered(spark):
    rows = [candidate("a", 1, request="r"), candidate("b", 1, request="bad"), candidate("c", 1, request="nowhere"), candidate("d", 1, relevance=7.5), candidate("e", 1, relevance=float("nan")), (*candidate("f", 1)[:5], None, *candidate("f", 1)[6:])]
    done = run(spark, rows)
    assert {r.id: r.reason for r in done.decisions.collect()} == {"a": "INCLUDED", "b": "EXCLUDED_INVALID_REQUEST", "c": "EXCLUDED_UNKNOWN_REQUEST", "d": "EXCLUDED_INVALID", "e": "EXCLUDED_INVALID", "f": "EXCLUDED_INVALID"}
    empty = run(spark, [candidate("a", 1, request="nowhere")]).results.collect()
    assert [(r.request_id, r.n_candidates, r.compiled_tokens, r.unused_tokens, r.context) for r in empty] == [("r", 0, 0, 10, None)]


def test_labels_are_escaped(spark):
    row = [candidate('i"<&>', 1)]
    assert '<block id="i&quot;&lt;&amp;&gt;"' in run(spark, row).results.first().context


def test_baselines_and_metrics(spark):
    rows = spark.createDataFrame([("r", "a", 4, 0.9, True, 10, 1), ("r", "b", 7, 0.8, False, 10, 2), ("r", "c", 2, 0.7, False, 10, 3)], "request_id string, id string, tokenCount long, score double, required boolean, available long, turn long")
    assert [(r.id, r.kept_tokens) for r in baselines.truncation(rows, [F.col("id")]).orderBy("id").collect()] == [("a", 4), ("b", 6)]
    assert [r.id for r in baselines.top_k(rows).collect()] == ["a"] and sorted(r.id for r in baselines.recent_only(rows).collect()) == ["b", "c"]
    assert [r.id for r in baselines.required_top_k(rows).collect()] == ["a"] and baselines.full_context(rows).first().tokens == 13
    required = spark.createDataFrame([("r", "f1", "a", "critical"), ("r", "f1", "z", "critical"), ("r", "f2", "z", "supporting")], "request_id string, fact_id string, block_id string, importance string")
    f = metrics.facts(rows, required).first()
    assert (f.fact_coverage, f.weighted_fact_coverage, f.critical_fact_coverage) == (0.5, 0.75, 1.0)
    ranked = spark.createDataFrame([("q", "x", 2), ("q", "y", 7)], "query_id string, id string, rank int")
    r = metrics.retrieval(ranked, spark.createDataFrame([("q", "x"), ("q", "y"), ("q", "z")], "query_id string, id string")).first()
    assert (round(r.recall_at_5, 3), round(r.recall_at_10, 3), r.reciprocal_rank) == (0.333, 0.667, 0.5)
    tags = metrics.by_tag(spark.createDataFrame([(1.0, ["a", "b"]), (3.0, ["a"])], "m double, tags array<string>"), "m").collect()
    assert {t.tag: (t.mean, t.n) for t in tags} == {"a": (2.0, 2), "b": (1.0, 1), None: (5 / 3, 3)}
    assert metrics.latency(spark.range(1, 101).select(F.col("id").cast("double").alias("ms"))).first().p95 == 95.05


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    metrics.write_report(str(tmp_path), {"seed": 1}, metrics.summary(rows, "x"), rows, rows.limit(0))
    assert {p.name for p in tmp_path.iterdir()} == {"cases.jsonl", "failures.json", "aggregate.json", "run-manifest.json", "report.md"}


def test_stream_equals_batch(spark, tmp_path):
    from blockwise.operators.chunk import chunk
    from blockwise.streaming.chunk_stream import chunk_stream

    options = validate.ChunkOptions(4, 8)
    rows = ingest.from_rows(spark, [dict(tenantId="t", workspaceId="w", sourceType="markdown", namespace="n", key=str(i), content=f"# H{i}\nSome words. More words here. And more of them, still.", metadata="{}") for i in range(6)])
    rows.limit(3).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        chunk_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", Words(), options).awaitTermination()
        rows.where("key >= 3").write.mode("append").parquet(f"{tmp_path}/in") if _ == 0 else None
    got, want = spark.read.parquet(f"{tmp_path}/out"), chunk(ingest.ingest(rows), Words(), options)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_providers(spark):
    import math

    from blockwise.sources.providers import FakeModel, Lexical, Static

    rows = [("a", "t", "w", None, "red fox runs"), ("b", "t", "w", None, "red red house, far from here"), ("c", "x", "w", None, "fox"), ("d", "t", "w", "p", "fox")]
    blocks = spark.createDataFrame(rows, "id string, tenantId string, workspaceId string, projectId string, content string")
    requests = spark.createDataFrame([("r", "t", "w", None, "Fox, RED!")], "request_id string, tenantId string, workspaceId string, projectId string, query string")
    assert sorted(r.id for r in Static(blocks).candidates(requests).collect()) == ["a", "b"]
    mean, idf = 11 / 4, lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, n, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    got = {r.id: r.score for r in Lexical(blocks).scores(requests).collect()}
    assert got == pytest.approx({"a": part(1, 3, 2) + part(1, 3, 3), "b": part(2, 6, 2)})
    best = Lexical(blocks, most=1).candidates(requests).collect()
    assert [(r.id, r.relevance, r.providerId) for r in best] == [("a", 1.0, "lexical-bm25")]
    assert FakeModel(lambda q, c: f"{q}:{len(c)}").answer("q", "abc") == "q:3"


def test_command_line(spark, tmp_path, capsys):
    from blockwise.__main__ import main

    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("# T\nBody text.")
    assert main(["inspect-blocks", str(tmp_path / "notes"), str(tmp_path / "blocks")], spark) == 0
    assert spark.read.json(str(tmp_path / "blocks")).first().content == "Body text."
    spark.createDataFrame([("r", "t", "w", None, 10, 0, None, None, None)], REQUEST).write.parquet(f"{tmp_path}/req")
    spark.createDataFrame([candidate("a", 5), candidate("b", 6)], CANDIDATE).write.parquet(f"{tmp_path}/cand")
    assert main(["compile", f"{tmp_path}/req", f"{tmp_path}/cand", f"{tmp_path}/out"], spark) == 0
    assert main(["trace", f"{tmp_path}/out", "r"], spark) == 0 and "EXCLUDED_BUDGET" in capsys.readouterr().out
    assert main(["eval", f"{tmp_path}/out"], spark) == 0 and "median" in capsys.readouterr().out
