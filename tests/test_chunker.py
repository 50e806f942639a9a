"""The chunker: structure, splitting, properties, golden identities and partition invariance."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockwise.functions.text import Utf16, is_blank, lone_surrogate
from blockwise.functions.validate import ChunkingError, ChunkingInputError, ChunkOptions, TokenizerError, check_tokenizer
from blockwise.operators.chunk import chunk, chunk_checked
from blockwise.operators.chunker import chunk as plain
from blockwise.operators.tokenizers import BytePair, CodePoints, Table, Words
from blockwise.sources.ingest import from_rows, ingest

WIDE = ChunkOptions(400, 4000)


class Slow:
    """The same counts without the additive path."""

    def __init__(self, inner):
        self.inner, self.id, self.version = inner, inner.id, inner.version

    def count(self, text):
        return self.inner.count(text)


class Scripted:
    id, version = "test:scripted", "1"

    def __init__(self, known, other):
        self.known, self.other = known, other

    def count(self, text):
        return self.known.get(text, self.other)


def found(text, options=WIDE, title=None, tokenizer=None):
    return [(text[c.start : c.end], c.headings) for c in plain(text, title, tokenizer or CodePoints(), options)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        (" \n\t\n", []),
        ("---\na: b\n---\n", []),
        ("---\na: b\nText", [("---\na: b\nText", ())]),
        ("﻿---\r\na: b\r\n---\r\nBody.\r\n", [("Body.", ())]),
        ("# One\nA.\n\n## Two\nB.\n\n### Three\nC.", [("A.", ("One",)), ("B.", ("One", "Two")), ("C.", ("One", "Two", "Three"))]),
        ("# One\nA.\n\n#### Four\nB.\n# Next\nC.", [("A.", ("One",)), ("B.", ("One", "Four")), ("C.", ("Next",))]),
        ("#   Spaced   Title   #\nBody.", [("Body.", ("Spaced Title",))]),
        ("#NotAHeading", [("#NotAHeading", ())]),
        ("####### seven", [("####### seven", ())]),
        ("Title\n=====\nText", [("Title\n=====\nText", ())]),
        ("#\nBody.", [("Body.", ())]),
        ("# #\nBody.", [("Body.", ("#",))]),
        ("# T\n```\n# Not a heading\n```\nafter", [("```\n# Not a heading\n```\nafter", ("T",))]),
        ("~~~\nopen\n\n# inside", [("~~~\nopen\n\n# inside", ())]),
        ("```a`b\ntext", [("```a`b\ntext", ())]),
        ("- a\n\n- b\n  - c\n\ntext", [("- a\n\n- b\n  - c\n\ntext", ())]),
        ("- item\n # Next\nbody", [("- item", ()), ("body", ("Next",))]),
        ("- item\n  # Inner\nbody", [("- item\n  # Inner\nbody", ())]),
        ("> quote\n# inside\n\n# Out\nx", [("> quote\n# inside", ()), ("x", ("Out",))]),
        ("<div>\n# inside\n</div>\n\nx", [("<div>\n# inside\n</div>\n\nx", ())]),
        ("﻿# T", [("﻿# T", ())]),
        ("# Title\rBody", [("# Title\rBody", ())]),
        ("# T\u0085x\nBody", [("Body", ("T\u0085x",))]),
        ("    code\n\ntext", [("    code\n\ntext", ())]),
    ],
)
def test_structure(text, want):
    assert found(text) == want


def test_blocks_apart_under_a_small_limit():
    small = ChunkOptions(5, 12)
    assert [t for t, _ in found("para one\n- a | b\n--- | ---\nx | y\nplain\n\n* * *\n\n---", small)] == ["para one", "- a | b\n--- | ---\nx | y", "plain", "* * *", "---"]
    assert [t for t, _ in found("1. a\n\n- b", small)] == ["1. a", "- b"] and [t for t, _ in found("- a\n\n    indented\n", ChunkOptions(3, 3))][0] == "- a"


def test_titles_and_lines():
    text = "Lead.\n\n# H\nBody\nmore."
    one, two = plain(text, "  My Title ", CodePoints(), WIDE)
    assert one.headings == ("  My Title ",) and two.headings == ("H",) and (two.first_line, two.last_line) == (4, 5)
    assert plain("x", " ﻿", CodePoints(), WIDE)[0].headings == ()


def test_counts_that_fall_as_text_grows():
    text = "aaa. bbb. ccc. ddd."
    known = {text: 19, "aaa.": 7, "aaa. bbb.": 6, "aaa. bbb. ccc.": 9, "ccc. ddd.": 5}
    assert [t for t, _ in found(text, ChunkOptions(6, 6), tokenizer=Scripted(known, 99))] == ["aaa. bbb.", "ccc. ddd."]
    known = {"alpha": 9, "alpha beta": 9, "alpha beta gamma": 4, "delta": 1}
    assert [t for t, _ in found("alpha beta gamma delta", ChunkOptions(4, 4), tokenizer=Scripted(known, 99))] == ["alpha beta gamma", "delta"]
    assert [t for t, _ in found("abcdef", ChunkOptions(3, 3), tokenizer=Scripted({"abcd": 3, "ef": 2}, 9))] == ["abcd", "ef"]


PARTS = ["# One", "## Two deep", "Some sentence here. Another one! A third? “Quoted.” End", "- a\n- b\n  - c", "1. x\n2. y", "> quote\n> more", "```py\ncode # x\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |", "<div>\nx\n</div>", "word " * 40, "😀😀😀 emoji. 漢字。 mixed é", "   ", " ﻿", "a\tb", "~~~\nopen"]


def made(seed):
    rng = random.Random(seed)
    text = "\n\n".join(rng.choice(PARTS) for _ in range(18))
    text = ("---\nk: v\n---\n" if seed % 3 == 0 else "") + text
    return text.replace("\n", "\r\n") if seed % 5 == 0 else text


@pytest.mark.parametrize("options", [(1, 1), (4, 8), (20, 30), (100, 250), (5000, 5000)])
def test_properties_of_made_documents(options):
    options = ChunkOptions(*options)
    for seed in range(30):
        text = made(seed)
        for tokenizer in (CodePoints(), Words()):
            got = plain(text, "T", tokenizer, options)
            assert got == plain(text, "T", Slow(tokenizer), options)
            end = 0
            for c in got:
                piece = text[c.start : c.end]
                assert c.start >= end and not is_blank(piece) and c.tokens == tokenizer.count(piece)
                end = c.end


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n#-`>|<\r\t😀é1 ", max_size=200), st.sampled_from([(1, 1), (3, 7), (10, 20)]))
def test_properties_of_any_text(text, options):
    options = ChunkOptions(*options)
    got = plain(text, None, Words(), options)
    assert got == plain(text, None, Slow(Words()), options)
    assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("bad", [(0, 1), (1, 0), (-1, 5), (5, 4), (1.5, 2), ("1", 2), (True, 2), (1, 2**53), (None, 1), (float("nan"), 2)])
def test_bad_options(bad):
    with pytest.raises(ChunkingInputError):
        ChunkOptions(*bad)


def test_bad_tokenizers():
    with pytest.raises(ChunkingInputError):
        check_tokenizer(Scripted.__new__(type("X", (), {"id": " ", "version": "1"})))
    for value in (1.5, -1, float("nan"), None, True):
        with pytest.raises(ChunkingError) as error:
            plain("text", None, Scripted({}, value), WIDE)
        assert error.value.code == "MARKDOWN_CHUNKING_TOKENIZER_FAILED" and error.value.span == (0, 4)
    with pytest.raises(TokenizerError):
        BytePair().count("needs ranks that this machine hasn't")
    with pytest.raises(TokenizerError):
        BytePair().count("\ud800")
    with pytest.raises(TokenizerError):
        Table([("a", 1), ("a", 2)])
    with pytest.raises(TokenizerError):
        Table([]).count("x")


def test_surrogates_and_offsets():
    assert [lone_surrogate(t) for t in ("ok😀", "a\ud800b", "\udc00", "😀\udfff", "😀", "\ud800")] == [None, 1, 0, 2, None, 0]
    utf16 = Utf16("a😀b😀")
    assert [utf16(k) for k in range(5)] == [0, 1, 3, 4, 6]


SOURCE = dict(tenantId="local", workspaceId="default", sourceType="markdown", namespace="vault:notes", key="note.md", metadata="{}")


def named(kind, *parts):
    """An identity by the standard library alone: SHA-256 of a JSON array without spaces."""
    return f"{kind}:sha256:" + hashlib.sha256(json.dumps(list(parts), separators=(",", ":")).encode()).hexdigest()


def test_golden_identities(spark):
    rows = [SOURCE | {"content": "# Alpha\nFirst body.\n\n# Beta\nSecond body.\n"}]
    docs = ingest(from_rows(spark, rows))
    document = named("source-document", "blockwise-source-document", 1, "local", "default", None, "markdown", "vault:notes", "note.md")
    assert docs.first().id == document
    one, two = chunk(docs, CodePoints(), WIDE).orderBy("ordinal").collect()
    assert one.normalizedContentHash == "sha256:ff30085e1616a5a5fde4fb8f215684cf9ff5e19aee7849823aac8d29462a158e"
    assert one.id == named("context-block", "blockwise-context-block", 1, document, ["Alpha"], one.normalizedContentHash, 0)
    assert two.id == named("context-block", "blockwise-context-block", 1, document, ["Beta"], "sha256:" + hashlib.sha256(b"Second body.").hexdigest(), 0)
    docs = ingest(from_rows(spark, [SOURCE | {"content": "Rootless.\n\n# Dup\nSame.\n\n# Dup\nSame.\n"}]))
    plain, same = ("sha256:" + hashlib.sha256(x).hexdigest() for x in (b"Rootless.", b"Same."))
    want = [named("context-block", "blockwise-context-block", 1, document, None, plain, 0), *(named("context-block", "blockwise-context-block", 1, document, ["Dup"], same, k) for k in (0, 1))]
    assert [r.id for r in chunk(docs, CodePoints(), WIDE).orderBy("ordinal").collect()] == want
    docs = ingest(from_rows(spark, [SOURCE | {"content": ""}]))
    assert docs.first().contentHash == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert chunk(docs, CodePoints(), WIDE).collect() == []


def test_partitions_do_not_matter(spark):
    rows = [SOURCE | {"key": f"n{i}.md", "content": made(i), "title": "x\x1fy\"\\" if i % 2 else None} for i in range(12)]
    docs = ingest(from_rows(spark, rows))
    results = {frozenset(map(str, chunk(d, Words(), ChunkOptions(20, 30), p).collect())) for d, p in ((docs, 1), (docs, 4), (docs.repartition(3), 17))}
    assert len(results) == 1
    content = {r.id: r.content for r in docs.collect()}
    for r in chunk(docs, Words(), ChunkOptions(20, 30)).collect():
        assert content[r.sourceDocumentId].encode("utf-16-le")[2 * r.startOffset : 2 * r.endOffset].decode("utf-16-le") == r.content


def test_rejected_sources(spark):
    docs = ingest(from_rows(spark, [SOURCE | {"content": "x"}, SOURCE | {"content": "y", "sourceType": "text"}]))
    from pyspark.sql import functions as F

    good, bad = chunk_checked(docs.withColumn("content", F.when(F.col("sourceType") == "text", "z").otherwise(F.col("content"))), CodePoints(), WIDE)
    assert good.count() == 1 and [[i.code for i in r.issues] for r in bad.collect()] == [["invalid_source_type", "content_hash_mismatch"]]
