"""Decontamination against a plain edit-distance search."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from blockwise.llm import decontamination as dc

WORDS = ["alpha", "river", "stone", "winter", "lantern", "quiet", "harbour", "meadow", "copper", "violet", "thunder", "glass", "orchard", "paper", "signal"]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def sellers(pattern: str, text: str) -> int:
    """Least edits of pattern against any part of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


@pytest.mark.parametrize("sizes", [None, (64, 50, 3)])
def test_scan_equals_plain_search(monkeypatch, sizes):
    if sizes:  # runs end within windows and regions
        for name, size in zip(("PIECE", "HITS", "ALIGNED"), sizes, strict=True):
            monkeypatch.setattr(dc, name, size)
    rng = random.Random(7)
    items = [(i, passage(rng, rng.randint(10, 30))) for i in range(12)]
    index = dc.Index.of(items)
    texts = []
    for _ in range(60):
        body = passage(rng, rng.randint(0, 20))
        if rng.random() < 0.7:
            own = rng.choice(items)[1]
            a = rng.randrange(max(1, len(own) - 150))
            body += " " + edited(rng, own[a : a + rng.choice([60, 110, 160, 400])], rng.choice([0, 0, 1, 3, 5, 7, 9])) + " " + passage(rng, 8)
        texts.append(body)
    got = {(r, w) for r, w, *_ in dc.scan(index, pa.array(texts))}
    want = {(r, k) for r, t in enumerate(texts) for k, w in enumerate(index.windows) if sellers(w.decode(), t) <= dc.budget(len(w))}
    assert got == want and want


def test_text_that_repeats_itself_equals_plain_search(monkeypatch):
    monkeypatch.setattr(dc, "HITS", 300)
    rng = random.Random(3)
    units = ["a", "ab", "abc ", "river stone ", "one two three four five "]
    index = dc.Index.of([(i, (u * 300)[: rng.choice([60, 100, 260])]) for i, u in enumerate(units)])
    texts = [edited(rng, (rng.choice(units) * 200)[: rng.choice([40, 90, 110, 300])], rng.choice([0, 2, 5, 9, 20])) for _ in range(40)]
    got = {(r, w) for r, w, *_ in dc.scan(index, pa.array(texts))}
    want = {(r, k) for r, t in enumerate(texts) for k, w in enumerate(index.windows) if sellers(w.decode(), t) <= dc.budget(len(w))}
    assert got == want and want


def test_memory_of_a_long_text_that_repeats_itself():
    index = dc.Index.of([(1, "x" * 5000), (2, "x" * 700), (3, "word " * 400)])
    assert len(index.windows) < 10 and [i for i in index.items if 1 in i] == [[1] * 99 + [2] * 13]
    text = "x" * 60_000 + " clean " + "word " * 15_000
    tracemalloc.start()
    got = dc.scan(index, pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {i for _, w, *_ in got for i in index.items[w]} == {1, 2, 3} and peak < 150 << 20


def test_folding_places_and_cases(spark):
    rng = random.Random(1)
    item = passage(rng, 20)
    rows = [(1, "Before. " + item.upper().replace(" ", ",\n\n") + "! after", 1), (2, passage(rng, 200), 1), (3, None, 1), (4, "", 1), (None, item, 1), (6, item, 1), (6, item, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(5, item), (6, "short"), (7, None), (8, "")], "item_id long, text string")
    got = dc.find(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 5), (1, 5), (6, 5), (6, 5)]
    hit = next(r for r in got if r.doc_id == 1)
    assert rows[0][1].encode()[hit.start_byte : hit.end_byte].decode() == item.upper().replace(" ", ",\n\n")
    assert sorted(r.doc_id for r in dc.remove(docs, bench).collect()) == [2, 3, 4]
    assert dc.remove(docs, bench).columns == docs.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(docs, none).collect() == [] and dc.remove(docs, none).count() == len(rows)
    assert dc.find(docs.limit(0), bench).collect() == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    rng = random.Random(2)
    items = [(i, passage(rng, 15)) for i in range(6)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in items] + [(99, passage(rng, 90))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.find(docs, bench).collect()) == [(i, i) for i, _ in items]
    assert [r.doc_id for r in dc.remove(docs, bench).collect()] == [99]
