"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from blockwise.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, NODE string, n long"


def brute(rows, n, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, *_), s) in enumerate(zip(rows, sets, strict=True))]


def texts(seed, groups=25, copies=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(groups):
        size = rng.choice([3, 4, 5, 6, 9, 10, 11, 14, 20, 35, 80, 200])
        base = rng.choices(vocabulary, k=size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 40 + 1])):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            if rng.random() < 0.2:
                own = passage + own
            if rng.random() < 0.2:
                own = own[: max(1, len(own) - rng.randint(1, 3))]
            out.append("  ".join(own) if rng.random() < 0.5 else " ".join(own).upper())
    return out


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (4, 85, 2), (5, 80, 3)])
def test_components_equal_brute_force(spark, n, percent, seed):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(seed))]
    rows += [(9000, None, "x", 1), (9001, "", "x", 1), (9002, " \t\n", "x", 1), (9003, "one", "x", 1), (9004, "ONE", "x", 1), (None, rows[0][1], "x", 1), (None, "alone here", "x", 1), (5, rows[5][1], "x", 1), (9005, "é É", "x", 1)]
    random.Random(0).shuffle(rows)
    got = jj.link_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), n, percent)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(brute(rows, n, percent), key=key)


def test_signatures_meet_for_every_linking_pair():
    """The pigeonhole argument itself, over sets at the very threshold."""
    rng = np.random.default_rng(4)
    plan = jj.Schemes(85)
    for size in [*range(1, 60), 75, 100, 150, 333, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop = int(rng.integers(0, size + 1))
            while drop and 100 * (size - drop) < 85 * size:
                drop -= 1
            b = rng.permutation(a)[: len(a) - drop]
            extra = 0
            while 100 * (len(b)) >= 85 * (size + extra + 1) and rng.random() < 0.9:
                extra += 1
            b = np.unique(np.concatenate([b, rng.integers(0, 2**64, extra, dtype=np.uint64)]))
            i = len(np.intersect1d(a, b))
            if len(b) and 100 * i >= 85 * (len(a) + len(b) - i) and jj.name_of(a) != jj.name_of(b):
                assert len(np.intersect1d(plan.signatures(a), plan.signatures(b))), size


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(4, base, "x", 1), (2, base + " end", "x", 2), (7, base, "x", 3), (2, base + " end", "x", 2), (9, None, "x", 4), (10, "", "x", 5), (11, "quite other words stand in here", "x", 6)]
    got = jj.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "NODE", "n"] and sorted(r.doc_id for r in got.collect()) == [2, 9, 10, 11]
    assert jj.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one_of_null_and_shared_doc_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(None, a, "x", 1), (None, a + " end", "x", 2), (1, b, "x", 3), (1, c, "x", 4), (2, b + " end", "x", 5), (3, c + " end", "x", 6), (None, d, "x", 7), (9, d, "x", 8)]
    got = jj.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "a"), (1, "b"), (1, "c"), (9, "d")]


def test_hot_groups_stay_whole(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"own{i}"]), "x", 1) for i in range(400)] + [(1000 + i, "copied words " * 10, "x", 1) for i in range(400)]
    got = jj.link_documents(spark.createDataFrame(rows, SCHEMA))
    assert {r.component_id for r in got.collect()} == {0, 1000}


def test_least_difference_bounds_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 40, 300, 700, 3000, 9000):
        own = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for share in (0, 0.3, 0.8, 0.95, 1):
            other = np.unique(np.concatenate([own[: int(share * len(own))], rng.integers(0, 2**64, size // 5, dtype=np.uint64)]))
            if len(other):
                apart = len(np.setxor1d(own, other))
                for x, y in ((own, other), (other, own)):
                    assert jj.least_difference(jj.sketch(x), jj.sketch(y)) <= apart
                if share < 0.5 and size >= 300:
                    assert jj.least_difference(jj.sketch(own), jj.sketch(other)) > jj.difference(len(own), len(other), 80)


def test_sets_of_unlike_texts_are_not_written(spark, monkeypatch):
    """Long texts with a passage in common meet by small segments; their sets are left where sketches rule a link out."""
    rng, rows = random.Random(4), {}
    monkeypatch.setattr(jj, "stored", lambda df, name, own=jj.stored: rows.setdefault(name, []).append(out := own(df, name)) or rows.setdefault(f"n {name}", []).append(out.count()) or out)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(1500))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(1300)) for _ in range(30)]
    texts.append(texts[0] + " and a few more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in jj.keep_one(docs).collect()}
    assert got == set(range(30)) and rows["n candidate-sets"][0] > 10 and sum(rows["n shingle-elements"]) == 2
