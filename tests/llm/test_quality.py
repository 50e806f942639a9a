"""Quality rules against brute force, and the classifier's parts and held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from blockwise.llm import quality_classifier as qc
from blockwise.llm import quality_rules as qr
from blockwise.llm.textnum import Texts

SCHEMA = "doc_id long, text string, lang string, kept string, N_WORDS int"
SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def odd(seed=1, n=200):
    rng = random.Random(seed)
    out = ["", None, " ", "\n", "a", "a\n\na\n a\na", "é ü\x0bx\x0cy\x85z", "x " * 500, "# * | <>&", "\r\nline\r\nline\r\n"]
    for _ in range(n):
        out.append("".join(rng.choice(["a ", "bc ", "é ", "漢", "\n", "d\n", "#", "  ", "\t", "x\ny z\n", "The of and "]) for _ in range(rng.randint(0, 60))))
    return out


def test_statistics_equal_brute_force(spark):
    rows = [(i if i % 50 else None, t, None if i % 7 == 0 else "en", "x", 1) for i, t in enumerate(odd())] + [(3, "same text", "en", "x", 1)] * 2
    got = qr.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = sorted(((i, *plain(t)) for i, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, *[r[s] for s in qr.STATISTICS], r.base_failed) for r in got), key=key) == want
    assert all(not r.kept for r in got if r.base_failed)


def shares(text):
    """Shares of the character classes and of the common words, plainly."""
    kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:?'\"()-]", r"[#*$%&|<>]", r"[!+/=@\[\\\]^_`{}~]", r"[^\x00-\x7F]", r"[\x00-\x08\x0E-\x1F\x7F]"]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    common = [words.count(w) for w in qr.COMMON_WORDS]
    return [len(re.findall(k, text)) for k in kinds], [*common, len(words) - sum(common)]


def distance(p, q):
    p, q = ([x / sum(h) for x in h] for h in (p, q))
    part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt((part(p, q) + part(q, p)) / 2)


def test_distances_equal_brute_force(spark):
    rng = random.Random(9)
    pieces = "the of Der und é 漢 river, stone. WINTER 12 #x a&b (of) la más the\x01 e-mail! new\nline tab\tbed".split(" ")
    texts = [" ".join(rng.choice(pieces) + str(rng.randint(0, 99)) * rng.randint(0, 1) for _ in range(rng.choice([5, 30, 60, 150]))) for _ in range(120)]
    rows = [(i, t, rng.choice(["en", "de", None]), "x", 1) for i, t in enumerate(texts)] + [(900, "XY " * 300, "none", "x", 1), (901, None, "en", "x", 1)]
    sums = {}
    for _, t, lang, *_ in rows:
        if not plain(t)[-1]:
            classes, common = shares(t)
            if classes[5] <= 0.01 * sum(classes) and classes[1] <= 0.25 * sum(classes):
                was = sums.get(lang, ([0] * len(classes), [0] * len(common)))
                sums[lang] = tuple([x + y for x, y in zip(a, b, strict=True)] for a, b in zip(was, (classes, common), strict=True))
    got, judged = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, SCHEMA)).collect()}, 0
    for i, t, lang, *_ in rows:
        own, ref = shares(t or ""), sums.get(lang)
        want = distance(own[0], ref[0]) if ref and len(t or "") >= 200 else None, distance(own[1], ref[1]) if ref and plain(t)[0] >= 40 else None
        for x, y in zip((got[i].class_distance, got[i].word_distance), want, strict=True):
            assert (x is None) == (y is None) and (y is None or abs(x - y) < 1e-9)
            judged += y is not None
        far = (want[0] or 0) > 0.19 or (want[1] or 0) > 0.5
        assert got[i].kept == (not plain(t)[-1] and not far)
    assert judged > 80 and len(sums) > 1


def test_verdicts(spark):
    rng = random.Random(5)
    words = "the of and to in river stone winter meadow lantern harbour quiet copper violet orchard".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(120), "en", "x", 1) for i in range(200)]
    rows += [(1000, prose(120).upper().replace(" ", "!! "), "en", "x", 1), (1001, prose(120).replace(" ", "### "), "en", "x", 1), (1002, prose(12).upper(), "en", "x", 1), (1003, prose(100), "fr", "x", 1), (1004, prose(50), None, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    gone = {r.doc_id for r in qr.judge(docs).collect() if not r.kept}
    assert gone == {1000, 1001}
    left = qr.filter_documents(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, *_ in rows} - gone
    assert qr.judge(docs.limit(0)).collect() == []


def test_isotonic_is_the_best_rising_fit():
    weights, sums = np.array([1.0, 2, 0, 1, 4, 1]), np.array([1.0, 0, 0, 1, 1, 1])
    assert np.allclose(qc.isotonic(weights, sums), [1 / 3, 1 / 3, 1 / 3 + (0.4 - 1 / 3) / 2, 0.4, 0.4, 1])


def test_features_are_finite_for_any_text():
    own = qc.features(Texts(pa.array(odd(), pa.string())))
    assert own.shape == (len(odd()), len(qc.NAMES)) and np.isfinite(own).all()


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, len(qc.NAMES)))
    z = qc.Model.cosines(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(z @ z.T - want).mean() < 0.06


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = qc.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_labels_nulls_and_none(spark):
    docs = spark.createDataFrame([(1, "a text", "x"), (None, None, "x"), (1, "a text", "x")], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in qc.classify(docs, labels).collect()] == [0.5] * 3
    assert qc.classify(docs.limit(0), labels).collect() == []
