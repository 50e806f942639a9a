"""Sanitisation against Python's re and a plain count of the disclosure rule."""

import hashlib
import math
import random
import re
from collections import Counter

from blockwise.llm import queries, sanitise

SCHEMA = "doc_id long, text string, Key string, base int"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [(k, m.start(), m.end(), m[0]) for k, m in out]


ODD = [
    "a@b.c_x@d.e", "a@b.c.d@e.f", "x@@y.z", "@a.b", "a@b", "a@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 00001.2.3.4", "1.2.3", "99999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "+1 (555) 123-4567", "+1234567", "+12345678", "++49 30 1234567-", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "ü+49 301 234 5678é", "😀 a@b.co 😀 10.0.0.1", "a" * 3000 + "@b.c", "1 " * 3000, "9" * 5000, "+" * 50 + "1", "1." * 3000, None, "", "x" * 5000,
]


def texts(seed=3, n=250):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", "x@y.z", "1", "22", "255", ".", "-", " ", "+", "(", ")", "4111111111111111", "5500-0000-0000-0004", "é", "😀", "\n", "word ", "+44 20 7946 0958", "10.1.2.3", "_", "%"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["call " + " a@b.co" * 700]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a@b.co", "x", 1), (5, "a@b.co", "x", 1), (5, "a@b.co", "x", 1)]
    got = sanitise.find(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *[f"n_{k}" for k in sanitise.KINDS], sanitise.joined("base").alias("b")).collect()
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    want = []
    for i, t, *_ in rows:
        spans = plain(t)
        n = Counter(k for k, *_ in spans)
        want.append((i, *[n[k] for k in sanitise.KINDS], ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "to a@b.co now"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = sorted(queries.op3_sanitise(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert one.spans == "email:3:9" and one.base_sha256 == hashlib.sha256(b"email:3:9").hexdigest()
    assert two.spans == "" and two.base_sha256 == hashlib.sha256(b"").hexdigest() and two.n_email == 0


def disclosed(rows, support, generalise):
    """The rule by plain counting."""
    near, pairs, entities, terms = [], Counter(), Counter(), Counter()
    for i, text in rows:
        terms.update(w for w in re.findall(r"[^\W\d_]+", text.lower()))
        for kind, a, b, value in plain(text):
            entities[kind, value] += 1
            left, right = text[:a], text[b:]
            of = [m for k, *m in plain(text) if k == kind]
            left = left[max((e for _, e, _ in of if e <= a), default=0) :]
            right = right[: min((s for s, _, _ in of if s >= b), default=len(text)) - b]
            for m in re.finditer(r"[^\W\d_]+", left[-120:]):
                if m.end() != len(left[-120:]) and not (len(left) > 120 and m.start() == 0) and len(m[0]) > 2:
                    base = a - len(left[-120:])
                    near.append((i, kind, value, m[0].lower(), base + m.start(), base + m.end()))
            for m in re.finditer(r"[^\W\d_]+", right[:120]):
                if m.start() != 0 and not (len(right) > 120 and m.end() == 120) and len(m[0]) > 2:
                    near.append((i, kind, value, m[0].lower(), b + m.start(), b + m.end()))
    pairs.update(x[1:4] for x in near)
    total = sum(terms.values())
    out = set()
    for i, kind, value, term, a, b in near:
        content = math.log2(total / entities[kind, value])
        if pairs[kind, value, term] >= support and 1 + math.log2(min(1, pairs[kind, value, term] / terms[term])) / content >= generalise:
            out.add((i, a, b))
    return out


def test_disclosing_terms_equal_a_plain_count(spark):
    rng = random.Random(2)
    filler = ["river", "stone", "winter", "meadow", "lantern", "quiet", "harbour"]
    rows = []
    for i in range(60):
        who = i % 3
        body = " ".join(rng.choice(filler) for _ in range(40))
        rows.append((i, f"{body} Zorblax{'abc'[who]} écrit from user{who}@mail.example, the {'gardener' if who else 'river'} {body}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in sanitise.find(docs, support=3, generalise=0.9).collect() for s in r.terms}
    assert got == disclosed(rows, 3, 0.9) and got
    clean = {r.doc_id: r.text for r in sanitise.redact(docs.withColumn("key", docs.text)).collect()}
    assert all("Zorblax" not in t and "@" not in t and "[EMAIL]" in t and "winter" in t for t in clean.values())


def disclosed_by_position(rows, support, generalise):
    """The rule by plain counting over 120 characters on both sides, whatever stands there."""
    near, entities, terms = [], Counter(), Counter()
    for i, text in rows:
        words = list(re.finditer(r"[^\W\d_]+", text))
        terms.update(w[0].lower() for w in words)
        for kind, a, b, value in plain(text):
            entities[kind, value] += 1
            for m in words:
                if len(m[0]) > 2 and (a - 120 <= m.start() and m.end() < a or b < m.start() and m.end() <= b + 120):
                    cut = m.start() == a - 120 > 0 or m.end() == b + 120 < len(text)
                    near += [] if cut else [(i, kind, value, m[0].lower(), m.start(), m.end())]
    pairs, total = Counter(x[1:4] for x in near), sum(terms.values())
    share = lambda kind, value, term: 1 + math.log2(min(1, pairs[kind, value, term] / terms[term])) / math.log2(total / entities[kind, value])
    return {(i, a, b) for i, kind, value, term, a, b in near if pairs[kind, value, term] >= support and share(kind, value, term) >= generalise}


def test_terms_beyond_neighbouring_matches_count(spark):
    rng = random.Random(4)
    filler = ["river", "stone", "winter", "meadow", "lantern", "quiet", "harbour", "😀 été"]
    rows = []
    for i in range(40):
        body = lambda: " ".join(rng.choice(filler) for _ in range(rng.choice([0, 3, 18, 60, 400])))
        rows.append((i, f"{body()} 4111 1111 1111 1111 exp 12/27 holder Zorblax {body()}" if i % 2 else f"{body()} Quorvex {i}@b.example x{i}@c.example, +44 20 7946 0958 me@d.example Trimbly {body()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in sanitise.find(docs).collect() for s in r.terms}
    assert got == disclosed_by_position(rows, 3, 0.9)
    texts = dict(rows)
    assert {"Zorblax", "Quorvex", "Trimbly"} <= {texts[i][a:b] for i, a, b in got}


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sanitise.find(docs).collect() == [] and sanitise.redact(docs).collect() == []
