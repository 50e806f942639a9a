"""Information-theoretic sanitisation of personal data; DataFrame and SQL functions only.

Protected entities are found by pattern: e-mail and IP addresses, card numbers that pass Luhn's
check, phone numbers. Then corpus co-occurrence tells which terms (runs of letters) give an entity
away where they stand near it, within CONTEXT characters of the text on either side, whatever else
is found there. With p(e) the share of an entity's
occurrences among all terms, IC(e) = -log2 p(e) and PMI(t, e) = log2(p(e | t) / p(e)), the share of
the entity's information that a term discloses is PMI / IC, which is 1 where the term never stands
anywhere else. A pair seen at least `support` times discloses; from `generalise` on the term is
generalised, from `remove` on removed. Disclosing terms become spans beside those of the entities.

Texts are read twice: for entities and their contexts, and to count the terms that are candidates.
Neither pass shuffles texts. Candidates are broadcast only after they are counted; beyond
BROADCAST_ROWS all terms are counted, partially at first, and joined.

Patterns are written so that no text makes them slow or deep: possessive where nothing could be
given back, and beginning only where a run does. Positions are sums of the lengths of matches and
of what is between them, in code points, summed in lots so that many matches stay cheap. Surroundings are cut from pieces of PIECE code points
for the same reason.

Defined cases: a null text counts as empty and has no spans; equal texts have equal spans, whatever
their doc_id; repeated rows each give a row; spans of different kinds may overlap; an empty table
gives an empty table; further columns are ignored by find and kept by redact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, small_or_not, stored

CONTEXT = 120
PIECE = 1024
LOT = 128
KINDS = ("email", "ip", "card", "phone")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
_MARKS = {"email": "instr(body, '@') > 0", "ip": "has_digit", "card": "has_digit", "phone": "instr(body, '+') > 0"}

_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr({_DIGITS}, -i, 1)) "
    f"WHEN int(substr({_DIGITS}, -i, 1)) > 4 THEN 2 * int(substr({_DIGITS}, -i, 1)) - 9 ELSE 2 * int(substr({_DIGITS}, -i, 1)) END) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": r"x.value rlike R'\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|\z)){4}\z'",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}


def _starts(steps: str) -> list[dict[str, str]]:
    """Three steps of columns that end in `starts`: where each of `steps` (structs of gap and size) begins, summed in lots."""
    return [
        {"lots": f"CASE WHEN size({steps}) > 0 THEN transform(sequence(0, (size({steps}) - 1) div {LOT}), c -> slice({steps}, int(c * {LOT} + 1), {LOT})) ELSE array() END"},
        {"before": "aggregate(transform(lots, l -> aggregate(l, 0L, (a, x) -> a + x.gap + x.size)), named_struct('at', 0L, 'all', cast(array() AS array<bigint>)), (a, t) -> named_struct('at', a.at + t, 'all', concat(a.all, array(a.at)))).all"},
        {"starts": "flatten(transform(lots, (l, c) -> aggregate(l, named_struct('at', get(before, c), 'all', cast(array() AS array<bigint>)), (a, x) -> named_struct('at', a.at + x.gap + x.size, 'all', concat(a.all, array(a.at + x.gap)))).all))"},
    ]


def _part(start: str, size: str) -> str:
    """At most `size` code points of the text from `start` on, out of the two pieces that hold them."""
    piece = f"int(({start}) div {PIECE})"
    return f"substring(concat(coalesce(get(pieces, {piece}), ''), coalesce(get(pieces, {piece} + 1), '')), int(({start}) % {PIECE} + 1), int({size}))"


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in columns.items()])


def _entities(df: DataFrame, kind: str) -> DataFrame:
    """df, which has body and has_digit, with an array of the kind's valid entities and their surroundings."""
    keep = df.columns
    pattern, mark = PATTERNS[kind], _MARKS[kind]
    df = _with(df, {"found": f"CASE WHEN {mark} THEN regexp_extract_all(body, R'{pattern}', 0) ELSE cast(array() AS array<string>) END"})
    df = _with(df, {"gaps": f"CASE WHEN size(found) > 0 THEN split(body, R'{pattern}', -1) ELSE cast(array() AS array<string>) END"})
    df = _with(df, {"head": "slice(gaps, 1, size(found))"})
    df = _with(df, {"steps": "transform(arrays_zip(found, head), x -> named_struct('value', x.found, 'size', length(x.found), 'gap', length(x.head)))"})
    for columns in _starts("steps"):
        df = _with(df, columns)
    df = _with(df, {"placed": "arrays_zip(starts, steps)"})
    df = _with(df, {"valid": f"filter(transform(placed, p -> named_struct('kind', '{kind}', 'value', p.steps.value, 'start', p.starts, 'end', p.starts + p.steps.size)), x -> {_VALID[kind]})"})
    df = _with(df, {"pieces": f"CASE WHEN size(valid) > 0 THEN regexp_extract_all(body, R'(?s).{{1,{PIECE}}}', 0) ELSE cast(array() AS array<string>) END"})
    left, right = _part("greatest(x.start - {0}, 0L)".format(CONTEXT), f"least(x.start, {CONTEXT}L)"), _part("x.end", f"{CONTEXT}L")
    df = _with(df, {"own": f"transform(valid, x -> named_struct('kind', x.kind, 'value', x.value, 'start', x.start, 'end', x.end, 'left', {left}, 'right', {right}, 'left_cut', x.start > {CONTEXT}, 'right_cut', length(body) > x.end + {CONTEXT}))"})
    return df.selectExpr(*keep, f"own AS {kind}")


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, and the entities of every row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    df = df.selectExpr("doc_id", "body", "md5(body) AS key", "body rlike '[0-9]' AS has_digit")
    for kind in KINDS:
        df = _entities(df, kind)
    return df.selectExpr("doc_id", "key", *[f"bigint(size({k})) AS n_{k}" for k in KINDS], f"concat({', '.join(KINDS)}) AS entities")


def contexts(based: DataFrame) -> DataFrame:
    """A row for each term near an entity: key, kind, value, term, start, end."""
    each = based.where("size(entities) > 0").selectExpr("key", "inline(entities)")
    sides = each.selectExpr("key", "kind", "value", "start", "end", "stack(2, 'left', left, left_cut, 'right', right, right_cut) AS (side, near, cut)")
    df = sides.selectExpr("*", r"regexp_extract_all(near, R'\p{L}+', 0) AS found", r"split(near, R'\p{L}+', -1) AS gaps")
    df = _with(df, {"head": "slice(gaps, 1, size(found))"})
    df = _with(df, {"steps": "transform(arrays_zip(found, head), x -> named_struct('size', length(x.found), 'gap', length(x.head)))"})
    for columns in _starts("steps"):
        df = _with(df, columns)
    df = df.selectExpr("key", "kind", "value", "side", "cut", "CASE WHEN side = 'left' THEN start - length(near) ELSE end END AS base", "length(near) AS width", "inline(arrays_zip(found, starts))")
    first, last = "starts = 0", "starts + length(found) = width"
    whole = f"CASE WHEN side = 'left' THEN NOT ({last}) AND NOT (cut AND {first}) ELSE NOT ({first}) AND NOT (cut AND {last}) END"
    return df.where(whole).where("length(found) >= 3").selectExpr("key", "kind", "value", "lower(found) AS term", "base + starts AS start", "base + starts + length(found) AS end")


def disclosures(docs: DataFrame, based: DataFrame, near: DataFrame, support: int, generalise: float) -> DataFrame:
    """(kind, value, term, share): the terms that disclose at least the share `generalise` of an entity."""
    pairs = stored(near.groupBy("kind", "value", "term").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= support), "term-pairs")
    wanted = stored(pairs.select("term").distinct(), "terms")
    # \x01 can't be in a run of letters: it stands for all other terms
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("word")).where("word != ''")
    if wanted.count() <= BROADCAST_ROWS:
        words = words.join(F.broadcast(wanted), words["word"] == wanted["term"], "left").select(F.coalesce("term", F.lit("\x01")).alias("word"))
    counted = stored(words.groupBy("word").agg(F.count("*").alias("n_term")), "term-counts")
    total = counted.agg(F.sum("n_term")).first()[0] or 0
    entities = based.where("size(entities) > 0").selectExpr("inline(entities)").groupBy("kind", "value").agg(F.count("*").alias("n_entity"))
    all_terms = F.greatest(F.lit(total), F.col("n_entity")).cast("double")
    content = F.log2(all_terms / F.col("n_entity"))
    given = F.least(F.col("n_pair") / F.col("n_term"), F.lit(1.0))
    share = F.when(content > 0, 1 + F.log2(given) / content).otherwise(0.0)
    joined = pairs.join(counted, pairs["term"] == counted["word"]).join(entities, ["kind", "value"])
    return joined.select("kind", "value", "term", share.alias("share")).where(F.col("share") >= generalise)


def find(docs: DataFrame, support: int = 3, generalise: float = 0.9, remove: float = 0.97) -> DataFrame:
    """doc_id, key, n_email, n_ip, n_card, n_phone, base, and terms: spans (kind, start, end) of disclosing terms."""
    based = stored(_based(docs), "entities")
    near = stored(contexts(based), "entity-contexts")
    telling = small_or_not(stored(disclosures(docs, based, near, support, generalise), "disclosures"))
    spans = near.join(telling, ["kind", "value", "term"]).groupBy("key", "start", "end").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= remove, "term_removed").otherwise("term_generalised")
    by_text = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "start", "end"))).alias("terms"))
    slim = based.selectExpr("doc_id", "key", *[f"n_{k}" for k in KINDS], "transform(entities, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end)) AS base")
    return slim.join(small_or_not(stored(by_text, "term-spans")), "key", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() AS array<struct<kind: string, start: bigint, end: bigint>>)")))


def joined(spans: str) -> Column:
    """kind:start:end of all spans, by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, **thresholds: float) -> DataFrame:
    """docs with its text sanitised: entities as [KIND], terms generalised as [TERM], removed ones gone.

    Where spans overlap the first stays, the longer of two that begin together.
    """
    found = find(docs, **thresholds)
    key, spans = free_name(docs, "text_key"), free_name(docs, "text_spans")
    by_text = found.groupBy(F.col("key").alias(key)).agg(F.first("base").alias("b"), F.first("terms").alias("t"))
    by_text = by_text.select(key, F.expr("array_sort(concat(b, t), (l, r) -> CASE WHEN l.start != r.start THEN int(sign(l.start - r.start)) ELSE int(sign(r.end - l.end)) END)").alias(spans)).where(F.size(spans) > 0)
    rows = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).join(by_text, key, "left")
    shown = "CASE x.kind WHEN 'term_removed' THEN '' WHEN 'term_generalised' THEN '[TERM]' ELSE concat('[', upper(x.kind), ']') END"
    new = F.expr(
        f"CASE WHEN {spans} IS NULL THEN text ELSE aggregate({spans}, named_struct('at', 0L, 'out', ''), (a, x) -> CASE WHEN x.start < a.at THEN a "
        f"ELSE named_struct('at', x.end, 'out', concat(a.out, substring(text, int(a.at + 1), int(x.start - a.at)), {shown})) END, a -> concat(a.out, substring(text, int(a.at + 1)))) END"
    )
    return rows.withColumn("text", new).select(*docs.columns)
