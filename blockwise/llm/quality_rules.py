"""Quality rules: distribution divergence from language references, beside fixed repetition rules.

Every text becomes a histogram of character classes and one of common words. The reference of a
language is the sum of the histograms of all its texts that pass the fixed rules; a text whose
Jensen-Shannon distance (base 2, 0 to 1) from its reference exceeds a threshold is rejected. Texts
too short for a histogram to mean anything (the minimum-length guards) are not judged by it. Texts
mostly in capitals or full of symbols don't enter a reference, lest junk set the standard.

Two passes over the texts: the first only sums the histograms by language (a few numbers per task
are shuffled), the second judges every row where it stands, so no text is ever shuffled.

Defined cases: a null text counts as empty (zero statistics, fails the rules: under ten words); a
null lang is a language of its own; a language without a usable reference judges by the fixed rules
alone; repeated rows and ties are judged alike, each row by itself; an empty table gives an empty
table; further columns pass through, and columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow, sliced, small_or_not, stored
from .textnum import LOWER, U64, Texts, mix, twice

SYMBOLS = b"#*$%&|<>"

#: Very common words of four languages.
COMMON_WORDS = (
    "the of and to in is that it for was with as are on be at by this he from or an which but not "
    "der die und das von zu mit den im ein eine ist nicht auf sich auch für dem des "
    "de la le et les un une en que pour est dans par au du qui sur pas plus "
    "el los las y por con para se su como lo más al"
).split()

#: Classes of a code point's first byte; bytes that continue a code point count for none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_punctuation", "beyond_ascii", "control")


def _classes() -> np.ndarray:
    out = np.full(256, len(CLASSES), dtype=np.uint8)
    out[0:32] = out[127] = CLASSES.index("control")
    out[33:127] = CLASSES.index("other_punctuation")
    out[[32, 9, 10, 11, 12, 13]] = CLASSES.index("space")
    out[97:123], out[65:91], out[48:58] = CLASSES.index("lower"), CLASSES.index("upper"), CLASSES.index("digit")
    out[list(b".,;:?'\"-()")] = CLASSES.index("stop")
    out[list(SYMBOLS)] = CLASSES.index("symbol")
    out[192:256] = CLASSES.index("beyond_ascii")
    return out


CLASS_OF = _classes()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@dataclass(frozen=True)
class Rules:
    """Production parameters of the verdict."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    guard_chars: int = 200  #: fewer characters: no verdict by character classes
    guard_words: int = 40  #: fewer words: no verdict by common words
    max_class_distance: float = 0.19
    max_word_distance: float = 0.5
    reference_max_symbols: float = 0.01  #: share of characters in a text that enters a reference
    reference_max_upper: float = 0.25


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    texts = Texts(pa.array([" ".join(COMMON_WORDS)]))
    keys = texts.word_hash
    order = np.argsort(keys)
    return keys[order], order


def statistics(texts: Texts, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts_code_point = (texts.data & 0xC0) != 0x80
    n_words = np.diff(texts.word_at)
    lo, hi, of = texts.lines
    before = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum(~texts.spaces, out=before[1:])
    full = before[hi] > before[lo]
    keys = mix(texts.hashes(lo[full], hi[full]) + mix(of[full].astype(U64)))
    again = twice(keys)
    repeated = np.zeros(texts.n, dtype=np.int64)
    if again.any():
        first = np.unique(keys[again], return_index=True)[1]
        repeated = np.bincount(of[full][again], minlength=texts.n) - np.bincount(of[full][again][first], minlength=texts.n)
    first, hashes = texts.windows(window)
    covered = np.zeros(len(texts.word_hash) + 1, dtype=np.int64)
    hot = first[twice(mix(hashes + mix(texts.word_text[first].astype(U64))))]
    np.add.at(covered, hot, 1)
    np.add.at(covered, hot + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": texts.per_text(starts_code_point & ~texts.spaces),
        "n_symbols": texts.per_text(IS_SYMBOL[texts.data]),
        "n_dup_lines": repeated,
        "n_repeat_words": np.bincount(texts.word_text[inside], minlength=texts.n),
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def class_counts(texts: Texts) -> np.ndarray:
    k = len(CLASSES) + 1
    where = np.repeat(np.arange(texts.n, dtype=np.int64) * k, np.diff(texts.at))
    return np.bincount(where + CLASS_OF[texts.data], minlength=texts.n * k).reshape(texts.n, k)[:, :-1]


def word_counts(texts: Texts) -> np.ndarray:
    """Counts of the common words, and of all others last."""
    lower = Texts.__new__(Texts)
    lower.n, lower.at, lower.data = texts.n, texts.at, LOWER[texts.data]
    keys, order = _common_hashes()
    lower.__dict__["words"], lower.__dict__["word_at"], lower.__dict__["spaces"] = texts.words, texts.word_at, texts.spaces
    hashes = lower.word_hash
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    kind = np.where(keys[at] == hashes, order[at], len(keys))
    k = len(keys) + 1
    return np.bincount(texts.word_text * k + kind, minlength=texts.n * k).reshape(texts.n, k)


def _lists(counts: np.ndarray, shares: bool) -> pa.Array:
    """The rows as lists; with shares, each divided by its sum (a null list where that is 0)."""
    rows, k = counts.shape
    total = counts.sum(axis=1)
    values = counts / np.maximum(total, 1)[:, None] if shares else counts.astype(np.float64)
    lists = pa.ListArray.from_arrays(np.arange(0, rows * k + 1, k, dtype=np.int32), pa.array(values.reshape(-1)))
    return pc.if_else(pa.array(total > 0), lists, pa.scalar(None, lists.type)) if shares else lists


def measured(df: DataFrame, column: str, prefix: str, rules: Rules, shares: bool) -> DataFrame:
    """df with the statistics and both histograms (as counts, or as shares), their names prefixed."""
    keep = df.schema
    out = T.StructType(
        keep.fields
        + [T.StructField(prefix + s, T.LongType()) for s in STATISTICS]
        + [T.StructField(prefix + h, T.ArrayType(T.DoubleType())) for h in ("classes", "common")]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            texts = Texts(batch.column(column))
            found = statistics(texts, rules.window)
            more = [pa.array(found[s].astype(np.int64)) for s in STATISTICS] + [_lists(class_counts(texts), shares), _lists(word_counts(texts), shares)]
            yield pa.RecordBatch.from_arrays(batch.columns + more, names=batch.schema.names + out.names[len(keep) :])

    return in_arrow(df, run, out)


def _distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares; null if either is null."""
    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(own, reference, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    distance = F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2, F.lit(0.0)))
    return F.when(own.isNotNull() & reference.isNotNull(), distance)  # greatest() alone would make 0 of null


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language: histograms, as shares, of its texts that pass the fixed rules and the reference bounds."""
    slim = measured(docs.select("lang", "text"), "text", "m_", rules, shares=False)
    width = {"m_classes": len(CLASSES), "m_common": len(COMMON_WORDS) + 1}
    chars = sum((F.col("m_classes")[i] for i in range(1, width["m_classes"])), F.col("m_classes")[0])
    clean = (F.col("m_classes")[CLASSES.index("symbol")] <= chars * rules.reference_max_symbols) & (
        F.col("m_classes")[CLASSES.index("upper")] <= chars * rules.reference_max_upper
    )
    sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c, k in width.items()]
    summed = slim.where(~_failed("m_", rules) & clean).groupBy(F.col("lang").alias("ref_lang")).agg(*sums)
    return summed.select("ref_lang", *[_shares(c).alias(f"ref_{c[2:]}") for c in width])


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(counts, lambda v: v / total))


def _failed(prefix: str, rules: Rules) -> Column:
    words = F.col(prefix + "n_words")
    return (words < rules.min_words) | (F.col(prefix + "n_repeat_words") * 100 > words * rules.max_repeat_percent)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the statistics, base_failed, class_distance, word_distance and kept.

    docs needs text and lang. The row count is unchanged.
    """
    prefix = free_name(docs, "m_")
    ref = small_or_not(stored(references(docs, rules), "language-references"))
    own = measured(docs, "text", prefix, rules, shares=True)
    joined = own.join(ref, own["lang"].eqNullSafe(ref["ref_lang"]), "left")
    words = F.col(prefix + "n_words")
    by_class = F.when(F.char_length(own["text"]) >= rules.guard_chars, _distance(F.col(prefix + "classes"), F.col("ref_classes")))
    by_word = F.when(words >= rules.guard_words, _distance(F.col(prefix + "common"), F.col("ref_common")))
    new = {s: F.col(prefix + s) for s in STATISTICS}
    new |= {"base_failed": _failed(prefix, rules), "class_distance": by_class, "word_distance": by_word}
    rest = [docs_col for docs_col in docs.columns if docs_col.lower() not in {*new, "kept"}]
    out = joined.select(*[own[c] for c in rest], *[c.alias(n) for n, c in new.items()])
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    flag = free_name(docs, "kept_row")
    judged = judge(docs.select(*[F.col(c).alias(f"c{i}_{c}") for i, c in enumerate(docs.columns)], "text", "lang"), rules)
    kept = judged.where("kept").withColumn(flag, F.lit(True))
    return kept.select(*[F.col(f"c{i}_{c}").alias(c) for i, c in enumerate(docs.columns)])
