"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

A text is described by statistics of its characters, words and lines. These are standardised and
mapped to FOURIER random cosines, whose inner products approximate a Gaussian kernel. Every task
sums its rows' normal equations; the sums of the tasks' sums, one matrix whose size is fixed, are
solved on the driver. Ridge scores of the labelled rows are counted by a fixed number of bins, over
which the pool-adjacent-violators rule fits the calibration. All labelled rows that may be learnt
from take part; nothing is sampled.

Texts are read once, for their statistics; learning and scoring use these few numbers a row.

Defined cases: a null text counts as empty, and an empty one has a score like any other; a null
doc_id is neither held out nor learnt from; rows of labels with a null quality are ignored, and
several labels of one doc_id count as their mean; without any label to learn from every score is
0.5; repeated rows are scored each; an empty table gives an empty table; other columns, labels among
them, are no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, sliced, stored
from .quality_rules import CLASSES, class_counts, statistics, word_counts
from .textnum import U64, Texts, mix

FOURIER = 256
BINS = 2000
_LOW, _HIGH = -0.5, 1.5  # ridge scores are binned between these
NAMES = (
    *(f"share_{c}" for c in CLASSES), "log_chars", "log_words", "word_chars", "word_chars_spread", "long_words", "bare_words",
    "upper_words", "distinct_words", "common_words", "repeated_words", "repeated_lines", "symbols_a_word", "words_a_line", "upper_letters",
)


def features(texts: Texts) -> np.ndarray:
    """One row of NAMES for each text."""
    found, classes, common = statistics(texts), class_counts(texts).astype(np.float64), word_counts(texts).astype(np.float64)
    chars, words = classes.sum(axis=1), found["n_words"].astype(np.float64)
    some = np.maximum(words, 1)
    lo, hi = texts.words

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[hi] - sums[lo]).astype(np.float64)

    def mean(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(texts.word_text, weights=of_word, minlength=texts.n) / some

    data = texts.data
    size = within((data & 0xC0) != 0x80)
    upper, letters = within((data >= 65) & (data <= 90)), within(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))
    first = np.unique(mix(texts.word_hash + mix(texts.word_text.astype(U64))), return_index=True)[1]
    average = mean(size)
    lines = texts.per_text(data == 10) + 1.0
    cells = {n: k for k, n in enumerate(CLASSES)}
    rows = [
        *(classes[:, k] / np.maximum(chars, 1) for k in range(len(CLASSES))),
        np.log1p(chars), np.log1p(words), average, np.sqrt(np.maximum(mean(size**2) - average**2, 0)), mean((size > 20).astype(np.float64)), mean((letters == 0).astype(np.float64)),
        mean((upper > 1).astype(np.float64)), np.bincount(texts.word_text[first], minlength=texts.n) / some, 1 - common[:, -1] / some, found["n_repeat_words"] / some,
        found["n_dup_lines"] / lines, found["n_symbols"] / some, np.log1p(words / lines), classes[:, cells["upper"]] / np.maximum(classes[:, cells["upper"]] + classes[:, cells["lower"]], 1),
    ]
    return np.stack(rows, axis=1)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            own = features(Texts(batch.column("text")))
            lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "features"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, features array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  #: calibrated value of each bin of ridge scores

    @staticmethod
    def cosines(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(11))
        w = rng.normal(size=(x.shape[1], FOURIER)) / np.sqrt(x.shape[1])
        z = np.cos(np.clip((x - centre) / scale, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FOURIER)) * np.sqrt(2 / FOURIER)
        return np.hstack([z, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x, self.centre, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(x), _centres(), self.steps)


def _centres() -> np.ndarray:
    return _LOW + (np.arange(BINS) + 0.5) * (_HIGH - _LOW) / BINS


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: rising means of sums over weights; where weights are 0, values between neighbours."""
    at = np.flatnonzero(weights > 0)
    pools: list[list[float]] = []  # weight, sum, how many
    for k in at:
        pools.append([float(weights[k]), float(sums[k]), 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, s, n = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + n]
    values = np.concatenate([[s / w] * n for w, s, n in pools])
    return np.interp(np.arange(len(weights)), at, values)


def held_out() -> Column:
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(told: DataFrame, labels: DataFrame, ridge: float = 1e-4) -> Model | None:
    """The model learnt from the labelled rows of `told` that aren't held out; None if there are none."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = stored(told.where(~held_out()).join(known, "doc_id").select("features", "y"), "labelled")
    d = len(NAMES)
    each = [f(F.col("features")[k]) for k in range(d) for f in (F.avg, F.stddev_pop)]
    n, *moments = rows.agg(F.count("*"), *each).first()
    if not n:
        return None
    centre, scale = np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6)

    def normal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        for batch in batches:
            z = Model.cosines(_matrix(batch.column("features")), centre, scale)
            total += z.T @ np.hstack([z, batch.column("y").to_numpy()[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(FOURIER + 1)), pa.ListArray.from_arrays(np.arange(0, total.size + 1, FOURIER + 2, dtype=np.int32), pa.array(total.reshape(-1)))], names=["row", "cells"]
            )

    # summed in the JVM, partially at first, so no task holds what all tasks found
    cells = in_arrow(rows, normal, "row long, cells array<double>").select("row", F.posexplode("cells").alias("at", "cell")).groupBy("row", "at").agg(F.sum("cell").alias("cell"))
    total = np.zeros((FOURIER + 1, FOURIER + 2))
    for r in cells.collect():  # as many as the matrix has cells
        total[r["row"], r["at"]] = r["cell"]
    weights = np.linalg.solve(total[:, :-1] + np.eye(FOURIER + 1) * ridge * n, total[:, -1])
    raw = Model(centre, scale, weights, np.zeros(BINS))

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((raw.ridge(_matrix(batch.column("features"))) - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    counts, sums = np.zeros(BINS), np.zeros(BINS)
    for r in in_arrow(rows, binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():  # at most BINS rows
        counts[r["bin"]], sums[r["bin"]] = r["n"], r["y"]
    return Model(centre, scale, weights, isotonic(counts, sums))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    told = stored(described(docs), "statistics")
    model = fit(told, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column("features"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(scores, 0, 1))], names=["doc_id", "score"])

    scored = in_arrow(told, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
