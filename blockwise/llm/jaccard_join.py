"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

A text's set is that of the 64-bit hashes of its distinct n-word shingles. The universe of hashes is
cut into m equal segments. Two sets that link differ in at most k places, a bound that depends on
their sizes only; so, with m segments, most agree in full, or but for one place. A set's signatures
are the hashes of its segments' subsets, and where a band's allocation says so also of each of these
less one element (one-deletion neighbourhoods). Two sets that link share a signature:

* sizes are dealt into bands so that partners are in one band or in adjacent ones; every band has
  a scheme, and a set takes part in its own band's and in the one below;
* with whole segments, m = k + 1 + z: at least z + 1 agree. With one-deletion neighbourhoods
  m = k // 2 + 1 + z: at least z + 1 differ in one place at most;
* empty segments (with neighbourhoods: of one element too) would be shared by many unlike sets. A
  set with at most z of them leaves them out (one that agrees is left); one with more keeps all;
* the allocation (m, z, neighbourhoods or not) of each band is the one with the least estimated
  cost: signatures made, plus the expected use of very small segments.

Candidates are checked exactly, on the sets. Equal sets are one node from the start, so copies make
no pairs, and a task emits the signatures of a set once. Pairs are bounded by sizes and by the
parities of 512 hash cells, a lower bound of the sets' difference, then by those of as many cells as
both sets have elements, as 512 say nothing of sets beyond some thousand. Only sets of the pairs that
are left are made again, written and compared.

Nodes are named by 64 bits of two independent sums over the set, so two unlike sets would be taken
for one with a chance of n * n / 2**65.

Defined cases: null and empty texts have no shingles and link with nothing; texts of fewer words
than n are one shingle; a null doc_id never names a component unless all its members have none;
repeated rows are copies of each other; ties go to the smallest doc_id; an empty table gives an
empty table; further columns are ignored by link_documents and kept by keep_one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import discard, free_name, free_shuffles, in_arrow, sliced, small_or_not, stored
from .textnum import U64, Texts, mix

CELLS = 512
#: Estimated cost of a set that keeps its small segments, in signatures.
SMALL_SEGMENT_COST = 2_000
#: Elements of a very small segment, without and with one-deletion neighbourhoods.
_SMALL = (0, 1)


def least_overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of a and b elements: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def difference(a: int, b: int, percent: int) -> int:
    return a + b - 2 * least_overlap(a, b, percent)


class Schemes:
    """Bands of sizes and the allocation of each, for one threshold."""

    def __init__(self, percent: int) -> None:
        self.percent, self.begins, self.plans = percent, [1], []

    def band(self, n: int) -> int:
        while self.begins[-1] <= n:
            self.begins.append(self.begins[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.begins, n, "right")) - 1

    def plan(self, band: int) -> tuple[int, int, bool]:
        """Segments, how many very small ones a set may leave out, and whether one-deletion neighbourhoods are used; (0, 0, False): only equal sets link."""
        while len(self.plans) <= band:
            self.plans.append(self._cheapest(len(self.plans)))
        return self.plans[band]

    def _cheapest(self, band: int) -> tuple[int, int, bool]:
        self.band(self.begins[band] if band < len(self.begins) else self.begins[-1])
        while len(self.begins) < band + 2:
            self.band(self.begins[-1])
        lo, hi = self.begins[band], self.begins[band + 1] - 1
        most = hi + hi * 100 // self.percent  # both sizes together; the difference depends on that sum only, and rises but for rounding
        k = max(difference(0, both, self.percent) for both in range(max(2 * lo, most - 60), most + 1))
        if k <= 0:
            return 0, 0, False
        best = (math.inf, (k + 1, 0, False))
        for deletions in (False, True):
            for z in sorted({*range(9), *(k * i // 40 for i in range(1, 20))}):
                m = (k // 2 if deletions else k) + 1 + z
                small = _SMALL[deletions]
                signatures = m + lo if deletions else m
                kept_small = _more_than(m, _at_most(lo, 1 / m, small + deletions), z)
                best = min(best, (signatures + SMALL_SEGMENT_COST * kept_small, (m, z, deletions)))
        return best[1]

    def signatures(self, u: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set of hashes."""
        own = self.band(len(u))
        out = [self._of(u, own)]
        if own and len(u) * self.percent <= 100 * (self.begins[own] - 1):
            out.append(self._of(u, own - 1))
        return np.concatenate(out)

    def _of(self, u: np.ndarray, band: int) -> np.ndarray:
        m, z, deletions = self.plan(band)
        if not m:
            return np.zeros(0, dtype=U64)
        edges = np.searchsorted(u, _edges(m))
        sizes = np.diff(edges)
        sums = np.zeros(len(u) + 1, dtype=U64)
        np.cumsum(u, out=sums[1:])
        whole = sums[edges[1:]] - sums[edges[:-1]]
        small = _SMALL[deletions]
        keep = sizes > small if np.count_nonzero(sizes <= small + deletions) <= z else np.ones(m, dtype=bool)
        segment = np.arange(m)
        salt = mix((np.flatnonzero(keep) + (band << 32)).astype(U64))
        out = [whole[keep] + salt]
        if deletions:
            salts = np.zeros(m, dtype=U64)
            salts[keep] = salt
            of = np.repeat(segment, sizes)
            out.append((whole[of] - u + salts[of])[keep[of]])
        return mix(np.concatenate(out))


@lru_cache(maxsize=4096)
def _edges(m: int) -> np.ndarray:
    """Where m equal segments of the 64-bit universe begin, and its end."""
    return np.array([(k << 64) // m for k in range(m)] + [(1 << 64) - 1], dtype=U64)


def _at_most(n: int, p: float, most: int) -> float:
    """Chance of at most `most` successes in n trials."""
    if p >= 1:
        return float(n <= most)
    if p <= 0:
        return 1.0
    choose = math.lgamma(n + 1)
    logs = (choose - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(most, n) + 1))
    return min(1.0, sum(map(math.exp, logs)))


def _more_than(n: int, p: float, z: int) -> float:
    return 1 - _at_most(n, p, z)


@lru_cache(maxsize=8)
def schemes(percent: int) -> Schemes:
    return Schemes(percent)


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    texts = Texts(column, lower=True)
    first, hashes = texts.windows(n)
    at = np.searchsorted(first, texts.word_at)
    words = texts.word_at
    for k in range(texts.n):
        if at[k] < at[k + 1]:
            yield np.unique(hashes[at[k] : at[k + 1]])
        elif words[k] < words[k + 1]:
            own = U64(words[k + 1] - words[k])
            for h in texts.word_hash[words[k] : words[k + 1]]:
                own = U64((int(own) * 0xD6E8FEB86659FD93 + int(h)) & (2**64 - 1))
            yield mix(np.array([own], dtype=U64) ^ U64(0x5851F42D4C957F2D))
        else:
            yield np.zeros(0, dtype=U64)


def name_of(u: np.ndarray) -> int:
    """The node of a set: 64 bits of two sums."""
    with np.errstate(over="ignore"):
        two = mix(np.array([u.sum(dtype=U64), mix(u ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64) + U64(len(u))], dtype=U64))
        return int(mix(two[:1] * U64(3) + two[1:]).astype(np.int64)[0])


def parities(u: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For `cells` cells, a power of two, whether an odd number of the set's hashes falls there, in words of 64 bits."""
    odd = (np.bincount((u & U64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def sketch(u: np.ndarray) -> np.ndarray:
    """The parities of at least twice as many cells as the set has elements."""
    return parities(u, max(CELLS, 1 << (2 * len(u) - 1).bit_length()))


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the difference of the sets of two sketches: cells of unlike parity, the finer sketch folded to the coarser."""
    if len(x) > len(y):
        x, y = y, x
    while len(x) < len(y):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(U64)).sum())


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of longs, without a copy."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _described(docs: DataFrame, n: int) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, node, size, parities and sketch of every row's set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            own = [(name_of(u), len(u), parities(u), sketch(u)) if len(u) else (None, 0, None, None) for u in sets(batch.column("text"), n)]
            nodes, sizes, cells, sketches = zip(*own, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["row", "doc_id", "node", "n", "cells", "sketch"],
            )

    return in_arrow(docs.select(_key().alias("row"), "doc_id", "text"), run, f"row long, doc_id {kind}, node long, n long, cells array<long>, sketch array<long>")


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(signature, node) of every set, once in a task however many copies it reads there."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, met = schemes(percent), set()
        for batch in sliced(batches, "text"):
            signatures, nodes = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
            for u in sets(batch.column("text"), n):
                if len(u) and (name := name_of(u)) not in met:
                    signatures.append(plan.signatures(u))
                    nodes.append(np.full(len(signatures[-1]), name, dtype=np.int64))
                    if len(met) < 2_000_000:
                        met.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signatures).view(np.int64)), pa.array(np.concatenate(nodes))], names=["signature", "node"])

    return in_arrow(docs.select("text"), run, "signature long, node long")


def _possible(percent: int):
    def possible(x: str, y: str) -> Column:
        lo, hi = F.least(x + "n", y + "n"), F.greatest(x + "n", y + "n")
        both = F.col(x + "n") + F.col(y + "n")
        overlap = F.ceil(both * percent / (100 + percent) - 1e-9)
        apart = sum((F.bit_count(F.col(f"{x}p{i}").bitwiseXOR(F.col(f"{y}p{i}"))) for i in range(CELLS // 64)), F.lit(0))
        return (lo * 100 >= hi * percent) & (apart <= both - 2 * overlap)

    return possible


def _linked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """row, doc_id, node, n_shingles, component and component_id of every row; a component is named by one of its nodes."""
    told = stored(_described(docs, n), "shingle-sets")
    buckets = linking.shared(_signed(docs, n, percent))
    free_shuffles(docs.sparkSession)
    of_interest = buckets.select("node").distinct()
    nodes = told.where("node is not null").groupBy("node").agg(F.min("row").alias("at"), F.max("n").alias("n"), *[F.max(F.col("cells")[i]).alias(f"p{i}") for i in range(CELLS // 64)])
    facts = stored(nodes.join(of_interest, "node", "left_semi"), "candidate-sets")
    used = [buckets, facts]

    def places(pairs: DataFrame) -> DataFrame:
        """(node, at): the nodes of these pairs, and a row that has the set of each."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        used.append(out := stored(facts.select("node", "at").join(ends, "node", "left_semi"), "sets-of-pairs"))
        return small_or_not(out)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_arrays(batch.column(c)) for c in ("a_sketch", "b_sketch"))
            sizes = zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)
            keep = [least_difference(v, w) <= difference(*both, percent) for v, w, both in zip(x, y, sizes, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in sliced(batches, "text"):
            found = {}
            for u in sets(batch.column("text"), n):
                if len(u) and (name := name_of(u)) not in met:
                    met.add(name)
                    found[name] = u.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "elements"])

    def check(pairs: DataFrame) -> DataFrame:
        sketches = told.select("row", "n", "sketch").join(places(pairs), F.col("row") == F.col("at")).select("node", "n", "sketch").dropDuplicates(["node"])
        x, y = (sketches.select(F.col("node").alias(p), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch")) for p in ("a", "b"))
        close = stored(in_arrow(pairs.join(x, "a").join(y, "b"), near, "a long, b long"), "close-pairs")
        texts = docs.select("text", _key().alias("row")).join(places(close).drop("node"), F.col("row") == F.col("at"), "left_semi").select("text")
        elements = stored(in_arrow(texts, hashed, "node long, elements array<long>").dropDuplicates(["node"]), "shingle-elements")
        used.extend([close, elements])
        free_shuffles(docs.sparkSession)
        x, y = (elements.select(F.col("node").alias(p), F.col("elements").alias(f"{p}_set")) for p in ("a", "b"))
        common = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - common
        return close.join(x, "a").join(y, "b").where(common * 100 >= union * percent).select("a", "b")

    found, _ = linking.connect(buckets, facts.drop("at"), _possible(percent), check)
    least = told.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = stored(named.join(smallest, "component").select("node", "component", "component_id"), "components")
    discard(*used)
    free_shuffles(docs.sparkSession)
    return told.select("row", "doc_id", "node", F.col("n").alias("n_shingles")).join(of_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, node, n_shingles and component_id of every row."""
    return _linked(docs, n, percent).drop("row", "component")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component, with the columns of docs; all rows without words.

    It is one of the component's least doc_id, nulls last; of unlike sets under that doc_id, the one of the least node.
    """
    row, once = free_name(docs, "set_row"), free_name(docs, "set_once")
    linked = _linked(docs, n, percent)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "row")
    first = linked.where("node is not null").groupBy("component").agg(F.min(order).alias("first"))
    again = linked.where("node is not null").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row", F.lit(True).alias("again"))
    chosen = first.select(F.col("first.row").alias("row")).join(again, "row", "left").select(F.col("row").alias(row), F.coalesce("again", F.lit(False)).alias(once))
    wordless = linked.where("node is null").select(F.col("row").alias(row), F.lit(False).alias(once)).distinct()
    keys = small_or_not(stored(chosen.unionByName(wordless), "kept-sets"))
    rows = docs.withColumn(row, _key()).join(keys, row)
    # only texts of rows that are there several times are shuffled to drop all but one
    return rows.where(~F.col(once)).select(*docs.columns).unionByName(rows.where(F.col(once)).dropDuplicates([row]).select(*docs.columns))
