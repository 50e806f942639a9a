"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items and texts are folded alike: ASCII letters in lower case, every run of ASCII white
space and punctuation one space. Folded items are cut into overlapping windows of WINDOW bytes
(a shorter item is one window), half a window apart, so any stretch of one and a half windows of an
item holds a whole window. A text is contaminated where a window aligns with it within the edit
budget, a share of the window's length.

A window of w bytes within e edits of a text's region shares at least w - q + 1 - e q of its q-grams
with it (the q-gram lemma), on diagonals that are at most e apart. So the q-grams of a text are
looked up among those of the windows, and the shared ones are counted by window and diagonal band;
bands overlap by half, so that the diagonals of one alignment are in one band. Bands that meet the
lemma's count are kept, and verified by an alignment confined to the band and its margin. Counted are
the places of a text that share a q-gram in the band, so that text which repeats itself, and meets a
repeated q-gram at many places of a window, counts once for each of its own: an alignment uses none
twice, so nothing is lost. Windows of equal bytes are looked up as one.

Texts are scanned where they are read: nothing is shuffled. The items are sent to the executors in
blocks of at most BLOCK_BYTES, one scan after another if they are more. Shared q-grams are listed in
runs of about HITS and aligned ALIGNED at a time, so beside some twenty bytes for each byte of a text
memory does not grow with it, however often text and items repeat themselves.

Defined cases: null and empty texts hold nothing, nor do items shorter than MIN_WINDOW after
folding, too short to tell from chance; repeated rows and items each give their own hits; empty
tables give empty results; further columns of documents are ignored by find and kept by remove.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, sliced
from .textnum import U64, Texts

Q = 12
WINDOW = 100
MIN_WINDOW = 50
EDIT_SHARE = 0.06
BLOCK_BYTES = 16 << 20
#: Bytes of folded text whose q-grams are looked up at once, shared q-grams listed at once, regions aligned at once.
PIECE, HITS, ALIGNED = 1 << 20, 1 << 20, 4096
_FILTER_BITS = 22


def _fold_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for b in range(128):
        if not chr(b).isalnum():
            out[b] = 32
    return out


_FOLD = _fold_table()


def fold(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts end to end, each after a byte 0, their offsets, and where every byte comes from."""
    data = _FOLD[texts.data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    inner = texts.at[(texts.at > 0) & (texts.at < len(data))]
    keep[inner] = True
    kept = np.flatnonzero(keep)
    sizes = np.diff(np.searchsorted(kept, texts.at))
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    own = np.ones(len(out), dtype=bool)
    own[at[:-1]] = False
    out[own] = data[kept]
    source = np.zeros(len(out), dtype=np.int32)  # a text of Arrow has less than 2 GB
    source[own] = kept
    return out, at, source


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes at every place where there are as many."""
    if len(data) < Q:
        return np.zeros(0, dtype=U64)
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    eight = four[:-4].astype(U64) | four[4:].astype(U64) << U64(32)
    n = len(data) - Q + 1
    return eight[:n] * U64(0x9E3779B97F4A7C15) + four[8 : 8 + n].astype(U64) * U64(0xC2B2AE3D27D4EB4F)


@dataclass
class Index:
    """The unlike windows of a block of items: q-gram hashes in order, and the window and place of each.

    items: the items of every window, one as often as it holds that window.
    """

    hashes: np.ndarray
    window: np.ndarray
    place: np.ndarray
    table: np.ndarray
    items: list[list]
    windows: list[bytes]

    @staticmethod
    def of(items: list[tuple]) -> Index:
        of: dict[bytes, list] = {}
        data, at, _ = fold(Texts(pa.array([t for _, t in items], pa.string())))
        raw = data.tobytes()
        for k, (item, _) in enumerate(items):
            own = raw[at[k] + 1 : at[k + 1]].strip(b" ")
            if len(own) < MIN_WINDOW:
                continue
            starts = [0] if len(own) <= WINDOW else [*range(0, len(own) - WINDOW, WINDOW // 2), len(own) - WINDOW]
            for s in starts:
                of.setdefault(own[s : s + WINDOW], []).append(item)
        windows = list(of)
        found = [grams(np.frombuffer(w, dtype=np.uint8)) for w in windows]
        hashes = np.concatenate([*found, np.zeros(0, U64)])
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        table[hashes >> U64(64 - _FILTER_BITS)] = True
        window = np.repeat(np.arange(len(windows)), [len(f) for f in found])
        place = np.concatenate([*[np.arange(len(f)) for f in found], np.zeros(0, np.int64)]).astype(np.int64)
        return Index(hashes[order], window[order], place[order], table, list(of.values()), windows)

    def hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in data, window and place in the window of every shared q-gram, in runs; a place of data is in one run, its windows and their places in order."""
        for begin in range(0, len(data), PIECE):
            own = grams(data[begin : begin + PIECE + Q - 1])
            at = np.flatnonzero(self.table[own >> U64(64 - _FILTER_BITS)])
            lo = np.searchsorted(self.hashes, own[at], "left")
            n = np.searchsorted(self.hashes, own[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            run = np.cumsum(n) // HITS
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(run)) + 1):
                if len(part):
                    m = n[part]
                    which = np.repeat(lo[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    yield np.repeat(at[part] + begin, m), self.window[which], self.place[which]


def budget(length: int) -> int:
    return int(length * EDIT_SHARE)


def align(windows: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window against any part of its region, band by band, and the end of that part.

    Row i of the table is kept for the places i + d of the region only, d from 0 to the band's width.
    """
    n, w = windows.shape
    width = regions.shape[1] - w + 1
    steps = np.arange(width, dtype=np.int16)
    cost = np.zeros((n, width), dtype=np.int16)
    for i in range(w):
        apart = regions[:, i : i + width] != windows[:, i : i + 1]
        new = cost + apart
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    best = cost.argmin(axis=1)
    return cost[np.arange(n), best], best + w


def _sums(row: np.ndarray, window: np.ndarray, band: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of equal row, window and band as one, their counts summed."""
    order = np.lexsort((band, window, row))
    r, v, b, n = (x[order] for x in (row, window, band, count))
    first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]) | (b[1:] != b[:-1])))
    return r[first], v[first], b[first], np.add.reduceat(n, first)


def banded(index: Index, data: np.ndarray, at: np.ndarray, half: int) -> list[tuple[np.ndarray, ...]]:
    """For either set of bands: row, window and band that share q-grams, and at how many places of the text."""
    found: list[list] = [[], []]
    for place, window, inside in index.hits(data):
        for shift in (0, 1):
            band = (place - inside + shift * half) // (2 * half)
            # the hits of a place come by window and, as places in the window rise, by falling band
            new = np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1]) | (band[1:] != band[:-1]))
            row = np.searchsorted(at, place[new], "right") - 1
            found[shift].append(_sums(row, window[new], band[new], np.ones(len(row), dtype=np.int64)))
    return [_sums(*(np.concatenate(x) for x in zip(*runs, strict=True))) for runs in found if runs]


def scan(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, window, edits, start, end) of every window found; places are bytes of the text as given."""
    texts = Texts(column)
    data, at, source = fold(texts)
    if not index.windows:
        return []
    lengths = np.array([len(w) for w in index.windows])
    edits = (lengths * EDIT_SHARE).astype(np.int64)
    half = int(edits.max()) + 1
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for shift, (r, v, b, count) in enumerate(banded(index, data, at, half)):
        enough = np.flatnonzero(count >= np.maximum(lengths[v] - Q + 1 - edits[v] * Q, 1))
        for length in np.unique(lengths[v[enough]]).tolist():
            alike = enough[lengths[v[enough]] == length]
            margin = budget(length)
            width = length + 2 * half + 2 * margin
            for own in np.split(alike, range(ALIGNED, len(alike), ALIGNED)):
                begin = b[own] * 2 * half - shift * half - margin
                where = begin[:, None] + np.arange(width)
                region = data[np.clip(where, 0, len(data) - 1)]
                lo, hi = at[r[own]][:, None], at[r[own] + 1][:, None]
                region = np.where((where > lo) & (where < hi), region, 0)
                text = np.array([np.frombuffer(index.windows[k], dtype=np.uint8) for k in v[own]]).reshape(len(own), length)
                cost, end = align(text, region)
                for k in np.flatnonzero(cost <= margin):
                    key, stop = (int(r[own][k]), int(v[own][k])), int(begin[k] + end[k])
                    start = max(stop - length, int(lo[k, 0]) + 1)
                    base = int(texts.at[key[0]])
                    hit = (int(cost[k]), int(source[start]) - base, int(source[min(stop, int(hi[k, 0])) - 1]) + 1 - base)
                    out[key] = min(out.get(key, hit), hit)
    return [(*k, *v) for k, v in sorted(out.items())]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of items of at most about BLOCK_BYTES; there is always one."""
    known = benchmark.select("item_id", "text").where("text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        block = known if n == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index.of([(r["item_id"], r["text"]) for r in block.collect()])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each text and item that meet: doc_id, item_id, windows found, least edits, first and last byte."""
    id_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, n_windows long, least_edits long, start_byte long, end_byte long"
    arrow_item = pa.array([], pa.int64()).type if item_kind == "bigint" else None
    found = None
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in sliced(batches, "text"):
                by: dict[tuple, list] = {}
                for row, window, edits, start, end in scan(own, batch.column("text")):
                    for item in own.items[window]:
                        by.setdefault((row, item), []).append((edits, start, end))
                if by:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array([r for r, _ in by], pa.int64())),
                            pa.array([i for _, i in by], arrow_item),
                            *[pa.array([f(x) for x in by.values()], pa.int64()) for f in (len, lambda x: min(e for e, _, _ in x), lambda x: min(s for _, s, _ in x), lambda x: max(e for _, _, e in x))],
                        ],
                        names=["doc_id", "item_id", "n_windows", "least_edits", "start_byte", "end_byte"],
                    )

        part = in_arrow(docs.select("doc_id", "text"), run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item, with the columns of docs."""
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in scan(sent.value, batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = in_arrow(docs, run, T.StructType(docs.schema.fields))
    return docs
