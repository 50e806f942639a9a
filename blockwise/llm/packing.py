"""Best-fit packing of token sequences: bounded-space online best fit.

A text's ids and the end id form one piece if they fit a sequence; longer texts are cut into full
pieces, the first of which may be shorter. Pieces reach a packer in the order of a hash, which
mixes lengths. A packer holds a fixed number of open sequences, found by a bitset keyed by free
space: a piece goes where the least room that suffices is left; when it fits nowhere and the number
of open sequences is reached, the fullest is closed. Every piece is packed; nothing is dropped.

Texts never leave the task that reads them: the pieces' five numbers are shuffled, to one packer
for every PIECES_PER_PACKER pieces, so the loss at the packers' ends stays a small share at any size.

Defined cases: a null or empty text is one piece of the end id; repeated rows are packed each by
itself; a null doc_id stays null; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, in_arrow, sliced, stored
from .tokens import encoder, with_end

PIECES_PER_PACKER = 400_000


class BestFit:
    """Open sequences by free space; `bits` has bit f where one with f free tokens is open."""

    def __init__(self, size: int, open_most: int) -> None:
        self.size, self.open_most = size, open_most
        self.bits, self.open, self.begun = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that a piece goes to, and its offset there."""
        fitting = self.bits >> length
        if fitting and length < self.size:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.begun
            self.begun += 1
            if length < self.size and self.open == self.open_most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - free


def cut_lengths(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n ids each: owner, start and length of every piece."""
    pieces = np.maximum(-(-n // size), 1)
    owner = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * size
    start = np.where(number == 0, 0, first[owner] + (number - 1) * size)
    return owner, start, np.where(number == 0, first[owner], size)


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end: int, size: int) -> DataFrame:
    """Every piece of every text, with the checksum of its ids."""
    slim = docs.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in sliced(batches, "text", CHUNK_BYTES // 2):
            ids, at = with_end(*coder.encode(batch.column("text")), end)
            owner, start, length = cut_lengths(np.diff(at), size)
            begin = (at[owner] + start) * 4
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return in_arrow(slim, run, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, vocabulary: str, end: int = 2, size: int = 1024, open_most: int = 1024) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = stored(pieces(docs, vocabulary, end, size), "pieces")
    packers = max(1, -(-cut.count() // PIECES_PER_PACKER))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    spread = cut.repartition(packers, key).sortWithinPartitions(key, "doc_id", "piece", "ids_crc32")
    out = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(size, open_most), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(k) for k in batch.column("length").to_pylist()]
            more = [pa.array([base + number for number, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=out.names)

    return in_arrow(spread, run, out)
