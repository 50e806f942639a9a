"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunks of all ids
that have one, a bitmap of which of them continue at the next level, and a rank directory (the set
bits before every block of 512), so that the place of an id's next chunk is one rank away: any
token, or any run of tokens, is read without decoding what stands before it.

A file, little-endian: `DAC1`; n_docs, n_ids and levels as u64; doc ids as i64, a byte each for a
null doc id, and n_docs + 1 offsets as u64; then by level the count as u64, the chunks, the bitmap
and the directory as u64. Files hold at most some IDS_PER_FILE ids (a longer text has its own), and
their names sort as the documents do: ascending doc id, nulls first, equal ids by the text.

Executors write a file under another name and then rename it, so a repeated or a lost task leaves
whole files only. Files go to any store that pyarrow.fs opens by URI.

Defined cases: a null or empty text is the end id alone; repeated rows are written each; a null
doc_id comes first and is read back as null; an empty table writes no file; doc_id must be a whole
number; only doc_id and text are read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_arrow, shared_path, sliced, small_or_not, stored
from .tokens import encoder, with_end

IDS_PER_FILE = 1_000_000
BLOCK = 512


def _ranks(bits: np.ndarray, n: int) -> np.ndarray:
    """Set bits before each block of BLOCK, and in all."""
    padded = np.zeros(-(-max(n, 1) // BLOCK) * BLOCK // 8, dtype=np.uint8)
    padded[: len(bits)] = bits
    return np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64))]).astype("<u8")


def encode_file(doc_ids: np.ndarray, nulls: np.ndarray, at: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> 8
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        levels += [np.array([len(rest)], "<u8").tobytes(), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), _ranks(bits, len(rest)).tobytes()]
        rest = more[goes_on]
    head = np.array([len(doc_ids), len(ids), len(levels) // 4], "<u8").tobytes()
    return b"".join([b"DAC1", head, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), at.astype("<u8").tobytes(), *levels])


class TokenFile:
    """Random access to one file's tokens."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != b"DAC1":
            raise ValueError("not a file of directly addressable codes")
        self.raw, self.place = raw, 4
        self.n_docs, self.n_ids, n_levels = self._read("<u8", 3).tolist()
        self.doc_ids, self.nulls, self.at = self._read("<i8", self.n_docs), self._read("u1", self.n_docs), self._read("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._read("<u8", 1)[0])
            self.levels.append((self._read("u1", n), self._read("u1", -(-n // 8)), self._read("<u8", -(-max(n, 1) // BLOCK) + 1)))

    def _read(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype=kind, count=n, offset=self.place)
        self.place += out.nbytes
        return out

    @staticmethod
    def rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // BLOCK
        part = bits[block * BLOCK // 8 : i // 8]
        last = int(bits[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(directory[block]) + int(np.bitwise_count(part).sum()) + last.bit_count()

    def token(self, i: int) -> int:
        out = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(bits, directory, i)
        return out

    def run(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b, b excluded: one stretch of each level."""
        out, where = np.zeros(b - a, dtype="<u4"), np.arange(b - a)
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not on.any():
                break
            where, a, b = where[on], self.rank(bits, directory, a), self.rank(bits, directory, b)
        return out


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = 2) -> DataFrame:
    """Write all texts' ids to `folder`; returns a stored row (part, file, n_ids) for each file."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            doc_ids, nulls, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            name = f"{root}/{part:07d}-{number:05d}.dac"
            own = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(encode_file(doc_ids, nulls, np.concatenate([[0], np.cumsum(sizes)]), ids))
            store.move(own, name)
            number += 1
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": pa.array([number - 1], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

        for batch in sliced(batches, "text"):
            ids, at = with_end(*coder.encode(batch.column("text")), end)
            of = batch.column("doc_id")
            held.append((pc.fill_null(of, 0).to_numpy(), of.is_null().to_numpy(zero_copy_only=False), np.diff(at), ids))
            if sum(len(x[3]) for x in held) >= IDS_PER_FILE:
                yield flush()
        if held:
            yield flush()

    return stored(in_arrow(ordered, run, "part long, file long, n_ids long"), "token-files")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    before = by_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("file")) - F.col("n_ids")
    base = small_or_not(stored(files.join(before, "part").select("part", "file", (F.col("before") + inside).alias("base")), "token-starts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                part, number = map(int, re.search(r"(\d+)-(\d+)\.dac$", path).groups())
                own = TokenFile(raw.as_buffer())
                sums = [zlib.crc32(own.run(a, b).tobytes()) for a, b in zip(own.at[:-1].tolist(), own.at[1:].tolist(), strict=True)]
                n = own.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.doc_ids, mask=own.nulls.astype(bool)), pa.array(own.at[:-1]), pa.array(np.diff(own.at)), pa.array(sums, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64())],
                    names=["doc_id", "own_start", "n_tokens", "ids_crc32", "part", "file"],
                )

    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    found = in_arrow(raw, run, "doc_id long, own_start long, n_tokens long, ids_crc32 long, part long, file long")
    return found.join(base, ["part", "file"]).select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    folder = shared_path(docs.sparkSession, "dac")
    return read(docs.sparkSession, folder, write(docs, folder, vocabulary, end))
