"""Chunking as a DataFrame operator: documents in, blocks out.

The structural scan runs in Arrow batches, one document after another; hashes and identities are
Columns over what it yields. Occurrences of equal blocks are counted within the document where it
is scanned, so no shuffle is needed. Long documents are dealt out by hash before they are scanned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity, validate
from ..functions.text import Utf16, json_text
from ..functions.validate import ChunkOptions
from . import chunker
from .tokenizers import Tokenizer

# How the chunker names itself in a block's metadata.
CHUNKER_ID, CHUNKER_VERSION = "blockwise-structural", "1"
CHUNKS = "ordinal int, headingPath array<string>, headingJson string, occurrence int, startOffset long, endOffset long, startLine int, endLine int, content string, tokenCount long"


def invalid_sources() -> list[Column]:
    """Rules for what may be chunked: Markdown whose content still has the hash it was ingested with."""
    return [
        validate.unless(F.col("sourceType") == "markdown", ["document", "sourceType"], "must be markdown", "invalid_source_type"),
        validate.unless(identity.digest("content") == F.col("contentHash"), ["content"], "must match document.contentHash", "content_hash_mismatch"),
    ]


def scanned(content: str, title: str | None, tokenizer: Tokenizer, options: ChunkOptions) -> Iterator[tuple]:
    """The values of CHUNKS for each chunk of one document."""
    utf16, seen = Utf16(content), Counter()
    for k, c in enumerate(chunker.chunk(content, title, tokenizer, options)):
        text = content[c.start : c.end]
        path = list(c.headings) or None
        same = (c.headings, text.replace("\r\n", "\n").replace("\r", "\n"))
        yield k, path, json_text(path) if path else None, seen[same], utf16(c.start), utf16(c.end), c.first_line, c.last_line, text, c.tokens
        seen[same] += 1


def chunk(documents: DataFrame, tokenizer: Tokenizer, options: ChunkOptions, partitions: int | None = None) -> DataFrame:
    """Blocks of documents (as ingest() returns them), with flat location columns."""
    validate.check_tokenizer(tokenizer)
    keep = ["id", "tenantId", "workspaceId", "projectId", "sourceType", "createdAt", "updatedAt", "metadata"]
    given = documents.select(*keep, "title", "content")
    if partitions:
        given = given.repartition(partitions, F.xxhash64("id"))
    out = T.StructType([given.schema[c] for c in keep] + T.StructType.fromDDL(CHUNKS).fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = pa.schema(list(to_arrow_schema(out))[len(keep) :])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, owner = [], []
                for k, (content, title) in enumerate(zip(part.column("content").to_pylist(), part.column("title").to_pylist(), strict=True)):
                    found = list(scanned(content or "", title, tokenizer, options))
                    rows += found
                    owner += [k] * len(found)
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(owner, pa.int64())) for c in keep] + columns, names=out.names)

    blocks = given.mapInArrow(run, out).withColumnRenamed("id", "sourceDocumentId")
    blocks = blocks.withColumn("normalizedContentHash", identity.normalised_hash("content"))
    blocks = blocks.withColumn("id", identity.block_id("sourceDocumentId", F.col("headingJson"), "normalizedContentHash", "occurrence"))
    oversized = F.when(F.col("tokenCount") > options.maxTokens, F.lit(',"oversized":true')).otherwise("")
    about = F.concat(
        F.lit('{"source":'), F.coalesce("metadata", F.lit("{}")), F.lit(f',"chunking":{{"chunkerId":{json_text(CHUNKER_ID)},"chunkerVersion":{json_text(CHUNKER_VERSION)}'), oversized,
        F.lit(f'}},"tokenization":{{"tokenizerId":{json_text(tokenizer.id)},"tokenizerVersion":{json_text(tokenizer.version)}}}}}'),
    )
    return blocks.withColumn("schemaVersion", F.lit(1)).withColumn("kind", F.lit("text-range")).withColumn("metadata", about).drop("headingJson")


def lines(documents: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """Every line as the chunker sees it: key, line (from 1), startOffset and endOffset in UTF-16 units, and its kind."""
    out = T.StructType([documents.schema[key], *T.StructType.fromDDL("line long, startOffset long, endOffset long, lineKind string").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows, owner = batch.slice(at, 256), [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    utf16 = Utf16(text or "")
                    found = [(n, utf16(x.start), utf16(x.end), chunker.line_kind(x.text)) for n, x in enumerate(chunker.scan_lines(text or ""), 1)]
                    rows += found
                    owner += [k] * len(found)
                columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns], names=out.names)

    return documents.select(key, content).mapInArrow(run, out)


def chunk_checked(documents: DataFrame, tokenizer: Tokenizer, options: ChunkOptions) -> tuple[DataFrame, DataFrame]:
    """Blocks of the documents that may be chunked, and the others with their issues."""
    good, bad = validate.split(documents, invalid_sources())
    return chunk(good, tokenizer, options), bad
