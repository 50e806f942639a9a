"""Chunking a stream of sources: stateless, so every micro-batch is the batch operator."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.validate import ChunkOptions
from ..operators.chunk import chunk
from ..operators.tokenizers import Tokenizer
from ..sources.ingest import INPUT, ingest


def chunk_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, tokenizer: Tokenizer, options: ChunkOptions, available_now: bool = True) -> StreamingQuery:
    """Ingest and chunk source rows that land as Parquet in a folder; blocks are appended as Parquet."""
    sources = spark.readStream.schema(INPUT).parquet(landing)
    writer = chunk(ingest(sources), tokenizer, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
