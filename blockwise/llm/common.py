"""What the operators of this subpackage share: shared-folder tables and byte-sized batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table of a few longs may be broadcast (about 16 MB); beyond it the plan shuffles.
BROADCAST_ROWS = 500_000
#: Bytes, by count of its numbers, up to which a stored table is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of text that one numpy step holds; its arrays take some forty times as much.
CHUNK_BYTES = 512 << 10
#: Bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 2 << 20
BATCH_CONF, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where none is named."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.blockwise.localDir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="blockwise-")
    spark.conf.set("spark.blockwise.localDir", own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/blockwise-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._blockwise_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._blockwise_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are finished and no longer held."""
    spark._jvm.System.gc()


def small_or_not(df: DataFrame) -> DataFrame:
    """Mark a stored table of numbers and arrays of them for broadcast if it is counted to be small; otherwise the join shuffles."""
    wide = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    width = [len(f.dataType.elementType.fields) if isinstance(f.dataType.elementType, T.StructType) else 1 for f in wide]
    rows, *inner = df.agg(F.count("*"), *[F.coalesce(F.sum(F.size(f.name)), F.lit(0)) for f in wide]).first()
    longs = rows * sum(len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 1 for f in df.schema.fields) + sum(n * w for n, w in zip(inner, width, strict=True))
    return F.broadcast(df) if 8 * longs <= BROADCAST_BYTES else df


def in_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in batches of some BATCH_BYTES, unless the session names another bound than Spark's default of 64 MB."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, DEFAULT_BATCH) == DEFAULT_BATCH:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that a Python worker has freed to the system, as workers wait for further tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose column holds about `most` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()
