"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

A shard owns the arcs that end at its virtual nodes. A row's key on the ring is the hash of its
text, so copies share an arc. Every shard takes the rows of its own arcs up to its bound; rows that
overflow continue clockwise to the next virtual node whose shard has room. The bounds are the row
count divided by the shards, rounded up for the first ones, so the law `rows` holds: counts are at
most one apart. As the rest of the ring keeps its owners, one more shard moves the rows of its own
arcs and of the overflow only.

Rows are counted by arc and by a salt from their doc_id, so an arc that holds one hot text is
ranked by many tasks. Only arcs x salts counts, a fixed number, reach the driver; texts are hashed
where they are read and never shuffled.

Defined cases: a null text has size 1, checksum 0 and the key of null; ties and repeated rows are
ordered by hash, doc_id and checksum, and rows alike in all of these are interchangeable; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SLOT_BITS = 16
SALTS = 32


def ring(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, in ring order."""
    def slot(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") >> (64 - SLOT_BITS)

    return sorted((slot(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))


def assign(counts: list[int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """For arcs in ring order, the stretches (arc, from, to, shard, first slot) of their ranked rows."""
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    placed, filled, over = [], [0] * n_shards, []

    def put(arc: int, begin: int, end: int, shard: int) -> int:
        k = min(end - begin, room[shard] - filled[shard])
        if k:
            placed.append((arc, begin, begin + k, shard, filled[shard]))
            filled[shard] += k
        return begin + k

    for arc, n in enumerate(counts):
        begin = put(arc, 0, n, owners[arc])
        if begin < n:
            over.append((arc, begin, n))
    for arc, begin, end in over:
        k = arc
        while begin < end:
            k = (k + 1) % len(owners)
            begin = put(arc, begin, end, owners[k])
    return placed


def shard(docs: DataFrame, n_shards: int = 16, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    nodes = ring(n_shards, virtual_nodes)
    slots, arc = [], 0
    for s in range(1 << SLOT_BITS):
        while arc < len(nodes) and nodes[arc][0] < s:
            arc += 1
        slots.append(arc % len(nodes))  # past the last node the ring begins again
    arc_of = F.broadcast(spark.createDataFrame(list(enumerate(slots)), "slot_of_key int, arc int"))
    key = F.xxhash64("text")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        key.alias("key"),
        F.shiftrightunsigned(key, 64 - SLOT_BITS).cast("int").alias("slot_of_key"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = stored(slim.join(arc_of, "slot_of_key").drop("slot_of_key"), "ring-keys")
    counted: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows.groupBy("arc", "salt").count().collect():  # at most arcs x SALTS rows
        counted[r["arc"]][r["salt"]] = r["count"]
    starts = []
    for a, by_salt in counted.items():
        begin = 0
        for salt in sorted(by_salt):
            starts.append((a, salt, begin))
            begin += by_salt[salt]
    stretches = assign([sum(counted[a].values()) for a in range(len(nodes))], [s for _, s in nodes], n_shards)
    start_of = F.broadcast(spark.createDataFrame(starts, "arc int, salt int, begin long"))
    stretch_of = F.broadcast(spark.createDataFrame(stretches, "arc int, lo long, hi long, shard int, first long"))
    within = F.row_number().over(W.partitionBy("arc", "salt").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("within", within).join(start_of, ["arc", "salt"]).withColumn("rank", F.col("begin") + F.col("within"))
    return ranked.join(stretch_of, (ranked["arc"] == stretch_of["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
