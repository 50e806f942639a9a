import zlib
from collections import Counter

import pytest

from blockwise.llm import sharding

SCHEMA = "doc_id long, text string, shard int, Size long"


def test_rows_law_and_slots(spark):
    rows = [(i, f"text {i}" if i % 3 else "copy", 1, 1) for i in range(3000)] + [(None, None, 1, 1), (7, "", 1, 1), (8, "é" * 5000, 1, 1), (8, "é" * 5000, 1, 1)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    again = sharding.shard(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), 16).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in again)


@pytest.mark.parametrize("n_shards", [3, 16])
def test_equals_a_plain_ring_walk(spark, n_shards):
    """Row by row: every node takes its own rows up to its shard's bound, then what is left over walks on."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 900}", 1, 1) for i in range(1500)] + [(None, None, 1, 1), (9, "", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    hashed = df.selectExpr("doc_id", "text", "xxhash64(text) AS k", f"pmod(xxhash64(doc_id, text), {sharding.SALTS}) AS salt").collect()
    nodes = sharding.ring(n_shards, 64)

    def arc(key):
        slot = (key % 2**64) >> (64 - sharding.SLOT_BITS)
        return next((a for a, (s, _) in enumerate(nodes) if s >= slot), 0)

    in_order = sorted(hashed, key=lambda r: (arc(r.k), r.salt, r.k, r.doc_id is not None, r.doc_id or 0))
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    want, over = Counter(), []
    for r in in_order:
        own = nodes[arc(r.k)][1]
        if room[own]:
            room[own] -= 1
            want[r.doc_id, own] += 1
        else:
            over.append(r)
    for r in over:
        a = arc(r.k)
        while not room[nodes[a][1]]:
            a = (a + 1) % len(nodes)
        room[nodes[a][1]] -= 1
        want[r.doc_id, nodes[a][1]] += 1
    assert over and Counter((r.doc_id, r.shard) for r in sharding.shard(df, n_shards).collect()) == want


def test_one_more_shard_moves_a_small_part(spark):
    df = spark.createDataFrame([(i, f"text {i}", 1, 1) for i in range(4000)], SCHEMA)
    was, now = ({r.doc_id: r.shard for r in sharding.shard(df, n).collect()} for n in (16, 17))
    assert sum(was[k] != now[k] for k in was) < 0.4 * len(was)


def test_copies_stay_together_where_bounds_allow(spark):
    df = spark.createDataFrame([(i, f"text {i // 4}", 1, 1) for i in range(4000)], SCHEMA)
    by_text = {}
    for r in sharding.shard(df, 4).collect():
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(v) == 1 for v in by_text.values()) > 0.9 * len(by_text)


def test_fewer_rows_than_shards_and_none(spark):
    assert len(sharding.shard(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA), 16).collect()) == 1
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 16).collect() == []
