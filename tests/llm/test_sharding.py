import zlib
from collections import Counter, defaultdict

import data

from chunklake.llm import sharding


def test_law_rows_slots_and_columns(spark):
    rows = data.documents()
    got = sharding.shard_manifest(data.frame(spark), 7).collect()
    assert len(got) == len(rows)
    n = Counter(r.shard for r in got)
    assert max(n.values()) - min(n.get(s, 0) for s in range(7)) <= 1
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_routes_match_a_sequential_ring(spark):
    """Rows enter one by one in the documented order; a full shard sends them on clockwise."""
    shards, nodes, slots = 5, 8, 256
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(500)]
    df = data.frame(spark, rows)
    from pyspark.sql import functions as F

    key = [F.col("doc_id"), F.xxhash64("text")]
    keyed = df.select("doc_id", sharding.place(slots, *key).alias("place"), F.xxhash64(F.lit(12), *key).alias("hash"))
    got = {r.doc_id: r.shard for r in sharding.routed(keyed, shards, nodes, slots).collect()}
    order = {r.place: r.order for r in sharding.ring(spark, shards, nodes, slots).collect()}
    room = [100] * shards
    for r in sorted(keyed.collect(), key=lambda r: ((r.place * sharding.TURN) % slots, r.hash)):
        s = next(s for s in order[r.place] if room[s])
        room[s] -= 1
        assert got[r.doc_id] == s


def test_the_ring_goes_clockwise(spark):
    """Each place's list of shards, told from where the shards stand."""
    from pyspark.sql import functions as F

    shards, nodes, slots = 6, 5, 128
    own = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("node"))
    stands = defaultdict(set)
    for r in own.select("shard", sharding.place(slots, F.col("shard"), F.col("node")).alias("place")).collect():
        stands[r.shard].add(r.place)
    rows = sharding.ring(spark, shards, nodes, slots).collect()
    assert sorted(r.place for r in rows) == list(range(slots)) and sorted(r.turn for r in rows) == list(range(slots))
    for r in rows:
        way = [min((p - r.place) % slots for p in stands[s]) for s in r.order]
        assert sorted(r.order) == list(range(shards)) and way == sorted(way)


def test_little_moves_when_a_shard_is_added(spark):
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(4000)]
    df = data.frame(spark, rows)
    a = {r.doc_id: r.shard for r in sharding.shard_manifest(df, 24).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_manifest(df, 25).collect()}
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.12


def test_table_keeps_rows_and_replaces_clashing_columns(spark):
    df = data.frame(spark)
    out = sharding.shard_table(df, 4)
    assert sorted(out.columns) == sorted([*df.columns, "slot"])
    assert out.count() == df.count() and out.select("shard").distinct().count() == 4
    assert sharding.shard_manifest(data.empty(spark), 4).count() == 0
    assert sharding.shard_manifest(data.frame(spark, data.documents()[:2]), 24).count() == 2
