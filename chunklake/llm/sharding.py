"""Sharding by a consistent-hash ring with virtual nodes and bounded loads; law ``rows``.

The ring has SLOTS places. Every shard stands at ``nodes`` hashed places; a row's key is hashed to a place and belongs to
the shard that stands first at or after it (clockwise). Loads are bounded: with n rows, a shard holds n div shards, the
first n mod shards one more. Rows enter in one fixed order, by the turn of their place and the rank of their hash there;
a row whose shard is full goes on clockwise to the next shard that is not. So counts differ by one at most, and another
shard takes most of its rows from the ring places that it enters.

How it is computed: only the counts of the SLOTS places (a bound that no data exceed) meet in one task, where a fold
finds when each shard became full: turn and rank. Each row then finds its shard alone, from its place's clockwise
list of shards and those moments. The number of a row in its shard is its rank at its place plus the offset of the place
in the shard. Rows of one place are ranked together, n / SLOTS of them: a table with more than about 10^12 rows needs a
larger ``slots``.

The key is doc_id and text together, so that a large group of equal texts is spread over all places and shards: the law ``rows``
leaves no room for keeping such a group in one shard.

Cases: null text has no bytes; null doc_id is a key like any other; rows equal in id and text are interchangeable; with
fewer rows than shards the last shards stay empty; other columns aren't read (shard_table keeps them; its columns shard and
slot replace input columns of these names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.llm.common import plain, replacing, text_bytes, written

SLOTS = 16384
NODES = 256
#: Odd, so that multiplying by it only reorders the places.
TURN = 40503


def place(slots: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *key), F.lit(slots)).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int = NODES, slots: int = SLOTS) -> DataFrame:
    """place, turn and order (the shards from that place clockwise) for each place. Its size does not depend on data."""
    own = [(F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards).cast("int")]
    stands = spark.range(shards * nodes).select(own[0].alias("shard"), place(slots, *own).alias("place")).distinct()
    grid = spark.range(shards * slots).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("place"))
    grid = grid.join(stands.withColumn("stand", F.col("place")), ["shard", "place"], "left")
    onward = W.partitionBy("shard").orderBy(F.col("place").desc()).rowsBetween(W.unboundedPreceding, 0)
    next_stand = F.coalesce(F.min("stand").over(onward), F.min("stand").over(W.partitionBy("shard")) + slots)
    near = grid.withColumn("next", next_stand).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("next", F.xxhash64("next", "shard").alias("tie"), "shard"))).alias("near"))
    return near.select("place", ((F.col("place").cast("long") * TURN) % slots).cast("int").alias("turn"), F.col("near.shard").alias("order"))


def fill_moments(counts: DataFrame, shards: int) -> DataFrame:
    """One row: full, the moment (turn, rank) from which each shard takes no more. counts: turn, order, n."""
    never = f"named_struct('turn', {2**31 - 1}, 'rank', 0L)"
    total, base = "total", f"cast(floor(total / {shards}) as bigint)"
    start = f"""named_struct(
        'room', transform(sequence(0, {shards - 1}), s -> {base} + if(s < {total} % {shards}, 1L, 0L)),
        'full', transform(sequence(0, {shards - 1}), s -> if({base} + if(s < {total} % {shards}, 1L, 0L) = 0L, named_struct('turn', -1, 'rank', 0L), {never})))"""
    step = """aggregate(p.order, named_struct('room', a.room, 'full', a.full, 'left', p.n),
        (b, s) -> if(b.left = 0L or b.room[s] = 0L, b, named_struct(
            'room', transform(b.room, (r, i) -> if(i = s, r - least(r, b.left), r)),
            'full', if(b.room[s] > b.left, b.full, transform(b.full, (f, i) -> if(i = s, named_struct('turn', p.turn, 'rank', p.n - b.left + b.room[s]), f))),
            'left', b.left - least(b.room[s], b.left))),
        b -> named_struct('room', b.room, 'full', b.full))"""
    one = counts.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("turn", "n", "order"))).alias("places"))
    return one.select(F.expr(f"aggregate(places, {start}, (a, p) -> {step}, a -> a.full)").alias("full"))


def routed(keyed: DataFrame, shards: int, nodes: int = NODES, slots: int = SLOTS) -> DataFrame:
    """keyed (place, hash, and columns to keep) with shard and slot."""
    spark = keyed.sparkSession
    places = written(ring(spark, shards, nodes, slots), "ring")
    counts = keyed.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    full = written(fill_moments(counts.join(places, "place"), shards), "ring-full")
    # places and full are of a size that only shards and slots set
    where = places.join(F.broadcast(full))
    others = [c for c in keyed.columns if c not in ("place", "hash")]
    rank = F.row_number().over(W.partitionBy("place").orderBy("hash")) - 1
    row = keyed.withColumn("rank", rank.cast("long")).join(F.broadcast(where), "place")
    shard = F.expr("filter(order, s -> full[s].turn > turn or (full[s].turn = turn and rank < full[s].rank))[0]")
    row = row.withColumn("shard", shard).select(*others, "place", "turn", "rank", "shard")
    pieces = row.groupBy("place", "turn", "shard").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select("place", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("offset"))
    return row.join(F.broadcast(offsets), ["place", "shard"]).select(*others, "shard", (F.col("rank") + F.col("offset")).alias("slot"))


def shard_manifest(docs: DataFrame, shards: int = 24, nodes: int = NODES, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    crc = F.crc32(plain(F.col("text")).cast("binary"))
    key = [F.col("doc_id"), F.xxhash64(plain(F.col("text")))]
    slim = docs.select("doc_id", (text_bytes(F.col("text")) + 8).alias("size"), crc.alias("text_crc32"), place(slots, *key).alias("place"), F.xxhash64(F.lit(12), *key).alias("hash"))
    x = routed(written(slim, "shard-slim"), shards, nodes, slots)
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_table(docs: DataFrame, shards: int = 24, nodes: int = NODES, slots: int = SLOTS) -> DataFrame:
    """docs with shard and slot. The texts are shuffled once, to rank the rows of a place."""
    key = [F.col("doc_id"), F.xxhash64(plain(F.col("text")))]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, place(slots, *key).alias("place"), F.xxhash64(F.lit(12), *key).alias("hash"))
    x = routed(keyed, shards, nodes, slots)
    return replacing(x.select("row.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), shard=F.col("__shard"), slot=F.col("__slot")).drop("__shard", "__slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """One folder for each shard, shard=0, shard=1, ..."""
    shard_table(docs, shards, **options).repartition("shard", F.floor(F.col("slot") / 1_000_000)).write.partitionBy("shard").parquet(path)
