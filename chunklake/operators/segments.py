"""Segments: packing, offsets, byte accounting, bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.operators.latest import with_liveness
from chunklake.schema import KEY, SEGMENT_HEADER, dims


def prefix_sum(df: DataFrame, value: str, name: str, block: int = 1 << 14) -> DataFrame:
    """df with the sum of value over all smaller gens (of the dimension) as ``name``.

    In two levels: within ranges of gen, and over the ranges' totals, so that no task sorts the whole log.
    """
    d = dims(df)
    x = df.withColumn("__b", F.floor(F.col("gen") / block))
    totals = x.groupBy(*d, "__b").agg(F.sum(value).alias("__t"))
    before = W.partitionBy(*d).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*d, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    inside = W.partitionBy(*d, "__b").orderBy("gen").rowsBetween(W.unboundedPreceding, -1)
    return x.join(starts, [*d, "__b"]).withColumn(name, F.col("__s") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__b", "__s")


def floor_packed(df: DataFrame, size: int) -> DataFrame:
    """df with seg: records are packed by the bytes before them, in segments of ``size`` bytes (no carry)."""
    return prefix_sum(df, "rb", "before").withColumn("seg", F.floor(F.col("before") / size)).drop("before")


def greedy_packed(df: DataFrame, size: int) -> DataFrame:
    """gen and seg of each record as the append path packs them: a segment closes once header and records reach ``size``.

    This is sequential: where a segment ends decides where the next begins. A task takes a dimension's (gen, bytes), 16
    bytes per record, and steps from segment to segment by binary search in the running sum.
    """
    d = dims(df)
    fields = [(c, t) for c, t in df.dtypes if c in (*d, "gen")]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("gen")
        total = np.cumsum(table["rb"].to_numpy().astype(np.int64))
        seg = np.zeros(len(total), np.int64)
        start, base, k = 0, 0, 1
        while start < len(total):
            last = int(np.searchsorted(total, base + size - SEGMENT_HEADER, side="left"))  # the record that fills it
            end = min(last + 1, len(total))
            seg[start:end] = k
            start, base, k = end, int(total[end - 1]), k + 1
        return table.select([c for c, _ in fields]).append_column("seg", pa.array(seg))

    schema = ", ".join(f"{c} {t}" for c, t in fields) + ", seg bigint"
    slim = df.select(*d, "gen", "rb")
    return (slim.groupBy(*d) if d else slim.groupBy()).applyInArrow(pack, schema)


def with_offsets(df: DataFrame) -> DataFrame:
    """Each record's offset in its segment file."""
    before = W.partitionBy(*dims(df), "seg").orderBy("gen").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.lit(SEGMENT_HEADER) + F.coalesce(F.sum("rb").over(before), F.lit(0)))


def segment_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(*dims(df), "seg").agg(F.sum("rb").alias("total_bytes"), F.count(F.lit(1)).alias("records"))


def live_bytes(df: DataFrame) -> DataFrame:
    """Live and total bytes of each segment; a segment without live records has 0."""
    x = with_liveness(df)
    return x.groupBy(*dims(df), "seg").agg(F.sum(F.when(F.col("live"), F.col("rb")).otherwise(0)).alias("live_bytes"), F.sum("rb").alias("total_bytes"))


def store_stats(df: DataFrame) -> DataFrame:
    return live_bytes(df).agg(F.sum("live_bytes").alias("live_bytes"), F.sum("total_bytes").alias("total_bytes"), F.count(F.lit(1)).alias("segments"))


def triage(df: DataFrame) -> DataFrame:
    """For each segment: live and corrupt latest records, dead records and bytes."""
    x = with_liveness(df)
    when = lambda c, v: F.sum(F.when(c, v).otherwise(F.lit(0)))
    live, bad = F.col("live"), F.col("corrupt")
    return x.groupBy(*dims(df), "seg").agg(
        when(live & ~bad, F.lit(1)).alias("live"),
        when(live & bad, F.lit(1)).alias("corrupt_latest"),
        when(~live, F.lit(1)).alias("dead"),
        when(~live, F.col("rb")).alias("dead_bytes"),
        when(live, F.col("rb")).alias("live_bytes"),
        F.sum("rb").alias("total_bytes"),
        F.min("epoch_ts").alias("created_epoch"),
    )


def bitmaps(df: DataFrame) -> DataFrame:
    """Each segment's existence map per known type: 1024 places, coordinates folded by 32."""
    place = F.col("x").bitwiseAND(31) * 32 + F.col("z").bitwiseAND(31)
    return df.where(F.col("type_id") < 3).groupBy(*dims(df), "seg", "type_id").agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))


def region_bitmap(df: DataFrame) -> DataFrame:
    """Set bits of each segment's existence map per known type."""
    return bitmaps(df).select(*dims(df), "seg", "type_id", F.bitmap_count("bits").alias("bits"))


def may_hold(df: DataFrame, maps: DataFrame, x: int, z: int, type_id: int) -> DataFrame:
    """Segments whose map (of ``bitmaps``) can hold a key: no false negatives, and unknown types always may be there."""
    if type_id > 2:
        return df.select(*dims(df), "seg").distinct()
    place = (x & 31) * 32 + (z & 31)
    byte = F.conv(F.hex(F.substring("bits", place // 8 + 1, 1)), 16, 10).cast("int")
    return maps.where((F.col("type_id") == type_id) & (byte.bitwiseAND(1 << place % 8) != 0)).select(*dims(maps), "seg")


def sort_violations(df: DataFrame) -> DataFrame:
    """Neighbours (by gen) in a segment whose keys are not strictly ascending."""
    key = F.struct(*KEY)
    order = W.partitionBy(*dims(df), "seg").orderBy("gen")
    return df.withColumn("bad", F.lag(key).over(order) >= key).groupBy(*dims(df), "seg").agg(F.count_if("bad").alias("violations"))


def index_delta(df: DataFrame) -> DataFrame:
    """x minus the x before it in a page's key order."""
    order = W.partitionBy(*dims(df), "seg").orderBy(*KEY, "gen")
    return df.withColumn("dx", F.col("x") - F.coalesce(F.lag("x").over(order), F.lit(0)))


def next_gen(df: DataFrame, persisted: int) -> DataFrame:
    return df.agg(F.greatest(F.max("gen") + 1, F.lit(persisted)).alias("next_gen"))
