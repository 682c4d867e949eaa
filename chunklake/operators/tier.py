"""Tiering: stable regions, promotion, invalidation, demotion, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.operators.latest import assigned, latest, region_project
from chunklake.schema import dims, keys

STABLE_FLUSHES, DEMOTE_RATIO = 30, 0.25


def _region(df: DataFrame) -> list[str]:
    return [*dims(df), "rx", "rz"]


def region_last_write(df: DataFrame) -> DataFrame:
    """Live slots of each region and the epoch of its last live write."""
    x = region_project(latest(df.select(*keys(df), "gen", "epoch_ts")))
    return x.groupBy(*_region(x)).agg(F.count(F.lit(1)).alias("slots"), F.max("epoch_ts").alias("last_write"))


def stable_regions(df: DataFrame, epoch: DataFrame, flushes: int = STABLE_FLUSHES) -> DataFrame:
    """Regions not written for ``flushes`` epochs. epoch: one row, one column."""
    return region_last_write(df).crossJoin(F.broadcast(epoch)).withColumn("stable", F.col("last_write") + flushes <= F.col("epoch"))


def promote_plan(df: DataFrame, stable: DataFrame) -> DataFrame:
    """Rows that become cold slots: live rows of stable regions in which every live row can be read."""
    x = region_project(latest(df))
    unreadable = x.where("corrupt").select(*_region(x)).distinct()
    own = stable.where("stable").select(*_region(x)).join(unreadable, _region(x), "left_anti")
    return x.join(own, _region(x), "left_semi")


def cold_slots(df: DataFrame, stable: DataFrame) -> DataFrame:
    """All live rows of the stable regions, in their slots."""
    x = region_project(latest(df))
    return x.join(stable.where("stable").select(*_region(x)), _region(x), "left_semi")


def invalidated(cold: DataFrame, writes: DataFrame) -> DataFrame:
    """Cold slots that later writes supersede: each once, however often it is written."""
    k = keys(cold)
    return cold.select(*k, "rx", "rz").join(writes.select(*k), k, "left_semi")


def invalid_ratio(cold: DataFrame, invalid: DataFrame) -> DataFrame:
    """Slots and invalid slots of each cold region; a region without invalid slots has 0."""
    k = keys(cold)
    marked = cold.select(*k, "rx", "rz").join(invalid.select(*k, F.lit(1).alias("bad")), k, "left")
    per = marked.groupBy(*_region(cold)).agg(F.count(F.lit(1)).alias("total_slots"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_slots"))
    return per.withColumn("ratio", F.col("invalid_slots") / F.col("total_slots"))


def demote_candidates(cold: DataFrame, invalid: DataFrame, ratio: float = DEMOTE_RATIO) -> DataFrame:
    return invalid_ratio(cold, invalid).where((F.col("total_slots") > 0) & (F.col("ratio") > ratio))


def demote_writeback(cold: DataFrame, invalid: DataFrame, head: DataFrame, ratio: float = DEMOTE_RATIO) -> DataFrame:
    """Valid slots of demoted regions as new writes: new version numbers, the current epoch. head: one row: base, epoch."""
    k = keys(cold)
    r = demote_candidates(cold, invalid, ratio).select(*_region(cold))
    back = cold.join(r, _region(cold), "left_semi").join(invalid.select(*k), k, "left_anti")
    return assigned(back.crossJoin(F.broadcast(head)), F.col("base"), ["gen"]).withColumn("epoch_ts", F.col("epoch"))


def tier_stats(cold: DataFrame, invalid: DataFrame, ratio: float = DEMOTE_RATIO) -> DataFrame:
    x = invalid_ratio(cold, invalid).withColumn("over", F.col("ratio") > ratio)
    size = cold.groupBy(*_region(cold)).agg(F.sum("rb").alias("bytes"))
    return x.join(size, _region(cold)).agg(F.count_if("over").alias("demoted"), F.count_if(~F.col("over")).alias("kept"), F.coalesce(F.sum(F.when(~F.col("over"), F.col("bytes"))), F.lit(0)).alias("cold_bytes"))


def reconciled(registered: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest against files (rx, rz, readable): add, delete or drop; what agrees is kept."""
    r = [*dims(registered), "rx", "rz"]
    x = registered.select(*r, F.lit(True).alias("listed")).join(files.select(*r, "readable"), r, "full_outer")
    action = F.when(F.col("listed").isNotNull() & F.col("readable").isNotNull(), "keep").when(F.col("listed").isNotNull(), "drop").when(F.col("readable"), "add").otherwise("delete")
    return x.withColumn("action", action).select(*r, "action")


def replayable(log: DataFrame, segment_sizes: DataFrame, cold_regions: DataFrame) -> DataFrame:
    """Log entries to apply: their segment exists and holds them whole, and their region isn't cold."""
    d = dims(log)
    x = region_project(log.join(segment_sizes.select(*d, "seg", "size"), [*d, "seg"]))
    whole = (F.col("offset") < F.col("size")) & (F.col("offset") + F.col("rb") <= F.col("size"))
    return x.where(whole).join(cold_regions.select(*_region(x)), _region(x), "left_anti")


def cold_point_read(cold: DataFrame, invalid: DataFrame, x: int, z: int, type_id: int) -> DataFrame:
    """The cold slot of one key; no row if there is none or if it is invalid. Only the key's region is read."""
    key = (F.col("x") == x) & (F.col("z") == z) & (F.col("type_id") == type_id)
    own = cold.where((F.col("rx") == x >> 5) & (F.col("rz") == z >> 5) & key)
    return own.join(invalid.where(key).select("x", "z", "type_id"), ["x", "z", "type_id"], "left_anti")
