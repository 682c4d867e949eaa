"""Versions: projections and filters of a log, latest version of each key, history, point and layered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.schema import KEY, REGION_MASK, REGION_SHIFT, TYPES, dims, keys


def region_project(df: DataFrame) -> DataFrame:
    """Adds the 32 x 32 region of each record and its place in it."""
    return df.withColumns(
        {
            "rx": F.shiftright("x", REGION_SHIFT),
            "rz": F.shiftright("z", REGION_SHIFT),
            "x_rel": F.col("x").bitwiseAND(REGION_MASK),
            "z_rel": F.col("z").bitwiseAND(REGION_MASK),
        }
    )


def abs_coords(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("rx") * 32 + F.col("x_rel"), "z": F.col("rz") * 32 + F.col("z_rel")})


def relative(coordinate: Column, region: Column) -> Column:
    """The place of a coordinate in a region, null outside it."""
    r = coordinate - region * 32
    return F.when(r.between(0, 31), r)


def without_corrupt(df: DataFrame) -> DataFrame:
    return df.where(~F.col("corrupt"))


def type_dimension(df: DataFrame) -> DataFrame:
    """The three known record types: a table of fixed size."""
    return df.sparkSession.createDataFrame(list(TYPES), "type_id int, dir string, type_name string")


def known_types(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(type_dimension(df)), "type_id", "left_semi")


def with_type_names(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(type_dimension(df)), "type_id")


def tombstones(df: DataFrame) -> DataFrame:
    return df.where(F.col("plen") == 0)


def latest_gens(df: DataFrame) -> DataFrame:
    """Highest version of each key: headers only, so no payload is shuffled."""
    return df.groupBy(*keys(df)).agg(F.max("gen").alias("gen"))


def latest(df: DataFrame) -> DataFrame:
    """The rows of the latest versions: versions are found on headers, then joined back by their unique number."""
    return df.join(latest_gens(df), [*keys(df), "gen"], "left_semi")


def latest_clean_gens(df: DataFrame) -> DataFrame:
    """Highest version of each key among the readable ones."""
    return latest_gens(without_corrupt(df))


def version_history(df: DataFrame) -> DataFrame:
    """Each version's age in its key (1: latest) and the version that superseded it."""
    newest = W.partitionBy(*keys(df)).orderBy(F.col("gen").desc())
    return df.withColumns({"version": F.row_number().over(newest), "superseded_by": F.lag("gen").over(newest)})


def with_liveness(df: DataFrame) -> DataFrame:
    """live: the record is the latest version of its key, readable or not.

    Found on headers and joined back by version, which is unique: no task holds all versions of a hot key.
    """
    d = dims(df)
    top = latest_gens(df).select(*(F.col(c).alias(f"_{c}") for c in (*d, "gen")))
    on = F.lit(True)
    for c in (*d, "gen"):
        on &= F.col(c) == F.col(f"_{c}")
    return df.join(top, on, "left").select(*df.columns, F.col("_gen").isNotNull().alias("live"))


def point_read(df: DataFrame, x: int, z: int, type_id: int) -> DataFrame:
    """The latest version of one key; no row if there is none or if it can't be read. The key filter reaches the scan."""
    own = df.where((F.col("x") == x) & (F.col("z") == z) & (F.col("type_id") == type_id))
    return latest(own).where(~F.col("corrupt"))


def region_scan(df: DataFrame, rx: int, rz: int) -> DataFrame:
    """Latest versions of a region; coordinate ranges reach the scan as filters."""
    return latest(df.where(F.col("x").between(rx * 32, rx * 32 + 31) & F.col("z").between(rz * 32, rz * 32 + 31)))


def hot_over_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """What a read returns for each key: the hot row if there is one, else the cold one. hot, cold: key, gen, ..."""
    k = keys(hot)
    h = hot.select(*k, F.struct(F.lit(1).alias("tier"), "gen", "plen").alias("v"))
    c = cold.select(*k, F.struct(F.lit(0).alias("tier"), "gen", "plen").alias("v"))
    best = h.unionByName(c).groupBy(*k).agg(F.max("v").alias("v"))
    return best.select(*k, "v.gen", "v.plen", F.when(F.col("v.tier") == 1, "hot").otherwise("cold").alias("tier"))


def live_keys(hot: DataFrame, cold: DataFrame, invalid: DataFrame) -> DataFrame:
    """Keys that a read finds: hot keys, and cold ones neither invalidated nor hot."""
    k = keys(hot)
    h = hot.select(*k).distinct()
    return h.select(*k, F.lit("hot").alias("tier")).unionByName(cold_live_keys(hot, cold, invalid).select(*k, F.lit("cold").alias("tier")))


def cold_live_keys(hot: DataFrame, cold: DataFrame, invalid: DataFrame) -> DataFrame:
    k = keys(cold)
    return cold.select(*k).join(invalid.select(*k), k, "left_anti").join(hot.select(*k), k, "left_anti")


def purge(hot: DataFrame, promoted_regions: DataFrame) -> DataFrame:
    """hot without the keys of promoted regions (rx, rz)."""
    r = [*dims(hot), "rx", "rz"]
    return region_project(hot).join(promoted_regions.select(*r), r, "left_anti")


def merged_pages(pages: DataFrame, increments: DataFrame) -> DataFrame:
    """Index pages and increments merged: the highest version of each key."""
    return latest_gens(pages.select(*keys(pages), "gen").unionByName(increments.select(*keys(increments), "gen")))


def assigned(batch: DataFrame, base: Column | int, order: list[str], block: int = 1 << 16) -> DataFrame:
    """batch with new version numbers base + 1, base + 2, ... in the given order.

    Numbers are global: rows are ranked within ranges of the first order column (a number), ranges are offset by their counts.
    """
    b = F.floor(F.col(order[0]) / block).alias("__b")
    x = batch.withColumn("__b", b)
    counts = x.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    start = counts.select("__b", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    rank = F.row_number().over(W.partitionBy("__b").orderBy(*order))
    base = F.lit(base) if isinstance(base, int) else base
    return x.join(start, "__b").withColumn("new_gen", base + F.col("__start") + rank).drop("__b", "__start")


def key_equal(a: str, b: str) -> Column:
    out = F.lit(True)
    for k in KEY:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out
