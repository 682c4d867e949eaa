"""Conversion from and to region files: sectors, resuming, merging, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.operators.latest import latest_clean_gens, region_project, with_type_names
from chunklake.schema import KEY, SECTOR, dims

REGION_NAME = r"^r\.(-?[0-9]+)\.(-?[0-9]+)\.mca$"
MARKER = r"^[^:]+:(chunk|entity|poi):r-?[0-9]+\.-?[0-9]+$"


def parsed_names(df: DataFrame) -> DataFrame:
    """name, rx, rz (null where the name is not a region file's)."""
    part = lambda i: F.nullif(F.regexp_extract("name", REGION_NAME, i), F.lit("")).cast("int")
    return df.select("name", part(1).alias("rx"), part(2).alias("rz"))


def marker(dim: Column, kind: Column, rx: Column, rz: Column) -> Column:
    return F.concat(dim, F.lit(":"), kind, F.lit(":r"), rx.cast("string"), F.lit("."), rz.cast("string"))


def parsed_progress(lines: DataFrame) -> DataFrame:
    """The valid markers of a progress file (value); other lines are ignored."""
    return lines.where(F.trim("value").rlike(MARKER)).select(F.trim("value").alias("marker")).distinct()


def to_convert(regions: DataFrame, done: DataFrame) -> DataFrame:
    """Regions (marker) that a resumed conversion still has to take up."""
    return regions.join(done.select("marker"), "marker", "left_anti")


def sector_plan(chunks: DataFrame) -> DataFrame:
    """Sectors of each chunk of a region file, in (z, x) order after the two header sectors; a chunk has 255 at most."""
    d = dims(chunks)
    n = F.ceil((F.col("plen") + 5) / SECTOR)
    before = W.partitionBy(*d, "rx", "rz", "type_id").orderBy("z", "x").rowsBetween(W.unboundedPreceding, -1)
    x = chunks.withColumn("sectors", n)
    return x.withColumns({"start": F.lit(2) + F.coalesce(F.sum("sectors").over(before), F.lit(0)), "fits": F.col("sectors") <= 255})


def exported(df: DataFrame) -> DataFrame:
    """Rows that an export writes: latest readable version, known type, no tombstone; with directory and region."""
    x = df.join(latest_clean_gens(df), [*dims(df), *KEY, "gen"], "left_semi")
    return region_project(with_type_names(x.where(F.col("plen") > 0)))


def report(df: DataFrame) -> DataFrame:
    """Regions, records, unknown types skipped, tombstones dropped, payloads that aren't compressed."""
    x = region_project(df.join(latest_clean_gens(df), [*dims(df), *KEY, "gen"], "left_semi"))
    known, gone = F.col("type_id") < 3, F.col("plen") == 0
    out = known & ~gone
    return x.agg(
        F.count_distinct(F.when(out, F.struct("rx", "rz", "type_id"))).alias("regions"),
        F.count_if(out).alias("records"),
        F.count_if(~known).alias("skipped"),
        F.count_if(known & gone).alias("tombstones"),
        F.count_if(out & is_legacy(F.col("payload"))).alias("legacy"),
    )


def is_legacy(payload: Column) -> Column:
    """Not gzip by its first bytes."""
    return F.coalesce(F.hex(F.substring(payload.cast("binary"), 1, 2)) != "1F8B", F.lit(True))


def export_merge(external: DataFrame, log: DataFrame) -> DataFrame:
    """External chunks (key, n) against the store's latest (key, plen): replaced, deleted by a tombstone, or kept."""
    k = [*dims(log), *KEY]
    x = external.join(log.select(*k, "plen"), k, "left")
    state = F.when(F.col("plen").isNull(), "keep").when(F.col("plen") == 0, "drop").otherwise("replace")
    return x.withColumn("action", state)


def read_through(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """hit, deleted or miss for each wanted key."""
    k = [*dims(log), *KEY]
    x = wanted.join(log.select(*k, "gen", "plen"), k, "left")
    return x.withColumn("state", F.when(F.col("gen").isNull(), "miss").when(F.col("plen") == 0, "deleted").otherwise("hit"))
