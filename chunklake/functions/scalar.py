"""Scalar functions and small reports over them."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunklake.functions.codecs import compressed

CODECS = ("none", "zstd")


def codec_id(comp_id: Column) -> Column:
    return comp_id.bitwiseAND(15)


def dict_slot(comp_id: Column) -> Column:
    return F.shiftright(comp_id, 4)


def make_comp_id(codec: Column, slot: Column) -> Column:
    return F.shiftleft(slot, 4).bitwiseOR(codec.bitwiseAND(15))


def codec_name(codec: Column) -> Column:
    """The name of a codec; an unknown one is an error."""
    out = F.when(codec == 0, CODECS[0]).when(codec == 1, CODECS[1])
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown codec "), codec.cast("string"))))


def varint_length(n: Column) -> Column:
    """Bytes of n >= 0 in seven-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(n), "^0+(?=.)", "")) / 7)).cast("int")


def human_bytes(n: Column) -> Column:
    k = 1024
    return (
        F.when(n < k, F.format_string("%d B", n))
        .when(n < k**2, F.format_string("%.1f KiB", n / k))
        .when(n < k**3, F.format_string("%.1f MiB", n / k**2))
        .otherwise(F.format_string("%.1f GiB", n / k**3))
    )


def nearest_rank(df: DataFrame, group: str, value: str, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """Values at sorted[n * a // b] for each group, without interpolation.

    From counts of distinct values, so that a group's rows are reduced before they are shuffled.
    """
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(group).orderBy(value))
    x = counts.withColumns({"upto": upto, "n": F.sum("c").over(W.partitionBy(group))})
    at = {k: F.min(F.when(F.col("upto") > F.floor(F.col("n") * a / b), F.col(value))).alias(k) for k, (a, b) in ranks.items()}
    return x.groupBy(group).agg(*at.values())


def simulated_cache(trace: DataFrame, budget: int) -> DataFrame:
    """Hits and misses of a page cache of ``budget`` bytes under a trace of (gen, seg, rb), one page for each segment.

    The cache keeps entries in order of arrival with a mark for each that was hit; a hand moves over them from the oldest,
    clears marks and evicts the first entry without one. Entries arrive one after another, so one task takes the trace of a
    log (24 bytes per access).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("gen")
        size_of, marked, newer, older = {}, {}, {}, {}
        oldest, newest, hand = None, None, None
        held, hits, misses, evicted = 0, 0, 0, 0
        for seg, size in zip(table["seg"].to_pylist(), table["rb"].to_pylist(), strict=True):
            if seg in size_of:
                marked[seg] = True
                hits += 1
                continue
            misses += 1
            while size_of and held + size > budget:
                at = oldest if hand is None else hand
                while marked[at]:
                    marked[at] = False
                    at = oldest if newer[at] is None else newer[at]
                hand = newer[at]
                before, after = older.pop(at), newer.pop(at)
                oldest, newest = (after if before is None else oldest), (before if after is None else newest)
                if before is not None:
                    newer[before] = after
                if after is not None:
                    older[after] = before
                held -= size_of.pop(at)
                del marked[at]
                evicted += 1
            size_of[seg], marked[seg], newer[seg], older[seg] = size, False, None, newest
            if newest is not None:
                newer[newest] = seg
            oldest, newest = (seg if oldest is None else oldest), seg
            held += size
        return pa.table({"hits": [hits], "misses": [misses], "evicted": [evicted], "held_bytes": [held]})

    return trace.groupBy().applyInArrow(run, "hits bigint, misses bigint, evicted bigint, held_bytes bigint")


def codec_ratios(df: DataFrame) -> DataFrame:
    """Stored and plain bytes of each type under each codec."""
    x = df.select("type_id", F.col("payload").cast("binary").alias("payload"))
    sizes = x.select("type_id", F.octet_length("payload").alias("plain"), F.octet_length(compressed("payload")).alias("zstd"))
    return sizes.groupBy("type_id").agg(F.sum("plain").alias("plain_bytes"), F.sum("zstd").alias("zstd_bytes"))
