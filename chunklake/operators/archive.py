"""Cold archives: similarity order, blocks, offsets, slot tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from chunklake.schema import ARCHIVE_HEADER, ENVELOPE, RECORDS_PER_BLOCK, dims
from chunklake.sources.formats import superfeature

FEATURE_WINDOW = 32


def with_superfeature(df: DataFrame, digest: str = "xxh64") -> DataFrame:
    """min_h and max_h, as hex: least and greatest hash of the payload's 32-byte windows, its tail included.

    digest: xxh64 is what archives are ordered by; md5 gives an order that other engines' SQL can tell too ('' for an empty payload).
    """
    if digest == "xxh64":

        def run(payloads: pa.Array) -> pa.Array:
            return pa.array(["{:016x}{:016x}".format(*superfeature(p or b"")) for p in payloads.to_pylist()], pa.string())

        both = arrow_udf(run, "string")(F.col("payload").cast("binary"))
        return df.withColumn("_both", both).withColumns({"min_h": F.substring("_both", 1, 16), "max_h": F.substring("_both", 17, 16)}).drop("_both")
    n = F.ceil(F.octet_length("payload") / FEATURE_WINDOW).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.md5(F.substring(F.col("payload"), i * FEATURE_WINDOW + 1, F.lit(FEATURE_WINDOW))))
    hashes = F.when(n > 0, windows).otherwise(F.array(F.lit("")))
    return df.withColumns({"min_h": F.array_min(hashes), "max_h": F.array_max(hashes)})


def layout(slots: DataFrame, digest: str = "xxh64") -> DataFrame:
    """Slots in similarity order: their place in the region, block and place in the block."""
    order = W.partitionBy(*dims(slots), "rx", "rz").orderBy("min_h", "max_h", "x_rel", "z_rel", "type_id")
    x = with_superfeature(slots, digest).withColumn("rn", F.row_number().over(order) - 1)
    return x.withColumns({"block": F.floor(F.col("rn") / RECORDS_PER_BLOCK), "in_block": F.col("rn") % RECORDS_PER_BLOCK})


def with_offsets(laid: DataFrame) -> DataFrame:
    """Where each payload begins in its block: after its own envelope and all records before it."""
    before = W.partitionBy(*dims(laid), "rx", "rz", "block").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    return laid.withColumn("offset_in_block", F.lit(ENVELOPE) + F.coalesce(F.sum("rb").over(before), F.lit(0)))


def blocks(laid: DataFrame) -> DataFrame:
    """Each block's records, bytes and place in the file, after the header and the tables."""
    r = [*dims(laid), "rx", "rz"]
    b = laid.groupBy(*r, "block").agg(F.count(F.lit(1)).alias("records"), F.sum("rb").alias("bytes"))
    order = W.partitionBy(*r).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return b.withColumn("file_offset", F.lit(ARCHIVE_HEADER) + F.coalesce(F.sum("bytes").over(order), F.lit(0)))


def slot_table(laid: DataFrame) -> DataFrame:
    order = W.partitionBy(*dims(laid), "rx", "rz").orderBy("z_rel", "x_rel", "type_id")
    return laid.withColumn("slot", F.row_number().over(order) - 1)


def summary(laid: DataFrame) -> DataFrame:
    r = [*dims(laid), "rx", "rz"]
    return blocks(laid).groupBy(*r).agg(F.count(F.lit(1)).alias("blocks"), F.sum("records").alias("slots"), F.sum("bytes").alias("plain_bytes"), F.max("bytes").alias("largest_block"))
