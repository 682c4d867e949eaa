"""Schemas of the record log and of what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A record's key within a dimension, in its sort order.
KEY = ("x", "z", "type_id")
#: Fixed sizes of the binary formats, in bytes.
ENVELOPE, SEGMENT_HEADER, ARCHIVE_HEADER, SECTOR = 40, 16, 20, 4096
RECORDS_PER_BLOCK, REGION_SHIFT, REGION_MASK = 64, 5, 31
#: type_id, directory, name of the known record types.
TYPES = ((0, "region", "chunk"), (1, "entities", "entity"), (2, "poi", "poi"))

RECORD_LOG = (
    "dim string, x int, z int, type_id int, gen bigint, epoch_ts bigint, record_ver int, comp_id int, payload binary, "
    "payload_len bigint, payload_hash bigint, is_corrupt boolean, seg_id bigint, offset bigint"
)
MCA_CHUNK = "dim string, kind string, region_x int, region_z int, x int, z int, type_id int, nbt binary, timestamp bigint, compression int"


def dims(df: DataFrame) -> list[str]:
    """The dimension column, if the log has one: keys, segments and regions are per dimension."""
    return ["dim"] if "dim" in df.columns else []


def keys(df: DataFrame) -> list[str]:
    return [*dims(df), *KEY]
