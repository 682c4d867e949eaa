"""Scans of the binary formats: Spark lists and reads the files (any store that it can read), executors parse them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions.codecs import gunzipped
from chunklake.schema import dims
from chunklake.sources import formats

_ENVELOPE = "record_ver int, type_id int, comp_id int, x int, z int, gen bigint, epoch_ts bigint, payload_len bigint, payload_hash bigint"
SEGMENT_ROWS = f"path string, seg_id bigint, {_ENVELOPE}, payload binary, offset bigint, is_corrupt boolean, truncated_tail boolean, resyncs int"
LOG_ROWS = f"path string, seg_id bigint, {_ENVELOPE}, offset bigint"
PAGE_ROWS = "path string, x int, z int, type_id int, seg_id bigint, offset bigint, payload_len bigint, gen bigint, comp_id int"
ARCHIVE_ROWS = f"path string, region_x int, region_z int, x_rel int, z_rel int, block int, offset_in_block bigint, plain_len bigint, {_ENVELOPE}, payload binary, invalid boolean"
REGION_ROWS = "path string, region_x int, region_z int, x int, z int, nbt binary, timestamp bigint, compression int"
MANIFEST_ROWS = "path string, copy string, epoch bigint, next_gen bigint, next_seg_id bigint, segments int, cold int, dictionaries int"
#: Names of a manifest and its copy: fixed values of the format.
MANIFEST, MANIFEST_COPY = "manifest.vsm", "manifest.vsm.bak"
FILES = "path string, length bigint"
#: Rows that go to Spark at a time.
ROWS = 1024


def files(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def _scan(found: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    kinds = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = list(parse(path, data))
                for i in range(0, len(out), ROWS):
                    part = out[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], arrow[k]) for n, k in kinds.items()], list(kinds))

    return found.select("path", "content").mapInArrow(batches, schema)


def _signed(r: dict) -> dict:
    return r | {"payload_hash": formats.signed(r["payload_hash"]), "gen": formats.signed(r["gen"])}


def segments(spark: SparkSession, path: str) -> DataFrame:
    def parse(name: str, data: bytes) -> Iterator[dict]:
        s = formats.scan_segment(data)
        for r in s.records:
            yield _signed(r) | {"path": name, "seg_id": s.seg_id, "truncated_tail": s.truncated_tail, "resyncs": s.resyncs}

    return _scan(files(spark, path, "*.vseg"), parse, SEGMENT_ROWS)


def epoch_log(spark: SparkSession, path: str) -> DataFrame:
    return _scan(files(spark, path, "*.velog"), lambda name, data: (_signed(r) | {"path": name} for r in formats.scan_log(data)), LOG_ROWS)


def index_pages(spark: SparkSession, path: str) -> DataFrame:
    return _scan(files(spark, path, "*.vix"), lambda name, data: (r | {"path": name} for r in formats.parse_page(data)), PAGE_ROWS)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Slots of all archives; their invalidation bitmaps lie beside them as .varc.inv."""
    own, marks = files(spark, path, "*.varc"), files(spark, path, "*.varc.inv")
    marks = marks.select(F.regexp_replace("path", r"\.inv$", "").alias("path"), F.col("content").alias("marks"))
    both = own.join(marks, "path", "left").select("path", F.struct("content", "marks").alias("content"))
    return _scan(both, lambda name, data: (_signed(r) | {"path": name} for r in formats.parse_archive(data["content"], data["marks"])), ARCHIVE_ROWS)


def region_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Chunks of all region files r.X.Z.mca in a folder, or of these files, at absolute coordinates."""

    def parse(name: str, data: bytes) -> Iterator[dict]:
        rx, rz = (int(v) for v in name.rsplit("/", 1)[-1].split(".")[1:3])
        for c in formats.parse_region(data):
            yield {"path": name, "region_x": rx, "region_z": rz, "x": rx * 32 + c["x_rel"], "z": rz * 32 + c["z_rel"], "nbt": c["nbt"], "timestamp": c["timestamp"], "compression": c["compression"]}

    found = files(spark, path, "*.mca").where(F.col("path").rlike(r"/r\.-?[0-9]+\.-?[0-9]+\.mca$"))
    return _scan(found, parse, REGION_ROWS)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each folder with a manifest: from the manifest itself, or from its copy where that can't be read. Neither can: an error."""

    def chosen(group: pa.Table) -> pa.Table:
        copies = {r["path"].rsplit("/", 1)[1]: r for r in group.to_pylist()}
        for name in (MANIFEST, MANIFEST_COPY):
            try:
                if name in copies:
                    m = formats.parse_manifest(copies[name]["content"])
                    tables = {c: len(m[c]) for c in ("segments", "cold", "dictionaries")}
                    own = {"path": copies[name]["path"], "copy": name} | {c: m[c] for c in ("epoch", "next_gen", "next_seg_id")} | tables
                    types = {"path": pa.string(), "copy": pa.string(), **dict.fromkeys(("epoch", "next_gen", "next_seg_id"), pa.int64()), **dict.fromkeys(tables, pa.int32())}
                    return pa.table({k: pa.array([v], types[k]) for k, v in own.items()})
            except formats.FormatError:
                continue
        raise formats.FormatError(f"{sorted(r['path'] for r in copies.values())}: neither the manifest nor its copy can be read")

    found = files(spark, path, f"{MANIFEST}*").where(F.regexp_extract("path", r"[^/]*$", 0).isin(MANIFEST, MANIFEST_COPY))
    return found.select("path", "content", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).groupBy("folder").applyInArrow(lambda t: chosen(t.select(["path", "content"])), MANIFEST_ROWS)


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _put(target: str, data: bytes) -> None:
    """A whole file, or none: written under another name and renamed."""
    fs, path = pyarrow.fs.FileSystem.from_uri(target)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path + ".tmp") as out:
        out.write(data)
    fs.move(path + ".tmp", path)


def write_region_files(chunks: DataFrame, root: str) -> DataFrame:
    """Writes region files from chunks (dir, rx, rz, x, z, payload, and timestamp if there is one), gzip or raw payloads; returns their
    paths and lengths. A task holds one region, 1024 chunks at most. root is a URI of a shared store."""
    d = dims(chunks)
    stamp = "timestamp" if "timestamp" in chunks.columns else None

    def write(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = rows[0]
        data = formats.region_file([{"x_rel": r["x"] & 31, "z_rel": r["z"] & 31, "nbt": gunzipped(r["payload"]), "timestamp": r[stamp] if stamp else 0} for r in rows])
        own = "/".join([root.rstrip("/"), *(str(first[c]) for c in d), first["dir"], f"r.{first['rx']}.{first['rz']}.mca"])
        _put(own, data)
        return pa.table({"path": [own], "length": [len(data)]})

    return chunks.groupBy(*d, "dir", "rx", "rz").applyInArrow(write, FILES)


def write_archives(slots: DataFrame, root: str, level: int = 9) -> DataFrame:
    """Writes one archive for each region of slots (rx, rz, x, z, type_id, gen, epoch_ts, comp_id, payload); a task holds one region."""
    d = dims(slots)

    def write(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = rows[0]
        data = formats.archive(first["rx"], first["rz"], rows, level)
        own = "/".join([root.rstrip("/"), *(str(first[c]) for c in d), f"r.{first['rx']}.{first['rz']}.varc"])
        _put(own, data)
        return pa.table({"path": [own], "length": [len(data)]})

    return slots.groupBy(*d, "rx", "rz").applyInArrow(write, FILES)


def write_segments(records: DataFrame, root: str) -> DataFrame:
    """Writes one segment file for each seg of records (seg, gen, x, z, type_id, epoch_ts, comp_id, payload), records in the order of gen;
    returns gen, seg, offset and payload_hash of each, as logs and index pages need them. A task holds one segment."""
    d = dims(records)
    schema = ", ".join([*(f"{c} string" for c in d), "seg bigint, gen bigint, offset bigint, payload_hash bigint"])

    def write(table: pa.Table) -> pa.Table:
        rows = table.sort_by("gen").to_pylist()
        data, out = bytearray(formats.segment_header(rows[0]["seg"])), []
        for r in rows:
            own = formats.record(r["payload"] or b"", **{n: r[n] for n in ("x", "z", "type_id", "gen", "epoch_ts", "comp_id")})
            out.append({c: r[c] for c in (*d, "seg", "gen")} | {"offset": len(data), "payload_hash": formats.signed(formats.record_hash(r["payload"] or b""))})
            data += own
        _put("/".join([root.rstrip("/"), *(str(rows[0][c]) for c in d), f"seg-{rows[0]['seg']}.vseg"]), bytes(data))
        return pa.Table.from_pylist(out, pa.schema([*((c, pa.string()) for c in d), *((c, pa.int64()) for c in ("seg", "gen", "offset", "payload_hash"))]))

    return records.groupBy(*d, "seg").applyInArrow(write, schema)


def write_epoch_logs(entries: DataFrame, root: str) -> DataFrame:
    """Writes one log for each epoch of entries (seg, offset, gen, x, z, type_id, epoch_ts, comp_id, payload_len, payload_hash): the log is
    cut at each flush. Entries are in the order of gen; returns paths and lengths."""
    d = dims(entries)
    fields = ("x", "z", "type_id", "gen", "epoch_ts", "comp_id", "payload_len")

    def write(table: pa.Table) -> pa.Table:
        rows = table.sort_by("gen").to_pylist()
        envelope = lambda r: formats.envelope(record_ver=1, payload_hash=r["payload_hash"] % 2**64, **{n: r[n] for n in fields})
        data = b"".join(formats.log_entry(r["seg"], envelope(r), r["offset"]) for r in rows)
        own = "/".join([root.rstrip("/"), *(str(rows[0][c]) for c in d), f"epoch-{rows[0]['epoch_ts']}.velog"])
        _put(own, data)
        return pa.table({"path": [own], "length": [len(data)]})

    return entries.groupBy(*d, "epoch_ts").applyInArrow(write, FILES)
