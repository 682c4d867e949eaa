"""The binary formats as bytes: numpy record layouts, parsers that turn damage into values or errors, and encoders."""

from __future__ import annotations

import gzip
import zlib
from dataclasses import dataclass, field

import numpy as np
import xxhash
import zstandard

from chunklake.functions.codecs import MAX_PLAIN
from chunklake.schema import ENVELOPE, RECORDS_PER_BLOCK, SECTOR, SEGMENT_HEADER

# Fixed values of the formats.
RECORD_MAGIC, SEGMENT_MAGIC, ARCHIVE_MAGIC = b"VSEG", b"VS01", b"VARC"
MANIFEST_VERSION, MAX_DICTIONARIES = 3, 16
RESYNC_WINDOW = 64 << 10
LOG_ENTRY = 64
REGION_SLOTS, MAX_SECTORS, EXTERNAL = 1024, 255, 0x80
BUCKETS = ("young", "active", "stable")
ENVELOPE_TYPE = np.dtype([("magic", "S4"), ("record_ver", "u1"), ("type_id", "<u2"), ("comp_id", "u1"), ("x", "<i4"), ("z", "<i4"), ("gen", "<u8"), ("epoch_ts", "<u4"), ("payload_len", "<u4"), ("payload_hash", "<u8")])
LOG_TYPE = np.dtype([("seg_id", "<u4"), ("env", ENVELOPE_TYPE), ("offset", "<u8"), ("pad", "V12")])
ARCHIVE_TYPE = np.dtype([("magic", "S4"), ("region_x", "<i4"), ("region_z", "<i4"), ("blocks", "<u4"), ("slots", "<u4")])
BLOCK_TYPE = np.dtype([("file_offset", "<u8"), ("comp_len", "<u4"), ("plain_len", "<u4")])
SLOT_TYPE = np.dtype([("x_rel", "<u2"), ("z_rel", "<u2"), ("type_id", "<u2"), ("block", "<u2"), ("offset_in_block", "<u4"), ("plain_len", "<u4")])
PAGE_TYPE = np.dtype([("z", "<i4"), ("type_id", "<u2"), ("seg_id", "<u4"), ("offset", "<u8"), ("payload_len", "<u4"), ("gen", "<u8"), ("comp_id", "u1")])
HEAD_TYPE = np.dtype([("format_version", "<u4"), ("epoch", "<u8"), ("next_gen", "<u8"), ("next_seg_id", "<u4")])
SEGMENT_TYPE = np.dtype([("id", "<u4"), ("live_bytes", "<u8"), ("total_bytes", "<u8"), ("bucket", "u1"), ("created_epoch", "<u8"), ("last_rewrite_epoch", "<u8")])
COLD_TYPE = np.dtype([("region_x", "<i4"), ("region_z", "<i4"), ("invalid_count", "<u4"), ("total_slots", "<u4")])
ENVELOPE_FIELDS = [n for n in ENVELOPE_TYPE.names if n != "magic"]


class FormatError(ValueError):
    """Bytes that are not what their format asks for."""


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def record_hash(payload: bytes) -> int:
    return xxhash.xxh64_intdigest(payload, 0)


# --- records and segments ----------------------------------------------------------------------------------------------------


def envelope(**values: int) -> bytes:
    r = np.zeros((), ENVELOPE_TYPE)
    r["magic"] = RECORD_MAGIC
    for k, v in values.items():
        r[k] = v
    return r.tobytes()


def parse_envelope(data: bytes, at: int = 0) -> dict[str, int]:
    if data[at : at + 4] != RECORD_MAGIC or len(data) - at < ENVELOPE:
        raise FormatError("not an envelope")
    r = np.frombuffer(data, ENVELOPE_TYPE, 1, at)[0]
    return {n: int(r[n]) for n in ENVELOPE_FIELDS}


def record(payload: bytes, **values: int) -> bytes:
    return envelope(**({"record_ver": 1, "payload_len": len(payload), "payload_hash": record_hash(payload)} | values)) + payload


def segment_header(seg_id: int) -> bytes:
    return SEGMENT_MAGIC + seg_id.to_bytes(4, "little") + bytes(8)


def segment_header_ok(data: bytes, seg_id: int) -> bool:
    return data[:SEGMENT_HEADER][:8] == SEGMENT_MAGIC + seg_id.to_bytes(4, "little")


@dataclass
class SegmentScan:
    seg_id: int
    records: list[dict] = field(default_factory=list)
    truncated_tail: bool = False
    resyncs: int = 0


def scan_segment(data: bytes) -> SegmentScan:
    """All records with their offsets. A record with a wrong hash stays, with hash 0; a short tail ends the scan; a damaged
    header is skipped to the next one within RESYNC_WINDOW."""
    if len(data) < SEGMENT_HEADER or data[:4] != SEGMENT_MAGIC:
        raise FormatError("not a segment")
    out = SegmentScan(int.from_bytes(data[4:8], "little"))
    at = SEGMENT_HEADER
    while at < len(data):
        if len(data) - at < ENVELOPE:
            out.truncated_tail = True
            break
        if data[at : at + 4] != RECORD_MAGIC:
            found = data.find(RECORD_MAGIC, at + 1, at + RESYNC_WINDOW + len(RECORD_MAGIC))
            if found < 0:
                raise FormatError(f"no record within {RESYNC_WINDOW} bytes after {at}")
            out.resyncs += 1
            at = found
            continue
        e = parse_envelope(data, at)
        end = at + ENVELOPE + e["payload_len"]
        if end > len(data):
            out.truncated_tail = True
            break
        payload = data[at + ENVELOPE : end]
        good = record_hash(payload) == e["payload_hash"]
        out.records.append(e | {"payload": payload, "offset": at, "payload_hash": e["payload_hash"] if good else 0, "is_corrupt": not good})
        at = end
    return out


# --- epoch log ---------------------------------------------------------------------------------------------------------------


def log_entry(seg_id: int, env: bytes, offset: int) -> bytes:
    return seg_id.to_bytes(4, "little") + env + offset.to_bytes(8, "little") + bytes(LOG_ENTRY - 12 - ENVELOPE)


def scan_log(data: bytes) -> list[dict]:
    """Entries up to the first that is short or has no envelope."""
    rows = np.frombuffer(data, LOG_TYPE, len(data) // LOG_ENTRY)
    good = rows["env"]["magic"] == RECORD_MAGIC
    stop = len(rows) if good.all() else int(np.argmin(good))
    return [{"seg_id": int(r["seg_id"]), **{n: int(r["env"][n]) for n in ENVELOPE_FIELDS}, "offset": int(r["offset"])} for r in rows[:stop]]


# --- index pages -------------------------------------------------------------------------------------------------------------


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int, most: int = 5) -> tuple[int, int]:
    value = 0
    for i, b in enumerate(data[at : at + most]):
        value |= (b & 127) << 7 * i
        if b < 128:
            if value >> 32:
                break
            return value, at + i + 1
    raise FormatError("bad varint")


def page(rows: list[dict]) -> bytes:
    """An index page: one entry for each key, the highest version, in key order."""
    best: dict[tuple, dict] = {}
    for r in rows:
        k = (r["x"], r["z"], r["type_id"])
        if k not in best or best[k]["gen"] < r["gen"]:
            best[k] = r
    out, before = [len(best).to_bytes(4, "little")], None
    for k in sorted(best):
        out.append(k[0].to_bytes(4, "little", signed=True) if before is None else varint((k[0] - before) & 0xFFFFFFFF))
        fixed = np.zeros((), PAGE_TYPE)
        for n in PAGE_TYPE.names:
            fixed[n] = best[k][n]
        out.append(fixed.tobytes())
        before = k[0]
    return b"".join(out)


def parse_page(data: bytes) -> list[dict]:
    """Strict: sorted keys, no trailing bytes, a count that fits."""
    if len(data) < 4 or (n := int.from_bytes(data[:4], "little")) > len(data) // (PAGE_TYPE.itemsize + 1):
        raise FormatError("page: bad count")
    at, x, out = 4, 0, []
    for i in range(n):
        if i:
            step, at = read_varint(data, at)
            x = (x + step + 2**31) % 2**32 - 2**31
        else:
            x, at = int.from_bytes(data[at : at + 4], "little", signed=True), at + 4
        if at + PAGE_TYPE.itemsize > len(data):
            raise FormatError("page: short entry")
        r = np.frombuffer(data, PAGE_TYPE, 1, at)[0]
        at += PAGE_TYPE.itemsize
        out.append({"x": x} | {c: int(r[c]) for c in PAGE_TYPE.names})
        if i and (out[-2]["x"], out[-2]["z"], out[-2]["type_id"]) >= (x, out[-1]["z"], out[-1]["type_id"]):
            raise FormatError("page: keys out of order")
    if at != len(data):
        raise FormatError("page: trailing bytes")
    return out


# --- manifest ----------------------------------------------------------------------------------------------------------------


def manifest(epoch: int, next_gen: int, next_seg_id: int, segments: list[dict], cold: list[dict], dictionaries: list[tuple[int, bytes]] = ()) -> bytes:
    if len(dictionaries) > MAX_DICTIONARIES:
        raise FormatError("too many dictionaries")
    head = np.array((MANIFEST_VERSION, epoch, next_gen, next_seg_id), HEAD_TYPE)
    out = [head.tobytes()]
    for rows, kind in ((segments, SEGMENT_TYPE), (cold, COLD_TYPE)):
        table = np.zeros(len(rows), kind)
        for i, r in enumerate(rows):
            for n in kind.names:
                table[i][n] = BUCKETS.index(r[n]) if n == "bucket" else r[n]
        out += [len(rows).to_bytes(4, "little"), table.tobytes()]
    out.append(len(dictionaries).to_bytes(4, "little"))
    for type_id, d in dictionaries:
        out += [type_id.to_bytes(2, "little"), len(d).to_bytes(4, "little"), d]
    body = b"".join(out)
    return record_hash(body).to_bytes(8, "little") + body


def parse_manifest(data: bytes) -> dict:
    body = data[8:]
    if len(data) < 8 or record_hash(body) != int.from_bytes(data[:8], "little"):
        raise FormatError("manifest: hash differs")
    at = 0

    def take(kind: np.dtype, n: int) -> np.ndarray:
        nonlocal at
        if at + kind.itemsize * n > len(body):
            raise FormatError("manifest: short")
        at += kind.itemsize * n
        return np.frombuffer(body, kind, n, at - kind.itemsize * n)

    u4 = np.dtype("<u4")
    if int(take(u4, 1)[0]) != MANIFEST_VERSION:
        raise FormatError("manifest: unknown version")
    at = 0
    head = take(HEAD_TYPE, 1)[0]
    tables = {}
    for name, kind in (("segments", SEGMENT_TYPE), ("cold", COLD_TYPE)):
        rows = take(kind, int(take(u4, 1)[0]))
        if name == "segments" and (rows["bucket"] >= len(BUCKETS)).any():
            raise FormatError("manifest: unknown bucket")
        tables[name] = [{n: BUCKETS[r[n]] if n == "bucket" else int(r[n]) for n in kind.names} for r in rows]
    dictionaries = []
    for _ in range(int(take(u4, 1)[0])):
        type_id, n = int(take(np.dtype("<u2"), 1)[0]), int(take(u4, 1)[0])
        dictionaries.append((type_id, take(np.dtype("u1"), n).tobytes()))
    if at != len(body):
        raise FormatError("manifest: trailing bytes")
    return {n: int(head[n]) for n in HEAD_TYPE.names} | tables | {"dictionaries": dictionaries}


# --- cold archives -----------------------------------------------------------------------------------------------------------


def superfeature(payload: bytes) -> tuple[int, int]:
    hashes = [record_hash(payload[i : i + 32]) for i in range(0, len(payload), 32)] or [record_hash(b"")]
    return min(hashes), max(hashes)


def archive(region_x: int, region_z: int, rows: list[dict], level: int = 9) -> bytes:
    """A region's records (x, z, type_id, payload, gen, epoch_ts, comp_id) in similarity order, 64 to a compressed block. The last row of a
    slot wins."""
    last = {(r["z"] & 31, r["x"] & 31, r["type_id"]): r for r in rows}
    order = sorted(last.items(), key=lambda kv: (*superfeature(kv[1]["payload"]), kv[0][1], kv[0][0], kv[0][2]))
    squeeze = zstandard.ZstdCompressor(level=level)
    blocks, slots = [], []
    for b in range(0, len(order), RECORDS_PER_BLOCK):
        plain = bytearray()
        for (z_rel, x_rel, type_id), r in order[b : b + RECORDS_PER_BLOCK]:
            own = record(r["payload"], **{n: r[n] for n in ("x", "z", "type_id", "gen", "epoch_ts", "comp_id")})
            slots.append((x_rel, z_rel, type_id, len(blocks), len(plain) + ENVELOPE, len(r["payload"])))
            plain += own
        blocks.append((squeeze.compress(bytes(plain)), len(plain)))
    slots.sort(key=lambda s: (s[1], s[0], s[2]))
    at = ARCHIVE_TYPE.itemsize + BLOCK_TYPE.itemsize * len(blocks) + SLOT_TYPE.itemsize * len(slots)
    table = []
    for data, plain_len in blocks:
        table.append((at, len(data), plain_len))
        at += len(data)
    head = np.array((ARCHIVE_MAGIC, region_x, region_z, len(blocks), len(slots)), ARCHIVE_TYPE)
    return b"".join([head.tobytes(), np.array(table, BLOCK_TYPE).tobytes(), np.array(slots, SLOT_TYPE).tobytes(), *(d for d, _ in blocks)])


def parse_archive(data: bytes, invalid: bytes | None = None) -> list[dict]:
    """All slots, invalidated ones too, in slot order. Raises on ranges, order or hashes that don't hold."""
    if len(data) < ARCHIVE_TYPE.itemsize or data[:4] != ARCHIVE_MAGIC:
        raise FormatError("not an archive")
    head = np.frombuffer(data, ARCHIVE_TYPE, 1)[0]
    n, m = int(head["blocks"]), int(head["slots"])
    tables = ARCHIVE_TYPE.itemsize + BLOCK_TYPE.itemsize * n + SLOT_TYPE.itemsize * m
    if len(data) < tables:
        raise FormatError("archive: short tables")
    blocks = np.frombuffer(data, BLOCK_TYPE, n, ARCHIVE_TYPE.itemsize)
    slots = np.frombuffer(data, SLOT_TYPE, m, ARCHIVE_TYPE.itemsize + BLOCK_TYPE.itemsize * n)
    if invalid is not None and len(invalid) != -(-m // 8):
        raise FormatError("archive: invalidation bitmap of another size")
    if any(int(b["file_offset"]) < tables or int(b["file_offset"]) + int(b["comp_len"]) > len(data) for b in blocks):
        raise FormatError("archive: block out of bounds")
    order = [(int(s["z_rel"]), int(s["x_rel"]), int(s["type_id"])) for s in slots]
    if any(a >= b for a, b in zip(order[:-1], order[1:], strict=True)) or any(z > 31 or x > 31 for z, x, _ in order):
        raise FormatError("archive: bad slot table")
    plain: dict[int, bytes] = {}
    out = []
    for i, s in enumerate(slots):
        b = int(s["block"])
        if b >= n or int(s["offset_in_block"]) + int(s["plain_len"]) > int(blocks[b]["plain_len"]):
            raise FormatError("archive: slot out of its block")
        if b not in plain:
            at = int(blocks[b]["file_offset"])
            plain[b] = zstandard.ZstdDecompressor().decompress(data[at : at + int(blocks[b]["comp_len"])], max_output_size=int(blocks[b]["plain_len"]) + 1)
        at = int(s["offset_in_block"])
        payload = plain[b][at : at + int(s["plain_len"])]
        e = parse_envelope(plain[b], at - ENVELOPE)
        if e["payload_len"] != len(payload) or e["payload_hash"] != record_hash(payload):
            raise FormatError(f"archive: slot {i} is damaged")
        out.append(e | {"region_x": int(head["region_x"]), "region_z": int(head["region_z"]), "x_rel": int(s["x_rel"]), "z_rel": int(s["z_rel"]), "block": b, "offset_in_block": at, "plain_len": len(payload), "payload": payload, "invalid": bool(invalid is not None and invalid[i // 8] >> i % 8 & 1)})
    return out


# --- region files --------------------------------------------------------------------------------------------------------------


def lz4_block(data: bytes, size: int) -> bytes:
    """A raw LZ4 block of known plain size."""
    out, at = bytearray(), 0

    def length(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        return n

    try:
        while at < len(data):
            token = data[at]
            at += 1
            n = length(token >> 4)
            if at + n > len(data):
                raise FormatError("lz4: short literals")
            out += data[at : at + n]
            at += n
            if at >= len(data):
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            n = length(token & 15) + 4
            if not 0 < back <= len(out) or len(out) + n > size:
                raise FormatError("lz4: bad match")
            for i in range(n):
                out.append(out[-back])
    except IndexError as e:
        raise FormatError("lz4: short block") from e
    if len(out) != size:
        raise FormatError("lz4: wrong size")
    return bytes(out)


def _inflate(data: bytes, kind: int) -> bytes:
    unpack = zlib.decompressobj(kind)
    out = unpack.decompress(data, MAX_PLAIN)
    if unpack.unconsumed_tail:
        raise FormatError("chunk larger than the limit")
    return out


def unpacked(version: int, data: bytes) -> bytes:
    if version == 1:
        return _inflate(data, 31)
    if version == 2:
        return _inflate(data, 15)
    if version == 3:
        return data
    if version == 4:
        size = int.from_bytes(data[:4], "big")
        if size > MAX_PLAIN:
            raise FormatError("chunk larger than the limit")
        return lz4_block(data[4:], size)
    raise FormatError(f"unknown chunk version {version}")


def parse_region(data: bytes) -> list[dict]:
    """The chunks of a region file: x_rel, z_rel, nbt, timestamp, compression."""
    if len(data) < 2 * SECTOR:
        raise FormatError("region: short header")
    places, stamps = np.frombuffer(data, ">u4", REGION_SLOTS), np.frombuffer(data, ">u4", REGION_SLOTS, SECTOR)
    out = []
    for i in np.flatnonzero(places).tolist():
        sector, count = int(places[i]) >> 8, int(places[i]) & 255
        at = sector * SECTOR
        if not count:
            continue
        if sector < 2 or at + 5 > len(data):
            raise FormatError(f"region: slot {i} out of bounds")
        n = int.from_bytes(data[at : at + 4], "big")
        if not 0 < n <= count * SECTOR - 4 or at + 4 + n > len(data):
            raise FormatError(f"region: slot {i} has a bad length")
        version = data[at + 4]
        if version & EXTERNAL:
            raise FormatError(f"region: slot {i} is stored elsewhere")
        out.append({"x_rel": i & 31, "z_rel": i >> 5, "nbt": unpacked(version, data[at + 5 : at + 4 + n]), "timestamp": int(stamps[i]), "compression": version})
    return out


def region_file(rows: list[dict]) -> bytes:
    """A region file of chunks (x_rel, z_rel, nbt, timestamp), zlib level 6, in (z, x) order."""
    places, stamps, body, sector = np.zeros(REGION_SLOTS, ">u4"), np.zeros(REGION_SLOTS, ">u4"), [], 2
    for r in sorted(rows, key=lambda r: (r["z_rel"], r["x_rel"])):
        packed = zlib.compress(r["nbt"], 6)
        own = (len(packed) + 1).to_bytes(4, "big") + b"\x02" + packed
        count = -(-len(own) // SECTOR)
        if count > MAX_SECTORS:
            raise FormatError("chunk needs more than 255 sectors")
        i = r["x_rel"] + r["z_rel"] * 32
        places[i], stamps[i] = sector << 8 | count, r.get("timestamp") or 0
        body.append(own.ljust(count * SECTOR, b"\0"))
        sector += count
    return places.tobytes() + stamps.tobytes() + b"".join(body)


def gzip_bytes(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)
