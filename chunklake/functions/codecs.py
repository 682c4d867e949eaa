"""Payload codecs and hashes as Arrow functions, with a registry as the extension point."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

MAX_PLAIN = 256 << 20


class CodecError(ValueError):
    """A payload that a codec can't decode."""


@dataclass(frozen=True)
class Codec:
    number: int
    name: str
    encode: Callable[[bytes, int, bytes | None], bytes]
    decode: Callable[[bytes, bytes | None], bytes]


def _zstd_dict(d: bytes | None) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}


def _zstd_encode(b: bytes, level: int, d: bytes | None) -> bytes:
    if level == 0 or not -10 <= level <= 22:
        raise CodecError(f"zstd level {level} is not in -10..22 without 0")
    return zstandard.ZstdCompressor(level=level, **_zstd_dict(d)).compress(b)


def _zstd_decode(b: bytes, d: bytes | None) -> bytes:
    try:
        return zstandard.ZstdDecompressor(**_zstd_dict(d)).decompress(b, max_output_size=MAX_PLAIN)
    except zstandard.ZstdError as e:
        raise CodecError(str(e)) from e


REGISTRY: dict[int, Codec] = {}


def register(codec: Codec) -> None:
    """Adds a codec; its number is the low half of comp_id."""
    if not 0 <= codec.number < 16:
        raise CodecError("codec numbers are 0 to 15")
    REGISTRY[codec.number] = codec


register(Codec(0, "none", lambda b, level, d: b, lambda b, d: b))
register(Codec(1, "zstd", _zstd_encode, _zstd_decode))


def comp_id(codec: int, slot: int = 0) -> int:
    return slot << 4 | codec & 15


def encode(payload: bytes, comp: int, level: int = 3, dictionaries: dict[int, bytes] | None = None) -> bytes:
    return _codec(comp).encode(payload, level, (dictionaries or {}).get(comp >> 4))


def decode(payload: bytes, comp: int, dictionaries: dict[int, bytes] | None = None) -> bytes:
    return _codec(comp).decode(payload, (dictionaries or {}).get(comp >> 4))


def _codec(comp: int) -> Codec:
    if comp & 15 not in REGISTRY:
        raise CodecError(f"unknown codec {comp & 15}")
    return REGISTRY[comp & 15]


def xxh64(payload: bytes) -> int:
    """The hash of an envelope (seed 0) as a signed number."""
    h = xxhash.xxh64_intdigest(payload, 0)
    return h - (1 << 64) if h >> 63 else h


def gzipped(payload: bytes) -> bytes:
    return gzip.compress(payload, mtime=0)


def gunzipped(payload: bytes) -> bytes:
    """A gzip payload unpacked; any other is taken as it is (written before payloads were packed)."""
    if payload[:2] != b"\x1f\x8b":
        return payload
    try:
        return gzip.decompress(payload)
    except (OSError, EOFError, zlib.error):
        return payload


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes | None:
    """A zstd dictionary, if there are at least 100 samples and 100 KiB."""
    if len(samples) < 100 or sum(map(len, samples)) < 100 << 10:
        return None
    return zstandard.train_dictionary(size, samples).as_bytes()


def _each(f: Callable[[bytes], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    return lambda a: pa.array([None if b is None else f(b) for b in a.to_pylist()], kind)


def compressed(payload: Column | str, level: int = 3) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _each(lambda b: encode(b, 1, level), pa.binary())(a)

    return arrow_udf(run, "binary")(payload)


def decompressed(payload: Column | str, comp: Column | str) -> Column:
    def run(a: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([None if b is None else decode(b, k) for b, k in zip(a.to_pylist(), c.to_pylist(), strict=True)], pa.binary())

    return arrow_udf(run, "binary")(payload, comp)


def payload_hash(payload: Column | str) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _each(xxh64, pa.int64())(a)

    return arrow_udf(run, "bigint")(payload)


def gunzip(payload: Column | str) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _each(gunzipped, pa.binary())(a)

    return arrow_udf(run, "binary")(payload)


def gzip_payload(payload: Column | str) -> Column:
    def run(a: pa.Array) -> pa.Array:
        return _each(gzipped, pa.binary())(a)

    return arrow_udf(run, "binary")(payload)
