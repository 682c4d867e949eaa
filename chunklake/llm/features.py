"""Hashed byte n-grams of whole texts, and bounded samples of them for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import unsigned_unit
from chunklake.llm.tokens import chunks

#: Texts whose features are held at a time.
TEXTS = 64


def ngrams(texts: list[bytes], table: bytes, dims: int, orders: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """One row of dims values for each text: root of each hashed n-gram's share, of length 1 (0 for an empty text)."""
    pad = b" " * max(orders)
    sizes = np.array([len(t) + 2 for t in texts])  # a blank before, and one after
    out = np.zeros((len(texts), dims))
    for first, last in _pieces(sizes):
        data = np.frombuffer((b"".join(b" " + t.translate(table) + b" " for t in texts[first:last])) + pad, np.uint8).astype(np.uint32)
        n = int(sizes[first:last].sum())
        owner = np.repeat(np.arange(last - first, dtype=np.uint32), sizes[first:last])
        for k in orders:
            h = np.zeros(n, np.uint32)
            for i in range(k):
                h *= np.uint32(257)
                h += data[i : n + i]
            h *= np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519 + 2 * k)
            h >>= np.uint32(12)
            h %= np.uint32(dims)
            ends = np.cumsum(sizes[first:last])
            inside = np.ones(n, bool)
            for i in range(1, k):  # n-grams that would go on into the next text
                inside[ends - i] = False
            out[first:last] += np.bincount((owner * np.uint32(dims) + h)[inside], minlength=(last - first) * dims).reshape(last - first, dims)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    for i in range(0, len(sizes), TEXTS):
        yield i, min(i + TEXTS, len(sizes))


def unit_hash(seed: int) -> Column:
    """A number in (0, 1) from doc_id alone."""
    return unsigned_unit(F.xxhash64(F.lit(seed), F.col("doc_id")))


def collected(docs: DataFrame, label: Column, make: Callable[[list[bytes]], np.ndarray]) -> tuple[list, np.ndarray]:
    """Labels and features of a bounded sample of documents, in the order of doc_id."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c in chunks(iter([b]), 2):
                x = make([t or b"" for t in c.column(2).to_pylist()]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), c.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    kind = "string"
    rows = docs.select(F.col("doc_id").cast("long"), label.cast(kind).alias("label"), F.col("text").cast("binary")).mapInArrow(batches, f"doc_id long, label {kind}, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    if not rows:
        return [], np.zeros((0, 1), np.float32)
    x = np.empty((len(rows), len(rows[0].x) // 2), np.float32)
    for i, r in enumerate(rows):  # one by one: no second copy of all
        x[i] = np.frombuffer(r.x, np.float16)
    return [r.label for r in rows], x
