"""Repeated passages by a depth-limited radix sort of suffixes.

Every position of a text (as UTF-8 bytes) begins a suffix, of which only the first ``window`` bytes (50) count: suffixes equal to
that depth are repeated windows. A byte is removed when it is covered by a window that also begins in a document with a
smaller doc_id. Matches never cross documents, overlaps count, and all windows are judged on the input.

The digits of the radix sort are wide and taken most significant first, and after each pass groups within one document are
dropped, so that only repeated text is sorted further:

1. The first digit is the window's anchor: of its 35 runs of 16 bytes the one of least hash, the leftmost if equal. Equal windows
   have equal anchors, at the same place in the window. Neighbouring windows mostly share an anchor, so they travel as one
   piece of text of window - 1 + n bytes for n windows. Pieces are dealt out by their anchor.
2. The second digit is the place of the anchor in the window and a 64-bit code of all its bytes. Groups of equal digits are
   compared byte for byte, so that a collision of codes never counts as a match.

Each task sorts its own chunk first in the same way, as a partial step before the shuffle: a window that a smaller document of
the chunk has is settled there, and only the others' pieces are sent. So a passage that all documents share arrives once
per chunk. What is found are spans (start, number of windows) of a document; they meet their text by (doc_id, hash of text).

The anchors are taken up in TURNS turns by their hash, one after another, so that only one turn's pieces are on disk at a time.

Memory: CHUNK bytes of text with some arrays of eight bytes per byte; in the second pass a part of about ``part_bytes`` of text,
expanded about STEP windows at a time (of one anchor in more windows than that, one place or some places at a time). The number of parts follows the input's size.

Cases: null text is empty; texts shorter than the window lose nothing; a null doc_id counts as larger than all others; documents
with one doc_id never remove each other's text; an empty table gives an empty result; other columns aren't read
(``without_repeats`` keeps them, with the text replaced by what is left, bytes that no longer form UTF-8 dropped).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import plain, written
from chunklake.llm.tokens import chunks

WINDOW, RUN = 50, 16
CHUNK = 3 << 20
CACHED = 96 << 10
STEP = 1 << 18
TURNS = 2
NO_ID = 2**63 - 1
PARTS = "part int, doc_id long, h long, spans binary, payload binary"
RUNS = "doc_id long, h long, start long, number long"
PIECE = np.dtype([("doc", "<u4"), ("start", "<u4"), ("place", "u1"), ("windows", "u1")])
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def loads(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as a view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit code of two columns of eight bytes."""
    x = a * ODD[0]
    x ^= x >> np.uint64(32)
    x += b
    x *= ODD[1]
    x ^= x >> np.uint64(29)
    x *= ODD[2]
    x ^= x >> np.uint64(32)
    return x


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, place of the anchor in the first, anchor's code."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.astype(np.uint64)
    eight = loads(data).copy()
    code = codes(eight[:-8], eight[8:])
    rank = code & np.uint64(0xFFFFFFFF00000000)
    rank |= np.arange(len(rank), dtype=np.uint64)
    anchor = (least_of(rank, window - RUN + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= window
    edge[starts[long]] += 1
    edge[ends[long] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge, dtype=np.int8)[:-1])
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    own = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return at[first], count, own[first] - at[first], code[own[first]]


def all_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """pieces() of all texts, taken up some at a time, so that its arrays stay in the processor's cache."""
    found, a = [], 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CACHED, side="right")))
        low = int(starts[a])
        first, *others = pieces(data[low : int(ends[b - 1])], starts[a:b] - low, ends[a:b] - low)
        found.append((first + low, *others))
        a = b
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _later(eight: np.ndarray, at: np.ndarray, group: np.ndarray, place: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Second pass: which of these windows also begin in a smaller document. at: where they stand in the text."""
    digits = [*(eight[at + i] for i in range(0, window - 7, 8)), *([eight[at + window - 8]] if window % 8 else [])]
    digit = codes(group.astype(np.uint64), place.astype(np.uint64))
    for x in digits:
        digit = codes(digit, x)
    by = np.argsort(digit, kind="stable")
    begins = _groups(digit[by], group[by], place[by], *(x[by] for x in digits))
    if len(_groups(digit[by])) != len(begins):
        # a collision of codes would cut one group into several: such codes are sorted by their bytes
        by = np.lexsort((*digits[::-1], place, group))
        begins = _groups(group[by], place[by], *(x[by] for x in digits))
    d = doc[by]
    low = np.repeat(np.minimum.reduceat(d, begins), np.diff(np.append(begins, len(by)))) if len(by) else d
    return by[d > low]


def repeated(data: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, code: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also begin in a smaller document: their piece, and their number in it. doc: ids, in order."""
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none
    # first pass: pieces by anchor; an anchor in one document only repeats nothing
    order = np.argsort(code, kind="stable")
    begins = _groups(code[order])
    size = np.diff(np.append(begins, len(order)))
    d = doc[order]
    several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
    group = np.repeat(np.where(several, np.cumsum(several), 0), size)
    order, group = order[group > 0], group[group > 0]
    if not len(order):
        return none, none
    eight = loads(data)
    out_piece, out_number = [], []
    # groups are taken up whole, about STEP windows at a time
    total = np.cumsum(count[order])
    begins = _groups(group)
    cuts, upto = [0], 0
    for b in begins[1:].tolist():
        if total[b - 1] - upto >= STEP:
            cuts.append(b)
            upto = total[b - 1]
    cuts.append(len(order))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, n = order[a:b], count[order[a:b]]
        piece, g = np.repeat(own, n), np.repeat(group[a:b], n)
        number = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        at, rest = first[piece] + number, place[piece] - number
        # equal windows have their anchor at the same place: a group of very many windows is taken up by places
        turns = min(window - RUN + 1, max(1, len(piece) // STEP))
        for turn in range(turns):
            of = np.flatnonzero(rest % turns == turn) if turns > 1 else slice(None)
            gone = _later(eight, at[of], g[of], rest[of], doc[piece[of]], window)
            out_piece.append(piece[of][gone])
            out_number.append(number[of][gone])
    return np.concatenate(out_piece), np.concatenate(out_number)


def runs_of(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' starts as maximal runs: document, first start and number, by document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    begins = np.flatnonzero(new)
    last = np.append(begins[1:], len(doc)) - 1
    return doc[begins], start[begins], start[last] - start[begins] + 1


def sent(ids: np.ndarray, hashes: np.ndarray, texts: list[bytes], parts: int, turn: int = 0, turns: int = 1) -> Iterator[tuple]:
    """A chunk's rows: spans that it settles itself, and for each part the pieces that others must see; anchors of one turn only."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    first, count, place, code = all_pieces(data, starts, ends)
    if turns > 1:
        own = (code >> np.uint64(40)) % np.uint64(turns) == turn
        first, count, place, code = first[own], count[own], place[own], code[own]
    if not len(first):
        return
    owner = np.searchsorted(ends, first, side="right")
    piece, number = repeated(data, first, count, place, code, ids[owner])
    doc, start, n = runs_of(owner[piece], first[piece] + number - starts[owner[piece]])
    spans, cut = np.stack([start, n], 1).astype("<i8"), np.append(_groups(doc), len(doc))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        k = int(doc[a])
        yield int(hashes[k] % parts), int(ids[k]), int(hashes[k]), spans[a:b].tobytes(), None
    left = np.ones(len(first), bool)
    settled = np.bincount(piece, minlength=len(first))
    left[settled == count] = False
    kept = np.flatnonzero(left)
    part = (code[kept] % np.uint64(parts)).astype(np.int64)
    kept, part = kept[np.argsort(part, kind="stable")], np.sort(part)
    cut = np.append(_groups(part), len(part)) if len(part) else []
    squeeze = zstandard.ZstdCompressor(level=3)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = kept[a:b]
        docs, doc = np.unique(owner[own], return_inverse=True)
        size = count[own] + WINDOW - 1
        at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        meta = np.empty(len(own), PIECE)
        meta["doc"], meta["start"], meta["place"], meta["windows"] = doc, first[own] - starts[owner[own]], place[own], count[own]
        head = np.array([len(docs), len(own)], "<i8").tobytes()
        # columns one after another compress better than rows
        columns = b"".join(np.ascontiguousarray(meta[c]).tobytes() for c in PIECE.names)
        yield int(part[a]), None, None, None, squeeze.compress(head + ids[docs].astype("<i8").tobytes() + hashes[docs].astype("<i8").tobytes() + columns + data[at].tobytes())


def received(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """The runs of repeated windows of all payloads of a part: doc_id, hash, start, number."""
    ids, hashes, doc, start, place, windows, text, base = [], [], [], [], [], [], [], 0
    stretch = zstandard.ZstdDecompressor()
    for p in payloads:
        p = stretch.decompress(p)
        d, n = (int(v) for v in np.frombuffer(p, "<i8", 2))
        at = 16
        ids.append(np.frombuffer(p, "<i8", d, at))
        hashes.append(np.frombuffer(p, "<i8", d, at + 8 * d))
        at += 16 * d
        columns = {}
        for c in PIECE.names:
            columns[c] = np.frombuffer(p, PIECE[c], n, at)
            at += n * PIECE[c].itemsize
        doc.append(columns["doc"].astype(np.int64) + base)
        start.append(columns["start"].astype(np.int64))
        place.append(columns["place"])
        windows.append(columns["windows"])
        text.append(p[at:])
        base += d
    if not text:
        return (np.zeros(0, np.int64),) * 4
    ids, hashes, doc, start = np.concatenate(ids), np.concatenate(hashes), np.concatenate(doc), np.concatenate(start)
    place, count = np.concatenate(place).astype(np.int64), np.concatenate(windows).astype(np.int64)
    data = np.frombuffer(b"".join(text), np.uint8)
    del text
    size = count + WINDOW - 1
    first = np.cumsum(size) - size
    eight = loads(data)
    code = codes(eight[first + place], eight[first + place + 8])
    piece, number = repeated(data, first, count, place, code, ids[doc])
    # the same document may come in several payloads: its runs meet at its text
    doc, start, number = runs_of(doc[piece], start[piece] + number)
    return ids[doc], hashes[doc], start, number


def _mapper(parts: int, turn: int, turns: int):
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in rows:
            for c in chunks(iter([b]), 2):
                if held and size + c.column(2).nbytes > CHUNK:
                    if out := list(sent(*_columns(held), parts, turn, turns)):
                        yield table(out)
                    held, size = [], 0
                held += zip(*(v.to_pylist() for v in c.columns), strict=True)
                size += c.column(2).nbytes
        if held and (out := list(sent(*_columns(held), parts, turn, turns))):
            yield table(out)

    return batches


def _columns(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]


def _reducer(group: pa.Table) -> pa.Table:
    """One row for each maximal run, so that rows follow the repeated text and not the number of parts."""
    settled = group.filter(pc.is_valid(group["spans"]))
    spans = settled["spans"].to_pylist()
    times = np.array([len(x) // 16 for x in spans], np.int64)
    own = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    found = received([p for p in group["payload"].to_pylist() if p is not None])
    mine = (np.repeat(settled["doc_id"].to_numpy(), times), np.repeat(settled["h"].to_numpy(), times), own[:, 0], own[:, 1])
    return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(mine, found, strict=True)], [c.split()[0] for c in RUNS.split(", ")])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the largest), id as it is, h (of the text) and text as bytes."""
    text, own = plain(F.col("text")), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), own.alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, part_bytes: int = 8 << 20, turns: int = TURNS) -> DataFrame:
    """doc_id, h and the list of spans of all documents that lose text; one row per document and text."""
    x = keyed(docs)
    total = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (part_bytes * turns)))
    long = x.where(F.octet_length("text") >= WINDOW).select("doc_id", "h", "text")
    found = None
    for turn in range(turns):
        own = long.mapInArrow(_mapper(parts, turn, turns), PARTS).groupBy("part").applyInArrow(_reducer, RUNS)
        own = written(own, "repeat-spans")  # the turn's shuffle files go as soon as this is written
        found = own if found is None else found.unionByName(own)
    return found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "number")).alias("spans"))


def cut(text: bytes, runs: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left. runs: start and number of repeated windows."""
    if not len(runs):
        return 0, 0, text
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    opens = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), opens, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _runs(spans: pa.ListArray) -> list[np.ndarray]:
    """Each row's runs; a null has none."""
    rows = spans.flatten()
    flat = np.stack([rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False)], 1) if len(rows) else np.zeros((0, 2), np.int64)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "spans")
    return docs.join(s, (F.col("doc_id") == F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")


def removals(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            text = b.column(1).to_pylist()
            found = [cut(t, s) for t, s in zip(text, _runs(b.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in text], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    x = _joined(keyed(docs), repeated_spans(docs, part_bytes)).select("id", "text", "spans")
    return x.mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs with their texts cut."""
    schema = docs.schema
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = plain(F.col("row.text"))
    own = row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"))
    x = _joined(own, repeated_spans(docs, part_bytes)).select("row.*", F.col("spans").alias("__spans"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at = b.schema.names.index("text")
            text = [None if t is None else cut(t.encode(), s)[2].decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), _runs(b.column(b.num_columns - 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)], b.schema.names[:-1])

    return x.mapInArrow(batches, schema)
