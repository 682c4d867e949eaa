"""Benchmark decontamination: an inverted index of test items, queried by every training passage with block-max WAND.

Index: its terms are pairs of neighbouring words (single words say little in a language of few syllables); the term of an item of
one word is that word. Every item is cut into segments of at most SEGMENT terms; a posting holds a segment and the share of the segment's own BM25 score that the term
brings, so that a passage's score for a segment is between 0 and 1 (the BM25-weighted part of the segment's terms that the
passage has). Postings are in order of segment, in blocks that carry their maxima.

Queries: all passages of all documents, of 2 * SEGMENT terms, one beginning every SEGMENT terms, so that a segment's terms stand
whole in one of them. A passage whose terms' maxima do not reach the threshold together cannot retrieve anything; for the
others WAND moves by the terms' maxima and skips blocks by the blocks' maxima. All segments at or above the threshold come out.

Verification: shingles of five words of the item in the document around the passage: at least ``overlap`` (0.8) of the item's,
and at least ``part_overlap`` of the question's and of the answer's alone. The answer is the item's last line, or its last
sentence where it has one line; an item of one sentence is a question only. A part of fewer than five words is one shingle.

The index is built on the driver, in flat arrays, and broadcast once. Its size is bounded: a word of an item costs at most WORD_BYTES
in the index (measured, every word new), and items of more than ``max_index_bytes`` by that bound are taken up in several parts
(by a hash of item_id), each with a pass over the documents.

Shingles are compared as wholes: a shingle's number is found word by word in tables of the items' own beginnings of shingles.

Cases: null text is empty and never matches; items without a word are left out; a null doc_id or item_id is carried on;
repeated documents are listed each; repeated items are items of their own; empty tables give an empty result; other columns
aren't read (``without_leaks`` keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import held, plain, rows_in, written
from chunklake.llm.tokens import chunks, ids_of, words_of

SEGMENT = 48
BLOCK = 16
SHINGLE = 5
K1, B = 1.2, 0.75
#: Upper bound of what one word of an item takes in the index and while it is built.
WORD_BYTES = 400
HIT = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and answer."""
    lines = [x for x in text.split(b"\n") if words_of(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(rb"(?<=[.!?])\s+", text) if words_of(x)]
    return (words_of(b" ".join(lines[:-1])), words_of(lines[-1])) if len(lines) > 1 else (words_of(text), [])


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    #: shingle numbers: tables[k] has, in order, the codes (number of the first k words * words + the next word) of k + 1 words
    tables: list[np.ndarray]
    #: codes of the terms (a pair as in tables[1], or words * words + word), in order; a term's number is its place
    codes: np.ndarray
    #: postings of term t: from first[t] to first[t + 1]; blocks of BLOCK postings begin anew with each term
    first: np.ndarray
    segments: np.ndarray
    shares: np.ndarray
    first_block: np.ndarray
    block_max: np.ndarray
    #: by term, and 0 at the end for unknown terms
    most: np.ndarray
    item_of: np.ndarray
    item_ids: list[int | None]
    #: by item: (words in a shingle, distinct numbers of the shingles) of the whole, the question and the answer
    pieces: list[tuple[tuple[int, np.ndarray], ...]]
    length: np.ndarray

    def terms(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pair and of the single word that begin with each word, -1 where there is none."""
        words = len(self.vocabulary)
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1].astype(np.int64) * words + ids[1:], -1)
        pair = _place(self.codes, np.append(pair, -1))
        pair[ends[ends > 0] - 1] = -1  # a term does not go on into the next text
        return pair, _place(self.codes, np.where(ids >= 0, ids.astype(np.int64) + words * words, -1))

    def numbers(self, ids: np.ndarray, upto: int) -> list[np.ndarray]:
        """The numbers of the shingles of 1, 2, ... ``upto`` words that begin with each word, -1 where the items have none."""
        out = [ids.astype(np.int64)]
        for k in range(1, upto):
            before, after = out[-1][:-1], ids[k:]
            out.append(_place(self.tables[k], np.where((before >= 0) & (after >= 0), before * len(self.vocabulary) + after, -1)))
        return out

    def nbytes(self) -> int:
        arrays = [*self.tables, self.codes, self.first, self.segments, self.shares, self.first_block, self.block_max, self.most, self.item_of, self.length]
        return sum(x.nbytes for x in arrays) + sum(v.nbytes + 200 for p in self.pieces for _, v in p) + sum(len(w) + 120 for w in self.vocabulary)


def _place(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where each code stands, -1 where it doesn't."""
    if not len(codes):
        return np.full(len(code), -1, np.int64)
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return np.where(codes[place] == code, place, -1)


def build(items: list[tuple[int | None, bytes]]) -> Index:
    vocabulary: dict[bytes, int] = {}
    number = lambda w: vocabulary.setdefault(w, len(vocabulary))
    kept, ids_, asked = [], [], []
    for item_id, text in items:
        words = np.array([number(w) for w in words_of(text)], np.int32)
        if len(words):
            kept.append(words)
            asked.append([len(p) for p in parts(text)])
            ids_.append(item_id)
    size = len(vocabulary)

    # numbers of shingles: parts of an item follow each other, so that the question is its first words and the answer its last
    tables, numbers = [np.arange(size, dtype=np.int64)], [[w.astype(np.int64)] for w in kept]
    for k in range(1, SHINGLE):
        codes = [n[-1][:-1] * size + w[k:] for n, w in zip(numbers, kept, strict=True)]
        tables.append(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64))
        for n, c in zip(numbers, codes, strict=True):
            n.append(np.searchsorted(tables[k], c))
    pieces = []
    for n, w, (question, answer) in zip(numbers, kept, asked, strict=True):
        own = []
        for a, b in ((0, len(w)), (0, question), (len(w) - answer, len(w))):
            k = min(SHINGLE, b - a)
            own.append((k, np.unique(n[k - 1][a : b - k + 1]) if k else np.zeros(0, np.int64)))
        pieces.append(tuple(own))
    del numbers

    coded = [w[:-1].astype(np.int64) * size + w[1:] if len(w) > 1 else w.astype(np.int64) + size * size for w in kept]
    codes = np.unique(np.concatenate(coded)) if coded else np.zeros(0, np.int64)
    cut, item_of = [], []
    for item, code in enumerate(coded):
        terms = np.searchsorted(codes, code)
        n = math.ceil(len(terms) / SEGMENT)
        cut += [terms[len(terms) * i // n : len(terms) * (i + 1) // n] for i in range(n)]
        item_of += [item] * n
    counted = [np.unique(s, return_counts=True) for s in cut]
    seen = np.bincount(np.concatenate([t for t, _ in counted]), minlength=len(codes)) if cut else np.zeros(0, np.int64)
    mean = sum(map(len, cut)) / max(1, len(cut))
    weight = np.log(1 + (len(cut) - seen + 0.5) / (seen + 0.5))
    term, segment, share = [], [], []
    for k, ((t, n), s) in enumerate(zip(counted, cut, strict=True)):
        brought = weight[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(s) / mean))
        term.append(t)
        segment.append(np.full(len(t), k, np.int32))
        share.append(brought / brought.sum())
    none = np.zeros(0, np.int64)
    term, segment, share = (np.concatenate(x) if x else none for x in (term, segment, share))
    order = np.argsort(term, kind="stable")  # within a term by segment
    term, segment, share = term[order], segment[order], share[order]
    times = np.bincount(term, minlength=len(codes))
    first = np.concatenate(([0], np.cumsum(times)))
    first_block = np.concatenate(([0], np.cumsum(-(-times // BLOCK))))
    opens = np.flatnonzero((np.arange(len(term)) - first[term]) % BLOCK == 0)
    block_max = np.maximum.reduceat(share, opens) if len(term) else np.zeros(0)
    most = np.append(np.maximum.reduceat(share, first[:-1]), 0.0) if len(term) else np.zeros(1)
    return Index(vocabulary, tables, codes, first, segment, share, first_block, block_max, most, np.array(item_of, np.int64), ids_, pieces, np.array([len(w) for w in kept], np.int64))


def wand(x: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All segments whose score for these distinct terms is threshold or more."""
    threshold -= 1e-9
    lists = []
    for w in terms:
        own, blocks = slice(x.first[w], x.first[w + 1]), slice(x.first_block[w], x.first_block[w + 1])
        lists.append((x.segments[own].tolist(), x.shares[own].tolist(), x.block_max[blocks].tolist(), float(x.most[w])))
    at = [0] * len(lists)
    order, out = list(range(len(lists))), []
    while order:
        order.sort(key=lambda i: lists[i][0][at[i]])
        reach, pivot = 0.0, -1
        for k, i in enumerate(order):
            reach += lists[i][3]
            if reach >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        segment = lists[order[pivot]][0][at[order[pivot]]]
        while pivot + 1 < len(order) and lists[order[pivot + 1]][0][at[order[pivot + 1]]] == segment:
            pivot += 1
        head = order[: pivot + 1]
        # what the lists' blocks can bring where this segment would stand
        bound, skip = 0.0, None
        for i in head:
            own, _, maxima, _ = lists[i]
            b = at[i] // BLOCK
            while b + 1 < len(maxima) and own[min(len(own), (b + 1) * BLOCK) - 1] < segment:
                b += 1
            bound += maxima[b]
            last = own[min(len(own), (b + 1) * BLOCK) - 1]
            skip = last + 1 if skip is None else min(skip, max(last, segment) + 1)
        if bound < threshold:
            target = max(skip, segment + 1)
            if pivot + 1 < len(order):
                target = min(target, lists[order[pivot + 1]][0][at[order[pivot + 1]]])
            target = max(target, segment + 1)
        elif lists[order[0]][0][at[order[0]]] == segment:
            score = sum(lists[i][1][at[i]] for i in head)
            if score >= threshold:
                out.append((segment, score))
            target = segment + 1
        else:
            target = segment
        for i in head:
            own, p = lists[i][0], at[i]
            while p < len(own) and own[p] < target:
                # whole blocks first
                p = (p // BLOCK + 1) * BLOCK if own[min(len(own), (p // BLOCK + 1) * BLOCK) - 1] < target else p + 1
            at[i] = p
        order = [i for i in order if at[i] < len(lists[i][0])]
    return out


def search(x: Index, ids: np.ndarray, ends: np.ndarray, threshold: float, overlap: float, part_overlap: float) -> Iterator[tuple]:
    """(text's position, item, score, overlaps, first word) of each item that a text holds; at most one row for each pair."""
    if not len(ids) or not x.item_ids:
        return
    terms, single = x.terms(ids, ends)
    gain = np.concatenate(([0.0], np.cumsum(x.most[terms] + x.most[single])))
    starts = np.concatenate(([0], ends[:-1]))
    count = np.maximum(1, -(-(ends - starts) // SEGMENT) - 1)  # passages of each text
    text = np.repeat(np.arange(len(ends)), count)
    first = starts[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(first + 2 * SEGMENT, ends[text])
    best: dict[tuple[int, int], tuple] = {}
    for k in np.flatnonzero(gain[last] - gain[first] >= threshold - 1e-6).tolist():
        own = np.concatenate((terms[first[k] : last[k]], single[first[k] : last[k]]))
        own = np.unique(own[own >= 0])
        if x.most[own].sum() < threshold - 1e-6:
            continue
        for segment, score in wand(x, own.tolist(), threshold):
            item, t = int(x.item_of[segment]), int(text[k])
            around = ids[max(starts[t], first[k] - x.length[item]) : min(ends[t], last[k] + x.length[item])]
            there = x.numbers(around, min(SHINGLE, len(around)))
            share = lambda n, part: 1.0 if not n else float(np.isin(part, there[n - 1]).mean()) if n <= len(there) else 0.0  # noqa: B023, E731
            all_of, question, answer = (share(*p) for p in x.pieces[item])
            if all_of >= overlap and min(question, answer) >= part_overlap and best.get((t, item), (0.0,))[0] < score:
                best[t, item] = (score, all_of, question, answer, int(first[k] - starts[t]))
    for (t, item), found in sorted(best.items()):
        yield t, item, *found


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_overlap: float = 0.5, max_index_bytes: int = 512 << 20) -> DataFrame:
    """One row for each document and test item that it holds: HIT's columns."""
    items = items.select(F.col("item_id").cast("long"), plain(F.col("text")).cast("binary").alias("text"))
    words = F.size(F.split(F.trim(F.regexp_replace(F.col("text").cast("string"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")), " "))
    total = items.agg(F.sum(words.cast("long") * WORD_BYTES + F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / max_index_bytes))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    out = None
    for part in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).collect()
        index = build(sorted(((r.item_id, bytes(r.text)) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        found = texts.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap, part_overlap), HIT)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(sent: Broadcast, threshold: float, overlap: float, part_overlap: float):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for b in chunks(rows):
            ids, ends = ids_of(b.column(1).to_pylist(), index.vocabulary)
            doc = b.column(0).to_pylist()
            hits = list(search(index, ids, ends, threshold, overlap, part_overlap))
            if hits:
                t, item, score, whole, question, answer, first = zip(*hits, strict=True)
                ints = [pa.array([doc[k] for k in t], pa.int64()), pa.array([index.item_ids[k] for k in item], pa.int64())]
                yield pa.RecordBatch.from_arrays([*ints, *(pa.array(v, pa.float64()) for v in (score, whole, question, answer)), pa.array(first, pa.int64())], [c.split()[0] for c in HIT.split(", ")])

    return batches


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text holds no item, whatever their doc_id."""
    h = F.xxhash64(plain(F.col("text")).cast("binary"))
    found = leaks(docs.select(h.alias("doc_id"), "text"), items, **options)  # a leak depends on the text alone
    gone = written(found.select(F.col("doc_id").alias("gone")).distinct(), "leaks")
    return docs.join(held(gone, rows_in(gone)), h == F.col("gone"), "left_anti")
