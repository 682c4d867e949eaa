"""License scans: exact set-similarity join of text blocks with license notices, beside exact phrases.

Blocks: windows of 2 * L words of every whole text, one beginning every L words, where L is the number of words of the longest
notice; so any L words in a row stand in one block. A block matches a notice when it holds at least ``threshold`` of the
notice's distinct words (containment).

The join is exact and never compares all blocks with all notices. Words are ordered by their frequency in the whole corpus,
rare ones first (a first pass counts them). A matching block must hold one of the notice's first |T| - needed + 1 words (prefix
filter), have at least ``needed`` distinct words (length filter), and where its first common word stands at place i of the notice
and j of the block, what is left of both must suffice (positional filter). Only notices' words matter to the overlap, but blocks'
lengths and places count all of their words. What is left is verified.

The notices are a parameter of bounded size (a table of texts); the corpus's words are counted for the notices' words only, so
what comes to the driver is as large as the notices, not as the corpus.

Cases: null and empty texts have no word, no label and score 0; null doc_id is carried on; a text repeated is scanned each time;
several labels may hold; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.tokens import chunks, ids_of, words_of

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as their licenses word them, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long, matches string"


@dataclass
class Notices:
    vocabulary: dict[bytes, int]  # word -> place in the order by frequency, rare ones first
    phrases: list[tuple[list[int], str]]
    notices: list[tuple[list[int], str]]  # distinct words in that order
    needed: list[int]
    prefix: np.ndarray  # by word: whether it stands in the prefix of a notice
    by_prefix: dict[int, list[tuple[int, int]]]  # word -> (notice, place in it)
    block: int


def vocabulary_of(phrases: Mapping[str, str], notices: Mapping[str, str]) -> list[bytes]:
    return sorted({w for t in [*phrases, *notices] for w in words_of(t.encode())})


def word_frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """Times that each of the words stands in the whole corpus; one row per batch and word is shuffled."""
    known = {w: i for i, w in enumerate(words)}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for b in rows:
            for c in chunks(iter([b]), 0):
                ids, _ = ids_of(c.column(0).to_pylist(), known)
                total += np.bincount(ids + 1, minlength=len(words) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(total[1:])], ["word", "n"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(batches, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r.word]: r.n for r in counted}


def prepare(frequency: Mapping[bytes, int], phrases: Mapping[str, str], notices: Mapping[str, str], threshold: float) -> Notices:
    order = sorted(vocabulary_of(phrases, notices), key=lambda w: (frequency.get(w, 0), w))
    vocabulary = {w: i for i, w in enumerate(order)}
    own = [(sorted({vocabulary[w] for w in words_of(t.encode())}), label) for t, label in notices.items()]
    needed = [int(np.ceil(threshold * len(t) - 1e-9)) for t, _ in own]
    prefix, by_prefix = np.zeros(len(order) + 1, bool), {}
    for k, ((t, _), n) in enumerate(zip(own, needed, strict=True)):
        for place, w in enumerate(t[: len(t) - n + 1]):
            prefix[w] = True
            by_prefix.setdefault(w, []).append((k, place))
    longest = max((len(words_of(t.encode())) for t in notices), default=1)
    return Notices(vocabulary, [([vocabulary[w] for w in words_of(t.encode())], label) for t, label in phrases.items()], own, needed, prefix, by_prefix, longest)


def matches(x: Notices, ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, distinct) -> dict[int, dict[int, float]]:
    """For each text (its position) the notices that one of its blocks meets, with the best containment."""
    out: dict[int, dict[int, float]] = {}
    rare = np.flatnonzero(x.prefix[ids])
    # a word stands in the block that begins at or before it and in the one before that
    text = np.searchsorted(ends, rare, side="right")
    at = (rare - starts[text]) // x.block
    blocks = sorted({(int(t), int(max(0, b - back))) for t, b in zip(text, at, strict=True) for back in (0, 1)})
    for t, b in blocks:
        first = int(starts[t]) + b * x.block
        last = min(first + 2 * x.block, int(ends[t]))
        known = sorted(set(ids[first:last].tolist()) - {-1})
        size = None
        for j, w in enumerate(known):
            for k, i in x.by_prefix.get(w, ()):
                notice, label = x.notices[k]
                if size is None:
                    size = distinct(t, b)
                if size < x.needed[k]:  # length filter
                    continue
                if 1 + min(len(notice) - i - 1, len(known) - j - 1) + min(i, j) < x.needed[k]:  # positional filter
                    continue
                overlap = len(set(notice).intersection(known))
                if overlap >= x.needed[k]:
                    own = out.setdefault(t, {})
                    own[k] = max(own.get(k, 0.0), overlap / len(notice))
    return out


def base_places(x: Notices, ids: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, str]]:
    """Where each phrase's words stand consecutively, in one text."""
    out = []
    for words, label in x.phrases:
        here = np.flatnonzero(ids == words[0])
        for k, w in enumerate(words[1:], 1):
            here = here[here + k < len(ids)]
            here = here[ids[here + k] == w]
        if len(here):
            here = here[np.searchsorted(ends, here, side="right") == np.searchsorted(ends, here + len(words) - 1, side="right")]
        out.append((here, label))
    return out


def scan_batch(x: Notices, texts: list[bytes | None]) -> Iterator[tuple]:
    ids, ends = ids_of(texts, x.vocabulary)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)

    numbered: dict[int, np.ndarray] = {}

    def distinct(t: int, b: int) -> int:
        if t not in numbered:  # a text's words are numbered once, whatever the number of its blocks
            numbers: dict[bytes, int] = {}
            numbered[t] = np.array([numbers.setdefault(w, len(numbers)) for w in words_of(texts[t])], np.int32)
        return len(np.unique(numbered[t][b * x.block : (b + 2) * x.block]))

    found = matches(x, ids, np.arange(len(texts)), starts, ends, distinct)
    base: dict[int, list[tuple[int, str]]] = {}
    for places, label in base_places(x, ids, ends):
        for t, p in zip(np.searchsorted(ends, places, side="right").tolist(), places.tolist(), strict=True):
            base.setdefault(t, []).append((p - int(starts[t]), label))
    for t in range(len(texts)):
        n = int(ends[t] - starts[t])
        own, mine = base.get(t, []), found.get(t, {})
        at = [p for p, _ in own]
        labels = {label for _, label in own}
        more = {x.notices[k][1] for k in mine}
        listed = ",".join(f"{x.notices[k][1]}:{mine[k]:.3f}" for k in sorted(mine))
        score = max([1.0 if own else 0.0, *mine.values()])
        yield n, len(own), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), score, max(0, -(-n // x.block)), listed


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, threshold: float = 0.9) -> DataFrame:
    """RESULT's columns of every document. labels: base labels and those of the notices that a block meets."""
    x = prepare(word_frequencies(docs, vocabulary_of(phrases, notices)), phrases, notices, threshold)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c in chunks(iter([b])):
                cols = list(zip(*scan_batch(x, c.column(1).to_pylist()), strict=True))
                if cols:
                    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], [n.split()[0] for n in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(batches, RESULT)
