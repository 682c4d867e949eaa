"""Words of whole texts, as bytes, for the operators that run in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z in lower case; ASCII letters, digits and all of UTF-8 beyond ASCII are parts of words; the rest separates.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of text that are taken up at a time, unless one text alone has more.
CHUNK = 2 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def chunks(rows: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most CHUNK bytes of text, or one row."""
    for b in rows:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0)
        start, total = 0, 0
        for i, n in enumerate(size.to_pylist()):
            if total and total + n > CHUNK:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < b.num_rows:
            yield b.slice(start)


def ids_of(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers (unknown: -1), one after another, and where each text's words end."""
    per = [words_of(t) for t in texts]
    ends = np.cumsum([len(w) for w in per], dtype=np.int64)
    get = vocabulary.get
    flat = [get(x, -1) for w in per for x in w]
    return np.array(flat, np.int32), ends
