"""What the two text indexes share: terms of a text, packed lists of numbers, texts of Arrow batches in segments."""

from __future__ import annotations

import string
from collections.abc import Iterator

#: A term is a run of letters, digits and bytes of characters beyond ASCII; A to Z count as a to z, all else parts terms.
_KEPT = string.ascii_lowercase + string.digits
TERM_BYTES = bytes(ord(chr(b).lower()) if b > 127 or chr(b).lower() in _KEPT else 32 for b in range(128)) + bytes(range(128, 256))
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, in order; none of a null text."""
    return text.translate(TERM_BYTES).split() if text else []


def number(words: list, seen: dict) -> list[int]:
    """A number a word, those of new words following those in seen, a defaultdict whose factory is its own length."""
    return [seen[w] for w in words]


def pack(values) -> tuple[bytes, object]:
    """Non-negative numbers below 2**35 in 7-bit groups, least first, and where each begins (one place more than values)."""
    import numpy as np

    v = np.asarray(values, np.int64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= 1 << 7 * k
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(5):
        there = np.flatnonzero(size > k)
        out[ends[there] + k] = (v[there] >> 7 * k & 127) | (size[there] > k + 1) * 128
    return out.tobytes(), ends


def unpack(packed: bytes):
    """The numbers of pack()."""
    import numpy as np

    b = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        there = np.flatnonzero(last - first >= k)
        out[there] |= (b[first[there] + k].astype(np.int64) & 127) << 7 * k
    return out


def segments(batches: Iterator, most_bytes: int, most_rows: int) -> Iterator[tuple[int, list, list]]:
    """(number, ids, texts) of Arrow batches (id, text): runs of rows of at most so many and about so many bytes, or one long text.

    The number holds the task's partition, so it is told apart from those of other tasks and the same when a task runs again.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        at = size = 0
        for i, text in enumerate([*texts, None]):
            if i == len(texts) or i > at and (i - at >= most_rows or size + len(text or b"") > most_bytes):
                if i > at:
                    yield number, ids[at:i], texts[at:i]
                    number += 1
                at, size = i, 0
            size += len(text or b"")
