"""Arrow text columns as flat numpy code-point arrays, and back.

Whole columns are converted at once: one UTF-8 to UTF-32 pass over the value buffer, offsets by cumulative
sums. No call is made per row.  A null text counts as an empty one; callers that must tell them apart use the
column's validity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time in a Python worker; bounds its memory, not the result.
CHUNK_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch into runs of rows with about `limit` bytes of text each (a longer text stands alone)."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield batch.slice(a, min(b, n) - a)
        a = min(b, n)


def to_codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows one after another (uint32) and the n + 1 row offsets into them."""
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    raw = memoryview(col.buffers()[2] or b"")[offs[0] : offs[-1]]
    byte = np.frombuffer(raw, np.uint8)
    cp = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(byte):
        return cp, offs - offs[0]
    starts = np.zeros(len(byte) + 1, np.int64)
    np.cumsum((byte & 0xC0) != 0x80, out=starts[1:])
    return cp, starts[offs - offs[0]]


def to_arrow(cp: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of to_codepoints; `valid` marks the rows that are not null."""
    data = np.ascontiguousarray(cp, np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int64) + (cp > 0xFFFF), out=width[1:])
    at = width[offsets]
    n = len(offsets) - 1
    nulls = None
    if valid is not None and not valid.all():
        nulls = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), n, [nulls, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())


def keep(cp: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops the code points where mask is false and moves the offsets along."""
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(mask, out=at[1:])
    return cp[mask], at[offsets]


def rolling_hash(cp: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of every k neighbouring code points (length len(cp) - k + 1), by doubling.

    The windows do not respect row ends; callers drop those that cross one.
    """
    if len(cp) < k:
        return np.zeros(0, np.uint64)
    base, power = np.uint64(0x9E3779B97F4A7C15 | 1), 1
    level = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    out: np.ndarray | None = None
    done, bit = 0, 1
    with np.errstate(over="ignore"):
        while bit <= k:
            scale = np.uint64(pow(int(base), power, 1 << 64))
            if k & bit:
                if out is None:
                    out, done = level, bit
                else:
                    n = len(cp) - done - bit + 1
                    out = out[:n] * np.uint64(pow(int(base), bit, 1 << 64)) + level[done : done + n]
                    done += bit
            if bit * 2 <= k:
                level = level[: len(level) - bit] * scale + level[bit:]
            bit *= 2
            power *= 2
        out = out ^ (out >> np.uint64(31))
        out = out * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(29))
