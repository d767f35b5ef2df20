"""Words of whole texts, a batch of documents at a time, in numpy.

A word is a run of bytes other than space and the five ASCII blanks from tab to
carriage return.  Those bytes never occur inside a longer UTF-8 sequence, so
runs of bytes and runs of characters are the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer word is still seen whole.
PIECE_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII letters in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finalizer)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(PIECE_BYTES, base, _U64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes of text, a document never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each row."""
    solid = ~BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    Sums of random byte values times powers of an odd number, by difference of
    running sums over pieces of the text, so that memory doesn't grow with the
    longest text."""
    out = np.empty(len(starts), _U64)
    forth, back = _powers()
    at = 0
    while at < len(starts):
        origin = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, origin + PIECE_BYTES, "right")))
        length = int(ends[stop - 1] - origin)
        if length > PIECE_BYTES:  # one word longer than a piece: hash it in parts, then the parts
            total = 0
            for k, p in enumerate(range(0, length, PIECE_BYTES)):
                part = data[origin + p:origin + min(p + PIECE_BYTES, length)]
                total = (total + int((_BYTE_VALUE[part] * forth[:len(part)]).sum()) * pow(_BASE, k * PIECE_BYTES, 1 << 64)) % (1 << 64)
            out[at] = total
        else:
            running = np.zeros(length + 1, _U64)
            np.cumsum(_BYTE_VALUE[data[origin:origin + length]] * forth[:length], out=running[1:])
            a, b = starts[at:stop] - origin, ends[at:stop] - origin
            out[at:stop] = (running[b] - running[a]) * back[a]
        at = stop
    return mix64(out + (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``width`` words inside a row, and their number by row.

    A row with fewer words, but some, has its whole sequence as its only run."""
    n = len(words)
    row_end = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    fits = np.arange(n) + width <= row_end[row]
    short = (counts > 0) & (counts < width)
    first = row_end - counts
    whole = np.zeros(n, bool)
    whole[first[short]] = True
    value = words.copy()
    for j in range(1, width):
        step = _U64((0xA0761D6478BD642F * (2 * j + 1)) & (2 ** 64 - 1)) | _U64(1)
        inside = np.arange(n) + j < row_end[row]
        later = np.zeros(n, _U64)
        later[:n - j] = words[j:]
        value = np.where(inside, mix64(value) + later * step, mix64(value) + _U64(j))
    use = fits | whole
    return mix64(value[use]), np.bincount(row[use], minlength=len(counts)) if n else np.zeros(len(counts), np.int64)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """All words as one Arrow array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    values = np.ascontiguousarray(data[~BLANK[data]])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(values))
