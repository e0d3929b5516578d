"""Vectorised words, word hashes and window hashes over Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D (those bytes never
occur inside a multi-byte UTF-8 character, so splitting bytes equals splitting
characters).  Everything works on the UTF-8 buffer of an Arrow column with
NumPy; no Python string is built per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT_BYTES = 1 << 20         # hashing works on runs of about this many bytes


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _space_table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _plain_table() -> np.ndarray:
    t = _lower_table()
    for b in range(128):
        if not chr(b).isalnum():
            t[b] = 0x20
    return t


LOWER = _lower_table()          # A-Z in lower case
PLAIN = _plain_table()          # also other ASCII than letters and digits as spaces


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``, row of each word, and for
    row r the word range ``first[r]:first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_slices(col, limit: int):
    """Runs of rows with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    begin, n = 0, len(col)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield begin, min(end, n)
        begin = end
    pa.default_memory_pool().release_unused()   # the worker may next run another operator


def split_words(col, byte_map: np.ndarray | None = None) -> Words:
    """Words of every row of an Arrow text column, after replacing each byte by
    its entry in ``byte_map`` (see ``LOWER``)."""
    data, offsets = text_buffer(col)
    if byte_map is not None:
        data = byte_map[data]
    n_rows = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, np.zeros(n_rows + 1, np.int64))
    word = ~_space_table()[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]                       # a word also ends where its row ends
    at = inner[(inner > 0) & (inner < len(data))]
    begins[at] = word[at]
    ends[at - 1] = word[at - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    return Words(data, start, end, row, first)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(w: Words, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word, a polynomial over tabulated bytes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 2 ** 63, 256, dtype=np.uint64)
    r = int(rng.integers(1, 2 ** 62)) * 2 + 1
    r_inv = pow(r, -1, 1 << 64)
    out = np.empty(len(w.start), dtype=np.uint64)
    i, n = 0, len(w.start)
    up = down = np.ones(1, np.uint64)
    while i < n:
        lo = int(w.start[i])
        j = max(i + 1, int(np.searchsorted(w.end, lo + SEGMENT_BYTES, "right")))
        hi = int(w.end[j - 1])
        if len(up) < hi - lo + 1:
            size = max(hi - lo + 1, 1 << 16)
            up, down = _powers(r, size), _powers(r_inv, size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[w.data[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = w.start[i:j] - lo, w.end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return splitmix(out)


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (by its first word;
    runs that cross a row are included, see ``window_valid``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rng = np.random.Generator(np.random.PCG64(seed + 7919))
    out = np.zeros(n, np.uint64)
    for c, j in zip(rng.integers(1, 2 ** 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), range(k)):
        out += splitmix(h[j:j + n] * c)
    return splitmix(out)


def window_valid(w: Words, k: int) -> np.ndarray:
    """Whether the run of ``k`` words from each word stays inside its row."""
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    return w.row[:n] == w.row[k - 1:]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed longs Spark stores."""
    return x.view(np.int64)
