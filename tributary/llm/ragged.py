"""Ragged text arrays: words, hashes and code points of an Arrow text column, without a Python object per word.

A text column is cut into chunks of about ``CHUNK`` bytes and at most ``CHUNK_ROWS`` rows, so that the arrays built over a chunk stay in the
CPU caches and a worker's memory doesn't follow the size of Spark's batches. One text longer than that is a chunk of
its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
#: Rows of a chunk at most, for arrays with a row of their own for each text.
CHUNK_ROWS = 1024
U64 = np.uint64


@dataclass
class Texts:
    """Rows lo..hi of a column: their bytes on end, row i at off[i]:off[i + 1]."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    def text(self, i: int) -> str:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null texts are empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = pc.cast(column, pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    buf, off = text_column(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + CHUNK_ROWS, n)
        yield Texts(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """bool[256], true within the (first, last) ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but space and the controls from tab to carriage return.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters and all bytes of characters beyond ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[LOWER] * U64(2) + U64(1)
_PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n; kept for the worker's life up to 4 chunks' length."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, CHUNK + 1)
    made = [np.concatenate([[U64(1)], np.full(size - 1, p, np.uint64)]).cumprod(dtype=np.uint64) for p in (_P, _P_INV)]
    if size <= 4 * CHUNK:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of a chunk: bytes start[i]:end[i]; row r has the words woff[r]:woff[r + 1]."""

    start: np.ndarray
    end: np.ndarray
    woff: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.woff)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.woff) - 1), self.counts)


def words(t: Texts, table: np.ndarray) -> Words:
    """Runs of the table's bytes; a row's end also ends a run."""
    n = len(t.buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(t.off), np.int64))
    inside = table[t.buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    before[t.off[:-1][t.off[:-1] < n]] = False
    after[t.off[1:][t.off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.off))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans start:end of symbols that stand as random 64-bit values."""
    n = len(values)
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(t: Texts, w: Words, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased, equal in all workers and runs."""
    return span_hashes((_BYTE if lower else _PLAIN)[t.buf], w.start, w.end)


def random_values(n: int) -> np.ndarray:
    """The random odd values of n symbols, the same in all workers."""
    return np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def code_values(cps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A random odd value for each code point, the same in all workers: the table's, and beyond it a mix of the code point."""
    out = table[np.minimum(cps, len(table) - 1)]
    beyond = cps >= len(table)
    if beyond.any():
        out[beyond] = mix(cps[beyond].astype(np.uint64) + U64(1 << 40)) | U64(1)
    return out


def hash_word(word: str) -> int:
    """The hash that word_hashes() gives one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    t = Texts(0, 1, b, np.array([0, len(b)]))
    return int(word_hashes(t, Words(np.array([0]), np.array([len(b)]), np.array([0, 1])))[0])


def shingles(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words on end within a row, and the row's offsets in them; a row of 1 to k - 1 words is one."""
    n, counts = len(h), np.diff(woff)
    made = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    soff = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(int(soff[-1]), np.uint64)
    if n == 0:
        return out, soff
    total = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        total += h[j : j + len(total)] * U64(pow(int(_P), j + 1, 2**64))
    long = counts >= k
    at = np.repeat(woff[:-1][long], made[long]) + _within(made[long])
    to = np.repeat(soff[:-1][long], made[long]) + _within(made[long])
    out[to] = mix(total[at])
    for r in np.flatnonzero((counts > 0) & ~long):
        x = np.array([counts[r]], np.uint64)
        for v in h[woff[r] : woff[r + 1]]:
            x = mix(x * _P + v)
        out[soff[r]] = x[0]
    return out, soff


def _within(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, on end."""
    end = np.cumsum(lengths)
    return np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - lengths, lengths)


within = _within


def gather_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, on end."""
    return np.repeat(start, length) + _within(length)


def distinct_sets(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and the new offsets."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, rows)) if len(off) > 2 else np.argsort(values, kind="stable")
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.concatenate([[0], np.cumsum(np.bincount(r[new], minlength=len(off) - 1))]).astype(np.int64)


def code_points(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The chunk as uint32 code points, and the rows' offsets in them."""
    cps = np.frombuffer(t.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
    return cps, first[t.off]


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def binary_rows(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each row's values as bytes."""
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    at = pa.py_buffer((off * values.itemsize).astype(np.int64).tobytes())
    return pc.cast(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, at, data]), pa.binary())
