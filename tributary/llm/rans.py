"""Static range asymmetric numeral system over numpy arrays.

A block is coded by LANES states that take its symbols in turn (symbol i goes to lane i mod LANES), all with one
frequency table; one numpy step codes a symbol of every lane. States lie in [2^31, 2^63) and give off 32-bit words.
Every CHECKPOINT steps a block notes the lanes' states and the place in its words, and a checksum of the symbols in
between, so that parts of a block can be decoded and verified side by side.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 1024
CHECKPOINT = 128
#: Frequencies of a table add up to 2^SCALE.
SCALE = 20
LOW = np.uint64(1 << 31)
U64 = np.uint64


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to the counts that add up to 2^SCALE, 1 at least for each symbol that occurs."""
    total, size = int(counts.sum()), 1 << SCALE
    present = np.flatnonzero(counts)
    if len(present) > size:
        raise ValueError(f"more than {size} different symbols")
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    out[present] = np.maximum(1, np.floor(counts[present] * (size / total)).astype(np.int64))
    order = present[np.argsort(-counts[present], kind="stable")]
    over = int(out.sum()) - size
    while over:
        # take from, or give to, the most frequent ones in proportion
        part = out[order] if over < 0 else out[order] - 1
        share = np.ceil(part * (abs(over) / max(1, part.sum()))).astype(np.int64)
        share = np.minimum(share, part) if over > 0 else share
        run = np.minimum(np.cumsum(share), abs(over))
        step = np.diff(np.concatenate([[0], run]))
        out[order] -= np.sign(over) * step
        over = int(out.sum()) - size
    return out


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = (np.cumsum(freq) - freq).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The symbol of each of the 2^SCALE slots."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def packed(self) -> bytes:
        """The table as bytes: symbols (as steps) and frequencies of those that occur, compressed."""
        at = np.flatnonzero(self.freq)
        body = np.concatenate([np.diff(at, prepend=0).astype("<u4"), self.freq[at].astype("<u4")]).tobytes()
        return np.array([len(self.freq), len(at)], "<u4").tobytes() + zlib.compress(body, 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        size, n = np.frombuffer(data[:8], "<u4").tolist()
        body = np.frombuffer(zlib.decompress(data[8:]), "<u4")
        freq = np.zeros(size, np.int64)
        freq[np.cumsum(body[:n])] = body[n:]
        return cls(freq)


@dataclass
class Block:
    """A coded block. place: words before each checkpoint's; states: the lanes' at each checkpoint; crc: of its symbols."""

    n: int
    words: np.ndarray
    place: np.ndarray
    states: np.ndarray
    crc: np.ndarray

    def parts(self) -> int:
        return len(self.place)


def lanes_for(n: int) -> int:
    """Lanes of a block of n symbols: fewer for short blocks, where their states would cost more than the symbols."""
    return min(LANES, max(1, n // 256))


def crc(symbols: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(symbols, "<u4").tobytes())


def encode(symbols: np.ndarray, table: Table) -> Block:
    """Codes from the last step to the first, so that decoding runs forwards."""
    n, lanes = len(symbols), lanes_for(len(symbols))
    steps = -(-n // lanes)
    freq, first = table.freq[symbols], table.first[symbols]
    state = np.full(lanes, LOW)
    out: list[np.ndarray] = []
    count = np.zeros(steps + 1, np.int64)
    marks: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        f, x = freq[lo:hi], state[: hi - lo]
        full = x >= (f << U64(63 - SCALE))
        if full.any():
            out.append(x[full].astype("<u4"))
            count[step] = len(out[-1])
            x = np.where(full, x >> U64(32), x)
        state[: hi - lo] = ((x // f) << U64(SCALE)) + x % f + first[lo:hi]
        if step % CHECKPOINT == 0:
            marks.append(state.copy())
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    place = np.concatenate([[0], np.cumsum(count[:steps])])[np.arange(0, steps, CHECKPOINT)] if steps else np.zeros(0, np.int64)
    sums = [crc(symbols[s * lanes : (s + CHECKPOINT) * lanes]) for s in range(0, steps, CHECKPOINT)]
    return Block(n, words, place, np.array(marks[::-1], "<u8").reshape(len(marks), lanes), np.array(sums, "<u4"))


def decode_part(block: Block, table: Table, part: int) -> np.ndarray:
    """The symbols between a checkpoint and the next; ValueError where their checksum doesn't fit."""
    n, lanes = block.n, lanes_for(block.n)
    lo_step, hi_step = part * CHECKPOINT, min(-(-n // lanes), (part + 1) * CHECKPOINT)
    state, at, words = block.states[part].astype(np.uint64), int(block.place[part]), block.words
    out = np.empty(min(n, hi_step * lanes) - lo_step * lanes, np.uint32)
    symbol, freq, first, mask = table.symbol, table.freq, table.first, U64((1 << SCALE) - 1)
    for step in range(lo_step, hi_step):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        x = state[: hi - lo]
        slot = x & mask
        s = symbol[slot.astype(np.int64)]
        out[lo - lo_step * lanes : hi - lo_step * lanes] = s
        x = freq[s] * (x >> U64(SCALE)) + slot - first[s]
        low = np.flatnonzero(x < LOW)
        if len(low):
            if at + len(low) > len(words):
                raise ValueError("a block ends too early")
            x[low] = (x[low] << U64(32)) | words[at : at + len(low)].astype(np.uint64)
            at += len(low)
        state[: hi - lo] = x
    if crc(out) != int(block.crc[part]):
        raise ValueError("a block's checksum doesn't fit its symbols")
    return out


def decode(block: Block, table: Table) -> np.ndarray:
    return np.concatenate([decode_part(block, table, p) for p in range(block.parts())]) if block.n else np.zeros(0, np.uint32)


def pack(block: Block) -> bytes:
    head = np.array([block.n, block.parts(), len(block.words), lanes_for(block.n)], "<u8").tobytes()
    return b"".join([head, block.place.astype("<u8").tobytes(), block.crc.astype("<u4").tobytes(), block.states.astype("<u8").tobytes(), block.words.astype("<u4").tobytes()])


def unpack(data: bytes) -> Block:
    n, parts, words, lanes = np.frombuffer(data, "<u8", 4).tolist()
    at = 32
    fields = []
    for kind, size in (("<u8", parts), ("<u4", parts), ("<u8", parts * lanes), ("<u4", words)):
        fields.append(np.frombuffer(data, kind, size, at))
        at += fields[-1].nbytes
    place, sums, states, stream = fields
    return Block(n, stream, place.astype(np.int64), states.reshape(parts, lanes), sums)
