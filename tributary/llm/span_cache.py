"""Ids of spans of code points: each distinct span goes through a tokenizer's library once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import pretoken
from .ragged import U64, code_values, random_values, span_hashes

KNOWN_BITS = 21
#: Ids of known spans that a worker holds before it starts anew.
STORE = 1 << 22

_VALUE = random_values(pretoken.SAFE)


class SpanCache:
    """store[at : at + length] holds a span's ids; make() gives those of new strings."""

    def __init__(self, kind: type, make: Callable[[list[str]], list[list[int]]]):
        self.kind, self.make = kind, make
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(1 << KNOWN_BITS, np.uint64)
        self.at = np.zeros(1 << KNOWN_BITS, np.int32)
        self.length = np.zeros(1 << KNOWN_BITS, np.int32)
        self.store, self.used = np.zeros(STORE, self.kind), 0

    def spans(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each span's place in the store and its number of ids; the places hold until the next call."""
        h = span_hashes(code_values(cps, _VALUE), start, end)
        h[h == 0] = 1  # 0 is a free slot
        slot = (h >> U64(64 - KNOWN_BITS)).astype(np.int64)
        at, length = self.at[slot].astype(np.int64), self.length[slot]
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            which = new[first]
            text = cps.tobytes().decode("utf-32-le")
            made = self.make([text[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            lengths = np.array([len(x) for x in made], np.int32)
            n = int(lengths.sum())
            if self.used + n > len(self.store):
                self._forget()
                if n > len(self.store):
                    self.store = np.zeros(n, self.kind)
                return self.spans(cps, start, end)
            self.store[self.used : self.used + n] = np.fromiter((i for x in made for i in x), self.kind, n)
            places = self.used + np.cumsum(lengths) - lengths
            self.used += n
            at[new], length[new] = places[back], lengths[back]
            self.key[slot[which]], self.at[slot[which]], self.length[slot[which]] = h[which], places, lengths
        return at, length
