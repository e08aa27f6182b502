"""Pre-tokens of code points: where the two vocabularies' patterns cut a text, found for a whole chunk at once.

Both patterns name contractions, runs of letters, of numbers and of other characters; they differ in what becomes of
white space and of digits. ``CLASS`` knows the code points under ``SAFE``; as tables of characters differ between Unicode
versions beyond the common scripts, ``classes_of`` asks a vocabulary's own splitter for the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

SAFE = 0x530
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(SAFE, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[i for i in range(SAFE) if regex.match(pattern, chr(i))]] = kind
    return out


CLASS = _classes()
#: The contractions of both patterns.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def contractions(cps: np.ndarray, off: np.ndarray, open_to: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Places and lengths of contractions; open_to: apostrophes at which a match can begin."""
    at = np.flatnonzero((cps == 0x27) & open_to)
    if not len(at):
        return []
    end = off[np.searchsorted(off, at, "right")]
    out = []
    for c in CONTRACTIONS:
        fits = at[at + len(c) <= end]
        for j, x in enumerate(c[1:], 1):
            fits = fits[cps[fits + j] == ord(x)]
        if len(fits):
            out.append((fits, len(c)))
    return out


#: Code points of the planes that have characters; what lies beyond them is no letter, number or space.
PLANES = ((0, 0xD800), (0xE000, 0x34000), (0xE0000, 0xE1000))


def classes_of(split: Callable[[str], list]) -> np.ndarray:
    """The classes of all code points as a splitter sees them that drops white space, cuts each number and keeps other runs.

    Of a code point c it is shown acca: one piece if c is a letter, two if it is a space, three if c is another
    character and four if it is a number.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    kind = np.array([OTHER, LETTER, SPACE, OTHER, NUMBER], np.uint8)
    for lo, hi in PLANES:
        for at in range(lo, hi, 1 << 15):
            to = min(at + (1 << 15), hi)
            shown = "\n".join(f"a{chr(c)}{chr(c)}a" for c in range(at, to))
            pieces = np.bincount([x[1][0] // 5 for x in split(shown)], minlength=to - at)
            out[at:to] = kind[np.minimum(pieces, 4)]
    out[:SAFE] = CLASS
    return out


def classes_of_runs(split: Callable[[str], list]) -> np.ndarray:
    """As classes_of(), for a splitter that keeps runs of letters, of numbers and of other characters apart, and white space.

    Of a code point c it is shown 1c, ac and !c, a line each: c is of the kind that it makes one piece with.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    for lo, hi in PLANES:
        for at in range(lo, hi, 1 << 14):
            to = min(at + (1 << 14), hi)
            pieces = split("".join(f"1{chr(c)}\na{chr(c)}\n!{chr(c)}\n" for c in range(at, to)))
            joined = np.array([x[1][0] for x in pieces if x[1][0] % 3 == 0 and x[1][1] >= x[1][0] + 2], np.int64)
            kind = np.full(to - at, SPACE, np.uint8)
            for k, which in enumerate((NUMBER, LETTER, OTHER)):
                kind[joined[joined % 9 == 3 * k] // 9] = which
            out[at:to] = kind
    out[:SAFE] = CLASS
    return out


def cut(cps: np.ndarray, off: np.ndarray, keeps_space: bool, classes: np.ndarray = CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens, and the rows' offsets in them.

    keeps_space: one blank before a run belongs to it, other white space is a pre-token, numbers run on;
    else white space goes and each digit stands alone.
    """
    n = len(cps)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    kind = classes[cps]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | first[1:]
    if not keeps_space:
        begin |= kind == NUMBER
    before = np.full(n, SPACE, np.uint8)
    before[1:] = kind[:-1]
    before[first] = SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = cps[:-1] == 0x20
    blank_before[first] = False
    open_to = (before != OTHER) & ~blank_before if keeps_space else before != OTHER
    for at, length in contractions(cps, off, open_to):
        begin[at] = True
        for j in range(1, length):
            begin[at + j] = False
        after = at + length
        begin[after[after < n]] = True
    if keeps_space:
        # a run of white space before another character: its last one stands alone, or joins the run if it is a blank
        last = np.flatnonzero((kind == SPACE) & np.append(kind[1:] != SPACE, False) & ~np.append(first[1:], True))
        begin[last] = True
        begin[last[cps[last] == 0x20] + 1] = False
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    if not keeps_space:
        real = kind[start] != SPACE
        start, end = start[real], end[real]
    return start, end, np.searchsorted(start, off)
