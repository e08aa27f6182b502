"""Token counts of a BPE vocabulary with word ends, by rank-synchronous array merging.

All distinct pre-tokens of a chunk stand as one ragged array of symbols. A round finds the rank of every neighbouring
pair, each sequence's lowest rank, and merges that pair everywhere in its sequence at once; sequences without a pair of
the vocabulary leave with the number of symbols that survive. Merging all places of a sequence's lowest pair at once is
the same as one after the other, leftmost first, because a merge only makes pairs of higher rank: each merge of the
vocabulary makes a symbol of its own (checked when the vocabulary is read).

Counts of pre-tokens are kept in a direct-mapped table of fixed size, so that a frequent word is merged once per worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pretoken
from .ragged import CHUNK, U64, chunks, code_points, code_values, random_values, span_hashes, text_column

NONE = np.int32(2**31 - 1)
#: Entries of the table of known pre-tokens (12 bytes each).
KNOWN_BITS = 21
#: Below this code point NFC changes nothing; lower case is one character for one, below it too, but for a few.
PLAIN = 0x300


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(other)) for b in range(256)]


class PairTable:
    """(left, right) -> (rank, merged symbol), looked up for whole arrays; linear probing in 2^19 slots."""

    BITS = 19

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << self.BITS
        key = left.astype(np.uint64) << U64(32) | right.astype(np.uint64)
        self.key, self.rank, self.merged = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE), np.zeros(size, np.int32)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            _, first = np.unique(at, return_index=True)
            first = first[self.rank[at[first]] == NONE]
            put = todo[first]
            self.key[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], put, merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (NONE without one) of each pair, and its slot."""
        key = left.astype(np.uint64) << U64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        hit = self.key[slot] == key
        rank = np.where(hit, self.rank[slot], NONE)
        left_over = np.flatnonzero(~hit & (self.rank[slot] != NONE))
        for _ in range(self.probes):
            if not len(left_over):
                break
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.BITS) - 1)
            s = slot[left_over]
            hit = self.key[s] == key[left_over]
            rank[left_over[hit]] = self.rank[s[hit]]
            left_over = left_over[~hit & (self.rank[s] != NONE)]
        return rank, slot


class WordVocabulary:
    """What merging needs of a vocabulary file: symbols of bytes inside and at the end of a word, and the merges."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.last = np.array([vocab[c + end] for c in characters], np.int32)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int32) for i in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(set(merged.tolist())) != len(merged):
            raise ValueError("two merges make the same symbol: merging by rank in step isn't defined")
        self.pairs = PairTable(left, right, merged)
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(text)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte = {c: i for i, c in enumerate(characters)}
        self._classes: np.ndarray | None = None
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_bytes = [s.encode() for s in special]

    @property
    def classes(self) -> np.ndarray:
        """The classes of all code points, as the library's splitter has them; found when a text needs them."""
        if self._classes is None:
            self._classes = pretoken.classes_of(self.split)
        return self._classes

    def surviving(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Symbols left of each word; word i's UTF-8 bytes are data[off[i]:off[i + 1]], none is empty."""
        ids = self.inner[data]
        ids[off[1:] - 1] = self.last[data[off[1:] - 1]]
        out, who = np.zeros(len(off) - 1, np.int32), np.arange(len(off) - 1)
        while len(who):
            rank = np.full(len(ids), NONE)
            slot = np.zeros(len(ids), np.int64)
            rank[:-1], slot[:-1] = self.pairs.find(ids[:-1], ids[1:])
            rank[off[1:] - 1] = NONE
            lowest = np.minimum.reduceat(rank, off[:-1])
            length = np.diff(off)
            done = lowest == NONE
            if done.any():
                out[who[done]] = length[done]
                keep = np.repeat(~done, length)
                ids, rank, slot = ids[keep], rank[keep], slot[keep]
                who, lowest, length = who[~done], lowest[~done], length[~done]
                off = np.concatenate([[0], np.cumsum(length)])
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, length))
            if len(at) > 1:  # of places that overlap every second is merged, from the left
                run = np.concatenate([[True], np.diff(at) > 1])
                first = np.flatnonzero(run)
                inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[inside % 2 == 0]
            ids[at] = self.pairs.merged[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            off = off - np.concatenate([[0], np.cumsum(~keep)])[off]
        return out

    def of_words(self, found: list[bytes]) -> np.ndarray:
        """Symbols left of each of these pre-tokens."""
        if not found:
            return np.zeros(0, np.int32)
        index = {w: i for i, w in enumerate(dict.fromkeys(found))}
        off = np.concatenate([[0], np.cumsum([len(x) for x in index])])
        return self.surviving(np.frombuffer(b"".join(index), np.uint8), off)[[index[w] for w in found]]

    def words_of(self, text: str) -> tuple[list[bytes], int]:
        """The pre-tokens of any text, as the library's own tables of characters cut it, and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        found = [bytes(self.byte[c] for c in w) for part in parts if part for w, _ in self.split(self.normalise(part))]
        return found, len(parts) - 1


_FEW = [i for i in range(PLAIN) if len(chr(i).lower()) != 1 or ord(chr(i).lower()) >= PLAIN]
_LOWER = np.array([0x20 if i in _FEW else ord(chr(i).lower()) for i in range(PLAIN)], np.uint32)
_VALUE = random_values(PLAIN)


class Counter:
    """Counts of texts in one worker."""

    def __init__(self, vocabulary: WordVocabulary):
        self.v = vocabulary
        self.key = np.zeros(1 << KNOWN_BITS, np.uint64)
        self.count = np.zeros(1 << KNOWN_BITS, np.int32)

    def known(self, h: np.ndarray, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        slot = (h >> U64(64 - KNOWN_BITS)).astype(np.int64)
        out = self.count[slot]
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            made = self.v.surviving(*utf8(cps, start[at], end[at]))
            out[new] = made[back]
            self.key[slot[at]], self.count[slot[at]] = h[at], made
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for t in chunks(column, 4 * CHUNK):
            cps, off = code_points(t)
            odd = (cps >= PLAIN) | np.isin(cps, _FEW)
            slow, special = np.zeros(t.hi - t.lo, bool), np.zeros(t.hi - t.lo, bool)
            if odd.any():
                slow[np.unique(np.searchsorted(off, np.flatnonzero(odd), "right") - 1)] = True
            raw = t.buf.tobytes()
            for s in self.v.special_bytes:
                at = raw.find(s)
                while at >= 0:
                    special[np.searchsorted(t.off, at, "right") - 1] = True
                    at = raw.find(s, at + 1)
            slow |= special
            for r in np.flatnonzero(special):
                found, n = self.v.words_of(t.text(r))
                out[t.lo + r] = int(self.v.of_words(found).sum()) + n
            rest = np.flatnonzero(slow & ~special)
            if len(rest):
                # texts beyond the plain code points: normalised by the library, cut and merged like the others
                made = [self.v.normalise(t.text(r)) for r in rest]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in made])])
                own = np.frombuffer("".join(made).encode("utf-32-le", "surrogatepass"), np.uint32)
                out[t.lo + rest] = self._counted(own, ends, self.v.classes)
            cps = _LOWER[np.where(odd, np.uint32(0x20), cps)]
            out[t.lo : t.hi] = np.where(slow, out[t.lo : t.hi], self._counted(cps, off, pretoken.CLASS))
        return out

    def _counted(self, cps: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Symbols of each row of normalised code points."""
        start, end, woff = pretoken.cut(cps, off, keeps_space=False, classes=classes)
        total = np.concatenate([[0], np.cumsum(self.known(span_hashes(code_values(cps, _VALUE), start, end), cps, start, end))])
        return total[woff[1:]] - total[woff[:-1]]


@lru_cache(maxsize=1)
def _counter(spec: str) -> Counter:
    """Known pre-tokens outlive the task."""
    return Counter(WordVocabulary(spec))


def utf8(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of spans of code points, on end, and the spans' offsets in them."""
    length = end - start
    c = cps[np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))]
    extra = (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    at = np.concatenate([[0], np.cumsum(extra + 1)])
    data = np.empty(int(at[-1]), np.uint8)
    lead = np.array([0, 0xC0, 0xE0, 0xF0], np.uint32)[extra]
    data[at[:-1]] = lead | (c >> (6 * extra).astype(np.uint32))
    for k in (1, 2, 3):
        some = extra >= k
        data[at[:-1][some] + k] = 0x80 | ((c[some] >> (6 * (extra[some] - k)).astype(np.uint32)) & 0x3F)
    return data, at[np.concatenate([[0], np.cumsum(length)])]


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of df: the kept columns, n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary: path, on the driver, of a BPE vocabulary with word ends; it is read there and broadcast (its size is the
    file's, not the data's). A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay; other columns of df are
    left out, so that their names can't clash. A very long text is counted whole, as a chunk of its own; an empty table gives
    no rows. One narrow pass: no shuffle, and a lost task is just run again.
    """
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    rows = df.select(*keep, text)
    schema = T.StructType(rows.schema.fields[:-1]).add("n_bytes", T.LongType()).add("n_tokens", T.LongType()).add("over_limit", T.BooleanType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for b in batches:
            column = b.column(len(keep))
            n = counter.texts(column)
            sizes = np.diff(text_column(column)[1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, schema)
