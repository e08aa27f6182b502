"""Alignment of two tokenizers' tokens over the bytes of the same texts, by byte-owner arrays.

np.repeat gives each byte of a chunk of texts its owning token of either tokenizer. Where the pair of owners changes a new
link begins: consecutive distinct pairs are all pairs of tokens whose byte ranges overlap. Where both owners change at once
is a cut, and the tokens between two cuts are a group.

A is a byte-level BPE of the tokenizers library over a blank and the text, B a sentencepiece model, which adds the blank
itself. Special tokens are never added, and their strings in a text are plain text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import Texts, binary_rows, chunks, code_points, gather_ranges
from .span_cache import SpanCache
from .tables import Workspace
from .token_ids import Encoder

#: Pairs whose counts are broadcast; the counts of all others are joined.
KNOWN_PAIRS = 1 << 20
#: Distinct pairs that a counting worker holds before it hands them on.
HELD_PAIRS = 1 << 21
BLANK = "▁"

ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, a binary, b binary"


class Ragged:
    """Rows of bytes on end, gathered by row number."""

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.length = np.array([len(x) for x in rows], np.int64)
        self.at = np.cumsum(self.length) - self.length

    def join(self, which: np.ndarray) -> np.ndarray:
        return self.flat[gather_ranges(self.at[which], self.length[which])]


def byte_level_bytes(pieces: list[str]) -> list[bytes]:
    """The bytes of byte-level pieces: printable Latin-1 characters stand for themselves, the others, in order, for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return [bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p in pieces]


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(BLANK, " ").encode()


class ByteSide(Encoder):
    """A's ids of a blank and each text."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.library.encode_special_tokens = True
        self.special = []
        self.kind = self.known.kind
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bytes = Ragged(byte_level_bytes([self.library.id_to_token(i) or "" for i in range(size)]))

    def of(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        return self.chunk(with_blank(t))


class PieceSide:
    """B's ids of each text.

    No piece has a blank behind another character, so merges never cross a place where a blank follows one: the spans
    between these places are encoded apart, each distinct one once a worker. A model with such pieces is refused.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("the model has pieces with a blank behind another character")
        self.kind = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        self.bytes = Ragged([piece_bytes(p, self.library.is_byte(i)) for i, p in enumerate(pieces)])
        self.known = SpanCache(self.kind, self._make)

    def _make(self, spans: list[str]) -> list[list[int]]:
        """Ids of a blank and each span: the library adds the blank, but to nothing."""
        blank = [self.library.piece_to_id(BLANK)]
        return [ids or blank for ids in self.library.encode(spans, num_threads=1)]

    def of(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        cps, off = code_points(t)
        if not len(cps):
            return np.zeros(0, self.kind), np.zeros(len(off) - 1, np.int64)
        blank = (cps == 0x20) | (cps == ord(BLANK))
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        first = off[:-1][np.diff(off) > 0]
        begin[first] = True
        start = np.flatnonzero(begin)
        woff = np.searchsorted(start, off)
        end = np.append(start[1:], len(cps))
        inner = np.ones(len(start), bool)
        inner[np.searchsorted(start, first)] = False
        at, length = self.known.spans(cps, start + inner, end)  # the span's own blank is the one that is added
        total = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        return self.known.store[gather_ranges(at, length)], total[woff[1:]] - total[woff[:-1]]


def with_blank(t: Texts) -> Texts:
    """A blank before each row."""
    off = t.off + np.arange(len(t.off))
    buf = np.empty(int(off[-1]), np.uint8)
    own = np.zeros(len(buf), bool)
    own[off[:-1]] = True
    buf[own], buf[~own] = 0x20, t.buf
    return Texts(t.lo, t.hi, buf, off)


def whole_rows(text: Texts, ids: np.ndarray, counts: np.ndarray, of: Ragged) -> np.ndarray:
    """Which rows' tokens, joined, are the row's bytes."""
    total = np.concatenate([[0], np.cumsum(of.length[ids])])
    to = np.concatenate([[0], np.cumsum(counts)])
    n = total[to[1:]] - total[to[:-1]]
    fits = n == np.diff(text.off)
    wrong = of.join(ids[np.repeat(fits, counts)]) != text.buf[np.repeat(fits, np.diff(text.off))]
    size = np.where(fits, n, 0)
    at = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(wrong)])
    return fits & (bad[at + size] == bad[at])


class Owners:
    """Links and cuts of tokens a and b over the same bytes: link i is of tokens a[link_a[i]] and b[link_b[i]]."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray):
        own_a, own_b = np.repeat(np.arange(len(a)), length_a[a]), np.repeat(np.arange(len(b)), length_b[b])
        moves_a, moves_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
        np.not_equal(own_a[1:], own_a[:-1], out=moves_a[1:])
        np.not_equal(own_b[1:], own_b[:-1], out=moves_b[1:])
        at = np.flatnonzero(moves_a | moves_b)
        self.link_a, self.link_b = own_a[at], own_b[at]
        cut = (moves_a & moves_b)[at]
        self.group = np.cumsum(cut) - 1
        self.n_groups = int(self.group[-1]) + 1 if len(at) else 0
        # a token lies in one group, that of its first link
        self.group_a = self.group[np.flatnonzero(np.diff(self.link_a, prepend=-1))]
        self.group_b = self.group[np.flatnonzero(np.diff(self.link_b, prepend=-1))]


def group_texts(o: Owners, a: np.ndarray, b: np.ndarray, digits: Ragged) -> tuple[np.ndarray, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; of all groups as bytes, and each group's end; digits has each number with a byte behind it."""
    n_a, n_b = np.bincount(o.group_a, minlength=o.n_groups), np.bincount(o.group_b, minlength=o.n_groups)
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[np.arange(len(a)) + (end_b - n_b)[o.group_a]] = a
    ids[np.arange(len(b)) + end_a[o.group_b]] = b
    text = digits.join(ids)
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[end_a + end_b - n_b - 1] = ord("|")
    mark[end_a + end_b - 1] = ord(";")
    to = np.cumsum(digits.length[ids])
    text[to - 1] = mark
    return text, to[end_a + end_b - 1]


@lru_cache(maxsize=1)
def _sides(spec: str, model: bytes) -> tuple[ByteSide, PieceSide, Ragged]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = ByteSide(spec), PieceSide(model)
    return a, b, Ragged([b"%d," % i for i in range(max(len(a.bytes.length), len(b.bytes.length)))])


def align(df: DataFrame, byte_bpe: str, piece_bpe: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, row (a number of its own, until it is computed again), n_a, n_b, n_groups, n_links, groups
    (`a1,a2|b1;a3|b2,b3`, decimal ids) and both sides' ids as little-endian integers of 2 bytes, or 4 for vocabularies
    beyond 65,536.

    Null and empty texts, and texts that a side doesn't give back byte for byte, have no tokens: zeros and empty values. Rows
    of one doc_id, or of none, each give a row. Very long texts are read whole, as a chunk of their own; an empty table gives
    no rows. Other columns are left out, so their names can't clash.
    """
    spark = df.sparkSession
    files = spark.sparkContext.broadcast((open(byte_bpe, encoding="utf-8").read(), open(piece_bpe, "rb").read()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b, digits = _sides(*files.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for t in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), *_aligned(t, side_a, side_b, digits, row)], _NAMES)
                row += t.hi - t.lo

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, ALIGNED)


_NAMES = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b"]


def _aligned(t: Texts, side_a: ByteSide, side_b: PieceSide, digits: Ragged, row: int) -> list[pa.Array]:
    rows = t.hi - t.lo
    blank = with_blank(t)
    (a, count_a), (b, count_b) = side_a.chunk(blank), side_b.of(t)
    whole = (np.diff(t.off) > 0) & whole_rows(blank, a, count_a, side_a.bytes) & whole_rows(blank, b, count_b, side_b.bytes)
    a, b = a[np.repeat(whole, count_a)], b[np.repeat(whole, count_b)]
    count_a, count_b = np.where(whole, count_a, 0), np.where(whole, count_b, 0)
    o = Owners(a, b, side_a.bytes.length, side_b.bytes.length)
    groups, ends = group_texts(o, a, b, digits)
    off_a, off_b = (np.concatenate([[0], np.cumsum(c)]) for c in (count_a, count_b))
    links = np.searchsorted(o.link_a, off_a)
    group = np.append(o.group_a, o.n_groups)[off_a]  # a row begins with a group
    at = np.concatenate([[0], ends])[group]
    data = groups.tobytes()
    strings = [data[i : max(j - 1, i)] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    numbers = [np.arange(row, row + rows), count_a, count_b, np.diff(group), np.diff(links)]
    ids = [binary_rows(x.astype(s.kind), off) for x, off, s in ((a, off_a, side_a), (b, off_b, side_b))]
    return [*(pa.array(x, pa.int64()) for x in numbers), pa.array(strings, pa.string()), *ids]


def _id_chunks(batch: pa.RecordBatch, a: int, b: int, kinds: tuple[type, type]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a batch of align()'s ids, with these ids on end and the rows' offsets in a's."""
    for t in chunks(pa.Array.from_buffers(pa.string(), batch.num_rows, batch.column(a).buffers(), batch.column(a).null_count, batch.column(a).offset)):
        part = batch.column(b).slice(t.lo, t.hi - t.lo)
        of_b = b"".join(part.to_pylist())
        yield t.lo, t.hi, np.frombuffer(t.buf.tobytes(), kinds[0]), np.frombuffer(of_b, kinds[1]), t.off // np.dtype(kinds[0]).itemsize


def pair_scores(aligned: DataFrame, byte_bpe: str, piece_bpe: str, ws: Workspace, known: int = KNOWN_PAIRS) -> DataFrame:
    """Per row of a kept table of align()'s rows: row, n_best and count_sum.

    A pair's count is how many links of all rows hold it; n_best are a row's links whose count is the highest of their B id's,
    count_sum the sum of its links' counts. The counts of the `known` most frequent pairs are broadcast, the links of all
    others meet theirs in a join.
    """
    spark = aligned.sparkSession
    side_a, side_b, _ = _sides(open(byte_bpe, encoding="utf-8").read(), open(piece_bpe, "rb").read())
    kinds, base = (side_a.kind, side_b.kind), len(side_a.bytes.length)
    lengths = spark.sparkContext.broadcast((side_a.bytes.length, side_b.bytes.length))
    ids = aligned.filter("n_links > 0").select("row", "a", "b")

    def codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = Owners(a, b, *lengths.value)
        return b[o.link_b].astype(np.int64) * base + a[o.link_a], o.link_a

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        def flush() -> pa.RecordBatch:
            code, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in batches:
            for _, _, a, b, _ in _id_chunks(batch, 1, 2, kinds):
                held.append(np.unique(codes(a, b)[0], return_counts=True))
                if sum(len(c) for c, _ in held[1:]) > HELD_PAIRS // 4:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD_PAIRS:
                        yield flush()
                        held.clear()
        if held:
            held[:] = [merged()]
            yield flush()

    pairs = ws.keep(ids.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    most = pairs.groupBy((F.expr(f"code div {base}")).alias("b_id")).agg(F.max("n").alias("most"))
    best = pairs.withColumn("b_id", F.expr(f"code div {base}")).join(most, "b_id").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    best = ws.keep(best, "best")
    # levels of counts, an eighth of a power of two apart: the lowest above which no more than `known` pairs lie
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r.level, r["pairs"]) for r in best.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for at, n in sizes:
        total += n
        if total > known:
            break
        least = at
    frequent = best.filter(level >= least).toArrow().sort_by("code")
    table = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, n_of, best_of = table.value
        for batch in batches:
            for lo, hi, a, b, off in _id_chunks(batch, 1, 2, kinds):
                links, owner = codes(a, b)
                code, back = np.unique(links, return_inverse=True)
                place = np.minimum(np.searchsorted(code_of, code), max(len(code_of) - 1, 0))
                found = code_of[place] == code if len(code_of) else np.zeros(len(code), bool)
                n, top = (np.where(found, x[place], 0) if len(code_of) else np.zeros(len(code), np.int64) for x in (n_of, best_of))
                sums = [np.concatenate([[0], np.cumsum(x[back])])[np.searchsorted(owner, off)] for x in (top.astype(np.int64), n)]
                open_ = ~found[back]
                row_of = np.searchsorted(off, owner[open_], "right") - 1
                rest = np.searchsorted(row_of, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(links[open_]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(np.diff(s)) for s in sums), lists], ["row", "n_best", "count_sum", "rest"])

    scored = ws.keep(ids.mapInArrow(score, "row long, n_best long, count_sum long, rest array<bigint>"), "scored")
    rest = scored.select("row", F.explode("rest").alias("code")).groupBy("row", "code").agg(F.count("*").alias("m"))
    more = rest.join(best, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
    whole: Callable[[str, str], object] = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return scored.join(more, "row", "left").select("row", whole("n_best", "more_best"), whole("count_sum", "more_sum"))


def alignment(df: DataFrame, byte_bpe: str, piece_bpe: str, doc_id: str = "doc_id", text: str = "text", known: int = KNOWN_PAIRS) -> DataFrame:
    """Per row of df: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (of align()'s groups; '' without
    tokens). Odd rows as in align(). The ids are kept once, so a lost executor costs no second encoding of the others' rows."""
    ws = Workspace(df.sparkSession, "alignment")
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = ws.keep(align(df, byte_bpe, piece_bpe, doc_id, text).select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", digest, "a", "b"), "aligned")
    scores = pair_scores(kept, byte_bpe, piece_bpe, ws, known)
    rows = kept.drop("a", "b").join(scores, "row", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
