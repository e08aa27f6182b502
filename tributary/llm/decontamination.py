"""Benchmark decontamination by latent semantic retrieval.

Passages of documents are TF-IDF vectors over the benchmark's words; document frequencies are counted over all passages
of the corpus. Their latent space comes from a distributed randomised SVD: every task sends its passages through a random
matrix O and adds up Y = A^T (A O), tasks' sums are added by blocks of terms, and the driver projects A^T A onto what Y
spans, by Y (O^T Y)^-1 Y^T, whose eigenvectors are the latent dimensions: one pass over the corpus gives sketch and
projection. The benchmark's own passages weigh as much as the whole corpus, so that the space keeps what tells its items
apart. Passages whose cosine to a benchmark passage reaches COSINE, and whose part along it COVER of its weight, are
candidates; the longest common subsequence of words decides, and for paraphrases also whether the answer (the words of
the item's last sentence) is there.

The benchmark is read in groups of bounded size, each with a space of its own; every passage of the corpus is compared
with each of a group's, in blocks of a matrix product.

Words in COMMON of all passages carry no weight there, be it that they are frequent or that the leak itself is, and others
weigh little. A leak needs PARAPHRASE of a passage's words only, so it may hold the lightest ones and miss the space's
thresholds. Where these could hold less than SAFE of a benchmark passage's weight, the passage has an exact path beside the
space: every place where enough of its words stand close together is a candidate, so that none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import ALNUM, U64, Texts, chunks, gather_ranges, word_hashes, words

WINDOW, STRIDE = 48, 24
#: Words of a benchmark passage at most; longer items are several passages, half of each in common.
PASSAGE = 64
RANK, OVERSAMPLE = 64, 16
#: Terms in at least this share of passages carry no weight.
COMMON = 0.05
COSINE = 0.4
#: And share of the benchmark passage's weight that a window must hold: a few words in common are no candidate.
COVER = 0.2
#: Share of a passage's weight that any leak of it holds, from which on the latent space alone is asked.
SAFE = 0.5
#: Share of a benchmark passage's words in common order: from COPY on a leak; from PARAPHRASE on, if the answer is there.
COPY, PARAPHRASE, ANSWER = 0.85, 0.6, 0.6
#: Distinct words and words of a group of the benchmark at most (but for a single item): what is broadcast at once.
GROUP_TERMS, GROUP_WORDS = 1 << 16, 1 << 20
#: Terms of a block of the sketch; windows times benchmark passages compared at once.
BLOCK, PRODUCT = 256, 1 << 22
SCHEMA = "doc_id {kind}, item_id long, similarity double, cosine double"


@dataclass
class Benchmark:
    """Passages of a group of items' words, and the vocabulary they span: its terms."""

    item: list[int]
    passages: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Benchmark:
        item, passages, answers = [], [], []
        for i, text in items:
            h = _hashes(text)
            sentences = [s for s in regex.split(r"[.!?\n]+", text) if len(_hashes(s))]
            answer = _hashes(sentences[-1]) if sentences else h
            for lo in range(0, max(1, len(h) - PASSAGE // 2), PASSAGE // 2) if len(h) > PASSAGE else [0]:
                if len(h):
                    item.append(i)
                    passages.append(h[lo : lo + PASSAGE])
                    answers.append(answer)
        vocabulary = np.unique(np.concatenate(passages)) if passages else np.zeros(0, np.uint64)
        return cls(item, passages, answers, vocabulary)

    @property
    def terms(self) -> int:
        return len(self.vocabulary)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that the benchmark has, and their terms."""
        seen = np.zeros(1 << 16, bool)
        seen[(self.vocabulary >> U64(48)).astype(np.int64)] = True
        at = np.flatnonzero(seen[(h >> U64(48)).astype(np.int64)])
        to = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[to] == h[at]
        return at[hit], to[hit]


def _hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    t = Texts(0, 1, b, np.array([0, len(b)]))
    return word_hashes(t, words(t, ALNUM))


def groups(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The items in groups that stay within the bounds; the driver holds one group at a time."""
    out, seen, n = [], set(), 0
    for i, text in items:
        h = _hashes(text)
        own = set(h.tolist())
        if out and (len(seen) + len(own - seen) > GROUP_TERMS or n + len(h) > GROUP_WORDS):
            yield out
            out, seen, n = [], set(), 0
        out.append((i, text))
        seen |= own
        n += len(h)
    if out:
        yield out


def windows(woff: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last words of the windows of WINDOW words: every row with words has one at least, the last ends with it."""
    n = np.diff(woff)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = woff[:-1][row] + k * stride
    return row, first, np.minimum(first + WINDOW, woff[1:][row])


def entries(at: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, term, count) of every term in a window."""
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last)
    window = np.repeat(np.arange(len(first)), hi - lo)
    t = term[gather_ranges(lo, hi - lo)]
    wide = int(t.max()) + 1 if len(t) else 1
    code, count = np.unique(window * wide + t, return_counts=True)
    return code // wide, code % wide, count


def project(window: np.ndarray, value: np.ndarray, basis: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of value * basis[:, at] by window (ascending): an array of n columns."""
    out = np.zeros((len(basis), n), np.float32)
    if len(window):
        begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        out[:, window[begin]] = np.add.reduceat(basis[:, at] * value, begin, 1)
    return out


class Space:
    """Weights (squares of the IDF, as rare words tell items apart) and the latent basis, with the benchmark's passages in it."""

    def __init__(self, benchmark: Benchmark, df: np.ndarray, n: int):
        self.benchmark = benchmark
        idf = np.log((1 + n) / (1 + df))
        self.idf = np.where(df >= COMMON * n, 0, idf * idf).astype(np.float32) if n else np.ones(len(df), np.float32)
        #: Passages that a leak may hold with little weight, and their terms: these are searched exactly, too.
        terms = [benchmark.lookup(p)[1] for p in benchmark.passages]
        self.exact = [i for i, t in enumerate(terms) if self.lightest(t) < SAFE]
        self.exact_terms = [np.unique(terms[i], return_counts=True) for i in self.exact]
        if not self.idf.any():
            self.idf = np.maximum(idf, 0.1).astype(np.float32)

    def lightest(self, terms: np.ndarray) -> float:
        """The share of a passage's weight that as many of its words hold as a leak needs, the lightest ones."""
        weight = np.sort(self.idf[terms].astype(np.float64) ** 2)
        return float(weight[: needed(len(terms))].sum() / max(weight.sum(), 1e-30))

    def values(self, window: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF of the entries, each window's made of length 1, and the lengths before that."""
        v = (1 + np.log(count)).astype(np.float32) * self.idf[term]
        norm = np.sqrt(np.bincount(window, v * v, n)).astype(np.float32)
        return v / np.maximum(norm, 1e-6)[window], norm

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate(self.benchmark.passages)
        to = np.cumsum([len(p) for p in self.benchmark.passages])
        at, term = self.benchmark.lookup(h)
        w, t, c = entries(at, term, np.concatenate([[0], to[:-1]]), to)
        return w, t, *self.values(w, t, c, len(to))

    def random(self) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(7)).standard_normal((len(self.idf), RANK + OVERSAMPLE)).astype(np.float32)

    def finish(self, corpus: np.ndarray, passages: int) -> None:
        """The basis from the corpus's A^T (A O) and the benchmark's."""
        w, t, v, self.weight = self.own()
        n, terms = len(self.benchmark.passages), len(self.idf)
        random = self.random()
        order = np.argsort(t, kind="stable")
        sketch = project(w, v, np.ascontiguousarray(random.T), t, n)
        own = project(t[order], v[order], sketch, w[order], terms).T
        self.basis = latent_basis(corpus + (max(passages, 1) / n) * own, random)
        z = project(w, v, self.basis, t, n).T
        self.items = (z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-6)).astype(np.float32)


def latent_basis(sketch: np.ndarray, random: np.ndarray) -> np.ndarray:
    """The first eigenvectors (rows) of a positive matrix M from its sketch M O: those of M's projection onto the sketch,
    Y (O^T Y)^-1 Y^T."""
    y, o = sketch.astype(np.float64), random.astype(np.float64)
    y /= np.abs(y).max() or 1
    core = o.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    some = value > 1e-6 * max(value[-1], 1e-300)
    if not some.any():
        return np.zeros((1, len(y)), np.float32)
    left, s, _ = np.linalg.svd(y @ (vector[:, some] / np.sqrt(value[some])), full_matrices=False)
    rank = min(RANK, int((s > 1e-3 * s[0]).sum()) or 1)
    return np.ascontiguousarray(left[:, :rank].T, np.float32)


def needed(m: int) -> int:
    """Words of a passage of m that a leak holds at least."""
    return max(1, int(np.ceil(PARAPHRASE * m - 1e-9)))


def span(m: int) -> int:
    """Words among which a passage of m words is looked for."""
    return m + m // 3 + 4


def common_order(masks: dict[int, int], m: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a text and the passage of m words that the masks stand for."""
    v = full = (1 << m) - 1
    for x in text:
        mask = masks.get(x)
        if mask:
            u = v & mask
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(passage: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(passage.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Judge:
    def __init__(self, space: Space):
        self.space, b = space, space.benchmark
        self.masks = [masks_of(p) for p in b.passages]
        self.answer_masks = [masks_of(a) for a in b.answers]

    def leak(self, p: int, h: np.ndarray, lo: int, hi: int, first: int, last: int) -> float:
        """The share of passage p in common order with the words around first:last (within lo:hi); 0 if it is no leak."""
        b = self.space.benchmark
        m = len(b.passages[p])
        text = h[max(lo, first - m) : min(hi, last + m)].tolist()
        if common_order(self.masks[p], m, text) < PARAPHRASE * m:
            return 0.0
        width, best, where = span(m), 0, 0
        for at in range(0, max(1, len(text) - width + m // 4 + 1), max(1, m // 4)):
            c = common_order(self.masks[p], m, text[at : at + width])
            if c > best:
                best, where = c, at
        if best < PARAPHRASE * m:
            return 0.0
        if best < COPY * m:
            n = len(b.answers[p])
            near = text[max(0, where - n) : where + width + n]
            if common_order(self.answer_masks[p], n, near) < ANSWER * n:
                return 0.0
        return best / m

    def chunk(self, t: Texts) -> dict[tuple[int, int], tuple[float, float]]:
        """(row, item) -> (share in common order, cosine) of the chunk's leaks."""
        s = self.space
        w = words(t, ALNUM)
        h = word_hashes(t, w)
        row, first, last = windows(w.woff, STRIDE)
        out: dict[tuple[int, int], tuple[float, float]] = {}
        at, term = s.benchmark.lookup(h)
        step = max(16, min(4096, PRODUCT // len(s.items)))
        for lo in range(0, len(row), step):
            f, e = first[lo : lo + step], last[lo : lo + step]
            window, tm, c = entries(at, term, f, e)
            some = s.idf[tm] > 0
            window, tm, c = window[some], tm[some], c[some]
            v, weight = s.values(window, tm, c, len(f))
            z = project(window, v, s.basis, tm, len(f))
            length = np.sqrt((z * z).sum(0))
            near = (z / np.maximum(length, 1e-6)).T @ s.items.T
            held = near * (length * weight)[:, None] / np.maximum(s.weight, 1e-6)
            for i, p in zip(*np.nonzero((near >= COSINE) & (held >= COVER)), strict=True):
                r = int(row[lo + i])
                key = (r, s.benchmark.item[p])
                if key in out and out[key][0] >= 1:
                    continue
                share = self.leak(int(p), h, int(w.woff[r]), int(w.woff[r + 1]), int(f[i]), int(e[i]))
                if share and share > out.get(key, (0.0,))[0]:
                    out[key] = (share, float(near[i, p]))
        by_term = np.argsort(term, kind="stable")
        places, begin = at[by_term], np.searchsorted(term[by_term], np.arange(s.benchmark.terms + 1))
        for p, own in zip(s.exact, s.exact_terms, strict=True):
            near = self.weighted(p, own, places, begin)
            if near is not None:
                near = around(at, near, span(len(s.benchmark.passages[p])))
                if not len(near):
                    continue
            some = self.dense(p, own, *((at, term) if near is None else (at[near], term[near])), w.woff, row, first, last).tolist()
            like = {i: cosine(h[first[i] : last[i]], s.benchmark.passages[p]) for i in some}
            for i in sorted(some, key=lambda i: -like[i]):
                r = int(row[i])
                key = (r, s.benchmark.item[p])
                if key in out and out[key][0] >= 1:
                    continue
                share = self.leak(p, h, int(w.woff[r]), int(w.woff[r + 1]), int(first[i]), int(last[i]))
                if share and share > out.get(key, (0.0,))[0]:
                    out[key] = (share, like[i])
        return out

    def weighted(self, p: int, own: tuple[np.ndarray, np.ndarray], places: np.ndarray, begin: np.ndarray) -> np.ndarray | None:
        """First words of spans with as many words with weight as passage p's leaks have besides those without; None if
        these may have none. places are sorted by term, each one's begin at begin[term]."""
        m = len(self.space.benchmark.passages[p])
        heavy = self.space.idf[own[0]] > 0
        need = needed(m) - int(own[1][~heavy].sum())
        if need <= 0:
            return None
        terms = own[0][heavy]
        place = np.sort(places[gather_ranges(begin[terms], begin[terms + 1] - begin[terms])])
        first = place[: max(len(place) - need + 1, 0)]
        return first[place[need - 1 :] - first < span(m)]

    def dense(self, p: int, own: tuple[np.ndarray, np.ndarray], at: np.ndarray, term: np.ndarray, woff: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Windows around which some span holds as many of passage p's words as a leak must, each as often as the passage
        has it at most: no other can be one."""
        m = len(self.space.benchmark.passages[p])
        times = np.zeros(self.space.benchmark.terms, np.uint8)
        times[own[0]] = own[1]
        mine = times[term] > 0
        place = at[mine]
        need = needed(m)
        if len(place) < need:
            return np.zeros(0, np.int64)
        # the first of need words in a row of the text that stand within a span
        near = np.flatnonzero(place[need - 1 :] - place[: len(place) - need + 1] < span(m))
        begin, end = place[near], place[near + need - 1]
        inside = end < woff[np.searchsorted(woff, begin, "right")]
        near, begin, end = near[inside], begin[inside], end[inside]
        if not len(begin):
            return np.zeros(0, np.int64)
        whole = self.enough(place, term[mine], times, near, np.minimum(begin + span(m), woff[np.searchsorted(woff, begin, "right")]), need)
        begin, end = begin[whole], end[whole]
        lo, hi = np.maximum(woff[:-1][row], first - m), np.minimum(woff[1:][row], last + m)
        # ends ascend with begins: the first begin within reach has the smallest end
        to = np.searchsorted(begin, lo)
        some = np.flatnonzero(to < len(begin))
        return some[end[to[some]] < hi[some]]

    def enough(self, place: np.ndarray, term: np.ndarray, times: np.ndarray, first: np.ndarray, to: np.ndarray, need: int) -> np.ndarray:
        """Of the spans from place[first] up to `to`, those with `need` words, each counted as often as the passage has it."""
        out = np.zeros(len(first), bool)
        count = np.searchsorted(place, to) - first
        for lo in range(0, len(first), 1 << 10):
            n = count[lo : lo + (1 << 10)]
            inside = np.arange(int(n.max())) < n[:, None]
            words_ = np.full(inside.shape, -1, np.int64)
            words_[inside] = term[gather_ranges(first[lo : lo + len(n)], n)]
            words_.sort(1)
            new = np.ones(words_.shape, bool)
            new[:, 1:] = words_[:, 1:] != words_[:, :-1]
            at = np.arange(words_.shape[1])
            again = at - np.maximum.accumulate(np.where(new, at, 0), 1)
            out[lo : lo + len(n)] = ((words_ >= 0) & (again < times[words_])).sum(1) >= need
        return out


def around(at: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Indices of the places that can lie in one span of this width with one that begins at any of these words."""
    if not len(begin):
        return begin
    lo, hi = np.searchsorted(at, begin - width), np.searchsorted(at, begin + 2 * width)
    new = np.append(True, lo[1:] > hi[:-1])
    lo, hi = lo[new], hi[np.append(new[1:], True)]
    return gather_ranges(lo, hi - lo)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of the counts of words."""
    both, to = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(to[: len(a)], minlength=len(both)), np.bincount(to[len(a) :], minlength=len(both))
    return float(x @ y / np.sqrt(float(x @ x) * float(y @ y)))


def _document_frequencies(texts: DataFrame, benchmark) -> tuple[np.ndarray, int]:
    terms = benchmark.value.terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, b = np.zeros(terms, np.int64), 0, benchmark.value
        for batch in batches:
            for t in chunks(batch.column(0)):
                w = words(t, ALNUM)
                row, first, last = windows(w.woff, WINDOW)
                at, term = b.lookup(word_hashes(t, w))
                _, tm, _ = entries(at, term, first, last)
                df += np.bincount(tm, minlength=terms)
                n += len(row)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], ["term", "n"])

    got = texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each benchmark term
    df = np.zeros(terms, np.int64)
    n = 0
    for r in got:
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def _sketched(texts: DataFrame, space) -> np.ndarray:
    """The sum over all passages of A^T (A O)."""
    terms = len(space.value.idf)
    wide = RANK + OVERSAMPLE

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total = space.value, np.zeros((wide, terms), np.float32)
        random = np.ascontiguousarray(s.random().T)
        for batch in batches:
            for t in chunks(batch.column(0)):
                w = words(t, ALNUM)
                _, first, last = windows(w.woff, WINDOW)
                window, tm, c = entries(*s.benchmark.lookup(word_hashes(t, w)), first, last)
                some = s.idf[tm] > 0
                window, tm, c = window[some], tm[some], c[some]
                v, _ = s.values(window, tm, c, len(first))
                y = project(window, v, random, tm, len(first))
                order = np.argsort(tm, kind="stable")
                total += project(tm[order], v[order], y, window[order], terms)
        total = np.ascontiguousarray(total.T)
        some = [i for i in range(0, terms, BLOCK) if total[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK for i in some], pa.int32()), pa.array([total[i : i + BLOCK].tobytes() for i in some], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.float32).astype(np.float64)
                sums[block] = sums[block] + x if block in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["block", "sums"])

    kind = "block int, sums binary"
    # tasks' sums are added twice: over a few tasks' each, then over these
    parts = texts.mapInArrow(gather, kind)
    few = parts.repartition("block", F.spark_partition_id() % 8).mapInArrow(add, kind)
    out = np.zeros((terms, wide), np.float32)
    for r in few.repartition("block").mapInArrow(add, kind).collect():  # terms x (RANK + OVERSAMPLE) numbers
        at = r["block"] * BLOCK
        x = np.frombuffer(r["sums"], np.float32).reshape(-1, wide)
        out[at : at + len(x)] += x
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", kind: str = "long") -> DataFrame:
    """doc_id, item_id, similarity (share of a benchmark passage's words in common order) and cosine (in the latent
    space; of the counts of words where the exact path found it): a row for each document and item it holds a copy or a
    paraphrase of. kind: the type of the documents' ids.

    The benchmark is a set of queries, read and broadcast in groups of GROUP_TERMS distinct words at most; each group is
    searched in all documents (the driver holds one group at a time). Items without words, null ones, null texts and empty
    ones match nothing. Rows of one doc_id give one row for each item; rows without doc_id are reported without it. Very
    long texts are read whole, as a chunk of their own; of two equal items each is reported; an empty table gives no rows.
    Other columns are left out, so their names can't clash. For each group three narrow passes over the texts; what is
    shuffled are counts and sums by term, and the leaks.
    """
    spark = documents.sparkSession
    asked = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL AND i IS NOT NULL").orderBy("i", "t")
    found = [_leaks_of(documents, g, doc_id, text, kind) for g in groups((r[0], r[1]) for r in asked.toLocalIterator())]
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], SCHEMA.format(kind=kind))
    rows = reduce(DataFrame.union, found)
    return rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "cosine")).alias("best")).select("doc_id", "item_id", "best.similarity", "best.cosine")


def _leaks_of(documents: DataFrame, items: list[tuple[int, str]], doc_id: str, text: str, kind: str) -> DataFrame | None:
    spark = documents.sparkSession
    made = Benchmark.of(items)
    if not made.passages:
        return None
    texts = documents.select(F.col(text).alias("text"))
    df, n = _document_frequencies(texts, spark.sparkContext.broadcast(made))
    space = Space(made, df, n)
    space.finish(_sketched(texts, spark.sparkContext.broadcast(space)), n)
    ready = spark.sparkContext.broadcast(space)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(ready.value)
        for b in batches:
            for t in chunks(b.column(1)):
                found = judge.chunk(t)
                ids = b.column(0).take(pa.array([t.lo + r for r, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in found], pa.int64()), pa.array([x for x, _ in found.values()], pa.float64()), pa.array([x for _, x in found.values()], pa.float64())], ["doc_id", "item_id", "similarity", "cosine"])

    return documents.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, SCHEMA.format(kind=kind))
