"""LM scores by masked pseudo-likelihood: every word is predicted from the words on both sides of it.

The prediction is a hierarchical softmax over all words of the corpus: a word's class from the two words on either side,
its leaf within the class from its neighbours, and the word within its leaf by the counts of the whole corpus. The most
frequent words are leaves of their own; all others fall into leaves by their last letters, so they are told apart by both
sides too. Two window networks in numpy give the first two levels.

The networks see their neighbours as classes, so what they learn from is a table of fixed size: how often each class and
leaf stands between each pair of neighbours. One pass counts it over every position of every document; training runs over
the counted contexts, weighted by their numbers, and doesn't depend on partitions, batches or the order of rows. A
document's score is the sum of its words' conditional log-probabilities, added in whole numbers of 2^-32.

Counts of all words are a written table. The most frequent ones are broadcast; the others' counts are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import LOWER, NOT_SPACE, U64, Texts, chunks, mix, word_hashes, words
from .tables import Workspace

#: Words whose counts are broadcast (those of the highest counts, all of a count or none); those of all others are joined.
VOCABULARY = 1 << 16
#: Classes and leaves of a class; words with a leaf of their own. The other leaves are for words by their ends.
CLASSES, WITHIN, OWN = 64, 32, 1536
LEAVES = CLASSES * WITHIN
#: What the networks see of a neighbour: one of the TOP words, else by length and whether it has a leaf; PAD beyond the text.
TOP, LENGTHS = 31, 8
NEAR = TOP + 2 * LENGTHS + 1
PAD = NEAR - 1
#: And of the words beyond the neighbours: none, a top word, with or without a leaf and short or long.
FAR, SHORT = 6, 6
HIDDEN, EPOCHS, BATCH, RATE = 24, 12, 512, 0.2
SLOTS = 20
ONE = float(1 << 32)


class Lexicon:
    """Leaves of words, and the broadcast counts. Its size is VOCABULARY's, not the corpus's."""

    def __init__(self, top: list[tuple[int, int]]):
        """top: (hash, count) by falling count."""
        h = np.array([x[0] for x in top], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hash = h[order]
        self.count = np.array([x[1] for x in top], np.int64)[order]
        self.own = np.where(order < OWN, order, -1).astype(np.int32)
        self.slot = np.full(1 << SLOTS, -1, np.int32)
        self.slot[(self.hash >> U64(64 - SLOTS)).astype(np.int64)] = np.arange(len(h), dtype=np.int32)

    def entry(self, h: np.ndarray) -> np.ndarray:
        """The words' entries, -1 without one."""
        if not len(self.hash) or not len(h):
            return np.full(len(h), -1, np.int64)
        to = self.slot[(h >> U64(64 - SLOTS)).astype(np.int64)].astype(np.int64)
        # a slot shows the last of its entries
        rest = np.flatnonzero((to >= 0) & (self.hash[to] != h))
        at = np.minimum(np.searchsorted(self.hash, h[rest]), len(self.hash) - 1)
        to[rest] = np.where(self.hash[at] == h[rest], at, -1)
        return to


class Reading:
    """A chunk's words as the networks see them."""

    def __init__(self, t: Texts, lex: Lexicon):
        w = words(t, NOT_SPACE)
        self.woff, self.hash = w.woff, word_hashes(t, w)
        self.entry = lex.entry(self.hash)
        own = np.where(self.entry >= 0, lex.own[self.entry], -1) if len(lex.own) else np.full(len(self.hash), -1)
        length = w.end - w.start
        self.leaf = np.where(own >= 0, own, end_leaf(t.buf, w.start, w.end)).astype(np.int64)
        bins = np.minimum(LENGTHS - 1, (length - 1) // 2)
        near = np.where((own >= 0) & (own < TOP), own, TOP + np.where(own >= 0, 0, LENGTHS) + bins)
        far = np.where((own >= 0) & (own < TOP), 1, 2 + 2 * (own < 0) + (length > SHORT))
        n = len(near)
        row = np.repeat(np.arange(len(w.woff) - 1), np.diff(w.woff))
        first, last = w.woff[:-1][row], w.woff[1:][row]
        at = np.arange(n)
        side = []
        for d, kind, none in ((-1, near, PAD), (1, near, PAD), (-2, far, 0), (2, far, 0)):
            p = at + d
            inside = (p >= first) & (p < last)
            seen = np.full(n, none, np.int64)
            seen[inside] = kind[p[inside]]
            side.append(seen)
        left, right, far_left, far_right = side
        self.pair = left * NEAR + right
        self.window = (self.pair * FAR + far_left) * FAR + far_right


def end_leaf(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The leaf of words by their last three bytes, A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.int64)
    code = LOWER[buf[end - 1]].astype(np.uint64)
    for k in (2, 3):
        byte = LOWER[buf[np.maximum(end - k, 0)]].astype(np.uint64)
        code = code * U64(257) + np.where(end - k >= start, byte + U64(1), U64(0))
    return OWN + (mix(code) % U64(LEAVES - OWN)).astype(np.int64)


class Network:
    """A window network: embeddings of what stands around a word, a hidden layer, and groups of a softmax each."""

    def __init__(self, sizes: tuple[int, ...], groups: int, flat: np.ndarray | None = None, held: np.ndarray | None = None):
        self.sizes, self.groups = sizes, groups
        out = LEAVES if groups > 1 else CLASSES
        self.shapes = ((sum(sizes), HIDDEN), (HIDDEN,), (HIDDEN, out), (out,))
        if flat is None:
            r = np.random.Generator(np.random.PCG64(4))
            flat = np.concatenate([(r.standard_normal(s) * (0.1 if len(s) > 1 else 0)).ravel() for s in self.shapes])
        self.flat = flat.astype(np.float32)
        self.parts = self._split(self.flat)
        #: Which outputs any word of the corpus has; others get no probability.
        self.held = np.ones(out, bool) if held is None else held

    def _split(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(flat, ends), self.shapes, strict=True)]

    def inputs(self, context: np.ndarray) -> np.ndarray:
        """Rows of the embeddings of each context's places."""
        out = np.empty((len(context), len(self.sizes)), np.int64)
        for i in range(len(self.sizes) - 1, -1, -1):
            context, out[:, i] = np.divmod(context, self.sizes[i])
        return out + np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer and the log-probabilities, [context, group, output]."""
        e, b, w, c = self.parts
        h = np.tanh(e[x].sum(1) + b)
        z = h @ w + c
        z[:, ~self.held] = -1e30
        z = z.reshape(len(x), self.groups, -1)
        z -= z.max(2, keepdims=True)
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return h, z

    def train(self, context: np.ndarray, counts, epochs: int = EPOCHS) -> None:
        """Adagrad over batches of contexts; counts(lo, hi): how often each output stands in those contexts."""
        n = len(context)
        if not n:
            return
        x = self.inputs(context)
        starts = np.arange(0, n, BATCH)
        total = np.zeros(self.shapes[2][1])
        for lo in starts:
            total += counts(lo, lo + BATCH).sum(0)
        self.held = total > 0
        e, _, w, c = self.parts
        c[:] = np.log(np.maximum(total, 0.5))
        seen = np.zeros_like(self.flat)
        scale = np.float32(len(starts) / total.sum())
        turn = np.random.Generator(np.random.PCG64(5))
        for _ in range(epochs):
            for lo in turn.permutation(starts):
                target, rows = counts(lo, lo + BATCH), x[lo : lo + BATCH]
                h, z = self.forward(rows)
                want = target.reshape(z.shape)
                grad = (np.exp(z, out=z) * want.sum(2, keepdims=True) - want).reshape(len(rows), -1) * scale
                dh = (grad @ w.T) * (1 - h * h)
                de = np.zeros_like(e)
                for i in range(rows.shape[1]):
                    one = np.zeros((len(rows), self.sizes[i]), np.float32)
                    at = int(sum(self.sizes[:i]))
                    one[np.arange(len(rows)), rows[:, i] - at] = 1
                    de[at : at + self.sizes[i]] = one.T @ dh
                step = np.concatenate([de.ravel(), dh.sum(0), (h.T @ grad).ravel(), grad.sum(0)])
                seen += step * step
                self.flat -= RATE * step / (np.sqrt(seen) + 1e-9)

    def table(self) -> np.ndarray:
        """Log-probabilities of all outputs in all contexts: float32[context, output]."""
        n = int(np.prod(self.sizes))
        out = np.empty((n, self.shapes[2][1]), np.float32)
        for lo in range(0, n, 4096):
            _, z = self.forward(self.inputs(np.arange(lo, min(lo + 4096, n))))
            out[lo : lo + 4096] = z.reshape(len(z), -1)
        return out


WINDOW, PAIR = (NEAR, NEAR, FAR, FAR), (NEAR, NEAR)


@lru_cache(maxsize=1)
def _tables(model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both networks' log-probabilities; they outlive the task."""
    flat = np.frombuffer(zlib.decompress(model), np.float32)
    held = flat[-LEAVES - CLASSES :] > 0
    flat = flat[: -LEAVES - CLASSES]
    kinds = Network(WINDOW, 1)
    n = len(kinds.flat)
    return Network(WINDOW, 1, flat[:n].copy(), held[LEAVES:]).table(), Network(PAIR, CLASSES, flat[n:].copy(), held[:LEAVES]).table()


class Model:
    """The lexicon, the trained networks and the leaves' masses."""

    def __init__(self, lex: Lexicon, windows: np.ndarray, pairs: np.ndarray):
        """windows[context, class] and pairs[context, leaf]: how often each stands there."""
        self.lex = lex
        self.mass = pairs.sum(0).astype(np.float64)
        nets = []
        for sizes, groups, found in ((WINDOW, 1, windows), (PAIR, CLASSES, pairs)):
            some = np.flatnonzero(found.any(1))
            net = Network(sizes, groups)
            net.train(some, lambda lo, hi, found=found, some=some: found[some[lo:hi]].astype(np.float32))
            nets.append(net)
        held = [nets[1].held.astype(np.float32), nets[0].held.astype(np.float32)]
        self.nets = zlib.compress(np.concatenate([nets[0].flat, nets[1].flat, *held]).tobytes(), 1)

    def log_p(self, r: Reading) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of a chunk's words in whole numbers of 2^-32, and the places of the words outside the lexicon:
        theirs lack the logarithm of their counts."""
        kinds, leaves = _tables(self.nets)
        each = kinds[r.window, r.leaf // WITHIN].astype(np.float64) + leaves[r.pair, r.leaf]
        known = r.entry >= 0
        count = np.where(known, self.lex.count[r.entry], 1) if len(self.lex.count) else np.ones(len(each))
        each += np.log(count) - np.log(np.maximum(self.mass[r.leaf], 1))
        return np.round(each * ONE).astype(np.int64), np.flatnonzero(~known)


def lexicon(texts: DataFrame, ws: Workspace) -> tuple[Lexicon, DataFrame | None]:
    """The lexicon, and word and n (2 at least) of all words outside its vocabulary, if there are any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            for t in chunks(b.column(0), 8 << 20):
                w = words(t, NOT_SPACE)
                held.append(np.unique(word_hashes(t, w), return_counts=True))
                n += len(held[-1][0])
                if n > 1 << 20:
                    held = [_merged(held)]
                    n = len(held[0][0])
                    if n > 1 << 20:
                        yield _counts(*held[0])
                        held, n = [], 0
        if held:
            yield _counts(*_merged(held))

    counted = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = ws.keep(counted, "words")
    # the smallest count of which VOCABULARY words at most have as much; a row for each different count decides it
    sizes = counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(VOCABULARY).collect()
    room, least = VOCABULARY, None
    for r in sizes:
        room -= r["k"]
        if room < 0:
            break
        least = r["n"]
    if not sizes:
        return Lexicon([]), None
    if least is None:
        least = sizes[0]["n"] + 1
    top = counted.filter(F.col("n") >= least).collect()  # VOCABULARY rows at most
    top.sort(key=lambda r: (-r["n"], r["word"]))
    lex = Lexicon([(r["word"], r["n"]) for r in top])
    rest = counted.filter((F.col("n") < least) & (F.col("n") > 1))
    if not rest.isEmpty():
        return lex, rest
    ws.drop("words")
    return lex, None


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[begin], np.add.reduceat(c, begin) if len(h) else c


def _counts(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["word", "n"])


#: The two tables of contexts, as (rows, columns); each is cut by the left neighbour.
_STATISTICS = ((NEAR * NEAR * FAR * FAR, CLASSES), (NEAR * NEAR, LEAVES))
_CELLS = "key int, cell binary, n binary"


def statistics(texts: DataFrame, lex) -> list[np.ndarray]:
    """How often each class stands in each window and each leaf between each pair, over every word of every text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(a * b, np.int64) for a, b in _STATISTICS]
        held: list[list[np.ndarray]] = [[], []]
        n = 0

        def put() -> None:
            for i, codes in enumerate(held):
                if codes:
                    total[i] += np.bincount(np.concatenate(codes), minlength=len(total[i]))
                    codes.clear()

        for b in batches:
            for t in chunks(b.column(0)):
                r = Reading(t, lex.value)
                held[0].append(r.window * CLASSES + r.leaf // WITHIN)
                held[1].append(r.pair * LEAVES + r.leaf)
                n += len(r.leaf)
                if n > 1 << 21:
                    put()
                    n = 0
        put()
        for i, x in enumerate(total):
            yield from _cells({i * NEAR + k: part for k, part in enumerate(x.reshape(NEAR, -1))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, cell, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key not in sums:
                    a, c = _STATISTICS[key // NEAR]
                    sums[key] = np.zeros(a * c // NEAR, np.int64)
                sums[key][np.frombuffer(cell, np.int32)] += np.frombuffer(n, np.int64)
        yield from _cells(sums)

    parts = texts.mapInArrow(gather, _CELLS)
    few = parts.repartition("key", F.spark_partition_id() % 8).mapInArrow(add, _CELLS)
    out = [np.zeros((a, b), np.int64) for a, b in _STATISTICS]
    for r in few.repartition("key").mapInArrow(add, _CELLS).collect():  # the tables' fixed size at most
        whole = out[r["key"] // NEAR].reshape(NEAR, -1)
        whole[r["key"] % NEAR, np.frombuffer(r["cell"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out


def _cells(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, x in sums.items():
        at = np.flatnonzero(x)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], ["key", "cell", "n"])


def fit(texts: DataFrame, ws: Workspace) -> tuple[Model, DataFrame | None]:
    """The model of a column text, and the counts of the words outside its lexicon (word, n)."""
    lex, rest = lexicon(texts, ws)
    return Model(lex, *statistics(texts, texts.sparkSession.sparkContext.broadcast(lex))), rest


def lm_scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_words, log_likelihood (sum over its words) and mean_log_likelihood (null without words).

    Null and empty texts have 0 words and a sum of 0; an empty table gives no rows. Very long texts are read whole, as a
    chunk of their own. Every row stays, repeated ones too (they weigh by their number in counts and training) and those
    without doc_id; words of equal count are ranked by their hash; other columns are left out, so their names can't
    clash. Scores are the same however the rows are partitioned. Three passes over the texts: counts of words (combined in
    each task before their shuffle), counts of contexts, scores. The driver gets VOCABULARY words and the two tables of
    contexts, whose size is fixed. Where words outside the vocabulary repeat, rows are written with them once, and their
    counts come by a join.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "lm")
    made, rest = fit(df.select(F.col(text).alias("text")), ws)
    model = spark.sparkContext.broadcast(made)
    kind_of_id = df.schema[doc_id].dataType.simpleString()
    joined = rest is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column(1)):
                r = Reading(t, model.value.lex)
                each, other = model.value.log_p(r)
                total = np.concatenate([[0], np.cumsum(each)])
                more = [pa.ListArray.from_arrays(pa.array(np.searchsorted(other, r.woff), pa.int32()), pa.array(r.hash[other].view(np.int64)))] if joined else []
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.lo, t.hi - t.lo), pa.array(np.diff(r.woff), pa.int64()), pa.array(total[r.woff[1:]] - total[r.woff[:-1]]), *more], ["doc_id", "n_words", "total", "others"][: 3 + joined]
                )

    kind = f"doc_id {kind_of_id}, n_words long, total long" + ", others array<bigint>" * joined
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, kind)
    if joined:
        # the number of a row is written with it, so that it is the same in both reads
        rows = ws.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        log = F.round(F.log(F.col("n").cast("double")) * ONE).cast("long")
        others = rows.select("row", F.explode("others").alias("word")).join(rest.select("word", log.alias("log")), "word")
        sums = others.groupBy("row").agg(F.sum("log").alias("log"))
        rows = rows.select("row", "doc_id", "n_words", "total").join(sums, "row", "left")
        rows = rows.withColumn("total", F.col("total") + F.coalesce(F.col("log"), F.lit(0)))
    rows = rows.withColumn("log_likelihood", F.col("total") / ONE)
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return rows.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))
