"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Features of a text are the counts of its words (hashed into WORDS terms) and of its style: triples of character classes
(letters by case, digits, kinds of space, each ASCII mark), repetition of words, and how often words come back. Both parts'
TF-IDF over a bounded sample of labelled documents make one matrix, which a randomised SVD reduces; the sample's vectors
and the projection are broadcast (both of a size that the parameters fix). Every document is compared with every labelled
vector, in blocks, and the labels of its NEIGHBOURS nearest ones vote with their cosine; all that tie with the last of
them vote too, so that no order of rows decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import NOT_SPACE, U64, Texts, chunks, word_hashes, words

#: Labelled documents that the classifier learns from at most (chosen by a hash of doc_id): its documented bound.
SAMPLE = 4000
RANK, NEIGHBOURS, POWER = 48, 21, 4
THRESHOLD = 0.3
TRIPLES, RATIOS, SPANS = 2048, 16, (1, 2, 4, 8)
STYLE = TRIPLES + RATIOS + 16 * len(SPANS)
#: Terms of words, and the length of their part beside that of the style's.
WORDS, WEIGHT = 4096, 0.5
SIZE = STYLE + WORDS


def _classes() -> np.ndarray:
    """Lower 0, upper 1, digit 2, blank 3, line end 4, other control 5, byte beyond ASCII 6, each mark from 7 on."""
    out = np.full(256, 5, np.int64)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x20], out[[0x0A, 0x0D]], out[0x80:] = 0, 1, 2, 3, 4, 6
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


_CLASS = _classes()


def features(t: Texts) -> np.ndarray:
    """A row of SIZE counts for each text of the chunk; an empty text has none."""
    rows = t.hi - t.lo
    out = np.zeros((rows, SIZE), np.float32)
    n = len(t.buf)
    if n == 0:
        return out
    kind = _CLASS[t.buf]
    row = np.repeat(np.arange(rows), np.diff(t.off))
    if n > 2:
        triple = (kind[:-2] * 1600 + kind[1:-1] * 40 + kind[2:]) * 0x9E3779B1 % (1 << 32) * TRIPLES >> 32
        same = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][same] * TRIPLES + triple[same], minlength=rows * TRIPLES)
        out[:, :TRIPLES] = counts.reshape(rows, TRIPLES)
    w = words(t, NOT_SPACE)
    h = word_hashes(t, w)
    out[:, STYLE:] = np.bincount(w.rows() * WORDS + (h % U64(WORDS)).astype(np.int64), minlength=rows * WORDS).reshape(rows, WORDS)
    for r in np.flatnonzero(w.counts):
        own = h[w.woff[r] : w.woff[r + 1]]
        m = len(own)
        out[r, TRIPLES + min(RATIOS - 1, int(RATIOS * len(np.unique(own)) / m))] = m
        for i, span in enumerate(SPANS):
            if m > span:
                share = float((own[span:] == own[:-span]).mean())
                out[r, TRIPLES + RATIOS + 16 * i + min(15, int(16 * share))] = m
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF, each row of length 1: the style's part and, WEIGHT times as long, the words'."""
    x = np.log1p(counts)
    x *= idf
    for part, length in ((x[:, :STYLE], 1.0), (x[:, STYLE:], WEIGHT)):
        part *= length / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)[:, None]
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


class Voter:
    """The fitted classifier."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        n = len(counts)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if n else 0.5
        self.idf = np.log((1 + n) / (1 + np.count_nonzero(counts, 0))).astype(np.float32) + 1
        x = weighted(counts, self.idf)
        rank = min(RANK, *x.shape)
        y = x @ np.random.Generator(np.random.PCG64(9)).standard_normal((SIZE, rank + 10)).astype(np.float32)
        for _ in range(3):
            y, _ = np.linalg.qr(x @ (x.T @ y))
        _, _, right = np.linalg.svd(y.T @ x, full_matrices=False)
        self.projection = np.ascontiguousarray(right[:rank].T, np.float32)
        self.vectors = self._unit(x @ self.projection)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(weighted(counts, self.idf) @ self.projection)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 in the vote; the labels' mean where a text has no features or no neighbour."""
        out = np.full(len(counts), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for lo in range(0, len(counts), 512):
            # cosines to six places: equal vectors tie wherever they stand
            near = np.round(self.latent(counts[lo : lo + 512]) @ self.vectors.T, 6)
            last = -np.partition(-near, k - 1, 1)[:, k - 1 : k]
            who, at = np.nonzero(near >= last)
            weight = np.maximum(near[who, at], 0).astype(np.float64) ** POWER
            total = np.bincount(who, weight, len(near))
            vote = np.bincount(who, weight * self.labels[at], len(near)) / np.maximum(total, 1e-12)
            out[lo : lo + 512] = np.where(total > 1e-12, np.clip(vote, 0, 1), self.prior)
        return out


def held_out(doc_id) -> DataFrame:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Voter:
    """Learn from at most SAMPLE labelled documents outside the held-out fifth (the first by a hash of doc_id).

    Rows without label, id or text don't count, nor do ids whose labels contradict each other; equal labels of one id are
    one. An id that many documents repeat is one document, by its smallest text. Without any, all scores are 0.5.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").drop("high")
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)  # a bounded sample: SAMPLE rows
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # an id that many rows repeat is one document

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b.column(1)):
                made = features(t).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.lo, t.hi - t.lo), b.column(2).slice(t.lo, t.hi - t.lo), pa.array([zlib.compress(x.tobytes(), 1) for x in made], pa.binary())], ["doc_id", "label", "counts"])

    got = rows.select("doc_id", "text", "label").mapInArrow(count, "doc_id long, label int, counts binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    counts = np.empty((len(got), SIZE), np.float32)
    for i, r in enumerate(got):
        counts[i] = np.frombuffer(zlib.decompress(r["counts"]), np.float32)
    return Voter(counts, np.array([r["label"] for r in got], np.float32))


def score(documents: DataFrame, voter: Voter, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of documents: doc_id, the kept columns, held_out, score and predicted (1 from THRESHOLD on).

    A null or empty text has no features and gets the labelled sample's mean as its score. Every row stays, repeated ones
    too; a row without doc_id counts as not held out. Very long texts are read whole, as a chunk of their own; an empty
    table gives no rows; columns that aren't kept are left out, so their names can't clash. One narrow pass.
    """
    model = documents.sparkSession.sparkContext.broadcast(voter)
    kept = [c for c in keep if c != "doc_id"]
    carried = text in kept  # then the text travels once
    rows = documents.select(F.col(doc_id).alias("doc_id"), *kept, held_out(F.col(doc_id)).alias("held_out"), *([] if carried else [F.col(text).alias("_text")]))
    out = rows.schema.fields[: 2 + len(kept)]
    at = 1 + kept.index(text) if carried else len(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.zeros(0)]
            for t in chunks(b.column(at)):
                made.append(model.value.scores(features(t)))
            s = np.concatenate(made)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(out)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*b.schema.names[: len(out)], "score", "predicted"])

    return rows.mapInArrow(judge, T.StructType(list(out)).add("score", T.DoubleType()).add("predicted", T.IntegerType()))


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    return score(documents, fit(documents, labels, label))
