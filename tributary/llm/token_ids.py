"""Token ids in a binary format of their own: encoded by the tokenizers library, packed by static range ANS.

The format is a Parquet table that Spark's writers commit, so it lives in any store and survives lost tasks. A row is a
segment of whole documents of about ``SEGMENT`` ids (a longer document is a segment of its own): the segment's
frequency table, which its blocks share, blocks of about ``BLOCK`` ids cut at ends of documents, and the documents'
ids and lengths. A segment can be read alone; so can a block, and within it the part after each checkpoint.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretoken, rans
from .ragged import Texts, chunks, code_points, gather_ranges
from .span_cache import SpanCache
from .tables import Workspace

SEGMENT, BLOCK = 1 << 21, 1 << 18
END_ID = 0

SCHEMA = (
    "part int, segment int, n_ids long, n_docs long, freq binary, blocks array<binary>, block_docs array<int>, "
    "doc_ids array<bigint>, lengths array<bigint>"
)


class Encoder:
    """The library's ids of whole texts; each distinct pre-token goes through the library once per worker."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        kind = np.uint16 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.library.no_truncation()
        self.library.no_padding()
        self._classes: np.ndarray | None = None
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.known = SpanCache(kind, lambda strings: [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    @property
    def classes(self) -> np.ndarray:
        """The classes of all code points, as the library's splitter has them; found when a text needs them."""
        if self._classes is None:
            self._classes = pretoken.classes_of_runs(self.library.pre_tokenizer.pre_tokenize_str)
        return self._classes

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of rows: all ids on end, and the number of each row's."""
        for t in chunks(column):
            yield self.chunk(t)

    def chunk(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        cps, off = code_points(t)
        rows = t.hi - t.lo
        slow = np.zeros(rows, bool)
        classes = self.classes if len(cps) and int(cps.max()) >= pretoken.SAFE else pretoken.CLASS
        raw = t.buf.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                slow[np.searchsorted(t.off, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        if slow.any():  # special strings: the library alone
            cps = cps.copy()
            cps[gather_ranges(off[:-1][slow], np.diff(off)[slow])] = 0x20
        start, end, woff = pretoken.cut(cps, off, keeps_space=True, classes=classes)
        at, length = self.known.spans(cps, start, end)
        total = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        counts = total[woff[1:]] - total[woff[:-1]]
        ids = self.known.store[gather_ranges(at, length)]
        if slow.any():
            own = {r: self.whole(t.text(r)) for r in np.flatnonzero(slow).tolist()}
            cut = total[woff]
            ids = np.concatenate([own[r] if r in own else ids[cut[r] : cut[r + 1]] for r in range(rows)] or [ids[:0]])
            counts[list(own)] = [len(x) for x in own.values()]
        return ids, counts


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id behind each row's ids."""
    counts = counts + 1
    to = np.cumsum(counts)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint32)
    last = np.zeros(len(out), bool)
    last[to - 1] = True
    out[~last], out[last] = ids, end_id
    return out, counts


class SegmentWriter:
    def __init__(self, part: int, vocabulary: int):
        self.part, self.segment, self.vocabulary = part, 0, vocabulary
        self._new()

    def _new(self) -> None:
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.n = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, docs: list) -> Iterator[pa.RecordBatch]:
        self.ids.append(ids.astype(np.uint16) if self.vocabulary <= 1 << 16 else ids)
        self.counts.append(counts)
        self.docs += docs
        self.n += len(ids)
        if self.n >= SEGMENT:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        ids, counts = np.concatenate(self.ids), np.concatenate(self.counts).astype(np.int64)
        table = rans.Table(rans.quantised(np.bincount(ids, minlength=self.vocabulary)))
        to = np.cumsum(counts)
        blocks, block_docs, doc, at = [], [], 0, 0
        while doc < len(counts):
            stop = max(doc + 1, int(np.searchsorted(to, at + BLOCK, "right")))
            blocks.append(rans.pack(rans.encode(ids[at : to[stop - 1]], table)))
            block_docs.append(stop - doc)
            doc, at = stop, int(to[stop - 1])
        row = {"part": self.part, "segment": self.segment, "n_ids": len(ids), "n_docs": len(counts), "freq": table.packed(), "blocks": blocks, "block_docs": block_docs, "doc_ids": self.docs, "lengths": counts.tolist()}
        self.segment += 1
        self._new()
        yield pa.RecordBatch.from_pylist([row], _ARROW)


_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("freq", pa.binary()),
    ("blocks", pa.list_(pa.binary())), ("block_docs", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())),
])


def write_ids(df: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of df's texts to a path of any store, in ascending order of doc_id.

    A null text counts as empty (its end id alone). Null ids come first; rows of one id follow a hash of their text, so
    that their order doesn't hang on the input's. Rows with one id, even a third of them all, are dealt to many tasks:
    the ranges are cut by id, that hash and the row's number. A very long text is a segment of its own; of an empty table
    files without rows are written; other columns are left out, so their names can't clash. One shuffle, of the texts; a task
    holds one segment.
    """
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        size = max(encoder.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        writer = SegmentWriter(TaskContext.get().partitionId(), size)
        for b in batches:
            docs, at = b.column(0).to_pylist(), 0
            for ids, counts in encoder.texts(b.column(1)):
                yield from writer.add(*with_end(ids, counts, end_id), docs[at : at + len(counts)])
                at += len(counts)
        yield from writer.close()

    keys = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "text", keys[1].alias("_h"), keys[2].alias("_n"))
    rows = rows.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").select("doc_id", "text")
    # the blocks are packed already: pages without compression or dictionaries hold no second copy of them
    packed = rows.mapInArrow(encode, SCHEMA).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
    packed.mode("errorifexists").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of write_ids(), from its files: doc_id, start (ids of all documents before), n_tokens and ids_crc32,
    on demand with their ids. Every part's checksum is verified; a broken file raises ValueError."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                table = rans.Table.unpacked(row["freq"])
                doc, start = 0, 0
                for data, n in zip(row["blocks"], row["block_docs"], strict=True):
                    ids = rans.decode(rans.unpack(data), table).astype("<u4")
                    lengths = np.array(row["lengths"][doc : doc + n], np.int64)
                    if lengths.sum() != len(ids):
                        raise ValueError("a block's documents don't fit its ids")
                    to = np.cumsum(lengths)
                    sums = [zlib.crc32(ids[a:e]) for a, e in zip((to - lengths).tolist(), to.tolist(), strict=True)]
                    columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"][doc : doc + n], pa.int64()), pa.array(start + to - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                    names = ["part", "segment", "doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    doc, start = doc + n, start + len(ids)

    files = spark.read.schema(SCHEMA).parquet(path)
    rows = files.select("freq", "blocks", "block_docs", "doc_ids", "lengths", "part", "segment").mapInArrow(
        decode, "part int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    )
    # ids before each part: a row for each task of the writer; before each segment within its part
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    place = sizes.join(before, "part").select("part", "segment", (F.col("before") + within).alias("before"))
    return rows.join(place, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def token_ids(df: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """write_ids() to a path (a new one in the shared folder, if none is given), then read_ids() from it: a row for each row of
    df, whatever its id or text; odd rows as in write_ids()."""
    path = path or Workspace(df.sparkSession, "ids").path("tokens")
    write_ids(df, path, vocabulary)
    return read_ids(df.sparkSession, path)
