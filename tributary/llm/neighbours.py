"""Nearest vectors by inner product: cross-polytope hashing, multiprobe tables, exact ranking of what they hold.

A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and files
each under its nearest signed axis. A query looks in the buckets of its nearest axes and ranks all they hold by the
exact inner product. Largest inner product becomes nearest on the sphere within bands of norms: rows are filed by band
and direction, and a query looks in the nearest buckets of every band and in further ones of the bands of large norms, by
the inner product that a band's rows may reach. Rows whose norms are within BAND of each other are one band.

Buckets are packed into parts of PART bytes; a bucket that holds more is cut into parts of its own by a hash of vec_id, so
that no task holds more, however many rows share a bucket. A query goes to the parts of the buckets it probes only: for a
number of queries, what is shuffled grows in proportion to the probed rows. Copies of one vector are ranked by vec_id, so
of each batch's copies the k + 1 smallest ids are kept: exactly those that can be among a query's k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

TABLES = 2
#: Recall that the number of probes is chosen for, and pairs of random vectors that it is tried on.
RECALL, PAIRS = 0.96, 4096
#: Bytes of a part's vectors in double precision; rows at least, however long the vectors.
PART, LEAST = 1 << 23, 256
#: Ratio of norms within a band; bands at most, of which so many hold the largest norms apart, however few rows have them.
BAND, BANDS, TOP = 1.05, 32, 8
RESULT = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def norm_bands(steps: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms at which bands begin, largest first, each band's largest norm and its rows; steps: rows by log(norm) / log(BAND).

    Small norms' bands hold many steps if there are too many: the large ones decide on inner products.
    """
    edge, largest, rows, last, before = [], [], [], -1, 0
    total = sum(steps.values())
    for i, (x, n) in enumerate(sorted(steps.items(), reverse=True)):
        band = i if i < TOP or len(steps) <= BANDS else TOP + (BANDS - TOP) * before // total
        if band != last:
            edge.append(0.0)
            largest.append(BAND ** (x + 0.5))
            rows.append(0)
        edge[-1], last = BAND ** (x - 0.5), band
        rows[-1] += n
        before += n
    edge[-1] = 0.0
    return np.array(edge), np.array(largest), np.array(rows, np.int64)


class Rotations:
    def __init__(self, dim: int, bands: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, tables: int = TABLES, seed: int = 10):
        self.dim, self.tables = dim, tables
        self.edge, self.largest, rows = bands
        self.bands, self.share = len(rows), rows / rows.sum()
        self.size = 1 << int(np.ceil(np.log2(dim + 1)))
        #: Cosine that only the nearest k of all rows reach, were these random.
        self.reach = float(np.sqrt(2 * np.log(max(2.0, rows.sum() / k)) / dim))
        self.signs = np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1.0, 1.0]), (tables, 3, self.size))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            x = hadamard(x * signs)
        return x

    def probes(self, n: int, k: int) -> int:
        """Buckets to probe in each table so that the k nearest of n vectors are found with RECALL, were they random; those
        of vectors in clusters lie closer and are found more often. Tried on pairs at the cosines of the first to the kth."""
        r = np.random.Generator(np.random.PCG64(11))
        x, z = (r.standard_normal((PAIRS, self.dim)) for _ in range(2))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        z -= x * (x * z).sum(1, keepdims=True)
        z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)
        quantile = NormalDist().inv_cdf
        share = np.minimum((np.arange(PAIRS) % k + 0.5) / max(n, 2 * k), 0.5)
        cosine = np.minimum(np.array([quantile(1 - s) for s in share]) / np.sqrt(self.dim), 1)[:, None]
        out = np.zeros((2, PAIRS, self.size))
        out[0, :, : self.dim], out[1, :, : self.dim] = x, cosine * x + np.sqrt(1 - cosine * cosine) * z
        y, stored = self.turned(out[0], 0), self.turned(out[1], 0)
        near = np.stack([-y, y], 2).reshape(PAIRS, -1)
        axis = np.abs(stored).argmax(1)
        at = 2 * axis + (stored[np.arange(PAIRS), axis] > 0)
        place = (near > near[np.arange(PAIRS), at][:, None]).sum(1)
        order = np.bincount(place * k + np.arange(PAIRS) % k, minlength=2 * self.size * k).reshape(-1, k)
        found = np.cumsum(order, 0) / np.bincount(np.arange(PAIRS) % k, minlength=k)
        recall = (1 - (1 - found) ** self.tables).mean(1)
        return int(np.argmax(recall >= min(RECALL, recall[-1]))) + 1

    def unit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions, filled up to the size, and norms."""
        scale = np.abs(x).max(1, keepdims=True)
        x = x / scale
        norm = np.sqrt((x**2).sum(1, keepdims=True))
        out = np.zeros((len(x), self.size))
        out[:, : self.dim] = x / norm
        return out, (norm * scale)[:, 0]

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        out, norm = self.unit(x)
        y = self.turned(out, table)
        axis = np.abs(y).argmax(1)
        band = (norm[:, None] < self.edge[None, :-1]).sum(1)
        return (band * 2 * self.size + 2 * axis + (y[np.arange(len(y)), axis] > 0)).astype(np.int32)

    def probed(self, q: np.ndarray, table: int, n: int, sizes: np.ndarray, least: int) -> np.ndarray:
        """bool[query, bucket]: the n nearest buckets of every band, further ones by the inner product that they may reach
        until another n (a band's counting by its share of the rows) are chosen, and until all hold at least so many rows:
        as many as are asked for, so that fewer come back only where the index has no more."""
        y = self.turned(self.unit(q)[0], table)
        near = np.stack([-y, y], 2).reshape(len(y), -1)
        order = np.argsort(-near, 1, kind="stable")
        out = np.zeros((len(y), self.bands, near.shape[1]), bool)
        np.put_along_axis(out, order[:, None, :], np.arange(near.shape[1])[None, None, :] < n, 2)
        out = out.reshape(len(y), -1)
        # a stored row's nearest axis has about this coordinate of it
        axis = np.sqrt(2 * np.log(2 * self.size) / self.size)
        may = (self.largest[None, :, None] * (axis * near[:, None, :] + self.reach)).reshape(len(y), -1)
        order = np.argsort(-may, 1, kind="stable")
        share = np.repeat(self.share, near.shape[1])[order]
        held = sizes[order]
        more = (np.cumsum(share, 1) - share < n - 1e-9) | (np.cumsum(held, 1) - held < least)
        chosen = np.zeros(out.shape, bool)
        np.put_along_axis(chosen, order, more, 1)
        return out | chosen


class Parts:
    """Which buckets of a table share a part, and which part is cut; from the buckets' sizes."""

    def __init__(self, sizes: np.ndarray, rows: int):
        #: Of each bucket its first part, how many parts it is cut into, and its place among the buckets of its part.
        self.first, self.cut, self.place = (np.zeros(len(sizes), np.int32) for _ in range(3))
        #: Buckets of each part.
        self.buckets: list[np.ndarray] = []
        open_, held = [], 0
        for b in np.flatnonzero(sizes).tolist():
            n = int(sizes[b])
            if n > rows:
                cut = -(-n // rows)
                self.first[b], self.cut[b] = len(self.buckets), cut
                self.buckets += [np.array([b])] * cut
                continue
            if held + n > rows or not open_:
                open_, held = [], 0
                self.buckets.append(open_)
                at = len(self.buckets) - 1
            self.first[b], self.cut[b], self.place[b] = at, 1, len(open_)
            open_.append(b)
            held += n
        self.buckets = [np.array(x) for x in self.buckets]


def smallest_copies(vectors: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Rows to keep: of equal vectors those with the smallest ids; of rows with equal vector and id one."""
    key = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(key, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    order, g = order[new], g[new]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return np.sort(order[rank < keep])


def _matrix(column: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries its k nearest rows of index found, its own vec_id
    left out, nearest first, ties to the smaller vec_id; score is the inner product in double precision.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than
    most of index (the shorter of two as frequent), nor rows without vec_id. Rows that repeat a vec_id count once, with the
    larger score. Other columns are left out, so their names can't clash. Without any valid row the result is empty.
    probes: buckets looked up in each table; by default so many that RECALL is met for that number of rows, were they
    random. The driver gets the sizes of buckets, whose number the parameters fix.
    """
    spark = index.sparkSession
    double = index.schema[vector].dataType.elementType.simpleString() != "float"
    kind = np.dtype(np.float64 if double else np.float32)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        df = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
        fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
        return df.filter((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))

    stored = valid(index)
    shape = stored.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not shape:
        return spark.createDataFrame([], RESULT)
    dim = shape[0]["dim"]
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # squares of doubles can leave their range
    step = F.coalesce(F.greatest(F.lit(-7000), F.least(F.lit(7000), F.round(F.log(square) / (2 * float(np.log(BAND)))).cast("int"))), F.lit(-7000))
    steps = stored.filter(F.size("vector") == dim).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # the range of norms bounds them
    turn = Rotations(dim, norm_bands({r["step"]: r["n"] for r in steps}), k, tables)
    ws = Workspace(spark, "nearest")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, m = b.column(0).to_numpy(), _matrix(b.column(1), dim, kind)
            keep = smallest_copies(m, ids, k + 1)
            ids, m = ids[keep], m[keep]
            data = _binary(m)
            for t in range(tables):
                bucket = turn.bucket(m.astype(np.float64), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), t, np.int32)), pa.array(bucket), pa.array(ids), data],
                    ["t", "bucket", "id", "vector"],
                )

    rows = stored.filter(F.size("vector") == dim).mapInArrow(file, "t int, bucket int, id long, vector binary")
    rows = ws.keep(rows, "rows")
    sizes = np.zeros((tables, turn.bands * 2 * turn.size), np.int64)
    for r in rows.groupBy("t", "bucket").agg(F.count("*").alias("n")).collect():  # a row for each table, band and axis
        sizes[r["t"], r["bucket"]] = r["n"]
    if not sizes.any():
        return spark.createDataFrame([], RESULT)
    probes = probes or turn.probes(int(sizes[0].sum()), k)
    parts = [Parts(x, max(LEAST, PART // (8 * dim))) for x in sizes]
    where = [(t, int(b), int(p.first[b]), int(p.cut[b]), int(p.place[b])) for t, p in enumerate(parts) for b in np.flatnonzero(p.cut)]
    where = spark.createDataFrame(where, "t int, bucket int, first int, cut int, place int")
    part = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cut"))).cast("int")
    # a row for each bucket: its number is fixed by the parameters
    filed = rows.join(F.broadcast(where), ["t", "bucket"]).select("t", part.alias("part"), F.lit(0).alias("kind"), "id", "vector", "place", F.lit(None).cast("binary").alias("probes"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, m = b.column(0).to_numpy(), _matrix(b.column(1), dim, kind)
            # so many queries at a time that what they probe stays small
            for lo in range(0, len(ids), block):
                yield from put(ids[lo : lo + block], m[lo : lo + block])

    block = max(256, 8192 // turn.bands)

    def put(ids: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        data = _binary(m)
        for t in range(tables):
            probed = turn.probed(m.astype(np.float64), t, probes, sizes[t], k + 1)
            for i, buckets in enumerate(parts[t].buckets):
                local = np.ascontiguousarray(probed[:, buckets], np.uint8)
                some = np.flatnonzero(local.any(1))
                n = len(some)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.full(n, x, np.int32)) for x in (t, i, 1)), pa.array(ids[some]), data.take(pa.array(some)), pa.array(np.zeros(n, np.int32)), _binary(local[some])],
                        ["t", "part", "kind", "id", "vector", "place", "probes"],
                    )

    schema = "t int, part int, kind int, id long, vector binary, place int, probes binary"
    asked = valid(queries).filter(F.size("vector") == dim).mapInArrow(ask, schema)
    both = filed.union(asked).repartition("t", "part").sortWithinPartitions("t", "part", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in range(4)]
            m = np.frombuffer(b"".join(b.column(4).to_pylist()), kind).reshape(-1, dim)
            place = b.column(5).to_numpy()
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
                now = tuple(int(c[lo]) for c in cols[:2])
                if now != key:
                    key, held = now, []
                if cols[2][lo] == 0:
                    held.append((cols[3][lo:hi], m[lo:hi], place[lo:hi]))
                    continue
                if len(held) != 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))] if held else []
                if held:
                    probed = np.frombuffer(b"".join(b.column(6).slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1)
                    for at in range(lo, hi, 128):
                        to = min(hi, at + 128)
                        yield _best(cols[3][at:to], m[at:to], probed[at - lo : to - lo], *held[0], k)

    found = both.mapInArrow(rank, "query_id long, ids array<bigint>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, ids, scores = None, [], []
        for b in batches:
            for q, i, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if q != query:
                    if query is not None:
                        yield _ranked(query, np.concatenate(ids), np.concatenate(scores), k)
                    query, ids, scores = q, [], []
                ids.append(i.values.to_numpy(zero_copy_only=False).astype(np.int64))
                scores.append(s.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if query is not None:
            yield _ranked(query, np.concatenate(ids), np.concatenate(scores), k)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, RESULT)


def _best(query_ids, q, probed, ids, vectors, place, k: int) -> pa.RecordBatch:
    """The k best rows of one part for each query, among the buckets it probes."""
    q = q.astype(np.float64)
    product = np.full((len(q), len(ids)), -np.inf)
    for x in np.unique(place):
        r, a = np.flatnonzero(place == x), np.flatnonzero(probed[:, x])
        if len(a):
            product[np.ix_(a, r)] = q[a] @ vectors[r].astype(np.float64).T
    product[query_ids[:, None] == ids[None, :]] = -np.inf
    out_i, out_s = [], []
    if len(ids) > k:
        last = -np.partition(-product, k - 1, 1)[:, k - 1]
    else:
        last = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0)))
    for i in range(len(q)):
        at = np.flatnonzero((product[i] >= last[i] - slack[i]) & (product[i] > -np.inf)) if np.isfinite(last[i]) else np.flatnonzero(product[i] > -np.inf)
        exact = (vectors[at].astype(np.float64) * q[i]).sum(1)
        order = np.lexsort((ids[at], -exact))[: k + 1]
        out_i.append(ids[at][order])
        out_s.append(exact[order])
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(out_i, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))], ["query_id", "ids", "scores"])


def _ranked(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, query, np.int64)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ids[first]), pa.array(scores[first])],
        ["query_id", "rank", "vec_id", "score"],
    )
