"""Vector search by exact distances, and chunks of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import distance_score

#: Bytes of query vectors in a block; a block is broadcast at a time.
BROADCAST_QUERIES = 64 << 20
#: Distances that a task looks at together.
CELLS = 1 << 21


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(index: DataFrame, queries: DataFrame, k: int = 5, measure: str = "l2") -> DataFrame:
    """query, rank, id, score: each query's k nearest rows; measure l2 (score 1 / (1 + d)), raw (squared distance) or cosine.

    index: id, vector; queries: query, vector. The queries are a stated set: every row is compared with each, a block of
    queries of BROADCAST_QUERIES bytes at a time; each task keeps k rows a query before they are ranked together. k is
    clamped to at least 1, and to the rows there are. Vectors that are null, hold null or are of another length have no
    distance.
    """
    k = max(k, 1)
    q = queries.select("query", F.col("vector").alias("q"))
    size = q.agg(F.sum(F.size("q") * 8)).first()[0] or 0
    blocks = -(-size // BROADCAST_QUERIES) or 1
    if blocks == 1:
        return _nearest(index, q, k, measure)
    dealt = q.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    return reduce(DataFrame.union, [_nearest(index, dealt.filter(F.col("_block") == i).drop("_block"), k, measure) for i in range(blocks)])


def _vectors(column: pa.Array | pa.ChunkedArray, cosine: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors by length, with cosine of length 1; without those that are null, hold null or can't have length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    held = np.maximum(length, 0)
    begin = np.cumsum(held) - held
    whole = length >= 0
    whole[np.repeat(np.arange(len(held)), held)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    values = pc.fill_null(pc.cast(flat, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(length[whole]).tolist():
        rows = np.flatnonzero(whole & (length == n))
        x = values[begin[rows][:, None] + np.arange(n)]
        if cosine and n:
            norm = np.sqrt(_summed(x * x))
            rows, x, norm = rows[norm != 0], x[norm != 0], norm[norm != 0]
            x = x / norm[:, None]
        out[n] = rows, x
    return out


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows from the first component to the last, so that equal vectors have equal ones wherever they are."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j]
    return out


def _kept(x: np.ndarray, q: np.ndarray, best: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x (the smallest ids first), queries and values of each query's k nearest that best, its k keys so far, allows;
    best takes their keys.

    Products of matrices find what may be among the k; its values are computed component by component.
    """
    k, dims = best.shape[1], x.shape[1]
    square, own = (x * x).sum(1), (q * q).sum(1)
    near = -(x @ q.T) if cosine else square[:, None] + own - 2 * (x @ q.T)
    slack = 32 * (dims + 8) * np.finfo(float).eps * (np.sqrt(square.max()) + np.sqrt(own)) ** 2
    limit = np.minimum(np.partition(near, min(k, len(x)) - 1, 0)[min(k, len(x)) - 1] if len(x) >= k else np.inf, best[:, -1]) + slack
    who, row = np.nonzero(~(near > limit).T)
    value = np.zeros(len(who))
    for j in range(dims):
        a, b = x[row, j], q[who, j]
        value += a * b if cosine else (a - b) * (a - b)
    key = np.where(np.isnan(value), -np.inf, -value) if cosine else value
    order = np.lexsort((row, key, who))
    who, row, value, key = who[order], row[order], value[order], key[order]
    begin = np.searchsorted(who, np.arange(len(q)))
    place = np.arange(len(who)) - begin[who]
    held = (place < k) & ~(key > best[who, -1])
    who, row, value, key, place = who[held], row[held], value[held], key[held], place[held]
    new = np.full(best.shape, np.inf)
    new[who, place] = key
    best[:] = np.sort(np.concatenate([best, new], 1), 1)[:, :k]
    return row, who, value


def _nearest(index: DataFrame, q: DataFrame, k: int, measure: str) -> DataFrame:
    cosine = measure == "cosine"
    asked = q.toArrow()  # a block of the stated queries
    ready = index.sparkSession.sparkContext.broadcast((asked["query"].combine_chunks(), _vectors(asked["q"], cosine)))
    made = StructType([StructField("query", q.schema["query"].dataType), StructField("id", index.schema["id"].dataType), StructField("v", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = ready.value
        best = {n: np.full((len(rows), k), np.inf) for n, (rows, _) in queries.items()}
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))  # ties go to the smaller id
            with np.errstate(all="ignore"):  # components that aren't finite
                for n, (rows, x) in _vectors(b.column(1), cosine).items():
                    step = max(1, CELLS // max(len(x), 1))
                    for lo in range(0, len(queries[n][0]) if n in queries and len(x) else 0, step):
                        of, y = (z[lo : lo + step] for z in queries[n])
                        row, who, value = _kept(x, y, best[n][lo : lo + step], cosine)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(of[who])), b.column(0).take(pa.array(rows[row])), pa.array(value)], ["query", "id", "v"])

    rows = index.select("id", "vector").mapInArrow(run, made)
    order = [F.desc("score"), F.asc("id")] if cosine else [F.asc("v"), F.asc("id")]
    rows = rows.withColumn("score", distance_score(F.col("v")) if measure == "l2" else F.col("v"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def kept_index(spark: SparkSession, folder: str, source: str, build: Callable[[str], DataFrame]) -> DataFrame:
    """The index of a source file: kept in folder under a name made of the source's path, built and written if it isn't there."""
    path = f"{folder}/{hashlib.sha256(source.encode()).hexdigest()}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build(source).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def chunks(docs: DataFrame, id_: str, text: str, shortest: int = 300, longest: int = 500, overlap: float = 0.15, head: int | None = None) -> DataFrame:
    """id, chunk (from 0, of those kept), tokens, text: windows of a text's tokens (runs without white space), as the index takes them.

    Windows start at every int(longest * (1 - overlap)) tokens until one reaches the end, and count from shortest tokens
    on. head: tokens of a document that an index with a bounded input reads (4096 in one of them); all, unless it is given.
    """
    stride = int(longest * (1 - overlap))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda w: w != "")
    words = words if head is None else F.slice(words, 1, head)
    rows = docs.select(F.col(id_).alias("id"), words.alias("w")).withColumn("n", F.size("w"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - longest) / stride).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    long_enough = F.filter(starts, lambda s: F.least(F.lit(longest), F.col("n") - s) >= shortest)
    parts = rows.withColumn("s", long_enough).select("id", "w", F.posexplode("s").alias("chunk", "start"))
    piece = F.slice("w", F.col("start") + 1, longest)
    return parts.select("id", "chunk", F.size(piece).alias("tokens"), F.array_join(piece, " ").alias("text"))
