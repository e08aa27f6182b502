"""Approximate cosine search: layered small-world graphs, one for each part of the index, searched by beams.

The index is a table. A part holds about PART rows, dealt by a hash of their ids, so that parts grow in number and not in
size; a task builds a part's graph and writes a row for each vector with its links on every layer. A search reads the parts,
follows the links for all queries of a block at once, and keeps k rows a query and part, which are then ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import BROADCAST_QUERIES

#: Rows of a part; links of a vector on the upper layers (twice as many on the lowest); beams of building and searching.
PART, LINKS, BUILD_BEAM, BEAM = 1 << 14, 16, 100, 64
#: Vectors that are inserted, and queries that are searched, at once.
TOGETHER = 512
#: Cells of links that are chosen anew at once.
CELLS = 1 << 14

INDEX = "part int, pos int, level int, id {id}, vector array<double>, links array<array<int>>"


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        scaled = rows / np.abs(rows).max(1, keepdims=True)
        return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _products(units: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """q[i] . units[rows[i, j]], and -inf where there is no row (-1)."""
    out = np.einsum("ijd,id->ij", units[rows], q)
    out[rows < 0] = -np.inf
    return out


def beam(units: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `width` nearest rows found from its entries (rows, or -1) over links, nearest first, with their products.

    All queries go on step by step together: each expands its nearest row that isn't expanded yet, until that row is
    farther than the last one of a full beam.
    """
    n, each = len(q), np.arange(len(q))
    seen = np.zeros((n, len(units)), bool)
    rows = np.full((n, width), -1, np.int64)
    value = np.full((n, width), -np.inf, units.dtype)
    done = np.ones((n, width), bool)
    live = each

    def merge(who: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[(new >= 0) & seen[who[:, None], new]] = -1
        at = np.nonzero(new >= 0)
        seen[who[at[0]], new[at]] = True
        all_rows = np.concatenate([rows[who], new], 1)
        all_value = np.concatenate([value[who], _products(units, new, q[who])], 1)
        all_done = np.concatenate([done[who], new < 0], 1)
        top = np.argsort(-all_value, 1, kind="stable")[:, :width]
        rows[who], value[who], done[who] = (np.take_along_axis(x, top, 1) for x in (all_rows, all_value, all_done))

    merge(each, entry.copy())
    while len(live):
        first = np.argmin(done[live], 1)  # the nearest that isn't expanded
        going = ~done[live, first]
        live, first = live[going], first[going]
        if not len(live):
            break
        done[live, first] = True
        merge(live, links[rows[live, first]].astype(np.int64))
    return rows, value


def _chosen(units: np.ndarray, q: np.ndarray, rows: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (nearest first) `most` that lie nearer to q than to any chosen before; the nearest others fill up."""
    n, width = rows.shape
    taken = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    near = np.full((n, width), -np.inf, units.dtype)  # of each candidate, to the nearest one chosen
    for j in range(width):
        take = (rows[:, j] >= 0) & (count < most) & (near[:, j] < value[:, j])
        who = np.flatnonzero(take)
        if not len(who):
            continue
        taken[who, j] = True
        count[who] += 1
        if j + 1 < width:
            near[who, j + 1 :] = np.maximum(near[who, j + 1 :], _products(units, rows[who, j + 1 :], units[rows[who, j]]))
    order = np.argsort(np.where(taken, 0, np.where(rows >= 0, 1, 2)), 1, kind="stable")[:, :most]
    out = np.take_along_axis(rows, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(units: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen rows to the new ones; a row with too many chooses again."""
    to = chosen.ravel()
    of = np.repeat(new, chosen.shape[1])[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    rows, begin, count = np.unique(to, return_index=True, return_counts=True)
    step = max(1, CELLS // (links.shape[1] + int(count.max(initial=0))))
    for lo in range(0, len(rows), step):
        r, b, c = rows[lo : lo + step], begin[lo : lo + step], count[lo : lo + step]
        more = np.full((len(r), int(c.max())), -1, np.int64)
        within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        more[np.repeat(np.arange(len(r)), c), within] = of[b[0] : b[0] + len(within)]
        more[(more[:, :, None] == links[r][:, None, :]).any(2)] = -1  # rows of one batch may have chosen each other
        both = np.concatenate([links[r].astype(np.int64), more], 1)
        value = _products(units, both, units[r])
        top = np.argsort(-value, 1, kind="stable")
        links[r] = _chosen(units, units[r], np.take_along_axis(both, top, 1), np.take_along_axis(value, top, 1), links.shape[1])


def build(units: np.ndarray, level: np.ndarray, links: int = LINKS, width: int = BUILD_BEAM) -> list[np.ndarray]:
    """Links of each layer, rows ordered by descending level: layer l holds the first rows, those of level l or higher.

    Rows of a level are inserted in batches no larger than half of what is there; a batch's rows also meet each other.
    """
    sizes = [int((level >= x).sum()) for x in range(int(level.max(initial=0)) + 1)]
    layers = [np.full((n, links * (1 if x else 2)), -1, np.int32) for x, n in enumerate(sizes)]
    at = 1
    while at < len(units):
        own = int(level[at])
        to = min(at + max(1, min(TOGETHER, at // 2)), sizes[own])
        new, q = np.arange(at, to), units[at:to]
        entry = np.zeros((len(new), 1), np.int64)
        for x in range(len(layers) - 1, -1, -1):
            if x > own:
                entry, _ = beam(units[: sizes[x]], layers[x], q, entry, 1)
                continue
            rows, value = beam(units[:at], layers[x], q, entry, width)
            among = q @ q.T
            np.fill_diagonal(among, -np.inf)
            best = np.argsort(-among, 1, kind="stable")[:, :links]
            all_rows = np.concatenate([rows, new[best]], 1)
            all_value = np.concatenate([value, np.take_along_axis(among, best, 1)], 1)
            all_rows[~np.isfinite(all_value)] = -1
            top = np.argsort(-all_value, 1, kind="stable")
            chosen = _chosen(units, q, np.take_along_axis(all_rows, top, 1), np.take_along_axis(all_value, top, 1), links)
            layers[x][at:to, :links] = chosen
            _link_back(units, layers[x], new, chosen)
            entry = rows
        at = to
    return layers


def search(units: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    entry = np.zeros((len(q), 1), np.int64)
    for x in range(len(layers) - 1, 0, -1):
        entry, _ = beam(units[: len(layers[x])], layers[x], q, entry, 1)
    return beam(units, layers[0], q, entry, width)


def _usable(vector: str):
    """Vectors without null, NaN or infinite components, of which one isn't 0."""
    x = F.col(vector)
    return F.size(x).__gt__(0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def graph_index(index: DataFrame, part: int = PART, links: int = LINKS, width: int = BUILD_BEAM) -> DataFrame:
    """The index of (id, vector) as a table to be written: part, pos, level, id, vector, links (of each layer, as pos).

    A vector's level and part follow from its id's hash, so the graph doesn't hang on the order of rows. Vectors that have no
    direction, or another size than most, are left out.
    """
    rows = index.select("id", F.col("vector").cast("array<double>").alias("vector")).filter(_usable("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size, n = (sizes["size"], sizes["n"]) if sizes else (0, 0)
    parts = max(1, -(-n // part))
    hashed = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 52))
    level = F.least(F.lit(12), F.floor(-F.log((hashed + 1) / float(1 << 52)) / math.log(links))).cast("int")
    dealt = rows.filter(F.size("vector") == size).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), level.alias("level"), "id", "vector")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("level"), F.xxhash64("id", F.lit(2)), "id")
    names = ["part", "pos", "level", "id", "vector", "links"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_part(batches):
            vectors = _matrix(held.column("vector"))
            level = held.column("level").to_numpy()
            layers = build(_unit(vectors).astype(np.float32), level, links, width)
            for lo in range(0, held.num_rows, 1024):
                some = held.slice(lo, 1024)
                out = [[layers[x][i][layers[x][i] >= 0].tolist() for x in range(level[i] + 1)] for i in range(lo, lo + some.num_rows)]
                columns = [some.column("part"), pa.array(np.arange(lo, lo + some.num_rows), pa.int32()), some.column("level"), some.column("id"), some.column("vector"), pa.array(out, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    return dealt.mapInArrow(make, INDEX.format(id=index.schema["id"].dataType.simpleString()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that stand ordered by part, a part at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = b.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and hi > lo and held[0].column("part")[0] != b.column("part")[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def graph_knn(index: DataFrame, queries: DataFrame, k: int = 5, width: int = BEAM) -> DataFrame:
    """query, rank, id, score: about the k nearest rows by cosine of each query (query, vector), from graph_index()'s table.

    The parts are dealt to tasks, the queries reach them in blocks of BROADCAST_QUERIES bytes. Queries without direction, or of
    another size than the index, have no rows. k is clamped to at least 1.
    """
    k = max(k, 1)
    width = max(width, k)
    spark = index.sparkSession
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).filter(_usable("vector"))
    size = asked.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    blocks = -(-size // BROADCAST_QUERIES) or 1
    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    rows = index.select("part", "pos", "id", "vector", "links").repartition(parts, "part").sortWithinPartitions("part", "pos")
    kinds = queries.schema["query"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    found = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        ready = spark.sparkContext.broadcast(block.toArrow())
        some = rows.mapInArrow(_searcher(ready, k, width), f"query {kinds[0]}, id {kinds[1]}, score double")
        found = some if found is None else found.union(some)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def _searcher(ready, k: int, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = ready.value
        lengths = asked.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if asked.num_rows else np.zeros(0)
        for part in _by_part(batches):
            exact = _unit(_matrix(part.column("vector")))
            units = exact.astype(np.float32)
            layers = _layers(part.column("links").combine_chunks(), len(units))
            mine = asked.filter(pa.array(lengths == units.shape[1]))
            for lo in range(0, mine.num_rows, TOGETHER):
                some = mine.slice(lo, TOGETHER)
                q = _unit(_matrix(some.column("vector")))
                rows, _ = search(units, layers, q.astype(np.float32), width)
                value = _products(exact, rows, q)
                top = np.argsort(-value, 1, kind="stable")[:, :k]
                rows, value = np.take_along_axis(rows, top, 1), np.take_along_axis(value, top, 1)
                who, at = np.nonzero(rows >= 0)
                yield pa.RecordBatch.from_arrays(
                    [some.column("query").combine_chunks().take(pa.array(who)), part.column("id").combine_chunks().take(pa.array(rows[who, at])), pa.array(value[who, at])],
                    ["query", "id", "score"],
                )

    return find


def _layers(links: pa.ListArray, n: int) -> list[np.ndarray]:
    """The links of each layer as a matrix with -1 where a row has fewer."""
    inner = links.values
    first, to = links.offsets.to_numpy(), inner.offsets.to_numpy()
    flat = inner.values.to_numpy()
    depth = np.diff(first)
    out = []
    for x in range(int(depth.max(initial=1))):
        rows = np.flatnonzero(depth > x)  # the first ones: rows stand by level
        begin, end = to[first[:-1][rows] + x], to[first[:-1][rows] + x + 1]
        count = end - begin
        m = np.full((len(rows), max(1, int(count.max(initial=0)))), -1, np.int32)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        m[np.repeat(np.arange(len(rows)), count), within] = flat[np.repeat(begin, count) + within]
        out.append(m)
    return out
