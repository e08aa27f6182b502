"""Graph analytics on edge tables (src, dst): degrees, components, paths, cores, centralities.

Iterations are rounds of joins and aggregates with a checkpoint each; what reaches the driver is a row of totals.

Measures over all pairs (reach, paths, betweenness) search from every vertex. Vertices with the same neighbours on both
sides are twins: they stand for each other, so one of them is searched from and through, with their number as its weight. A
graph that then has SEARCHED * BROADCAST_EDGES edges at most is broadcast and its vertices are dealt to tasks, each of which adds
up its searches, so that no row for a pair is made; a larger one is searched by joins, a level a round. Betweenness of a graph in which
few vertices have a part in every edge is searched among these (see covers). So are power iterations: a
small graph's in memory, a larger one's by joins, with the same steps and the same ends. Components are found by tasks among
the edges that they have, a bounded number at a time, then among what these have in common; only what is left goes by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import covers

#: Edges of a graph that is broadcast at most (12 bytes each, and its vertices' names on the driver).
BROADCAST_EDGES = 2_000_000
#: Searches from every vertex take graphs of so many times as many edges: by joins they make a row for each pair.
SEARCHED = 8
#: Places (sources times vertices) that a task searches at a time.
PLACES = 1 << 21
#: Edges of which a task looks for connected vertices at a time.
GROUPED_EDGES = 1 << 20
#: Edges of a vertex above which it may be a hub, whose edges are dealt with their other ends.
HUB = 1000


@dataclass
class Adjacency:
    """A small digraph without parallel edges, by default without loops: vertex i's edges are start[i]:start[i + 1] of to, and
    it stands for size[i] twins (None: one each)."""

    names: list
    start: np.ndarray
    to: np.ndarray
    size: np.ndarray | None = None

    @classmethod
    def of(cls, edges: DataFrame, loops: bool = False, times: int = 1) -> Adjacency | None:
        """The graph of an edge table, if it is small enough: so many times BROADCAST_EDGES."""
        plain = edges.select("src", "dst").distinct()
        if plain.count() > times * BROADCAST_EDGES:
            return None
        got = plain.toArrow()
        src, dst = got["src"].combine_chunks(), got["dst"].combine_chunks()
        names = pa.concat_arrays([src, dst]).unique()
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
        if not loops:
            a, b = a[a != b], b[a != b]
        order = np.lexsort((b, a))
        return cls(names.to_pylist(), np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))]), b[order])

    @property
    def ends(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def reversed(self) -> Adjacency:
        a = self.ends
        order = np.lexsort((a, self.to))
        return Adjacency(self.names, np.concatenate([[0], np.cumsum(np.bincount(self.to, minlength=len(self.start) - 1))]), a[order], self.size)

    def levels(self, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Breadth-first searches from several sources: a level's new places (source number * (n + 1) + vertex), and the edges
        of shortest paths that lead to them, as places of both ends and the edge's number. The source itself is at place n;
        its own vertex there are its twins, which aren't entered if it has none."""
        n = len(self.start) - 1
        seen = np.full(len(sources) * (n + 1), -1, np.int32)
        row = np.arange(len(sources)) * (n + 1)
        single = np.ones(len(sources), bool) if self.size is None else self.size[sources] == 1
        seen[(row + sources)[single]] = 0
        at = row + n
        seen[at] = 0
        hops = 0
        while len(at):
            hops += 1
            v = at % (n + 1)
            v = np.where(v == n, sources[at // (n + 1)], v)
            length = self.start[v + 1] - self.start[v]
            begin = np.cumsum(length) - length
            edge = np.arange(int(length.sum())) + np.repeat(self.start[v] - begin, length)
            origin = np.repeat(at, length)
            target = origin - origin % (n + 1) + self.to[edge]
            fresh = seen[target] < 0
            seen[target[fresh]] = hops
            on = seen[target] == hops
            at = np.flatnonzero(seen == hops)
            yield at, origin[on], target[on], edge[on]


def twins(edges: DataFrame) -> DataFrame:
    """v, rep, size: the smallest of the vertices with the same neighbours on both sides, loops aside, and how many they are.

    Neighbours are equal by their number and 128 bits of hash on each side, combined before they are shuffled.
    """
    plain = edges.filter("src <> dst").select("src", "dst").distinct()
    ends = plain.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(0).alias("side")).union(plain.select(F.col("dst").alias("v"), F.col("src").alias("w"), F.lit(1).alias("side")))
    ends = ends.union(vertices(edges).select("v", F.lit(None).alias("w"), F.lit(None).alias("side")))  # those with loops only
    of = lambda side, x: F.coalesce(x(F.when(F.col("side") == side, F.xxhash64("w", F.lit(side)))), F.lit(0))
    keys = [f(side) for side in (0, 1) for f in (lambda k: F.count_if(F.col("side") == k), lambda k: of(k, F.bit_xor), lambda k: F.coalesce(F.bit_xor(F.when(F.col("side") == k, F.xxhash64(F.lit("twin"), "w"))), F.lit(0)))]
    names = [f"k{i}" for i in range(len(keys))]
    key = cut(ends.groupBy("v").agg(*[x.alias(c) for x, c in zip(keys, names, strict=True)]))
    return key.join(key.groupBy(*names).agg(F.min("v").alias("rep"), F.count("*").alias("size")), names).select("v", "rep", "size")


def _folded(edges: DataFrame, sizes: DataFrame | None = None) -> tuple[DataFrame, Adjacency | None]:
    """twins(), and the graph of one vertex for each group of them, if it is small enough. sizes: v, size, how many a vertex
    stands for already."""
    same = twins(edges)
    if sizes is not None:
        each = same.select("v", "rep").join(sizes, "v")
        same = same.select("v", "rep").join(each.groupBy("rep").agg(F.sum("size").alias("size")), "rep").select("v", "rep", "size")
    same = cut(same)
    reps = same.filter("v = rep").select("v")
    among = edges.join(reps.withColumnRenamed("v", "src"), "src", "left_semi").join(reps.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
    small = Adjacency.of(cut(among), times=SEARCHED)
    if small is None:
        return same, None
    # vertices whose neighbours are all twins of others have edges to the one of them that stands for these
    got = same.filter("v = rep").join(vertices(among), "v", "left_semi").select("v", "size").toArrow()
    size = dict(zip(got["v"].to_pylist(), got["size"].to_pylist(), strict=True))
    small.size = np.array([size[x] for x in small.names], np.int64)
    return same, small


def searched(edges: DataFrame, graph: Adjacency, search, least: int = 1) -> np.ndarray:
    """Sums of search(graph, sources), an array of numbers, over all vertices, dealt to tasks; least sources at a time."""
    n = len(graph.names)
    return added_up(edges.sparkSession, graph, search, n, max(least, PLACES // max(n, 1)))


def added_up(spark: SparkSession, shared, search, n: int, step: int) -> np.ndarray:
    """Sums of search(shared, numbers), an array of a size that is bounded, over 0..n-1, dealt to tasks; step numbers at a time."""
    ready = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo in range(0, len(ids), step):
                got = search(ready.value, ids[lo : lo + step])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    tasks = max(1, min(n, spark.sparkContext.defaultParallelism))
    # all tasks run before the first sum is read: an iterator alone would run one after the other
    parts = cut(spark.range(0, n, 1, tasks).mapInArrow(run, "sums binary")).toLocalIterator()
    return sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(0) if not n else 0.0)


def _table(edges: DataFrame, graph: Adjacency, **columns) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    spark = edges.sparkSession
    made = pa.table({"v": pa.array(graph.names), **{c: pa.array(x) for c, x in columns.items()}})
    return spark.createDataFrame(made).withColumn("v", F.col("v").cast(kind))


def projection(entries: DataFrame) -> DataFrame:
    """Bipartite digraph of named materials and processes: inputs to the process, the process to its outputs; parallel edges once."""
    node = F.coalesce(F.nullif(F.col("code"), F.lit("")), F.col("name"))
    process = F.concat(F.lit("process "), F.col("process").cast("string"))
    src, dst = F.when(F.col("side") == "in", node).otherwise(process), F.when(F.col("side") == "in", process).otherwise(node)
    return entries.filter(node.isNotNull()).select(src.alias("src"), dst.alias("dst")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops."""
    plain = edges.filter("src <> dst").select("src", "dst")
    return plain.union(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """v, in_degree, out_degree, degree, flow (in times out)."""
    out = edges.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return out.groupBy("v").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).select("v", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), (F.col("in_degree") * F.col("out_degree")).alias("flow"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row per side: mean, min, max of the degrees."""
    d = degrees(edges)
    flat = d.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_degree").alias("k")) for s in ("in", "out")])).alias("x"))
    return flat.groupBy("x.side").agg(F.avg("x.k").alias("mean"), F.min("x.k").alias("min"), F.max("x.k").alias("max"))


def density_reciprocity(edges: DataFrame) -> DataFrame:
    """One row: n, m, m / (n (n - 1)) and the share of edges whose reverse is there."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("b", F.lit(1))
    counts = e.join(back, ["src", "dst"], "left").agg(F.count("*").alias("m"), F.count("b").alias("mutual"))
    n = vertices(e).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(counts)).select("n", "m", F.coalesce(F.col("m") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)), F.lit(0.0)).alias("density"), F.coalesce(F.col("mutual") / F.nullif(F.col("m"), F.lit(0)), F.lit(0.0)).alias("reciprocity"))


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path from src to dst, semi-naive; loops of cycles included."""
    step = cut(edges.select("src", "dst").distinct())
    known, fresh = step, cut(step.select(F.col("src").alias("src"), F.col("dst").alias("dst")))
    while not fresh.isEmpty():
        longer = fresh.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        fresh = cut(longer.join(known, ["src", "dst"], "left_anti"))
        known = cut(known.union(fresh))
    return known


def _words(graph: Adjacency) -> list[np.ndarray]:
    """The vertices, 64 at most at a time, of which each stands for as many twins."""
    size = np.ones(len(graph.names), np.int64) if graph.size is None else graph.size
    order = np.argsort(size, kind="stable")
    same = np.split(order, np.flatnonzero(np.diff(size[order])) + 1)
    return [x[lo : lo + 64] for x in same for lo in range(0, len(x), 64)]


def _reached(into: Adjacency, sources: np.ndarray) -> Iterator[np.ndarray]:
    """For each hop how many of a word's sources and their twins reach a vertex then.

    into: each vertex's edges lead to where it is reached from. A word's 64 bits stand for as many sources, so a level is one
    pass over the edges of what isn't reached from all. A source reaches its twins where it would come back to itself.
    """
    n, k = len(into.names), len(sources)
    many = 1 if into.size is None else int(into.size[sources[0]])
    bit = np.uint64(1) << np.arange(k).astype(np.uint64)
    front = np.zeros(n, np.uint64)
    front[sources] = bit
    seen = front.copy() if many == 1 else np.zeros(n, np.uint64)
    full = np.bitwise_or.reduce(bit)
    length = np.diff(into.start)
    while True:
        left = np.flatnonzero((seen != full) & (length > 0))
        if len(left) * 4 < n:  # the edges of few
            begin = np.cumsum(length[left]) - length[left]
            to = into.to[np.arange(int(length[left].sum())) + np.repeat(into.start[left] - begin, length[left])]
        else:
            left = np.flatnonzero(length)
            begin, to = into.start[left], into.to
        new = np.zeros(n, np.uint64)
        if len(left):
            new[left] = np.bitwise_or.reduceat(front[to], begin) & ~seen[left]
        if not new.any():
            return
        seen |= new
        counts = many * np.bitwise_count(new).astype(np.float64)
        if many > 1:
            counts[sources] -= (new[sources] & bit) != 0  # not to itself
        yield counts
        front = new


def _counted(shared: tuple[Adjacency, list[np.ndarray]], words: np.ndarray) -> np.ndarray:
    """How many vertices reach each one, of the sources of these words."""
    into, sources = shared
    out = np.zeros(len(into.names))
    for w in words.tolist():
        for counts in _reached(into, sources[w]):
            out += counts
    return out


def _by_hops(shared: tuple[Adjacency, list[np.ndarray]], words: np.ndarray) -> np.ndarray:
    """How many pairs are so many hops apart, by hops from 0."""
    into, sources = shared
    out = np.zeros(len(into.names) + 2)
    for w in words.tolist():
        for hops, counts in enumerate(_reached(into, sources[w]), 1):
            out[hops] += counts @ into.size
    return out


def reach_counts(edges: DataFrame) -> DataFrame:
    """v, descendants, ancestors; a vertex isn't its own. Vertices that reach each other reach the same: searches go between
    strong components, from each once."""
    comp = cut(strong_components(edges))
    size = cut(comp.groupBy("component").agg(F.count("*").alias("size")))
    of = lambda end: comp.select(F.col("v").alias(end), F.col("component").alias(f"{end}_c"))
    met = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst")
    between = cut(met.filter("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct())
    same, small = _folded(between, size.select(F.col("component").alias("v"), "size"))
    if small is not None:
        words = _words(small)
        up, down = (added_up(edges.sparkSession, (g, words), _counted, len(words), 64).astype(np.int64) for g in (small.reversed(), small))
        reps = _table(edges, small, more=down, less=up).withColumnRenamed("v", "rep")
        got = same.select(F.col("v").alias("component"), "rep").join(reps, "rep").select("component", "more", "less")
    else:
        pairs = cut(closure(between))
        side = lambda at, to, name: pairs.join(size.withColumnRenamed("component", to), to).groupBy(F.col(at).alias("component")).agg(F.sum("size").alias(name))
        got = side("src", "dst", "more").join(side("dst", "src", "less"), "component", "full")
    own = size.join(got, "component", "left")
    return comp.join(own, "component").select("v", *[(F.col("size") - 1 + F.coalesce(c, F.lit(0))).alias(name) for c, name in (("more", "descendants"), ("less", "ancestors"))])


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """v, component: the smallest vertex connected with it. nodes: v, all vertices, those without edges included."""
    links = cut(edges.filter("src <> dst").select("src", "dst"))
    every = nodes if nodes is not None else vertices(edges)
    return _named(every, _connected(links)).select("v", F.col("c").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """v, component: the smallest vertex that it reaches and that reaches it. Tables never outgrow the edges."""
    kept, left = _contracted(edges)
    return _named(kept, _mutual(left)).select("v", F.col("c").alias("component"))


def both_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """weak_components() and strong_components(), for which the graph is contracted once."""
    kept, left = _contracted(edges)
    return tuple(_named(kept, found).select("v", F.col("c").alias("component")) for found in (_connected(left), _mutual(left)))


def _named(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """v, c: each vertex with the group of its c, if kept has one, else its own; what is in no group stays."""
    at = kept if "c" in kept.columns else kept.select("v", F.col("v").alias("c"))
    return at.join(groups.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))


def _connected(links: DataFrame) -> DataFrame:
    """v, c: the smallest vertex connected with it, for all ends of links."""
    return _grouped(links.coalesce(1), _weak) if links.count() <= GROUPED_EDGES else _merged(_grouped(_dealt(links), _weak))


def _mutual(links: DataFrame) -> DataFrame:
    """v, c: the smallest vertex of its strong component, for all ends of links in components of several."""
    return _grouped(links.coalesce(1), _strong) if links.count() <= GROUPED_EDGES else _coloured(links)


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, c: the smallest vertex of those that were put together with it; the distinct edges left between these).

    Tasks put together what is strongly connected by the edges that they have; what tasks have in common is put together too.
    So it goes on while that halves the edges and a task can't have all of them.
    """
    left = cut(edges.filter("src <> dst").select("src", "dst"))
    kept = vertices(edges).select("v", F.col("v").alias("c"))
    n = left.count()
    while n > GROUPED_EDGES:
        groups = cut(_merged(_grouped(_dealt(left), _strong)))
        side = lambda end: groups.select(F.col("v").alias(end), F.col("c").alias(f"{end}_c"))
        near = left.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select(F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst"))
        left = cut(near.filter("src <> dst").distinct())
        kept = _named(kept, groups)
        n, before = left.count(), n
        if 2 * n > before:
            break
    return cut(kept), left


def _dealt(links: DataFrame) -> DataFrame:
    """The edges of a vertex in one partition, but for those of hubs, which go with their other end. Hubs are 200,000 at most,
    whatever the graph, and are broadcast."""
    much = max(HUB, links.count() // 100_000)
    ends = links.select(F.col("src").alias("v")).union(links.select(F.col("dst").alias("v")))
    hubs = cut(ends.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > much).select("v"))
    side = lambda end: hubs.select(F.col("v").alias(end), F.lit(True).alias(f"{end}_hub"))
    known = links.join(F.broadcast(side("src")), "src", "left").join(F.broadcast(side("dst")), "dst", "left")
    a, b = F.xxhash64("src"), F.xxhash64("dst")
    home = F.when(F.col("src_hub").isNull(), a).when(F.col("dst_hub").isNull(), b).otherwise(F.xxhash64("src", "dst"))
    return known.select("src", "dst", home.alias("home")).repartition("home").select("src", "dst")


def _grouped(links: DataFrame, group) -> DataFrame:
    """v, c: vertices that are connected by GROUPED_EDGES edges of a task, and the smallest of them: group(a, b, n) gives the
    smallest for each of n vertices from the ends of the edges. Groups of one aren't named."""
    most = GROUPED_EDGES
    kind = links.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while sum(map(len, held)) + len(b) >= most:
                room = most - sum(map(len, held))
                yield of([*held, b[:room]])
                held, b = [], b[room:]
            held.append(b)
        if sum(map(len, held)):
            yield of(held)

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = pa.Table.from_batches(held)
        src, dst = got["src"].combine_chunks(), got["dst"].combine_chunks()
        names = pa.concat_arrays([src, dst]).unique()
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
        least = group(a, b, len(names))
        some = np.flatnonzero(np.bincount(least, minlength=len(names))[least] > 1)
        return pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(least[some]))], ["v", "c"])

    return links.mapInArrow(run, f"v {kind}, c {kind}")


def _weak(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex connected with each, by hooking and shortcutting."""
    c = np.arange(n)
    while True:
        x, y = c[a], c[b]
        if np.array_equal(x, y):
            return c
        np.minimum.at(c, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(c, up := c[c]):
            c = up


def _strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each one's strong component, by one search in depth."""
    begin = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist()
    to, at, end = b[np.argsort(a, kind="stable")].tolist(), begin[:-1], begin[1:]
    number, low, of, stack, count = [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        path = [root]
        stack.append(root)
        while path:
            v = path[-1]
            i = at[v]
            if i < end[v]:
                at[v] = i + 1
                w = to[i]
                if not number[w]:
                    count += 1
                    number[w] = low[w] = count
                    path.append(w)
                    stack.append(w)
                elif of[w] < 0 and number[w] < low[v]:
                    low[v] = number[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                w = -1
                while w != v:
                    w = stack.pop()
                    of[w] = v
    found, least = np.array(of, np.int64), np.full(n, n)
    np.minimum.at(least, found, np.arange(n))
    return least[found]


def _merged(groups: DataFrame) -> DataFrame:
    """v, c of groups that tasks found: groups with a vertex in common are one. A vertex is in as many groups as tasks had it."""
    met = cut(groups.groupBy("v").agg(F.min("c").alias("c"), F.collect_set("c").alias("all")))
    links = cut(met.filter("size(all) > 1").select(F.explode("all").alias("src"), F.col("c").alias("dst")).filter("src <> dst").distinct())
    roots = _grouped(links.coalesce(1), _weak) if links.count() <= GROUPED_EDGES else _hooked(links)
    return _named(met.select("v", "c"), roots)


def _hooked(links: DataFrame) -> DataFrame:
    """v, c: the smallest vertex connected with it, by hooking and shortcutting, a round at a time."""
    both = cut(undirected(links))
    labels = cut(vertices(links).select("v", F.col("v").alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("c").alias("near"))
        step = labels.join(near, "v", "left").select("v", "c", F.least("c", F.coalesce("near", "c")).alias("n"))
        root = labels.select(F.col("v").alias("n"), F.col("c").alias("r"))
        new = cut(step.join(root, "n").select("v", F.least("n", "r").alias("new"), "c"))
        done = new.filter("new <> c").isEmpty()
        labels = new.select("v", F.col("new").alias("c"))
        if done:
            return labels


def _coloured(links: DataFrame) -> DataFrame:
    """v, c: the smallest vertex of its strong component, for vertices of components of several.

    Vertices without an edge in or out are components of their own and go, round by round. Each other vertex takes the
    smallest vertex that reaches it; what reaches that one in turn, among those of its colour, is its component and goes
    too. Rounds hang on path lengths and on how components follow each other.
    """
    left, found = links, None
    while not left.isEmpty():
        inner = left.select("src").intersect(left.select("dst")).select(F.col("src").alias("v"))
        kept = cut(left.join(inner.withColumnRenamed("v", "src"), "src", "left_semi").join(inner.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
        if kept.count() < left.count():
            left = kept
            continue
        colour = cut(vertices(left).withColumn("c", F.col("v")))
        while True:
            near = left.join(colour.select(F.col("v").alias("src"), "c"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("near"))
            new = cut(colour.join(near, "v", "left").select("v", F.least("c", F.coalesce("near", "c")).alias("c"), F.col("c").alias("old")))
            done = new.filter("c <> old").isEmpty()
            colour = new.select("v", "c")
            if done:
                break
        same = left.join(colour.select(F.col("v").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b")
        back = cut(same.select("src", "dst", "a"))
        inside = cut(colour.filter("v = c"))
        fresh = inside
        while not fresh.isEmpty():
            more = back.join(fresh.select(F.col("v").alias("dst"), F.col("c").alias("a")), ["dst", "a"]).select(F.col("src").alias("v"), F.col("a").alias("c")).distinct()
            fresh = cut(more.join(inside, "v", "left_anti"))
            inside = cut(inside.union(fresh))
        found = inside if found is None else found.union(inside)
        gone = inside.select("v")
        left = cut(left.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))
    return found if found is not None else links.limit(0).select(F.col("src").alias("v"), F.col("dst").alias("c"))


def component_stats(components: DataFrame) -> DataFrame:
    """One row: components, smallest and largest size, how many of each, and their vertices' shares."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    ends = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum("size").alias("n"))
    x = sizes.crossJoin(F.broadcast(ends))  # one row
    one = x.groupBy("lo", "hi", "n").agg(F.count("*").alias("components"), F.count_if(F.col("size") == F.col("lo")).alias("n_smallest"), F.count_if(F.col("size") == F.col("hi")).alias("n_largest"))
    return one.select("components", F.col("lo").alias("smallest"), F.col("hi").alias("largest"), "n_smallest", "n_largest", (F.col("lo") * F.col("n_smallest") / F.col("n")).alias("share_smallest"), (F.col("hi") * F.col("n_largest") / F.col("n")).alias("share_largest"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges within the largest weak component, ties to the one with the smallest vertex."""
    labels = cut(weak_components(edges))
    top = labels.groupBy("component").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "component").limit(1).select("component")
    return edges.join(labels.join(F.broadcast(top), "component").select(F.col("v").alias("src")), "src", "left_semi")  # top: one row


def distances(edges: DataFrame) -> DataFrame:
    """src, dst, hops of the shortest paths along edges, a level a round; src <> dst."""
    step = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    known, level, d = cut(step.withColumn("hops", F.lit(1))), step, 1
    while not level.isEmpty():
        d += 1
        longer = level.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).filter("src <> dst").distinct()
        level = cut(longer.join(known, ["src", "dst"], "left_anti"))
        known = cut(known.union(level.withColumn("hops", F.lit(d))))
    return known


def path_stats(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One row: mean shortest path and diameter of the largest component, by default without directions."""
    inside = largest_component(edges)
    inside = cut(inside if directed else undirected(inside))
    _, small = _folded(inside)
    if small is None:
        return distances(inside).agg(F.coalesce(F.avg("hops"), F.lit(0.0)).alias("mean_path"), F.coalesce(F.max("hops"), F.lit(0)).alias("diameter"))
    words = _words(small)
    pairs = added_up(edges.sparkSession, (small.reversed(), words), _by_hops, len(words), 64)
    total, longest = float(np.sum(pairs)), int(max(np.flatnonzero(pairs), default=0))
    mean = float(pairs @ np.arange(len(pairs))) / total if total else 0.0
    return edges.sparkSession.createDataFrame([(mean, longest)], "mean_path double, diameter int")


def average_clustering(edges: DataFrame) -> DataFrame:
    """One row: the mean coefficient over the vertices of the largest component, without directions; vertices below degree 2 count as 0."""
    return clustering(largest_component(edges)).agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("average"))


def is_connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: whether all vertices are in one weak component; a graph without any isn't connected."""
    return weak_components(edges, nodes).agg((F.count_distinct("component") == 1).alias("connected"))


def clustering(edges: DataFrame) -> DataFrame:
    """v, degree, triangles, coefficient without directions; below degree 2 it is 0."""
    e = cut(undirected(edges))
    deg = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    # each edge points to its end of higher degree, so a hub doesn't pair its neighbours
    d = e.join(deg.select(F.col("v").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("v").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = cut(d.filter("ds < dd OR (ds = dd AND src < dst)").select("src", "dst"))
    wedge = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").filter("a <> b")
    closed = wedge.join(up.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi")
    each = closed.select(F.explode(F.array("src", "a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("triangles"))
    k = F.col("degree")
    return deg.join(each, "v", "left").select("v", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(k > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / F.nullif(k * (k - 1), F.lit(0))).otherwise(0.0).alias("coefficient"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """v, core by peeling: what has fewer than k + 1 neighbours left is of core k. Cores aren't defined for graphs with loops:
    these have no rows."""
    if not edges.filter("src = dst").isEmpty():
        return vertices(edges).limit(0).withColumn("core", F.lit(0))
    small = Adjacency.of(undirected(edges))
    if small is not None:
        return _table(edges, small, core=_cores(small))
    left, k, out = cut(undirected(edges)), 0, None
    while not left.isEmpty():
        deg = left.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
        low = cut(deg.filter(F.col("d") <= k).select("v"))
        if low.isEmpty():
            k = int(deg.agg(F.min("d")).first()[0])
            continue
        found = low.withColumn("core", F.lit(k))
        out = found if out is None else out.union(found)
        rest = left.join(low.select(F.col("v").alias("src")), "src", "left_anti").join(low.select(F.col("v").alias("dst")), "dst", "left_anti")
        # neighbours that lose their last edge go with this core
        gone = left.select(F.col("src").alias("v")).distinct().join(rest.select(F.col("src").alias("v")).distinct(), "v", "left_anti").join(low, "v", "left_anti")
        out = cut(out.union(gone.withColumn("core", F.lit(k))))
        left = cut(rest)
    if out is None:
        return vertices(edges).withColumn("core", F.lit(0))
    return out


def _cores(graph: Adjacency) -> np.ndarray:
    """Cores by peeling in rounds: what has at most k neighbours left goes with core k, until none has; then k grows."""
    n, ends = len(graph.names), graph.ends
    core, there, k = np.zeros(n, np.int32), np.ones(n, bool), 0
    degree = np.diff(graph.start)
    while there.any():
        low = there & (degree <= k)
        if not low.any():
            k = int(degree[there].min())
            continue
        core[low] = k
        there &= ~low
        lost = low[graph.to] & there[ends]
        degree = degree - np.bincount(ends[lost], minlength=n)
    return core


def core_shares(cores: DataFrame) -> DataFrame:
    """core, n, share of the vertices, and the smallest and largest core, from core_numbers(); a row for each core."""
    sizes = cores.groupBy("core").agg(F.count("*").alias("n"))
    ends = sizes.agg(F.min("core").alias("min_core"), F.max("core").alias("max_core"), F.sum("n").alias("all"))
    return sizes.crossJoin(F.broadcast(ends)).select("core", "n", (F.col("n") / F.col("all")).alias("share"), "min_core", "max_core")  # ends: one row


def largest_strong_component(edges: DataFrame) -> DataFrame:
    """Edges within the largest strong component, ties to the one with the smallest vertex."""
    labels = cut(strong_components(edges))
    top = labels.groupBy("component").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "component").limit(1).select("component")
    own = labels.join(F.broadcast(top), "component").select("v")  # top: one row
    return edges.join(own.withColumnRenamed("v", "src"), "src", "left_semi").join(own.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")


class NotConverged(ArithmeticError):
    """A power iteration whose rounds are spent."""


def or_largest_strong(edges: DataFrame, measure, **options) -> DataFrame:
    """measure of the graph; where it doesn't converge, of its largest strong component."""
    try:
        return measure(edges, **options)
    except NotConverged:
        return measure(largest_strong_component(edges), **options)


def _settled(x: np.ndarray, step, max_iter: int, tol: float) -> np.ndarray:
    """x after steps until one changes it by less than tol in all."""
    if not len(x):
        return x
    for _ in range(max_iter):
        new = step(x)
        change, x = np.abs(new - x).sum(), new
        if change < tol:
            return x
    raise NotConverged(f"no convergence in {max_iter} rounds")


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """v, rank: power iteration; vertices without out-edges give to all; stops at an L1 change under n * tol.

    A round is one checkpoint and one row of totals for the driver: the change, and what the dangling vertices hold.
    Raises NotConverged where max_iter rounds don't suffice.
    """
    small = Adjacency.of(edges, loops=True)
    if small is not None:
        n, ends = len(small.names), small.ends
        out = np.diff(small.start)
        rank = np.full(n, 1.0 / max(n, 1))

        def step(x: np.ndarray) -> np.ndarray:
            return (1 - alpha) / n + alpha * x[out == 0].sum() / n + alpha * np.bincount(small.to, x[ends] / out[ends], n)

        return _table(edges, small, rank=_settled(rank, step, max_iter, n * tol))
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    links = cut(e.join(out, "src"))
    nodes = vertices(edges).join(out.withColumnRenamed("src", "v"), "v", "left").select("v", F.col("k").isNull().alias("dangling"))
    rank = cut(nodes.withColumn("r", F.lit(1.0)))
    n, lost = rank.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("dangling"), 1.0)), F.lit(0.0))).first()
    if not n:
        return rank.select("v", F.col("r").alias("rank"))
    rank, lost = rank.withColumn("r", F.lit(1.0 / n)), lost / n
    for _ in range(max_iter):
        given = links.join(rank.select(F.col("v").alias("src"), "r"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("r") / F.col("k")).alias("g"))
        new = cut(rank.join(given, "v", "left").select("v", "dangling", F.col("r").alias("old"), (F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.coalesce("g", F.lit(0.0))).alias("r")))
        change, lost = new.agg(F.sum(F.abs(F.col("r") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0))).first()
        rank = new.select("v", "dangling", "r")
        if change < n * tol:
            return rank.select("v", F.col("r").alias("rank"))
    raise NotConverged(f"no convergence in {max_iter} rounds")


def hits(edges: DataFrame, max_iter: int = 1000, tol: float = 1e-8) -> DataFrame:
    """v, hub, authority, each adding up to 1: hubs by rounds of power iteration until their L1 change is under tol, with
    one checkpoint and one row of totals a round. Raises NotConverged where max_iter rounds don't suffice."""
    small = Adjacency.of(edges, loops=True)
    if small is not None:
        n, ends = len(small.names), small.ends

        def authorities(hub: np.ndarray) -> np.ndarray:
            return np.bincount(small.to, hub[ends], n)

        def step(hub: np.ndarray) -> np.ndarray:
            new = np.bincount(ends, authorities(hub)[small.to], n)
            return new / (new.sum() or 1)

        hub = _settled(np.full(n, 1.0 / max(n, 1)), step, max_iter, tol)
        authority = authorities(hub)
        return _table(edges, small, hub=hub, authority=authority / (authority.sum() or 1))
    e = cut(edges.select("src", "dst").distinct())
    state = cut(vertices(e).withColumn("hub", F.lit(1.0)))
    n = state.count()
    if not n:
        return state.withColumn("authority", F.col("hub"))
    state, total = state.withColumn("hub", F.lit(1.0 / n)), 1.0

    def gathered(column: str, of: str, to: str, by: DataFrame) -> DataFrame:
        return e.join(by.select(F.col("v").alias(of), column), of).groupBy(F.col(to).alias("v")).agg(F.sum(column).alias("g"))

    for _ in range(max_iter):
        authority = gathered("hub", "src", "dst", state).withColumnRenamed("g", "authority")
        raw = gathered("authority", "dst", "src", authority)
        both = cut(state.select("v", F.col("hub").alias("old")).join(raw, "v", "left").join(authority, "v", "left").select("v", "old", F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("authority", F.lit(0.0)).alias("authority")))
        total, held = both.agg(F.sum("g"), F.sum("authority")).first()
        if not total:
            return both.select("v", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
        state = both.select("v", (F.col("g") / total).alias("hub"), (F.col("authority") / held).alias("authority"), "old")
        if state.agg(F.sum(F.abs(F.col("hub") - F.col("old")))).first()[0] < tol:
            return state.select("v", "hub", "authority")
    raise NotConverged(f"no convergence in {max_iter} rounds")


def eigenvector(edges: DataFrame, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """v, value: left eigenvector centrality by power iteration on A + I, of length 1; stops at an L1 change under n * tol.
    One checkpoint a round. Raises NotConverged where max_iter rounds don't suffice."""
    small = Adjacency.of(edges, loops=True)
    if small is not None:
        n, ends = len(small.names), small.ends

        def step(x: np.ndarray) -> np.ndarray:
            x = x + np.bincount(small.to, x[ends], n)
            return x / (np.sqrt((x * x).sum()) or 1)

        return _table(edges, small, value=_settled(np.full(n, 1.0 / max(n, 1) ** 0.5), step, max_iter, n * tol))
    e = cut(edges.select("src", "dst").distinct())
    state = cut(vertices(e).withColumn("x", F.lit(1.0)))
    n = state.count()
    if not n:
        return state.select("v", F.col("x").alias("value"))
    state = state.withColumn("x", F.lit(1.0 / n**0.5))
    for _ in range(max_iter):
        given = e.join(state.select(F.col("v").alias("src"), "x"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum("x").alias("g"))
        new = cut(state.join(given, "v", "left").select("v", F.col("x").alias("old"), (F.col("x") + F.coalesce("g", F.lit(0.0))).alias("x")))
        norm = float(new.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0])
        state = new.select("v", "old", (F.col("x") / norm).alias("x"))
        if state.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tol:
            return state.select("v", F.col("x").alias("value"))
        state = state.select("v", "x")
    raise NotConverged(f"no convergence in {max_iter} rounds")


def shortest_path_trees(edges: DataFrame) -> DataFrame:
    """src, v, hops, paths: the number of shortest paths from every source, level by level."""
    step = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    level = cut(vertices(edges).select(F.col("v").alias("src"), "v", F.lit(0).alias("hops"), F.lit(1.0).alias("paths")))
    known = level
    while True:
        d = F.col("hops") + 1
        reached = level.join(step.select(F.col("src").alias("v"), F.col("dst").alias("next")), "v").groupBy("src", F.col("next").alias("v"), d.alias("hops")).agg(F.sum("paths").alias("paths"))
        level = cut(reached.join(known, ["src", "v"], "left_anti").select("src", "v", "hops", "paths"))
        if level.isEmpty():
            return known
        known = cut(known.union(level))


def betweenness(edges: DataFrame, normalized: bool = False) -> tuple[DataFrame, DataFrame]:
    """(v, value) and (src, dst, value): shortest paths through vertices and edges of a digraph, by Brandes' accumulation."""
    whole = Adjacency.of(cut(edges.select("src", "dst").distinct()), times=SEARCHED)
    # a core of an eighth of the vertices at most: else twins among it are worth more
    cover = whole and covers.covered(whole.ends, whole.to, len(whole.names), min(covers.CORE, len(whole.names) // 8))
    if cover:
        return _betweenness_by(edges, whole, *cover, normalized)
    same, small = _folded(edges)
    if small is not None:
        return _betweenness_of(edges, same, small, normalized)
    step = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    tree = cut(shortest_path_trees(edges))
    # links of the trees: from v to a w one level further
    links = tree.select("src", "v", "hops", F.col("paths").alias("pv")).join(step.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v")
    links = cut(links.join(tree.select("src", F.col("v").alias("w"), (F.col("hops") - 1).alias("hops"), F.col("paths").alias("pw")), ["src", "w", "hops"]))
    depth = tree.agg(F.max("hops")).first()[0] or 0
    delta, flows = None, None
    for d in range(depth - 1, -1, -1):
        at = links.filter(F.col("hops") == d)
        if delta is not None:
            at = at.join(delta.select("src", F.col("v").alias("w"), "delta"), ["src", "w"], "left")
        else:
            at = at.withColumn("delta", F.lit(0.0))
        at = cut(at.select("src", "v", "w", (F.col("pv") / F.col("pw") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("c")))
        now = at.groupBy("src", "v").agg(F.sum("c").alias("delta"))
        delta = cut(now if delta is None else delta.union(now))
        flows = at if flows is None else flows.union(at)
    n = vertices(edges).count()
    node_scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    edge_scale = 1.0 / (n * (n - 1)) if normalized and n > 1 else 1.0
    none = edges.sparkSession.createDataFrame([], "src string, v string, delta double") if delta is None else delta
    node = none.filter(F.col("src") != F.col("v")).groupBy("v").agg(F.sum("delta").alias("d"))
    of_nodes = vertices(edges).join(node, "v", "left").select("v", (F.coalesce("d", F.lit(0.0)) * node_scale).alias("value"))
    each = step.withColumn("d", F.lit(0.0)) if flows is None else step.join(flows.groupBy(F.col("v").alias("src"), F.col("w").alias("dst")).agg(F.sum("c").alias("d")), ["src", "dst"], "left")
    return of_nodes, each.select("src", "dst", (F.coalesce("d", F.lit(0.0)) * edge_scale).alias("value"))


def _dependencies(graph: Adjacency, sources: np.ndarray) -> np.ndarray:
    """Dependencies of several sources and their twins on each vertex, then on each edge, added up; of twins each has as much."""
    n, m = len(graph.names), len(graph.to)
    row = np.arange(len(sources)) * (n + 1)
    own = row + n
    size = np.append(graph.size, 1)
    many = graph.size[sources]
    weight = np.tile(size, len(sources))  # how many vertices a place stands for
    weight[row + sources] = many - 1
    times = np.repeat(many, n + 1).astype(np.float64)  # how many sources' searches pass a vertex of a place
    times[row + sources] = many - 1
    paths = np.zeros(len(times))
    paths[own] = 1
    steps = []
    for _, origin, target, edge in graph.levels(sources):
        paths += np.bincount(target, weight[origin] * paths[origin], len(paths)) if len(target) else 0
        steps.append((origin, target, edge))
    delta, flow = np.zeros(len(paths)), np.zeros(m)
    for origin, target, edge in reversed(steps):
        share = paths[origin] / paths[target] * (1 + delta[target])
        delta += np.bincount(origin, share * weight[target], len(paths)) if len(origin) else 0
        # from the source itself an edge is passed once, from or to its twins by the searches of the others
        passed = np.where(origin % (n + 1) == n, 1, np.minimum(times[origin], times[target]))
        flow += np.bincount(edge, share * passed, m) if len(edge) else 0
    delta[own] = 0
    return np.concatenate([(delta * times).reshape(len(sources), n + 1)[:, :n].sum(0), flow])


def _betweenness_by(edges: DataFrame, graph: Adjacency, cover: covers.Cover, core: np.ndarray, rest: np.ndarray, kind: np.ndarray, normalized: bool) -> tuple[DataFrame, DataFrame]:
    n = len(graph.names)
    got = added_up(edges.sparkSession, cover, covers.sums, cover.searches, 32 * covers.SOURCES)
    value, flow = covers.assembled(cover, core, rest, kind, got if cover.searches else np.zeros(0), graph.ends, graph.to, n)
    node_scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    edge_scale = 1.0 / (n * (n - 1)) if normalized and n > 1 else 1.0
    to = _table(edges, graph, value=value * node_scale)
    names, which = pa.array(graph.names), edges.schema["src"].dataType.simpleString()
    flows = pa.table({"src": names.take(pa.array(graph.ends)), "dst": names.take(pa.array(graph.to)), "value": pa.array(flow * edge_scale)})
    return to, edges.sparkSession.createDataFrame(flows).select(F.col("src").cast(which).alias("src"), F.col("dst").cast(which).alias("dst"), "value")


def _betweenness_of(edges: DataFrame, same: DataFrame, graph: Adjacency, normalized: bool) -> tuple[DataFrame, DataFrame]:
    n, folded = same.count(), len(graph.names)
    got = searched(edges, graph, _dependencies)
    node_scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    edge_scale = 1.0 / (n * (n - 1)) if normalized and n > 1 else 1.0
    kind = edges.schema["src"].dataType.simpleString()
    names = pa.array(graph.names)
    flows = pa.table({"a": names.take(pa.array(graph.ends)), "b": names.take(pa.array(graph.to)), "value": pa.array(got[folded:] * edge_scale)})
    each = edges.sparkSession.createDataFrame(flows).select(F.col("a").cast(kind), F.col("b").cast(kind), "value")
    plain = edges.filter("src <> dst").select("src", "dst").distinct()
    plain = plain.join(same.select(F.col("v").alias("src"), F.col("rep").alias("a")), "src").join(same.select(F.col("v").alias("dst"), F.col("rep").alias("b")), "dst")
    nodes = same.select("v", "rep").join(_table(edges, graph, value=got[:folded] * node_scale).withColumnRenamed("v", "rep"), "rep", "left")
    return nodes.select("v", F.coalesce("value", F.lit(0.0)).alias("value")), plain.join(each, ["a", "b"]).select("src", "dst", "value")


def random_graph(spark, n: int, p: float, seed: int = 0) -> DataFrame:
    """Erdős–Rényi digraph on 0..n-1 without loops: each pair is an edge with probability p, from a seeded hash of the pair."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst")).filter("src <> dst")
    unit = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return pairs.filter(unit < p)


def small_world(spark, n: int, k: int, p: float, seed: int = 0) -> DataFrame:
    """Watts–Strogatz: a ring with k / 2 neighbours on each side, the far end of an edge drawn anew with probability p; k is even."""
    if k % 2:
        raise ValueError("k must be even")
    ring = spark.range(n * (k // 2)).select((F.col("id") % n).alias("src"), (F.floor(F.col("id") / n) + 1).alias("step"))
    draw = lambda salt, m: F.pmod(F.xxhash64("src", "step", F.lit(seed), F.lit(salt)), F.lit(m))
    far = F.when(draw(1, 1 << 30) / float(1 << 30) < p, draw(2, n)).otherwise((F.col("src") + F.col("step")) % n)
    return ring.select("src", far.alias("dst")).filter("src <> dst").distinct()


def preferential(n: int, m: int, seed: int = 0) -> list[tuple[int, int]]:
    """Barabási–Albert edges: each new vertex joins m earlier ones in proportion to their degree; drawn one after the other."""
    import random

    generator, ends, out = random.Random(seed), list(range(m)), []
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(generator.choice(ends))
        out += [(v, u) for u in sorted(chosen)]
        ends += [*chosen, *[v] * m]
    return out


def small_world_added(spark, n: int, k: int, p: float, seed: int = 0) -> DataFrame:
    """Newman–Watts: the ring of small_world() stays whole; with probability p an edge's start gets a further edge."""
    ring = small_world(spark, n, k, 0.0, seed)
    draw = lambda salt, m: F.pmod(F.xxhash64("src", "dst", F.lit(seed), F.lit(salt)), F.lit(m))
    more = ring.filter(draw(1, 1 << 30) / float(1 << 30) < p).select("src", draw(2, n).alias("dst")).filter("src <> dst")
    return ring.union(more).distinct()


def regular(n: int, d: int, seed: int = 0) -> list[tuple[int, int]]:
    """Edges of a random graph in which every vertex has d neighbours: ends are paired at random, anew until no pair repeats; n * d is even."""
    import random

    if n * d % 2 or not 0 <= d < n:
        raise ValueError("n * d must be even and d below n")
    generator = random.Random(seed)
    while True:
        ends, edges = [v for v in range(n) for _ in range(d)], set()
        while ends:
            generator.shuffle(ends)
            rest = []
            for a, b in zip(ends[::2], ends[1::2], strict=True):
                if a != b and (min(a, b), max(a, b)) not in edges:
                    edges.add((min(a, b), max(a, b)))
                else:
                    rest += [a, b]
            if len(rest) == len(ends):
                break
            ends = rest
        if not ends:
            return sorted(edges)


def clustered(n: int, m: int, p: float, seed: int = 0) -> list[tuple[int, int]]:
    """Holme–Kim edges: as preferential(), but each further edge of a new vertex closes a triangle with probability p."""
    import random

    generator, ends, near = random.Random(seed), list(range(m)), {v: set() for v in range(n)}
    out = []
    for v in range(m, n):
        chosen: list[int] = []
        while len(chosen) < m:
            friends = sorted(near[chosen[-1]] - {v, *chosen}) if chosen and generator.random() < p else []
            u = generator.choice(friends) if friends else generator.choice(ends)
            if u not in chosen:
                chosen.append(u)
        for u in chosen:
            near[v].add(u)
            near[u].add(v)
            out.append((v, u))
        ends += [*chosen, *[v] * m]
    return out
