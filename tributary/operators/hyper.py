"""Directed hypergraphs of processes: build, audit, reach, criticality, disruption.

Tables: entries (process, side in|out, code or null, name), registry (code, name).

Fixpoints run over many scenarios. Of edges with the same sources and targets one is enough for them. A hypergraph that then
has BROADCAST_ENDS ends at most is broadcast, and scenarios are dealt to tasks, each of which runs its own to their ends as
rows of a matrix; what falls with each vertex is followed along the edges alone. For a larger one all scenarios run at once,
one DataFrame round after the other; each round is checkpointed, and only its row count reaches the driver. Both give the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import typed_code
from ..plans.lineage import cut


#: Ends (sources and targets) of a hypergraph that is broadcast at most (8 bytes each, and its vertices' names on the driver).
BROADCAST_ENDS = 2_000_000
#: Cells (scenarios times ends) that a task holds at a time.
CELLS = 1 << 22
#: Flags (scenarios times vertices and edges, 5 bytes each) that a task holds while it follows what falls.
FLAGS = 1 << 25


@dataclass
class Hypergraph:
    vertices: DataFrame  # v
    sources: DataFrame  # edge, v
    targets: DataFrame  # edge, v
    edges: DataFrame  # edge, n_src


class Incidence:
    """A small hypergraph as arrays: sources by edge, targets by vertex."""

    def __init__(self, sources: pa.Table, targets: pa.Table):
        number = lambda *columns: np.unique(np.concatenate([np.asarray(c.to_pylist(), object) for c in columns]).astype(object)) if any(len(c) for c in columns) else np.zeros(0, object)
        self.names = number(sources["v"], targets["v"])
        edges = number(sources["edge"], targets["edge"])
        at = {x: i for i, x in enumerate(self.names.tolist())}
        of = {x: i for i, x in enumerate(edges.tolist())}
        get = lambda t, c, d: np.array([d[x] for x in t[c].to_pylist()], np.int64)
        edge, v = get(sources, "edge", of), get(sources, "v", at)
        order = np.lexsort((v, edge))
        self.source, edge = v[order], edge[order]
        self.n_edges, self.at = len(edges), at
        #: Edges with sources, and where theirs begin.
        self.with_sources, self.begin = np.unique(edge, return_index=True)
        edge, v = get(targets, "edge", of), get(targets, "v", at)
        order = np.lexsort((edge, v))
        self.target_edge = edge[order]
        #: Vertices that some edge makes, and where theirs begin.
        self.made, self.made_begin = np.unique(v[order], return_index=True)

    @classmethod
    def of(cls, g: Hypergraph) -> Incidence | None:
        """The hypergraph's arrays, if it is small enough."""
        sources, targets = cut(g.sources.select("edge", "v")), cut(g.targets.select("edge", "v"))
        if sources.count() + targets.count() > BROADCAST_ENDS:
            return None
        return cls(sources.toArrow(), targets.toArrow())

    def mask(self, sets: list) -> np.ndarray:
        """A row of flags for each set of names; names that no edge has don't matter."""
        out = np.zeros((len(sets), len(self.names)), bool)
        for i, x in enumerate(sets):
            out[i, [self.at[v] for v in x or () if v in self.at]] = True
        return out

    def made_by(self, edges: np.ndarray, every: bool = False) -> np.ndarray:
        """For flags of edges those of the vertices that any of them (every one that makes it) makes."""
        out = np.zeros((len(edges), len(self.names)), bool)
        if len(self.made):
            out[:, self.made] = (np.logical_and if every else np.logical_or).reduceat(edges[:, self.target_edge], self.made_begin, 1)
        return out

    def reached(self, starts: np.ndarray, removed: np.ndarray) -> np.ndarray:
        first = starts & ~removed
        made = np.zeros_like(first)
        while True:
            fired = np.ones((len(first), self.n_edges), bool)
            if len(self.begin):
                fired[:, self.with_sources] = np.logical_and.reduceat((first | made)[:, self.source], self.begin, 1)
            new = self.made_by(fired) & ~removed
            if (new == made).all():
                return made
            made = new

    def fallen(self, seeds: np.ndarray) -> np.ndarray:
        failed = seeds
        while True:
            dead = np.zeros((len(failed), self.n_edges), bool)
            if len(self.begin):
                dead[:, self.with_sources] = np.logical_or.reduceat(failed[:, self.source], self.begin, 1)
            new = failed | self.made_by(dead, every=True)
            if (new == failed).all():
                return failed
            failed = new


class Falls:
    """What falls with each vertex of a small hypergraph: edges that fire only, with the supports of what they make."""

    def __init__(self, inc: Incidence, start: list, base: list):
        n, m = len(inc.names), inc.n_edges
        edge = np.repeat(inc.with_sources, np.diff(np.append(inc.begin, len(inc.source))))
        made_edge, v = inc.target_edge, np.repeat(inc.made, np.diff(np.append(inc.made_begin, len(inc.target_edge))))
        round_, top, fired = np.full(n, -1), np.zeros(m, np.int64), np.zeros(m, bool)
        first, i = inc.mask([start])[0], 0
        round_[first] = 0
        self.made = np.zeros(n, bool)  # whether some edge makes it, of the start too
        while True:
            i += 1
            lost = np.bincount(edge[round_[inc.source] < 0], minlength=m) > 0
            new = ~lost & ~fired
            top[new], fired = i - 1, ~lost
            out = np.unique(v[new[made_edge]])
            self.made[out] = True
            fresh = out[round_[out] < 0]
            round_[fresh] = i
            if not len(fresh):
                break
        alive = fired[edge]
        self.uses = _lists(inc.source[alive], edge[alive], n)  # a vertex's edges
        alive = fired[made_edge]
        made_edge, v = made_edge[alive], v[alive]
        held = ~first[v]  # the start is there without them
        self.makes = _lists(made_edge[held], v[held], m)
        self.n_makers = np.bincount(v[held], minlength=n)
        held &= top[made_edge] < round_[v]
        self.supports = _lists(made_edge[held], v[held], m)
        self.n_supports = np.bincount(v[held], minlength=n)
        self.own = np.zeros(m, bool)  # edges that make the base
        self.own[made_edge[inc.mask([base])[0][v]]] = True
        self.n, self.m = n, m
        self.tried = np.flatnonzero(np.diff(self.uses[0]) > 0)

    def lost(self, scenarios: np.ndarray, failed: np.ndarray, fallen_by: np.ndarray, dead: np.ndarray) -> np.ndarray:
        """How many made vertices fall with each of these, and one more if all edges that make the base do; the flags are
        cleared again. A vertex falls once all its supports have; then it is taken back if another edge still makes it."""
        n, m = self.n, self.m
        own = np.arange(len(scenarios)) * n + scenarios
        at, fallen, edges = own, [own], []
        failed[own] = True
        while len(at):
            e = _steps(at, n, m, self.uses)
            e = np.unique(e[~dead[e]])
            dead[e] = True
            edges.append(e)
            k, c = np.unique(_steps(e, m, n, self.supports), return_counts=True)
            fallen_by[k] += c.astype(np.int32)
            at = k[(fallen_by[k] == self.n_supports[k % n]) & ~failed[k]]
            failed[at] = True
            fallen.append(at)
        at, e = np.concatenate(fallen), np.concatenate(edges) if edges else np.zeros(0, np.int64)
        fallen_by[_steps(e, m, n, self.supports)] = 0
        failed[at], dead[e] = False, False
        while True:
            k, c = np.unique(_steps(e, m, n, self.makes), return_counts=True)
            fallen_by[k] = c
            back = (fallen_by[at] < self.n_makers[at % n]) & (at % n != scenarios[at // n])
            fallen_by[k] = 0
            if not back.any():
                break
            at = at[~back]
            e = np.unique(_steps(at, n, m, self.uses))
        out = np.bincount((at // n)[self.made[at % n]], minlength=len(scenarios))
        if self.own.any():
            out += np.bincount((e // m)[self.own[e % m]], minlength=len(scenarios)) == self.own.sum()
        return out


def _lists(of: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the x of each of 0..n-1 begin, and these in a row."""
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), x[np.argsort(of, kind="stable")]


def _steps(places: np.ndarray, n: int, m: int, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places (scenario * n + number) one step further, among m numbers."""
    begin, to = lists
    scenario, x = places // n, places % n
    length = begin[x + 1] - begin[x]
    ends = np.cumsum(length)
    return np.repeat(scenario * m, length) + to[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[x] - (ends - length), length)]


def _criticality_of(inc: Incidence, g: Hypergraph, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """criticality_and_reach() of a small hypergraph; vertices that something uses are dealt to tasks."""
    spark = g.vertices.sparkSession
    start = [r["v"] for r in precursors(g).union(base.select("v")).distinct().toLocalIterator()]
    falls = Falls(inc, start, [r["v"] for r in base.select("v").collect()])  # one
    # neighbours in the list fall with as much: they are dealt at random
    tried = np.random.default_rng(0).permutation(falls.tried)
    ready = spark.sparkContext.broadcast((falls, tried))
    names = spark.createDataFrame(pa.table({"code": pa.array(inc.names.tolist(), pa.string()), "at": pa.array(np.arange(falls.n)), "made": pa.array(falls.made)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        falls, tried = ready.value
        step = max(1, FLAGS // max(1, falls.n + falls.m))
        held = None
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            held = held or (np.zeros(step * falls.n, bool), np.zeros(step * falls.n, np.int32), np.zeros(step * falls.m, bool))
            parts = [tried[ids[lo : lo + step]] for lo in range(0, len(ids), step)]
            found = [falls.lost(x, *held) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (parts, found)], ["at", "n"])

    tasks = max(1, min(len(tried), 4 * spark.sparkContext.defaultParallelism))
    lost = spark.range(0, len(tried), 1, tasks).mapInArrow(run, "at long, n long")
    rated = g.vertices.join(base, "v", "left_anti").select(F.col("v").alias("code"))
    value = F.coalesce("n", F.col("made").cast("long"), F.lit(0))  # without a vertex that nothing uses only itself is missing
    return rated.join(names.join(lost, "at", "left"), "code", "left").select("code", value.cast("long").alias("criticality")), names.filter("made").select(F.col("code").alias("v"))


def patterns(g: Hypergraph) -> Hypergraph:
    """The hypergraph with one edge, the smallest, of those with the same sources and the same targets: the same vertices are
    reached, and fall. Sides are equal by their number of vertices and 128 bits of hash, combined before they are shuffled."""
    rows = g.edges.select("edge", F.lit(None).cast("string").alias("v"), F.lit(None).cast("int").alias("side"))
    rows = rows.union(g.sources.select("edge", "v", F.lit(0))).union(g.targets.select("edge", "v", F.lit(1)))
    of = lambda k, *salt: F.coalesce(F.bit_xor(F.when(F.col("side") == k, F.xxhash64(*salt, "v"))), F.lit(0))
    keys = [x for k in (0, 1) for x in (F.count_if(F.col("side") == k), of(k), of(k, F.lit("edge")))]
    names = [f"k{i}" for i in range(len(keys))]
    kept = cut(rows.groupBy("edge").agg(*[x.alias(c) for x, c in zip(keys, names, strict=True)]).groupBy(*names).agg(F.min("edge").alias("edge")).select("edge"))
    return Hypergraph(g.vertices, *[x.join(kept, "edge", "left_semi") for x in (g.sources, g.targets, g.edges)])


def _by_scenario(inc: Incidence, rows: DataFrame, run, alone: bool = False) -> DataFrame:
    """(scenario, v) of run(incidence, flags of each set column) for rows of scenario and sets of names.

    alone: names that no edge has stay in the result with the first set that holds them.
    """
    ready = rows.sparkSession.sparkContext.broadcast(inc)
    kind = rows.schema["scenario"].dataType.simpleString()
    step = max(1, CELLS // max(1, len(inc.source) + len(inc.target_edge)))

    def batches(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inc = ready.value
        for b in bs:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                sets = [part.column(i).to_pylist() for i in range(1, part.num_columns)]
                got = run(inc, *[inc.mask(x) for x in sets])
                who, v = np.nonzero(got)
                names = inc.names[v].tolist()
                who = who.tolist()
                if alone:
                    for i, x in enumerate(sets[0]):
                        more = [y for y in x or () if y not in inc.at]
                        names += more
                        who += [i] * len(more)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who, pa.int64())), pa.array(names, pa.string())], ["scenario", "v"])

    return rows.mapInArrow(batches, f"scenario {kind}, v string")


def _sets(rows: DataFrame, name: str) -> DataFrame:
    """scenario, and its vertices as one set: as many as the small hypergraph has at most."""
    return rows.groupBy("scenario").agg(F.collect_set("v").alias(name))


def build(entries: DataFrame, registry: DataFrame, include_unregistered: bool = False, drop_sourceless: bool = False) -> Hypergraph:
    """Sides are sets of vertices; processes without a target go, then on demand those without a source."""
    typed = entries.withColumn("v", typed_code(F.col("code")))
    vertices = registry.select(typed_code(F.col("code")).alias("v")).filter("v IS NOT NULL")
    if include_unregistered:
        vertices = vertices.union(typed.filter("v IS NOT NULL").select("v"))
    vertices = vertices.distinct()
    known = typed.filter("v IS NOT NULL").join(vertices, "v", "left_semi").select(F.col("process").alias("edge"), "side", "v").distinct()
    targets = known.filter("side = 'out'").select("edge", "v")
    kept = targets.select("edge").distinct()
    sources = known.filter("side = 'in'").select("edge", "v").join(kept, "edge", "left_semi")
    n = sources.groupBy("edge").agg(F.count("*").alias("n_src"))
    edges = kept.join(n, "edge", "left").select("edge", F.coalesce("n_src", F.lit(0)).alias("n_src"))
    if drop_sourceless:
        edges = edges.filter("n_src > 0")
        targets = targets.join(edges.select("edge"), "edge", "left_semi")
    return Hypergraph(vertices, sources, targets, edges)


def audit(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """One row of counts of the build: vertices, edges, entries by class, processes without target, and of those without source the reasons."""
    typed = entries.withColumn("v", typed_code(F.col("code")))
    vertices = registry.select(typed_code(F.col("code")).alias("v")).filter("v IS NOT NULL").distinct()
    marked = typed.join(vertices.withColumn("known", F.lit(True)), "v", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    per = marked.groupBy("process").agg(
        F.count_if(F.col("v").isNull()).alias("untyped"),
        F.count_if(F.col("v").isNotNull() & ~F.col("known")).alias("unregistered"),
        F.count_if(F.col("known") & (F.col("side") == "out")).alias("outs"),
        F.count_if(F.col("known") & (F.col("side") == "in")).alias("ins"),
        F.count_if(F.col("side") == "in").alias("raw_ins"),
        F.count_if((F.col("side") == "in") & F.col("v").isNotNull()).alias("typed_ins"),
    )
    bare = (F.col("outs") > 0) & (F.col("ins") == 0)
    counts = per.agg(
        F.count("*").alias("n_processes"), F.count_if(F.col("outs") > 0).alias("n_edges"), F.sum("untyped").alias("n_untyped"),
        F.sum("unregistered").alias("n_unregistered"), F.count_if(F.col("outs") == 0).alias("n_no_target"), F.count_if(bare).alias("n_sourceless"),
        F.count_if(bare & (F.col("raw_ins") == 0)).alias("sourceless_empty"),
        F.count_if(bare & (F.col("typed_ins") > 0)).alias("sourceless_unregistered"),
        F.count_if(bare & (F.col("raw_ins") > 0) & (F.col("typed_ins") == 0)).alias("sourceless_untyped"),
    )
    return vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(counts))  # one row each


def degrees(g: Hypergraph) -> DataFrame:
    """v, in_degree (edges that make it), out_degree (edges that use it); 0 for vertices without."""
    made = g.targets.groupBy("v").agg(F.count("*").alias("in_degree"))
    used = g.sources.groupBy("v").agg(F.count("*").alias("out_degree"))
    out = g.vertices.join(made, "v", "left").join(used, "v", "left")
    return out.select("v", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def precursors(g: Hypergraph) -> DataFrame:
    """Vertices that some edge uses and none makes."""
    return g.sources.select("v").distinct().join(g.targets.select("v").distinct(), "v", "left_anti")


def reachable(g: Hypergraph, starts: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, v): what the edges make from each scenario's start (scenario, v), without the removed (scenario, v).

    An edge fires once all its sources are there; edges without sources fire at once. Start vertices belong to the result
    only if some edge makes them. removed vertices are neither used nor made; other products of their edges are.
    """
    removed = removed if removed is not None else starts.limit(0)
    g = patterns(g)
    small = Incidence.of(g)
    if small is not None:
        rows = _sets(starts, "s").join(_sets(removed, "r"), "scenario", "full_outer").select("scenario", "s", "r")
        return cut(_by_scenario(small, rows, Incidence.reached))
    sources, targets, edges = cut(g.sources), cut(g.targets), cut(g.edges)
    removed = cut(removed)
    scenarios = starts.select("scenario").union(removed.select("scenario")).distinct()
    first = cut(starts.join(removed, ["scenario", "v"], "left_anti").distinct())
    free = scenarios.crossJoin(edges.filter("n_src = 0").select("edge"))  # scenarios x edges that fire anyhow
    always = cut(free.join(targets, "edge").select("scenario", "v").join(removed, ["scenario", "v"], "left_anti").distinct())
    made, n = always, always.count()
    while True:
        there = first.union(made).distinct()
        ready = there.join(sources, "v").groupBy("scenario", "edge").agg(F.count("*").alias("n")).join(edges, "edge").filter("n = n_src")
        new = ready.select("scenario", "edge").join(targets, "edge").select("scenario", "v").join(removed, ["scenario", "v"], "left_anti")
        made = cut(new.union(always).distinct())
        now = made.count()
        if now == n:
            return made
        n = now


def made_in_round(g: Hypergraph, start: DataFrame) -> DataFrame:
    """(v, round): what is reached from the start (v), and the round in which it is made first, from 1 on.

    An edge fires in the round after that in which its last source is there; start vertices are there from the beginning.
    """
    sources, targets, edges = cut(g.sources), cut(g.targets), cut(g.edges)
    there = cut(start.select("v").distinct())
    made = None
    i = 0
    while True:
        i += 1
        held = sources.join(there, "v", "left_semi").groupBy("edge").agg(F.count("*").alias("n"))
        ready = edges.join(held, "edge", "left").filter("coalesce(n, 0) = n_src").select("edge")
        new = targets.join(ready, "edge", "left_semi").select("v").distinct()
        new = cut((new if made is None else new.join(made, "v", "left_anti")).withColumn("round", F.lit(i)))
        made = new if made is None else made.unionByName(new)
        if new.isEmpty():
            return cut(made)
        there = cut(there.union(new.select("v")).distinct())


def criticality(g: Hypergraph, base: DataFrame) -> DataFrame:
    """code, criticality: how many vertices fewer are reached from the precursors and the base without each vertex; the base (one row, v) isn't rated."""
    return criticality_and_reach(g, base)[0]


def criticality_and_reach(g: Hypergraph, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """criticality(), and reach(), which it finds on the way.

    What is reached is computed once, with the round of each vertex. For a removed vertex only what may fall with it is
    looked at: a vertex falls once all its live supports (edges that fire with sources of earlier rounds alone) have lost a
    source. That deletes too much where a vertex is also made by later ones, so what has an edge left whose sources all stand
    is taken back, round by round. There are rows for what falls with a vertex only, never for what stays.
    """
    g = patterns(g)
    small = Incidence.of(g)
    if small is not None:
        return _criticality_of(small, g, base)
    start = cut(precursors(g).union(base.select("v")).distinct())
    made = made_in_round(g, start)
    there = start.withColumn("round", F.lit(0)).unionByName(made.join(start, "v", "left_anti"))
    held = g.sources.join(there, "v").groupBy("edge").agg(F.count("*").alias("n"), F.max("round").alias("top"))
    fired = g.edges.join(held, "edge", "left").filter("coalesce(n, 0) = n_src").select("edge", "n_src", F.coalesce("top", F.lit(0)).alias("top"))
    fired = cut(fired)
    sources = cut(g.sources.join(fired, "edge", "left_semi"))
    all_targets = cut(g.targets.join(fired.select("edge", "top"), "edge"))
    targets = cut(all_targets.join(start, "v", "left_anti"))  # the base is there without them
    supports = targets.join(made, "v").filter("top < round").select("edge", "v")
    rated = cut(g.vertices.join(base, "v", "left_anti").select(F.col("v").alias("scenario")))
    tried = cut(rated.join(sources.select(F.col("v").alias("scenario")).distinct(), "scenario", "left_semi"))
    fallen = propagate(Hypergraph(g.vertices, sources, supports, fired), tried.select("scenario", F.col("scenario").alias("v")))
    while True:
        dead = cut(fallen.join(sources, "v").select("scenario", "edge").distinct())
        back = fallen.filter("v <> scenario").join(targets.select("edge", "v"), "v").join(dead, ["scenario", "edge"], "left_anti").select("scenario", "v").distinct()
        back = cut(back)
        if back.isEmpty():
            break
        fallen = cut(fallen.join(back, ["scenario", "v"], "left_anti"))
    lost = fallen.join(made.select("v"), "v", "left_semi").groupBy("scenario").agg(F.count("*").alias("n"))
    # the base itself is reached as long as an edge makes it
    own = all_targets.join(base.select("v"), "v", "left_semi").select("edge")
    unmade = dead.join(own, "edge").groupBy("scenario").agg(F.count("*").alias("m")).join(F.broadcast(own.agg(F.count("*").alias("of"))), F.col("m") == F.col("of")).select("scenario", F.lit(1).alias("m"))
    alone = made.select(F.col("v").alias("scenario"), F.lit(1).alias("own"))
    out = rated.join(lost, "scenario", "left").join(unmade, "scenario", "left").join(alone, "scenario", "left")
    value = F.coalesce("n", "own", F.lit(0)) + F.coalesce("m", F.lit(0))  # without a vertex that nothing uses only itself is missing
    return out.select(F.col("scenario").alias("code"), value.cast("long").alias("criticality")), made.select("v")


def reach(g: Hypergraph, base: DataFrame) -> DataFrame:
    """v: what is reached from the precursors and the base."""
    return reachable(g, precursors(g).union(base.select("v")).distinct().select(F.lit("").alias("scenario"), "v")).select("v")


def checked_base(g: Hypergraph, code: str) -> DataFrame:
    """One row, v: a base material, which must be a vertex."""
    base = g.vertices.filter(F.col("v") == code)
    if base.isEmpty():
        raise ValueError(f"{code} is no vertex")
    return base


def ranked(c: DataFrame, g: Hypergraph, reached: DataFrame) -> DataFrame:
    """Criticality with competition rank, degrees, whether the vertex is reached and whether it is a precursor."""
    marked = lambda df, name: df.select(F.col("v").alias("code"), F.lit(True).alias(name))
    out = c.withColumn("rank", F.rank().over(Window.orderBy(F.desc("criticality"))))
    out = out.join(degrees(g).withColumnRenamed("v", "code"), "code")
    out = out.join(marked(reached, "in_reach"), "code", "left").join(marked(precursors(g), "in_pre"), "code", "left")
    return out.select("rank", "code", "criticality", "in_degree", "out_degree", F.coalesce("in_reach", F.lit(False)).alias("in_reach"), F.coalesce("in_pre", F.lit(False)).alias("in_pre"))


def report_summary(ranking: DataFrame, g: Hypergraph, reached: DataFrame) -> DataFrame:
    """One row: vertices reached, precursors, how many codes share the third-highest criticality, and the first three codes with theirs."""
    top = ranking.orderBy(F.desc("criticality"), "code").limit(3).agg(F.sort_array(F.collect_list(F.struct((-F.col("criticality")).alias("minus"), "code"))).alias("t"))
    sizes = reached.agg(F.count("*").alias("reach")).crossJoin(F.broadcast(precursors(g).agg(F.count("*").alias("n_pre"))))
    third = -F.get("t", F.size("t") - 1)["minus"]
    tied = ranking.crossJoin(F.broadcast(top)).groupBy("t").agg(F.count_if(F.col("criticality") == third).alias("n_tied_with_third"))
    columns = [x for i in range(3) for x in (F.coalesce(F.get("t", F.lit(i))["code"], F.lit("")).alias(f"top{i + 1}_code"), (-F.get("t", F.lit(i))["minus"]).alias(f"top{i + 1}_criticality"))]
    return sizes.crossJoin(F.broadcast(tied)).select("reach", "n_pre", "n_tied_with_third", *columns)  # one row each


def sides(entries: DataFrame) -> DataFrame:
    """process, ins, outs: sets of codes of entries that have one, without any test of them; processes with neither side are left out."""
    coded = entries.filter(F.col("code").isNotNull())
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("code"))))  # noqa: E731  a process's codes
    return coded.groupBy("process").agg(of("in").alias("ins"), of("out").alias("outs"))


def dihypergraph(entries: DataFrame) -> DataFrame:
    """process, tail, head: the materials' names (or codes) of each side as sets; a process without any entry is left out."""
    name = F.coalesce(F.nullif(F.col("code"), F.lit("")), F.nullif(F.col("name"), F.lit("")))
    rows = entries.select("process", "side", name.alias("m")).filter("m IS NOT NULL")
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("m"))))
    return rows.groupBy("process").agg(of("in").alias("tail"), of("out").alias("head"))


def propagate(g: Hypergraph, seeds: DataFrame) -> DataFrame:
    """(scenario, v): what fails if the seeds (scenario, v) do, these included.

    A process dies with any of its sources; a material fails once it has producers and all are dead.
    """
    g = patterns(g)
    small = Incidence.of(g)
    if small is not None:
        return cut(_by_scenario(small, _sets(seeds, "s"), Incidence.fallen, alone=True))
    sources, targets = cut(g.sources), cut(g.targets)
    producers = targets.groupBy("v").agg(F.count("*").alias("n_producers"))
    failed = cut(seeds.select("scenario", "v").distinct())
    n = failed.count()
    while True:
        dead = failed.join(sources, "v").select("scenario", "edge").distinct()
        lost = dead.join(targets, "edge").groupBy("scenario", "v").agg(F.count("*").alias("n")).join(producers, "v").filter("n = n_producers")
        failed = cut(failed.union(lost.select("scenario", "v")).distinct())
        now = failed.count()
        if now == n:
            return failed
        n = now


def disruption(g: Hypergraph, registry: DataFrame, dominance_: DataFrame, crit: DataFrame | None = None) -> DataFrame:
    """Per registered code its trade status, dominance, and for dominated ones what fails with it."""
    codes = registry.select("code").distinct().join(dominance_, "code", "left")
    status = F.when(typed_code(F.col("code")).isNull(), "invalid").when(F.col("total").isNull(), "absent").otherwise("ok")
    rows = codes.withColumn("status", status)
    seeds = rows.filter("status = 'ok' AND dominated").select(F.col("code").alias("scenario"), F.col("code").alias("v"))
    fallen = propagate(g, seeds).filter("v <> scenario").groupBy(F.col("scenario").alias("code")).agg(F.count("*").alias("k"), F.array_join(F.sort_array(F.collect_list("v")), " ").alias("d"))
    size = g.vertices.agg(F.count("*").alias("n_vertices"))
    out = rows.join(fallen, "code", "left").crossJoin(F.broadcast(size))  # size: one row
    struck = (F.col("status") == "ok") & F.coalesce("dominated", F.lit(False))
    n = F.when(struck, F.coalesce("k", F.lit(0)))
    columns = ["code", "status", "total", "top_partner", "share", F.coalesce("dominated", F.lit(False)).alias("dominated"), n.alias("n_dependents")]
    columns += [F.when(struck, F.coalesce("d", F.lit(""))).alias("dependents"), F.when(F.col("n_vertices") > 1, n / (F.col("n_vertices") - 1)).alias("dependents_frac")]
    if crit is not None:
        out = out.join(crit, "code", "left")
        columns.append(F.when(struck, F.col("criticality")).alias("reach_loss"))
    return out.select(*columns)


def summary(report: DataFrame) -> DataFrame:
    """One row of counts over a disruption report; the code with most dependents, ties to the smaller one."""
    dominated = (F.col("status") == "ok") & F.col("dominated")
    top = F.max_by("code", F.when(dominated, F.struct("n_dependents", (-F.col("code").try_cast("int")).alias("m"))))
    return report.agg(
        F.count("*").alias("n_codes"), F.count_if(F.col("status") == "invalid").alias("n_invalid"), F.count_if(F.col("status") == "absent").alias("n_absent"),
        F.count_if(F.col("status") == "ok").alias("n_in_trade"), F.count_if(dominated).alias("n_dominated"), F.count_if(dominated & (F.col("n_dependents") > 0)).alias("n_cascading"),
        F.count_if(dominated & (F.col("n_dependents") == 0)).alias("n_local"), F.coalesce(F.sum("n_dependents"), F.lit(0)).alias("total_dependents"),
        F.when(F.count_if(dominated) > 0, top).otherwise("").alias("max_code"), F.coalesce(F.max("n_dependents"), F.lit(0)).alias("max_dependents"),
    )
