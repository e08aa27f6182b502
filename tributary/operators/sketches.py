"""Reach and distances of large graphs by cardinality sketches, merged along the edges round by round.

Each vertex holds a sketch of the vertices it reaches within so many steps, of the same size whatever their number; a round
gives it the union of its successors' sketches. So there is a row for each vertex and never one for a pair. Only vertices
whose sketch has changed are heard in the next round. Sketching, union and estimate are Spark's own aggregates, which combine
before their shuffle; the relative standard error is about 1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .graphs import vertices

#: Binary logarithm of a sketch's registers: 4 KB a vertex, an error of 1.6 %.
LG_K = 12


def _rounds(edges: DataFrame, lg_k: int, max_rounds: int | None):
    """After each round (v, sketch, size, moved), the start included; the last one has no vertex that moved."""
    links = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct())
    state = vertices(edges).groupBy("v").agg(F.hll_sketch_agg("v", lg_k).alias("sketch"))
    state = cut(state.select("v", "sketch", F.lit(1.0).alias("size"), F.lit(True).alias("moved")))
    yield state
    i = 0
    while (max_rounds is None or i < max_rounds) and not state.filter("moved").isEmpty():
        heard = links.join(state.filter("moved").select(F.col("v").alias("dst"), "sketch"), "dst").groupBy(F.col("src").alias("v")).agg(F.hll_union_agg("sketch").alias("more"))
        both = state.join(heard, "v", "left").select("v", "sketch", "size", "more")
        union = F.when(F.col("more").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "more"))
        new = both.select("v", union.alias("sketch"), F.col("size").alias("old"))
        state = cut(new.withColumn("size", F.hll_sketch_estimate("sketch").cast("double")).select("v", "sketch", "size", (F.col("size") > F.col("old")).alias("moved")))
        yield state
        i += 1


def reach_estimates(edges: DataFrame, lg_k: int = LG_K, max_rounds: int | None = None) -> DataFrame:
    """v, descendants, ancestors: about how many other vertices each one reaches, and is reached from (in max_rounds steps at
    most, if given). Loops and parallel edges don't count; edges without one of their ends are left out."""
    out = None
    for name, e in (("descendants", edges.select("src", "dst")), ("ancestors", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        for state in _rounds(e, lg_k, max_rounds):
            last = state
        sizes = last.select("v", F.greatest(F.round(F.col("size")) - 1, F.lit(0)).cast("long").alias(name))
        out = sizes if out is None else out.join(sizes, "v")
    return out.select("v", "descendants", "ancestors")


def distance_estimates(edges: DataFrame, lg_k: int = LG_K, share: float = 0.9) -> DataFrame:
    """One row: pairs (about how many ordered pairs are connected), average_distance, effective_diameter (steps within which
    `share` of them are) and longest (steps until nothing new is reached). Nulls for a graph without connected pairs."""
    totals = [state.agg(F.count("*"), F.sum("size")).first() for state in _rounds(edges.select("src", "dst"), lg_k, None)]  # a row a round
    n = totals[0][0]
    pairs = [max((s or 0.0) - n, 0.0) for _, s in totals]
    while len(pairs) > 1 and pairs[-1] <= pairs[-2]:
        pairs.pop()
    whole = pairs[-1]
    average = sum(i * (b - a) for i, (a, b) in enumerate(zip(pairs[:-1], pairs[1:], strict=True), 1)) / whole if whole else None
    within = next(i for i, x in enumerate(pairs) if x >= share * whole) if whole else None
    return edges.sparkSession.createDataFrame([(whole, average, within, len(pairs) - 1 if whole else None)], "pairs double, average_distance double, effective_diameter int, longest int")
