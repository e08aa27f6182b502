"""Connected components of a link table, by hooking to the smallest neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(id, component): for every id of the links (a, b) the smallest id it is connected with.

    A round takes each id's smallest neighbouring component, then that component's own; rounds grow with the logarithm
    of the longest path for the usual shapes. Only the test for the last round reaches the driver. Aggregates combine
    before their shuffle, so that an id with very many links is no hot spot; each round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = ws.keep(both, f"{name}-edges")
    labels = ws.keep(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), f"{name}-0")
    n = 0
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        root = labels.select(F.col("id").alias("new"), F.col("component").alias("root"))
        step = hooked.join(root, "new", "left").select("id", F.least("new", F.coalesce("root", "new")).alias("component"), "old")
        n += 1
        labels = ws.keep(step.select("id", "component", (F.col("component") != F.col("old")).alias("moved")), f"{name}-{n}")
        moved = labels.filter("moved").isEmpty()
        labels = labels.drop("moved")
        ws.drop(f"{name}-{n - 1}")
        if moved:
            ws.drop(f"{name}-edges")
            return labels
