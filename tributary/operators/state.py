"""Edits of the research state as rewrites of its tables: processes, entries, references, materials."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import is_six_digits
from ..functions.text import without_fragment
from ..plans.lineage import cut


def insert(table: DataFrame, rows: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Rows with new keys are added; known keys raise, or with overwrite replace."""
    if overwrite:
        return table.join(rows.select(key), key, "left_anti").unionByName(rows)
    if not rows.join(table.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"{key} is there already")
    return table.unionByName(rows)


def replace(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of known keys replace theirs; unknown keys raise."""
    if not rows.join(table.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"no such {key}")
    return insert(table, rows, key, overwrite=True)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def add_references(refs: DataFrame, new: DataFrame) -> DataFrame:
    """References (process, url, ...) whose URL without fragment isn't there yet; of new ones with one URL the first (pos) counts."""
    key = lambda df: df.withColumn("_u", without_fragment(F.col("url")))
    fresh = key(new).withColumn("_r", F.row_number().over(Window.partitionBy("process", "_u").orderBy("pos"))).filter("_r = 1")
    fresh = fresh.join(key(refs).select("process", "_u"), ["process", "_u"], "left_anti")
    return refs.unionByName(fresh.select(*refs.columns))


def remove_references(refs: DataFrame, gone: DataFrame) -> DataFrame:
    key = lambda df: df.withColumn("_u", without_fragment(F.col("url")))
    return key(refs).join(key(gone).select("process", "_u"), ["process", "_u"], "left_anti").select(*refs.columns)


def add_entries(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the new ones that don't stand on the other side of their process (by code, or a bare name), and the ones rejected for that.

    New ones that are there already are ignored; of new ones that say the same the first by code and name counts.
    """
    ident = F.coalesce(F.col("code"), F.lower("name"))
    held = entries.select("process", "side", ident.alias("_e")).distinct()
    marked = new.withColumn("_e", ident)
    other = held.select("process", "_e", F.when(F.col("side") == "in", "out").otherwise("in").alias("side"))
    rejected = marked.join(other, ["process", "side", "_e"], "left_semi")
    fine = marked.join(other, ["process", "side", "_e"], "left_anti").join(held, ["process", "side", "_e"], "left_anti")
    fine = fine.withColumn("_r", F.row_number().over(Window.partitionBy("process", "side", "_e").orderBy("name", *[c for c in entries.columns if c == "pos"]))).filter("_r = 1")
    return entries.unionByName(fine.select(*entries.columns)), rejected.select(*entries.columns)


def remove_entries(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("process", "side", "code"), ["process", "side", "code"], "left_anti").select(*entries.columns)


def add_materials(materials: DataFrame, new: DataFrame) -> DataFrame:
    """code, name, aliases: new codes are added; known ones keep their name and take names and aliases as further aliases, without repeats."""
    merged = materials.alias("o").join(new.alias("n"), "code", "full_outer")
    empty = F.array().cast("array<string>")
    name = F.coalesce(F.col("o.name"), F.col("n.name"))
    other = F.when(F.col("o.name").isNotNull() & F.col("n.name").isNotNull(), F.array(F.col("n.name"))).otherwise(empty)
    aliases = F.array_distinct(F.concat(F.coalesce(F.col("o.aliases"), empty), other, F.coalesce(F.col("n.aliases"), empty)))
    return merged.select("code", name.alias("name"), F.filter(aliases, lambda a: a != name).alias("aliases"))


def find_material(materials: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, code: by code, else by name, else by alias; among several the first (pos)."""
    keys = materials.select(F.lit(1).alias("p"), F.col("code").alias("asked"), "code", "pos")
    keys = keys.union(materials.select(F.lit(2), "name", "code", "pos")).union(materials.select(F.lit(3), F.explode("aliases"), "code", "pos"))
    hit = asked.join(keys, "asked")
    return hit.groupBy("asked").agg(F.min_by("code", F.struct("p", "pos")).alias("code"))


def duplicate_processes(entries: DataFrame) -> DataFrame:
    """process, ins, outs, first, n of processes that share the codes of both sides with others: a row for each member.

    first is the smallest of the n members. Those without any code form one group, which may be large; so members stay
    rows, and what is shuffled for a group is its count.
    """
    codes = lambda side: F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("code")))), ",")  # noqa: E731  a process's entries
    sig = entries.groupBy("process").agg(codes("in").alias("ins"), codes("out").alias("outs"))
    groups = sig.groupBy("ins", "outs").agg(F.count("*").alias("n"), F.min("process").alias("first")).filter("n > 1")
    return sig.join(groups, ["ins", "outs"]).select("process", "ins", "outs", "first", "n")


def merge_duplicates(entries: DataFrame, processes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each group's first process stays for all of it; entries of the others go."""
    gone = members.filter("process <> first").select("process")
    return remove(entries, gone, "process"), remove(processes, gone, "process")


def makers(entries: DataFrame, code: DataFrame) -> DataFrame:
    """code, process: processes that make the codes asked for."""
    return entries.filter("side = 'out'").join(code.select("code").distinct(), "code", "left_semi").select("code", "process").distinct()


# Lists of a configuration or of an analysis context: questions, constraints, materials, references.


def append_absent(items: Column, item: Column) -> Column:
    """The list with the item at its end, unless it holds it."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def replaced_at(items: Column, position: int, item: Column) -> Column:
    """The list with the item at a position from 0; as it is for positions it doesn't have."""
    return F.transform(items, lambda x, i: F.when(i == position, item).otherwise(x))


def removed_at(items: Column, position: int) -> Column:
    return F.filter(items, lambda x, i: i != position)


def without(items: Column, item: Column) -> Column:
    return F.array_remove(items, item)


def looked_up(rows: DataFrame, scores: DataFrame, key: str, content: str | None = None) -> DataFrame:
    """Rows with the score of a table by key, null without one; 0 where a content column is given and empty."""
    out = rows.join(scores.select(key, "score"), key, "left")
    if content is None:
        return out
    return out.withColumn("score", F.when(F.coalesce(F.col(content), F.lit("")) == "", 0.0).otherwise(F.col("score")))


def refined(state: Any, generate: Callable[[Any, float], Any], review: Callable[[Any, float], tuple[Any, bool]], min_reviews: int, max_reviews: int) -> Any:
    """Generate and review until a review has no updates and min_reviews are done, max_reviews at most.

    generate and review get the state and a temperature: generating cools as reviews add up, reviewing warms.
    """
    for i in range(max_reviews):
        state = generate(state, 1 - i / max_reviews)
        state, updated = review(state, i / max_reviews)
        if not updated and i + 1 >= min_reviews:
            break
    return state


# Lookups and filters of the research folders.


def unmined(materials: DataFrame) -> DataFrame:
    """Materials to research: those that aren't mined; without a mark they aren't."""
    return materials.filter(~F.coalesce("mined", F.lit(False)))


def wanted(materials: DataFrame, codes: list[str] | DataFrame | None) -> DataFrame:
    """Materials of a list, or a table, of codes; all of them without one."""
    if isinstance(codes, DataFrame):
        return materials.join(codes.select("code"), "code", "left_semi")
    return materials if codes is None else materials.filter(F.col("code").isin(codes))


def unknown(suggested: DataFrame, materials: DataFrame) -> DataFrame:
    """Suggested codes that aren't registered, each once."""
    return suggested.select("code").filter("code <> ''").distinct().join(materials.select("code"), "code", "left_anti")


def settled(processes_of: DataFrame) -> DataFrame:
    """code, settled: whether research on a material may be skipped: it has a process, and all of them have a score. processes_of: code, score."""
    return processes_of.groupBy("code").agg((F.count("*") == F.count("score")).alias("settled"))


def listed_references(cached: DataFrame, failed: bool = False) -> DataFrame:
    """Lines for cached references (url, error): those without an error, on demand also those with one, which are marked."""
    line = F.when(F.col("error").isNull(), F.concat(F.lit("- "), "url")).otherwise(F.concat(F.lit("- [FAILED] "), "url"))
    return cached.select("url", "error", line.alias("line")).filter(F.lit(failed) | F.col("error").isNull())


def material_lookup(materials: DataFrame) -> DataFrame:
    """key, code: every id, name and label of the materials (by pos); of a key that several have the last one's counts."""
    keys = materials.select("code", "pos", F.explode(F.array("id", "name", "label")).alias("key")).filter("key <> ''")
    return keys.groupBy("key").agg(F.max_by("code", "pos").alias("code"))


def linked_processes(entries: DataFrame, codes: DataFrame) -> DataFrame:
    """code, process, role of the processes a material takes part in; on both sides it is a precursor."""
    rows = entries.join(codes.select("code").distinct(), "code", "left_semi")
    return rows.groupBy("code", "process").agg(F.when(F.bool_or(F.col("side") == "in"), "precursor").otherwise("product").alias("role"))


def other_than_parent(components: DataFrame) -> DataFrame:
    """Components (parent, child) that aren't their own parent's name."""
    return components.filter(F.col("child") != F.col("parent"))


def all_codes(states: list[DataFrame]) -> DataFrame:
    """The six-digit codes that any of several states registers."""
    out = states[0].select("code")
    for s in states[1:]:
        out = out.union(s.select("code"))
    return out.filter(is_six_digits(F.col("code"))).distinct()


def component_tree(children: DataFrame, root: str, leaves: tuple[str, ...] = ("raw", "software", "equipment"), depth: int = 3) -> DataFrame:
    """parent, child, level of the tree under root: children (parent, child, kind) level by level, depth levels at most.

    Kinds in leaves aren't grown further. A child that several parents share is there for each of them.
    """
    edges = cut(other_than_parent(children).select("parent", "child", "kind").distinct())
    level = cut(edges.filter(F.col("parent") == root).withColumn("level", F.lit(1)))
    out = level
    for i in range(2, depth + 1):
        grow = level.filter(~F.col("kind").isin(list(leaves))).select(F.col("child").alias("parent")).distinct()
        level = cut(edges.join(grow, "parent").withColumn("level", F.lit(i)))
        out = out.union(level.select(out.columns))
    return out.select("parent", "child", "kind", "level")


def tree_levels(nodes: DataFrame) -> DataFrame:
    """depth (0 for those without a parent), n, first: how many nodes (id, parent) each level has, and the smallest, level by
    level: a round joins the last level alone, whatever the size of the tree."""
    links = cut(nodes.filter("parent IS NOT NULL").select("id", "parent"))
    level, depth, out = cut(nodes.filter("parent IS NULL").select("id")), 0, None
    while True:
        row = level.groupBy(F.lit(depth).alias("depth")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
        out = row if out is None else out.union(row)
        level, depth = cut(links.join(level.withColumnRenamed("id", "parent"), "parent").select("id")), depth + 1
        if level.isEmpty():
            return out
