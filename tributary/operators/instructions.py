"""Instructions that edit processes, folded in their order, each process by itself.

A process is a document: process, description, scale, ins and outs (arrays of entries: code, name; a bare name has no
code) and refs (URLs). Documents and instructions of a process meet in one task; processes without instructions don't
leave the JVM. What can't be done changes nothing further and becomes a row of messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

ENTRY = "struct<code:string,name:string>"
DOCUMENT = f"process string, description string, scale double, ins array<{ENTRY}>, outs array<{ENTRY}>, refs array<string>"
#: Of kind: AddProcess, RemoveProcess, AddMaterial, RemoveMaterial, SetProcess or AddReference. AddProcess reads description,
#: scale, ins, outs and refs; the edits of materials side (in or out) and ins (the entries); AddReference refs.
INSTRUCTION = f"pos long, kind string, process string, side string, description string, scale double, ins array<{ENTRY}>, outs array<{ENTRY}>, refs array<string>"

_MANY = pa.list_(pa.struct([("code", pa.string()), ("name", pa.string())]))
MADE = pa.schema([("process", pa.string()), ("description", pa.string()), ("scale", pa.float64()), ("ins", _MANY), ("outs", _MANY), ("refs", pa.list_(pa.string())), ("pos", pa.int64()), ("message", pa.string())])
#: Processes that a task holds as Python's objects at a time.
ROWS = 1000


class Refused(ValueError):
    """An edit that the state doesn't allow."""


@dataclass
class Process:
    description: str | None = None
    scale: float | None = None
    ins: list = field(default_factory=list)
    outs: list = field(default_factory=list)
    refs: list = field(default_factory=list)

    def add(self, side: str, entry: tuple) -> None:
        """An entry at the end of a side, unless it is there; refused if it is on the other side."""
        here, there = (self.ins, self.outs) if side == "in" else (self.outs, self.ins)
        if any(_same(x, entry) for x in there):
            raise Refused(f"{entry[0] or entry[1]} is on the other side")
        if not any(_same(x, entry) for x in here):
            here.append(entry)

    def remove(self, side: str, entry: tuple) -> None:
        here = self.ins if side == "in" else self.outs
        here[:] = [x for x in here if not (x[0] == entry[0] if x[0] and entry[0] else x == entry)]

    def refer(self, url: str) -> None:
        if url.split("#")[0] not in self.refs:
            self.refs.append(url)


def _same(held: tuple, entry: tuple) -> bool:
    """By code where both have one; a bare name equals a bare name or a held entry's name."""
    if entry[0]:
        return held[0] == entry[0]
    return held[1] == entry[1]


def _entries(items) -> list[tuple]:
    return [(x["code"], x["name"]) for x in ([] if items is None else items)]


def step(held: Process | None, r) -> tuple[Process | None, str | None]:
    """The process after one instruction, and what kept it from being done in full."""
    if r.kind == "AddProcess":
        if held is not None:
            return held, "is there already"
        held = Process(r.description, None if pd.isna(r.scale) else float(r.scale))
        try:
            for side, items in (("out", r.outs), ("in", r.ins)):
                for x in _entries(items):
                    held.add(side, x)
            for url in [] if r.refs is None else r.refs:
                held.refer(url)
        except Refused as e:
            return held, str(e)
        return held, None
    if r.kind not in ("RemoveProcess", "AddMaterial", "RemoveMaterial", "SetProcess", "AddReference"):
        return held, f"unknown instruction {r.kind}"
    if held is None:
        return None, "isn't there"
    try:
        if r.kind == "RemoveProcess":
            return None, None
        if r.kind == "SetProcess":
            held.description = held.description if r.description is None else r.description
            held.scale = held.scale if pd.isna(r.scale) else float(r.scale)
        elif r.kind == "AddReference":
            for url in [] if r.refs is None else r.refs:
                held.refer(url)
        else:
            for x in _entries(r.ins):
                (held.add if r.kind == "AddMaterial" else held.remove)(r.side, x)
    except Refused as e:
        return held, str(e)
    return held, None


def folded(documents: DataFrame, instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents after the instructions, and messages (pos, process, message) of those not done in full.

    AddProcess puts products before precursors before references and stops at the first that is refused, as the others do
    with theirs. An instruction for a process that isn't there is refused, AddProcess for one that is.
    """
    asked = instructions.filter("process IS NOT NULL")
    still = documents.join(asked.select("process").distinct(), "process", "left_anti")
    todo = asked.groupBy("process").agg(F.collect_list(F.struct("pos", "kind", "process", "side", "description", "scale", "ins", "outs", "refs")).alias("todo"))
    held = documents.groupBy("process").agg(F.last(F.struct("description", "scale", "ins", "outs", "refs")).alias("held"))

    def fold(held: dict | None, todo: list[dict]) -> Iterator[dict]:
        now = held and Process(held["description"], held["scale"], _entries(held["ins"]), _entries(held["outs"]), list(held["refs"] or []))
        for x in sorted(todo, key=lambda x: (x["pos"] is None, x["pos"] or 0)):
            now, message = step(now, SimpleNamespace(**x))
            if message:
                yield {"process": x["process"], "pos": x["pos"], "message": message}
        if now is not None:
            both = {c: [{"code": a, "name": b} for a, b in x] for c, x in (("ins", now.ins), ("outs", now.outs))}
            yield {"process": todo[0]["process"], "description": now.description, "scale": now.scale, **both, "refs": now.refs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                rows = [x for r in zip(part["held"].to_pylist(), part["todo"].to_pylist(), strict=True) for x in fold(*r)]
                yield pa.RecordBatch.from_pylist(rows, MADE)

    # both results read it: instructions are followed once
    got = cut(todo.join(held, "process", "left").select("held", "todo").mapInArrow(run, f"{DOCUMENT}, pos long, message string"))
    return still.unionByName(got.filter("message IS NULL").select(*documents.columns)), got.filter("message IS NOT NULL").select("pos", "process", "message")


def documents_of(processes: DataFrame, entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents from tables: processes (process, description, scale), entries (process, side, code, name, pos), refs (process, url, pos)."""
    in_order = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"])  # noqa: E731  a process's own
    entry = F.struct(F.nullif(F.col("code"), F.lit("")).alias("code"), "name")
    side = lambda k: entries.filter(F.col("side") == k).select("process", "pos", entry.alias("x")).groupBy("process")
    out = processes.select(F.col("process").cast("string").alias("process"), "description", F.col("scale").cast("double").alias("scale"))
    for name, rows in (("ins", side("in")), ("outs", side("out")), ("refs", refs.select("process", "pos", F.col("url").alias("x")).groupBy("process"))):
        got = rows.agg(in_order(rows).alias(name)).withColumn("process", F.col("process").cast("string"))
        empty = F.array().cast("array<string>" if name == "refs" else f"array<{ENTRY}>")
        out = out.join(got, "process", "left").withColumn(name, F.coalesce(name, empty))
    return out.select("process", "description", "scale", "ins", "outs", "refs")
