"""Documents linked by the Jaccard similarity of their word n-grams: a blocked sparse product of the document by n-gram incidence.

An entry of the product is the overlap of two documents; a link needs ceil(percent (n + m) / (100 + percent)) of it. Three
bounds that follow from the sizes alone keep the product sparse:

- Columns: of a document's n n-grams, ordered alike in all documents, the first n - ceil(n percent / 100) + 1 hold one of any
  document that it is linked with, so only these are multiplied to find which rows meet. The order is by frequency, n-grams
  that many documents hold last; it needs frequencies of no exactness, so n-grams are counted in SLOTS counters by their hash.
- Rows: a document whose first common n-gram stands at place i has an overlap of n - i at most, so a partner can't be larger
  than that allows; a column keeps the rows that still have a partner there, and multiplies two rows only where it is the
  first that they have in common.
- Entries: blocks of rows are multiplied slice by slice of the columns, the deciding ones first; a pair whose overlap so far
  and whose n-grams still to come can't reach its need is discarded, and rows without open pairs leave the product. So the
  n-grams of all but few rows never have to be shuffled.

Documents with one and the same set are one row. First each column's rows are multiplied with its hub alone, which joins most
true groups at a cost in proportion to their members; columns whose rows then still lie in several components are multiplied
in full across these, in blocks of bounded size. No column is capped, and no group's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .near_dups import BLOCK, _apart, _compared, _confirmed, _dealt, _rarest, add_common, by_value, common, shingle_sets
from .ragged import U64, gather_ranges, list_array, mix
from .tables import Workspace

NGRAM, PERCENT = 3, 90
#: Counters of n-grams by their hash, a power of two, and of a run of them that is summed together: a table of fixed size,
#: whatever the corpus, of 4 MB once it is broadcast.
SLOTS, RUN = 1 << 22, 1 << 14
#: Blocks of others beyond which a column's rows meet again by their rarest n-grams.
MANY = 8
#: Slices of the columns of a block's product.
SLICES = 8

_rng = np.random.Generator(np.random.PCG64(11))
_A, _B = _rng.integers(0, 2**63, 2, dtype=np.uint64) * U64(2) + U64(1)


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counter(k: int) -> Callable:
    """A task's counts, a row for each run of counters that isn't empty, packed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for values, _ in shingle_sets(b.column(0), k):
                np.add.at(n, _slot(values), 1)
        runs = n.reshape(-1, RUN)
        held = np.flatnonzero(runs.any(1))
        packed = [pa.compress(runs[i].tobytes(), codec="zstd", asbytes=True) for i in held]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(packed, pa.binary())], ["run", "n"])

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of the runs in this task: floor(2 log2 n) of each counter."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for run, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = np.frombuffer(pa.decompress(packed, 8 * RUN, codec="zstd", asbytes=True), np.int64)
            total[run] = total[run] + n if run in total else n
    levels = [np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.uint8).tobytes() for n in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["run", "level"])


def frequency_levels(texts: DataFrame, k: int) -> np.ndarray:
    """For each slot how many n-grams of all texts fall in it, in steps of half a power of two."""
    counts = texts.mapInArrow(_counter(k), "run int, n binary").repartition("run").mapInArrow(_summed, "run int, level binary").toArrow()
    out = np.zeros((SLOTS // RUN, RUN), np.uint8)
    for run, level in zip(counts.column("run").to_pylist(), counts.column("level").to_pylist(), strict=True):
        out[run] = np.frombuffer(level, np.uint8)
    return out.ravel()


def deciding(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n ordered n-grams hold one of any other set that is similar enough; 0 where only an equal set is."""
    return np.where(100 * n >= percent * (n + 1), n - -(-n * percent // 100) + 1, 0)


def _rows(k: int, percent: int, levels: Broadcast) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value.astype(np.uint64) << U64(56)
        for b in batches:
            at = 0
            for v, off in shingle_sets(b.column(1), k):
                n = np.diff(off)
                full = n > 0
                x, y = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if full.any():
                    first = off[:-1][full]
                    x[full], y[full] = np.add.reduceat(mix(v ^ _A), first), np.bitwise_xor.reduceat(mix(v ^ _B), first)
                order = level[_slot(v)] | (mix(v) >> U64(8))
                for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    order[i:j].sort()
                many = deciding(n, percent)
                columns = list_array(order[gather_ranges(off[:-1], many)].view(np.int64), np.concatenate([[0], np.cumsum(many)]), pa.int64())
                ids = b.column(0).slice(at, len(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), columns], ["doc_id", "n_shingles", "fp_a", "fp_b", "columns"])
                at += len(n)

    return rows


def _sets(k: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for v, off in shingle_sets(b.column(1), k):
                n = len(off) - 1
                each = [v[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(each, pa.binary())], ["id", "shingles"])
                at += n

    return sets


def product_links(sets: list[np.ndarray], part: np.ndarray, percent: int, slices: int = SLICES) -> np.ndarray:
    """Which sets of different parts are linked: the block's product, a slice of the columns at a time."""
    m, size = len(sets), np.array([len(x) for x in sets])
    both = size[:, None] + size[None, :]
    need = -(-percent * both // (100 + percent))
    open_ = sizes_fit(size, part, percent)
    value, who = by_value(sets)
    count, left = np.zeros(m * m, np.int64), size.copy()
    overlap = count.reshape(m, m)
    if len(value) < 1 << 12:
        slices = 1
    cuts = np.searchsorted(value, np.linspace(0.0, 2.0**64, slices, endpoint=False).astype(np.uint64)).tolist() + [len(value)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        active = open_.any(1)
        if not active.any():
            break
        of = who[lo:hi]
        stays = active[of]
        if stays.any():
            add_common(count, m, value[lo:hi][stays], of[stays])
        left -= np.bincount(of, minlength=m)
        open_ &= overlap + np.minimum(left[:, None], left[None, :]) >= need
    return open_  # no columns are left, so what is open has its need


def open_pairs(columns: list[np.ndarray], n: np.ndarray, part: np.ndarray, percent: int, first: int | None = None) -> np.ndarray:
    """Which sets of n n-grams and different parts may still be linked after the product of their deciding columns; on demand
    only those of which no column before `first` is common.

    Of two sets, all n-grams up to the earlier one of their last deciding columns have been seen. What they have in common
    beyond it is no more than either of them still holds.
    """
    last = np.array([x[-1] for x in columns])
    seen = np.stack([np.searchsorted(x, np.minimum(last, x[-1]), "right") for x in columns])  # [i, j]: of i's, up to the earlier end
    left = n[:, None] - seen
    need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    open_ = (part[:, None] != part[None, :]) & (common(columns) + np.minimum(left, left.T) >= need)
    if first is not None and open_.any():
        open_ &= common([x[: np.searchsorted(x, first)] for x in columns]) == 0
    return open_


def sizes_fit(n: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of different parts have sizes that can be linked."""
    need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
    return (part[:, None] != part[None, :]) & (np.minimum(n[:, None], n[None, :]) >= need)


def _columns(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    """Each row's values of a list column."""
    column = batch.column(i)
    values, off = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _open_hubs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be linked by their deciding columns."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _columns(b, 3), _columns(b, 5)
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            keep = [bool(open_pairs([x[i], y[i]], np.array([n[i], m[i]]), np.arange(2), percent)[0, 1]) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: nodes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("columns").alias(f"of_{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "of_a", "n_b", "of_b").mapInArrow(check, "a long, b long")


def _open_members(dealt: DataFrame, of: DataFrame, percent: int, only_first: bool) -> DataFrame:
    """The blocks' members that may be linked with another one, of which the block's column is the first common one.

    of: rep, n and columns: with only_first those that other rows have too, and no more than that and the sizes is asked; else
    the deciding ones.
    """
    rows = dealt.join(of.select("rep", "n", "columns"), "rep").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep")

    def passed(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len({g[4] for g in group}) > 1:
            columns, band = [g[6] for g in group], group[0][0]
            of_column = all(x[min(np.searchsorted(x, band), len(x) - 1)] == band for x in columns)  # else the rarest n-grams' block
            n, part = np.array([g[5] for g in group]), np.array([g[4] for g in group])
            if only_first:
                keep = sizes_fit(n, part, percent)
                if of_column:
                    keep &= common([x[: np.searchsorted(x, band)] for x in columns]) == 0
            else:
                keep = open_pairs(columns, n, part, percent, band if of_column else None)
            keep = keep.any(1)
            if keep.any():
                rows = zip(*(g[:5] for g, k in zip(group, keep.tolist(), strict=True) if k), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _MEMBER, strict=True)], ["band", "i", "j", "rep", "component"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            columns = _columns(b, 6)
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)):
                if row[:3] != key:
                    yield from passed(group)
                    key, group = row[:3], []
                group.append((*row, columns[i].copy()))  # else a batch would stay for the group's sake
        yield from passed(group)

    return rows.select("band", "i", "j", "rep", "component", "n", "columns").mapInArrow(check, "band long, i int, j int, rep long, component long")


_MEMBER = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def ngram_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Per row of df: doc_id, n_shingles and component_id (the smallest doc_id it is connected with).

    Links: 100 * common >= percent * union of the texts' distinct n-word shingles (A-Z lower-cased; a text of fewer words is
    one shingle). Texts without words, empty and null ones have 0 shingles and no links. Rows of one doc_id are one document;
    a row without doc_id has no component. Very long texts are read whole, as a chunk of their own; an empty table gives no
    rows. Other columns are left out, so their names can't clash. n-grams are 64-bit hashes, equal sets are told by size and
    128 bits.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "ngrams")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(rows.select("text"), n))
    incidence = ws.keep(rows.mapInArrow(_rows(n, percent, levels), "doc_id long, n_shingles long, fp_a long, fp_b long, columns array<bigint>"), "incidence")
    same = ["fp_a", "fp_b", "n_shingles"]
    real = incidence.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = ws.keep(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("columns").alias("columns")), "nodes")

    placed = nodes.select("rep", F.col("n_shingles").alias("n"), F.posexplode("columns").alias("place", "band"))
    entries = placed.select("band", "rep", "n", F.expr(f"{100 + percent} * (n - place) div {percent} - n").alias("most"))  # the largest partner
    least = F.min(F.when(F.col("most") >= F.col("n"), F.col("n"))).alias("least")  # of two rows, the smaller one can have a larger partner
    shared = entries.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("hub"), least).filter("m > 1 AND least IS NOT NULL").drop("m")
    members = ws.keep(entries.join(shared, "band").filter("most >= n OR least <= most").select("band", "rep", "n", "hub"), "members")
    labels = None
    if not members.isEmpty():

        def sets_of(ids: DataFrame, name: str) -> DataFrame:
            return ws.keep(rows.join(ids.toDF("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(n), "id long, shingles binary"), name)

        near = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
        pairs = members.filter((F.col("rep") != F.col("hub.rep")) & near).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
        pairs = ws.keep(_open_hubs(pairs, nodes, percent), "pairs")
        links = ws.keep(_confirmed(pairs, sets_of(pairs.select("a").union(pairs.select("b")), "sets-0"), percent), "links-0")
        first = components(links, ws, "first").withColumnRenamed("id", "rep")
        # blocks of deciding columns first: n is their number
        size = F.greatest(F.lit(1), F.ceil(F.col("n") * (100 - percent) / 100)).cast("long").alias("n")
        now = ws.keep(members.join(first, "rep", "left").select("band", "rep", size, F.coalesce("component", "rep").alias("component")), "now")
        open_ = ws.keep(now.join(_once(now), "band").join(_apart(now), "band"), "open")
        few, many = open_.filter(F.col("others") <= MANY * BLOCK), open_.filter(F.col("others") > MANY * BLOCK)
        if not many.isEmpty():
            few = few.union(_rarest(many.select("rep", "component").distinct(), sets_of(many.select("rep"), "sets-1"), percent, ws).select(few.columns))
        sized = nodes.select("rep", F.col("n_shingles").alias("n"), "columns")
        held = few.groupBy("rep").agg(F.array_sort(F.collect_set("band")).alias("columns")).join(sized.select("rep", "n"), "rep")  # a set's own columns
        maybe = ws.keep(_open_members(_dealt(few), held, percent, True), "maybe")
        still = ws.keep(_open_members(maybe, sized, percent, False), "still")
        # what is left of a block is dealt again by the sizes of the full sets
        left = still.join(nodes.select("rep", F.col("n_shingles").alias("n")), "rep").select(F.xxhash64("band", "i", "j").alias("band"), "rep", "n", "component")
        left = left.join(_once(left), "band").join(_apart(left), "band")
        rest = ws.keep(_compared(_dealt(left), sets_of(still.select("rep"), "sets-2"), percent, product_links), "links-1")
        labels = components(links.union(rest), ws, "all").withColumnRenamed("id", "rep")
        ws.drop("members", "pairs", "now", "open", "rare", "rare-bands", "maybe", "still", "sets-0", "sets-1", "sets-2", "links-0", "links-1")

    copies = nodes.filter("copies > 1").select(*same, "rep")
    out = incidence.select("doc_id", *same).join(copies, same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    component = F.col("rep")
    if labels is not None:
        out, component = out.join(labels, "rep", "left"), F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _once(members: DataFrame) -> DataFrame:
    """Of groups with the same members, in several components, one: band."""
    who = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 31))).alias("s"), F.count("*").alias("m")]
    sizes = members.groupBy("band").agg(*who, F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    return sizes.groupBy("x", "s", "m").agg(F.min("band").alias("band")).select("band")


def ngram_join_sql(n: int = NGRAM, percent: int = PERCENT) -> str:
    """ngram_join() of the table documents, in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), held AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END)) AS shingle FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id
), product AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM product JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id"""
