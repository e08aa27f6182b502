"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of the shingles' hashes gives two values, the smallest and the largest, so a signature of 128 values
costs 64 hash evaluations a shingle; a value of either kind agrees with the probability of the sets' similarity. Four
values (both of two permutations) make a band. With 32 bands a pair at a similarity of 0.75 shares none with a
probability of about 5e-6 if its sets are large; in small sets the smallest and the largest value hang together, so pairs
with a set of SMALL shingles or fewer also meet by those of their prefixes: the smallest hashes, of which similar sets
have one in common for certain.

Documents with one and the same set are one node. Bands hold candidates; every link is confirmed on the full sets. First
each band's members are compared with its hub, the smallest one, which joins nearly all true groups at a cost in
proportion to the members. Bands that still hold several components are then compared in full across these components,
a small band within a task. In a larger one the members of its largest component are cut into blocks, and each block meets
the members of the other components, so that the cost is in proportion to the members while the others are few. Where they
are many, too, the band's members first meet again by the rarest of their shingles (the prefix of each set, ordered by how
many of these members hold a shingle), which loses no link and leaves few members together. Nothing is capped, and no
group's pairs are ever written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ragged import NOT_SPACE, U64, chunks, gather_ranges, list_array, mix, shingles, word_hashes, words
from .tables import Workspace

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BANDS = 64, 32
#: Sets of which no link is missed, whatever the hashes.
SMALL = 16
#: Shingles of a block of a band's members; a member counts as BLOCK / 1024 at least, so that a task compares 2048 members at most.
BLOCK = 1 << 17
#: Sets beyond which a value's holders are counted by a matrix product.
DENSE = 24

_rng = np.random.Generator(np.random.PCG64(8))
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(0, 2**63, 4, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk of rows the sets of their texts' k-word shingles as ascending hashes, and the rows' offsets."""
    for t in chunks(column):
        w = words(t, NOT_SPACE)
        v, off = shingles(word_hashes(t, w), w.woff, k)
        at = off.tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            v[a:b].sort()
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        new[off[:-1][off[:-1] < len(v)]] = True
        yield v[new], np.concatenate([[0], np.cumsum(new)])[off]


def band_keys(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The BANDS keys of each set; sets aren't empty."""
    first = off[:-1]
    out = np.empty((len(first), BANDS), np.uint64)
    per = PERMUTATIONS // BANDS
    for band in range(BANDS):
        key = np.full(len(first), U64(band))
        for j in range(per):
            p = band * per + j
            moved = values * _A[p] + _B[p]
            key = mix(key * _C[2 * j] + np.minimum.reduceat(moved, first))
            key = mix(key * _C[2 * j + 1] + np.maximum.reduceat(moved, first))
        out[:, band] = key
    return out


def prefix_keys(values: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets that may be linked with one of SMALL shingles, and each set's number of them.

    Of n ascending hashes the first n - ceil(n * percent / 100) + 1: two sets that are similar enough share one of these.
    """
    n = np.diff(off)
    many = np.where((n > 0) & (n <= SMALL * 100 // percent), n - -(-n * percent // 100) + 1, 0)
    return mix(values[gather_ranges(off[:-1], many)] * _C[0] + U64(BANDS)), many


def keys_of(values: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and prefix keys of each set, and the sets' offsets in them; an empty set has none."""
    full = np.diff(off) > 0
    extra, many = prefix_keys(values, off, percent)
    koff = np.concatenate([[0], np.cumsum(full * BANDS + many)])
    out = np.empty(int(koff[-1]), np.uint64)
    if full.any():
        own = np.append(off[:-1][full], len(values))
        out[(koff[:-1][full][:, None] + np.arange(BANDS)).ravel()] = band_keys(values, own).ravel()
        out[gather_ranges(koff[:-1] + full * BANDS, many)] = extra
    return out, koff


def _sketcher(percent: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for v, off in shingle_sets(b.column(1)):
                n = np.diff(off)
                full = n > 0
                a, c = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if full.any():
                    first = off[:-1][full]
                    a[full] = np.add.reduceat(mix(v ^ _A[0]), first)
                    c[full] = np.bitwise_xor.reduceat(mix(v ^ _A[1]), first)
                keys, koff = keys_of(v, off, percent)
                ids = b.column(0).slice(at, len(n))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), list_array(keys.view(np.int64), koff, pa.int64())],
                    ["doc_id", "n_shingles", "fp_a", "fp_b", "bands"],
                )
                at += len(n)

    return sketch


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for v, off in shingle_sets(b.column(1)):
            n = len(off) - 1
            sets = [v[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(sets, pa.binary())], ["id", "shingles"])
            at += n


def set_at(column: pa.Array, i: int) -> np.ndarray:
    """The set in row i, without a copy."""
    return np.frombuffer(column[i].as_buffer(), np.uint64)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id (the smallest doc_id it is connected with) and kept.

    Links: 100 * common >= percent * union of the texts' distinct 5-word shingles (A-Z lower-cased; a text of fewer
    words is one shingle). Texts without words, empty and null ones have 0 shingles and no links. Rows of one doc_id are
    one document. A row without doc_id has no component and is kept. Very long texts are read whole, as a chunk of their
    own; an empty table gives no rows. Other columns are left out, so their names can't clash. Hot groups: equal sets
    meet in aggregates that combine before the shuffle; joins back to them are plain equi-joins that Spark splits where
    a key is hot; links of a hub are compared row by row.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "near")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = ws.keep(rows.mapInArrow(_sketcher(percent), "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<bigint>"), "sketch")
    same = ["fp_a", "fp_b", "n_shingles"]
    real = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = ws.keep(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")

    keyed = nodes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).filter("m > 1").select("band", "hub")
    members = ws.keep(keyed.join(shared, "band"), "members")
    labels = None
    if not members.isEmpty():
        ids = members.select(F.col("rep").alias("doc_id")).distinct()
        sets = ws.keep(rows.join(ids, "doc_id", "left_semi").mapInArrow(_full_sets, "id long, shingles binary"), "sets")
        pairs = members.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        links = ws.keep(_confirmed(pairs, sets, percent), "links-0")
        first = components(links, ws, "first").withColumnRenamed("id", "rep")
        now = ws.keep(members.join(first, "rep", "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("component")), "now")
        open_ = ws.keep(now.join(_apart(now), "band"), "open")
        few, many = open_.filter(F.col("others") <= BLOCK), open_.filter(F.col("others") > BLOCK)
        if not many.isEmpty():
            few = few.union(_rarest(many.select("rep", "component").distinct(), sets, percent, ws).select(few.columns))
        rest = ws.keep(_rest(few, sets, percent), "links-1")
        labels = components(links.union(rest), ws, "all")
        ws.drop("members", "now", "open", "rare", "rare-bands", "sets", "links-0", "links-1")

    copies = nodes.filter("copies > 1").select(*same, "rep")
    out = sketch.select("doc_id", *same).join(copies, same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    if labels is not None:
        out = out.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    else:
        out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            yield b.select(["a", "b"]).filter(pa.array([linked(set_at(x, i), set_at(y, i), percent) for i in range(b.num_rows)], pa.bool_()))

    each = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    each = each.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    return each.select("a", "b", "of_a", "of_b").mapInArrow(confirm, "a long, b long").distinct()


def _apart(members: DataFrame) -> DataFrame:
    """Bands of members (band, n, component) in several components: band, the largest component (big), its shingles
    (largest) and those of all others (others)."""
    each = members.groupBy("band", "component").agg(F.sum(F.greatest("n", F.lit(BLOCK // 1024))).alias("load"))
    bands = each.groupBy("band").agg(F.max(F.struct("load", "component")).alias("top"), F.sum("load").alias("load"), F.count("*").alias("parts"))
    return bands.filter("parts > 1").select("band", F.col("top.component").alias("big"), F.col("top.load").alias("largest"), (F.col("load") - F.col("top.load")).alias("others"))


def _rarest(members: DataFrame, sets: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Bands of members (rep, component) that share one of their rarest shingles: band, rep, n, component, and _apart()'s.

    Of n shingles, the rarest among these members first, the first n - ceil(n * percent / 100) + 1 make the bands: two sets
    that are similar enough share one of these, whatever the order, and the rarer they are the fewer others do. Of bands
    with the same members one stays.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = set_at(b.column(2), i)
                rows = [pa.array(np.full(len(x), v)) for v in (b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(x))]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(x.view(np.int64))], ["rep", "component", "n", "shingle"])

    held = members.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").select("rep", "component", "shingles")
    each = ws.keep(held.mapInArrow(spread, "rep long, component long, n long, shingle long"), "rare")
    holders = each.groupBy("shingle").agg(F.count("*").alias("df"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    ranked = each.join(holders, "shingle").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    bands = ranked.select("rep", "component", "n", F.explode(F.slice("all", 1, prefix)).alias("x")).filter("x.df > 1").select(F.col("x.shingle").alias("band"), "rep", "n", "component")
    who = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 31))).alias("s"), F.count("*").alias("m")]
    sizes = bands.groupBy("band").agg(*who, F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    once = sizes.groupBy("x", "s", "m").agg(F.min("band").alias("band")).select("band")
    bands = ws.keep(bands.join(once, "band"), "rare-bands")
    return bands.join(_apart(bands), "band")


def _rest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (band, rep, component, and _apart()'s) of one band that lie in different components."""
    return _compared(_dealt(open_), sets, percent, _alike)


def _dealt(open_: DataFrame) -> DataFrame:
    """The members in blocks that are compared in one task: band, i, j, rep, component.

    A band of more than BLOCK shingles is cut by a hash of the member into blocks of about as many: those of the largest
    component each meet those of the others, and these meet each other; a task compares two blocks of a band.
    """
    whole = F.col("largest") + F.col("others") <= BLOCK
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    a, b = blocks("largest"), blocks("others")
    big = F.col("component") == F.col("big")
    own = F.pmod(F.xxhash64("rep"), F.when(big, a).otherwise(b)).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    meets = (
        F.when(whole, F.array(pair(F.lit(0), F.lit(0))))
        .when(big, F.transform(numbers(b), lambda k: pair(own, a + k)))
        .otherwise(F.concat(F.transform(numbers(a), lambda k: pair(k, a + own)), F.transform(numbers(b), lambda k: pair(a + F.least(own, k), a + F.greatest(own, k)))))
    )
    return open_.select("band", "rep", "component", F.explode(meets).alias("at")).select("band", "at.i", "at.j", "rep", "component")


def _compared(dealt: DataFrame, sets: DataFrame, percent: int, alike: Callable) -> DataFrame:
    """Links within the blocks; alike(sets, components, percent) gives the matrix of links between sets."""
    rows = dealt.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            for i, (*k, rep, component) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                if k != key:
                    yield from _joined(group, percent, alike)
                    key, group = k, []
                group.append((rep, component, set_at(b.column(5), i).copy()))  # else a batch would stay for the group's sake
        yield from _joined(group, percent, alike)

    return rows.select("band", "i", "j", "rep", "component", "shingles").mapInArrow(compare, "a long, b long").distinct()


def _alike(sets: list[np.ndarray], part: np.ndarray, percent: int) -> np.ndarray:
    same = common(sets)
    size = np.array([len(x) for x in sets])
    return (100 * same >= percent * (size[:, None] + size[None, :] - same)) & (part[:, None] != part[None, :])


def _joined(group: list[tuple[int, int, np.ndarray]], percent: int, alike: Callable) -> Iterator[pa.RecordBatch]:
    """Edges that join the members which links connect: the smallest of them with each other one."""
    if len({c for _, c, _ in group}) < 2:
        return
    ids = np.array([r for r, _, _ in group])
    link = alike([x for _, _, x in group], np.array([c for _, c, _ in group]), percent)
    if not link.any():
        return
    root = ids.copy()
    while True:
        near = np.where(link, root[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, near)
        if (new == root).all():
            break
        root = new
    moved = root != ids
    yield pa.RecordBatch.from_arrays([pa.array(root[moved]), pa.array(ids[moved])], ["a", "b"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common values of every two sets."""
    m = len(sets)
    value, who = by_value(sets)
    out = np.zeros(m * m, np.int64)
    add_common(out, m, value, who)
    return out.reshape(m, m)


def by_value(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sets' values, ascending, and the set of each."""
    value = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    return value[order], who[order]


def add_common(out: np.ndarray, m: int, value: np.ndarray, who: np.ndarray) -> None:
    """Add to the m x m counts (flat) what each value's holders have in common; values ascend."""
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    length = np.diff(np.append(begin, len(value)))
    for n in np.unique(length[length <= DENSE]).tolist():
        at = begin[length == n]
        for step in range(0, len(at), 1 << 14):
            w = who[at[step : step + (1 << 14), None] + np.arange(n)]
            out += np.bincount((w[:, :, None] * m + w[:, None, :]).ravel(), minlength=m * m)
    at = np.flatnonzero(length > DENSE)
    for step in range(0, len(at), 1024):
        some = at[step : step + 1024]
        held = np.zeros((m, len(some)), np.float32)
        held[who[gather_ranges(begin[some], length[some])], np.repeat(np.arange(len(some)), length[some])] = 1
        out += (held @ held.T).astype(np.int64).ravel()
