"""Phrase collocations by level-wise passes (Apriori): k words on end are counted only where both phrases of k - 1 words that
overlap in them are frequent.

Level k reads all texts once. The frequent phrases of level k - 1 reach the workers as a bitmap of their hashes, never larger
than 2^BITMAP_BITS bits: where two phrases share their bits a few rare ones are counted in vain, and the exact counts drop
them again, so the result is the same for a bitmap of any size. Counts combine within a chunk, within a task and before the
shuffle, so a phrase or a language that holds a third of all words is no hot spot. The levels are tables of phrases with
their counts; cuts are scored by joining them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ragged import LOWER, U64, Texts, Words, byte_table, chunks, gather_ranges, mix, word_hashes, words
from .tables import Workspace

MIN_COUNT, LONGEST, TOP, SCALE = 100, 5, 2000, 1000
UNKNOWN = "und"
#: Bits of the largest bitmap of frequent phrases, 32 MB; smaller levels take 16 bits a phrase.
BITMAP_BITS = 28
#: Shares into which a language's phrases are dealt to be ranked; a task gets SHARES times `top` phrases at last.
SHARES = 128
#: Bytes of texts whose phrases are counted at once.
COUNTED = 1 << 22

#: Fixed values of the contract: what ends a piece, and what is no part of a word within one.
ENDS = byte_table(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
INSIDE = ~(ENDS | byte_table((0x20, 0x20), (0x09, 0x09)))


def lang_value(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def room(t: Texts, w: Words) -> np.ndarray:
    """How many words of its piece stand from each word on, itself included."""
    n = len(w.start)
    ends = np.concatenate([[0], np.cumsum(ENDS[t.buf])])
    piece = np.concatenate([ends[w.start[1:]] != ends[w.start[:-1]], [True]]) if n else np.zeros(0, bool)
    piece[w.woff[1:][w.woff[1:] > 0] - 1] = True  # a row's last word
    last = np.flatnonzero(piece)
    return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


_STEP = U64(0x9E3779B97F4A7C15)


def phrase_hashes(h: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on, whatever follows; h and lang are the words' and their languages' values."""
    n = max(len(h) - k + 1, 0)
    out = mix(lang[:n] + U64(k))
    for j in range(k):
        out = mix(out * _STEP + h[j : j + n])
    return out


def phrase_bytes(t: Texts, w: Words, first: np.ndarray, k: int) -> pa.Array:
    """The k words from each of these words on, A-Z lower-cased, with one blank between them."""
    which = (first[:, None] + np.arange(k)).ravel()
    length = w.end[which] - w.start[which]
    to = np.cumsum(length + 1)  # a blank behind each word
    flat = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    flat[gather_ranges(to - 1 - length, length)] = LOWER[t.buf[gather_ranges(w.start[which], length)]]
    keep = np.ones(len(flat), bool)
    keep[to[k - 1 :: k] - 1] = False  # but the last
    off = np.concatenate([[0], to[k - 1 :: k] - np.arange(1, len(first) + 1)]).astype(np.int64)
    data = pa.py_buffer(flat[keep].tobytes())
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(off.tobytes()), data).cast(pa.string())


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = U64(64 - bits)
    return (h >> shift).astype(np.int64), (mix(h + _STEP) >> shift).astype(np.int64)


def _known(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    a, b = probes(h, bits)
    set_ = lambda x: (bitmap[x >> 3] >> (x & 7).astype(np.uint8)) & 1
    return (set_(a) & set_(b)).astype(bool)


def _counter(k: int, filters) -> Callable:
    """Counts of the phrases of k words of (text, lang) rows; filters: the bitmap of those of k - 1 words, and its bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).dictionary_encode()
            names = [x for x in langs.dictionary.to_pylist()]
            values, code = np.array([lang_value(x) for x in names], np.uint64), langs.indices.to_numpy(zero_copy_only=False)
            for t in chunks(b.column(0), COUNTED):
                w = words(t, INSIDE)
                row = w.rows()
                of = code[t.lo : t.hi][row]
                h, lang = word_hashes(t, w), values[of] if len(values) else np.zeros(0, np.uint64)
                at = np.flatnonzero(room(t, w) >= k)
                if k > 1:
                    bitmap, bits = filters.value
                    frequent = _known(bitmap, bits, phrase_hashes(h, lang, k - 1))
                    at = at[frequent[at] & frequent[at + 1]]
                key, first, n = np.unique(phrase_hashes(h, lang, k)[at], return_index=True, return_counts=True)
                if k == 1:
                    total = np.bincount(of, minlength=len(names))
                    yield _counts(pa.array(names, pa.string()), pa.array([""] * len(names), pa.string()), total)
                if len(key):
                    yield _counts(pa.array(names, pa.string()).take(pa.array(of[at[first]])), phrase_bytes(t, w, at[first], k), n)

    return count


def _counts(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n.astype(np.int64))], ["lang", "phrase", "f"])


def _bits(k: int, bits: int) -> Callable:
    """Words of 64 bits of the bitmap that phrases of k words (lang, phrase) set: at, mask."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            value = {x: lang_value(x) for x in set(names)}
            lo = 0
            for t in chunks(b.column(1)):
                w = words(t, INSIDE)
                lang = np.repeat(np.array([value[x] for x in names[lo : lo + t.hi - t.lo]], np.uint64), k)
                h = phrase_hashes(word_hashes(t, w), lang, k)[::k]
                at = np.concatenate(probes(h, bits))
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "mask"])
                lo += t.hi - t.lo

    return each


def bitmap(level: DataFrame, k: int, phrases: int, most: int = BITMAP_BITS) -> tuple[np.ndarray, int]:
    """The bitmap of a level's phrases: or-ed by Spark, so that the driver holds no more than the bitmap itself."""
    bits = min(max(16, (16 * phrases - 1).bit_length() if phrases else 0), most)
    set_ = level.select("lang", "phrase").mapInArrow(_bits(k, bits), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[set_.column("at").to_numpy()] = set_.column("mask").to_numpy()
    return out.view(np.uint8), bits


def levels(df: DataFrame, ws: Workspace, min_count: int = MIN_COUNT, longest: int = LONGEST, most: int = BITMAP_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """Of rows (text, lang) all words of each language (lang, n), and for 1 to `longest` words the frequent phrases (lang, phrase, f)."""
    spark = df.sparkSession
    tables: list[DataFrame] = []
    filters = total = None
    for k in range(1, longest + 1):
        counts = df.mapInArrow(_counter(k, filters), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        level = ws.keep(counts.filter((F.col("f") >= min_count) | (F.col("phrase") == "")), f"level-{k}")
        if k == 1:
            total = level.filter("phrase = ''").select("lang", F.col("f").alias("n"))
            level = level.filter(f"phrase != '' AND f >= {min_count}")
        tables.append(level)
        size = level.count()
        if not size:
            break
        if k < longest:
            filters = spark.sparkContext.broadcast(bitmap(level, k, size, most))
    return total, tables


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, most: int = BITMAP_BITS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z lower-cased) are cut at punctuation and line ends into pieces, these at blanks and tabs into words. n counts a
    language's words, f(phrase) its occurrences within pieces. Candidates have 2 to `longest` words and a = f >= min_count; a
    cut into l = f(first part) and r = f(rest) scores floor(1000 a n / (l r)), computed as decimals, and the lowest cut counts,
    of equal ones the first. A candidate within a longer one that is as frequent is dropped. Order: score, a, then the
    phrase's bytes.

    Null and empty texts have no words, a null lang is `und`; repeated rows count each. Very long texts are read whole, as a
    chunk of their own; an empty table gives no rows. Other columns are left out, so their names can't clash.
    """
    ws = Workspace(df.sparkSession, "phrases")
    rows = df.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    total, tables = levels(rows, ws, min_count, longest, most)
    every = reduce(DataFrame.union, tables)
    found = reduce(DataFrame.union, tables[1:]) if len(tables) > 1 else every.limit(0)
    return ranked(found, every, total, ws, top)


def ranked(found: DataFrame, every: DataFrame, total: DataFrame, ws: Workspace, top: int) -> DataFrame:
    """Scores of the candidates (lang, phrase, f) from the tables of all levels and of all words."""
    w = F.split("phrase", " ", -1)
    inner = found.filter(F.size(w) > 2).select("lang", "f", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))).alias("phrase"))
    # a phrase is never more frequent than one within it, so a longer one that counts has a chain of equal counts down to it
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stay = found.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * f").select("lang", "phrase", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.size(w) - 1))
    cuts = stay.select("lang", "phrase", "a", w.alias("w"), cut.alias("k"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    score = F.expr(f"(CAST(a AS DECIMAL(18, 0)) * CAST({SCALE} AS DECIMAL(4, 0)) * CAST(n AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = ws.keep(lowest.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score")), "scored")
    # the first of each share of a language's phrases, then of these: no task gets all phrases of a language
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    some = scored.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top).drop("rank")
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> str:
    """collocations() of the table documents, in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS words
  FROM worded, range(1, {longest} + 1) AS ks(k), range(1, len(w) - k + 2) AS starts(i)
), f AS (
  SELECT lang, k, phrase, any_value(words) AS words, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {min_count}
), inner_ AS (
  SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(f) AS longer
  FROM f, range(2, k) AS ms(m), range(1, k - m + 2) AS ss(s) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, cut, ({SCALE} * c.f::HUGEINT * t.n::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM f c, range(1, c.k) AS places(cut), f x, f y, total t
  WHERE c.k > 1 AND x.lang = c.lang AND y.lang = c.lang AND t.lang = c.lang
    AND x.phrase = array_to_string(c.words[1:cut], ' ') AND y.phrase = array_to_string(c.words[cut + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= {top}"""
