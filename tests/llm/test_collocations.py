"""Collocations against a count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import collocations as co
from tributary.llm.ragged import chunks, word_hashes, words
from tributary.llm.tables import Workspace


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    held = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    best = {}
    for (lang, long), c in held.items():
        for k in range(2, len(long)):
            for i in range(len(long) - k + 1):
                key = (lang, long[i : i + k])
                best[key] = max(best.get(key, 0), c)
    out = {}
    for (lang, p), a in held.items():
        if 100 * best.get((lang, p), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((" ".join(p), a, left, right, n[lang], score))
    return sorted((lang, i + 1, *x) for lang, v in out.items() for i, x in enumerate(sorted(v, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]))


def corpus(seed, n=400):
    rng = random.Random(seed)
    common = ["the", "of", "Und", "é", "日本", "x-y", "a"]
    stock = ["new york city hall", "in the end", "at at at", "one two three four five six", "é é"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 14)):
            parts.append(rng.choice(stock) if rng.random() < 0.4 else rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(300)}")
            parts.append(rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", ";", "\r\n", "\x0b", " \x00 "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "fr", None, ""])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_are_those_of_all_counts(spark, seed, monkeypatch):
    rows = [*corpus(seed), (None, "en"), ("", "de"), ("solo", "de"), *[("in the end", "en")] * 3, ("in the end " * 9000, "fr")]
    df = spark.createDataFrame([(t, x, 1, "clash") for t, x in rows], "text string, lang string, rank int, phrase string").repartition(5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 8)
    for most in (28, 16, 7):  # a bitmap that is full counts more, with the same result
        found = co.collocations(df, min_count=8, most=most)
        assert found.columns == columns
        assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(co, "COUNTED", 300)
    assert sorted(map(tuple, co.collocations(df, min_count=8, longest=3, top=4).collect())) == brute(rows, 8, 3, 4)


def test_counts_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits are exact."""
    a, n, le, r = 10**12 + 1, 10**13 + 7, 10**12 + 3, 10**12 + 9
    every = spark.createDataFrame([("en", "x", le), ("en", "y", r), ("en", "x y", a)], "lang string, phrase string, f long")
    total = spark.createDataFrame([("en", n)], "lang string, n long")
    got = co.ranked(every.filter("phrase = 'x y'"), every, total, Workspace(spark, "t"), 5).collect()
    assert [tuple(x) for x in got] == [("en", 1, "x y", a, le, r, n, 1000 * a * n // (le * r))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(none).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None), ("", "en"), ("., !", "en")], "text string, lang string"), min_count=1).count() == 0
    assert co.collocations(spark.createDataFrame([("a b", None)], "text string, lang string"), min_count=1).select("lang", "phrase", "score").collect() == [("und", "a b", 2000)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\t\n\x0b\x0c\r\x1f é", max_size=25), min_size=1, max_size=5), st.integers(1, 4))
def test_phrases_of_a_chunk(rows, k):
    found = Counter()
    for t in chunks(pa.array(rows, pa.string())):
        w = words(t, co.INSIDE)
        at = np.flatnonzero(co.room(t, w) >= k)
        h = co.phrase_hashes(word_hashes(t, w), np.zeros(len(w.start), np.uint64), k)
        texts = co.phrase_bytes(t, w, at, k).to_pylist()
        found.update(texts)
        assert len({(int(x), y) for x, y in zip(h[at], texts, strict=True)}) == len(set(texts)) == len(set(h[at].tolist()))
    assert found == Counter(" ".join(w[i : i + k]) for x in rows for w in pieces(x) for i in range(len(w) - k + 1))
