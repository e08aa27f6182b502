"""The n-gram join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import near_dups, ngram_join
from tributary.llm.ngram_join import deciding, open_pairs, product_links


def shingles(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] == rows[j][0] or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[y] = x
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def corpus(seed, n=160):
    """Short and long texts, groups of exact and near copies, chains of edits, and a line that a third of all share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno") + str(rng.randrange(60))
    line = " ".join(word() for _ in range(30))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([1, 2, 3, 9, 12, 13, 21, 40, 120, 400]))]
        if rng.random() < 0.33:
            base += line.split()
        for _ in range(rng.choice([1, 1, 1, 2, 5, 14])):
            out.append(" ".join(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):  # a chain: each text is an edit of the one before
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base = base[: max(1, len(base) - 1)]
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize(("block", "many"), [(40, 8), (400, 8), (40, 0)])
def test_small_blocks(spark, monkeypatch, block, many):
    """Large columns are cut into blocks, and beyond `many` of these their members meet by their rarest n-grams."""
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(9, 120)
    assert sorted(map(tuple, ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_columns_that_decide(rng=random.Random(4)):
    """Linked sets share one of their deciding n-grams in any common order; sets that have none link with equal ones only."""
    for _ in range(3000):
        n = rng.randrange(1, 60)
        a = set(range(n))
        b = set(a)
        for _ in range(rng.randrange(0, 1 + n // 8)):
            b.discard(rng.randrange(n))
        b |= {100 + i for i in range(rng.randrange(0, 1 + n // 10))}
        if not b or a == b or 100 * len(a & b) < 90 * len(a | b):
            continue
        order = list(range(200))
        rng.shuffle(order)
        x, y = (sorted(s, key=lambda v: order[v])[: int(deciding(np.array([len(s)]), 90)[0])] for s in (a, b))
        assert set(x) & set(y)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_discarded_by_its_deciding_columns(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for n in rng.integers(9, 80, 12):
        base = rng.choice(5000, int(n), replace=False)
        for _ in range(6):
            edit = np.where(rng.random(n) < rng.choice([0, 0.02, 0.06, 0.3]), rng.integers(5000, 9000, n), base)
            sets.append(np.unique(edit[rng.random(n) < rng.choice([1, 0.97])]))
    sets = [s for s in sets if deciding(np.array([len(s)]), 90)[0]]
    columns = [s[: int(deciding(np.array([len(s)]), 90)[0])] for s in sets]
    size, part = np.array([len(s) for s in sets]), np.arange(len(sets))
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    link = (100 * both >= 90 * (size[:, None] + size[None, :] - both)) & (part[:, None] != part[None, :])
    open_ = open_pairs(columns, size, part, 90)
    assert link.any() and not (link & ~open_).any() and (open_ == open_.T).all() and open_.sum() < open_.size / 2


@pytest.mark.parametrize("slices", [1, 8, 64])
def test_product_is_all_overlaps(slices):
    rng = np.random.default_rng(slices)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.choice(base, int(n), replace=False), rng.integers(0, 2**63, 3, dtype=np.uint64)])) for n in rng.integers(330, 401, 40)]
    sets += [s[rng.random(len(s)) < 0.97] for s in sets]
    part = np.arange(len(sets))
    part[5] = part[4]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(s) for s in sets])
    want = (100 * want >= 90 * (size[:, None] + size[None, :] - want)) & (part[:, None] != part[None, :])
    assert want.any() and (product_links(sets, part, 90, slices) == want).all()


def test_levels_count_all_texts(spark):
    texts = ["a b c d", "a b c", "a b c x", None, ""] * 3
    levels = ngram_join.frequency_levels(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), 3)
    values = {t: next(near_dups.shingle_sets(pa.array([t]), 3))[0] for t in ("a b c", "b c d", "q r s")}
    assert [int(levels[ngram_join._slot(v)][0]) for v in values.values()] == [6, 3, 0] and len(levels) == ngram_join.SLOTS


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, long), (9, long + " end"), (9, long + " end"), (10, "x"), (None, "one"), (None, long), (11, "été à été"), (12, "ÉTÉ à été")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, band int")
    found = sorted(map(tuple, ngram_join.ngram_join(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = 30000 - 2
    assert found == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, n, 8), (9, n + 1, 8), (9, n + 1, 8), (10, 1, 10), (11, 1, 11), (12, 1, 12), (None, 1, None), (None, n, None)]


def test_empty_table(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
