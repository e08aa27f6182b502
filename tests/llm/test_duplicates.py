"""Near-duplicates, neighbours and leaks against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import decontamination, near_dups, neighbours
from tributary.llm.components import components
from tributary.llm.decontamination import leaks
from tributary.llm.near_dups import common, near_duplicates, shingle_sets
from tributary.llm.neighbours import nearest, smallest_copies
from tributary.llm.tables import Workspace


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sets_of(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, root = [(i, sets_of(x)) for i, x in rows if i is not None], {}
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed, n=160):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[g.choice(vocabulary) for _ in range(g.randint(1, 120))] for _ in range(n // 4)]
    passage = [g.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        w = list(g.choice(base))
        for _ in range(g.choice([0, 0, 1, 2, 4, 9])):
            w[g.randrange(len(w))] = g.choice(vocabulary)
        if g.random() < 0.3:
            w = passage + w[: g.randint(0, 15)]
        out.append((i * 3, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = corpus(seed) + [(1, None), (2, ""), (4, " \n"), (5, None), (7, "One two"), (8, "one  TWO"), (10, "two one"), (11, "a"), (13, "a")]
    g = random.Random(seed)
    g.shuffle(rows)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute(rows)
    assert all(r.n_shingles == len(sets_of(dict(rows)[i])) and r.kept == (i == r.component_id) for i, r in got.items())


def test_large_group_of_near_copies(spark):
    g = random.Random(3)
    base = [f"x{i}" for i in range(90)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(g.randint(0, 3)):
            w[g.randrange(90)] = f"y{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_without_id_repeats_and_clashes(spark):
    rows = [(None, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "a b c d e f", "y"), (3, "A b c d e F", "z"), (9, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got.collect()) == [("3", 3, True), ("5", 3, False), ("5", 3, False), ("9", 9, True), ("None", None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_compare_all(spark, monkeypatch):
    """Bands cut into many blocks give the same components."""
    monkeypatch.setattr(near_dups, "BLOCK", 1024 * 4)
    rows = corpus(7, 200)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_crowd_that_shares_a_line(spark, monkeypatch):
    """Short texts around one frequent line: large bands without many links, resolved by their rarest shingles."""
    monkeypatch.setattr(near_dups, "BLOCK", 1024 * 2)
    g = random.Random(13)
    line = "all rights reserved by the owner of this page"
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(5))
    rows = [(i, f"{word()} {line} {' '.join(word() for _ in range(g.randint(0, 9)))}") for i in range(400)]
    rows += [(1000 + i, t + g.choice(["", " " + word()])) for i, (_, t) in enumerate(g.sample(rows, 120))]
    seen = []
    rarest = near_dups._rarest
    monkeypatch.setattr(near_dups, "_rarest", lambda *a: seen.append(1) or rarest(*a))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen and got == brute(rows)


@pytest.mark.parametrize(("union", "common_"), [(4, 3), (8, 6), (12, 9), (16, 12), (20, 15), (21, 16)])
def test_no_small_pair_is_missed(union, common_):
    """Pairs at the threshold exactly, one of them with 16 shingles at most, share a key for certain."""
    g = np.random.default_rng(union)
    n = 40_000
    values = g.integers(0, 2**63, (n, union), dtype=np.uint64)
    more = g.integers(0, union - common_ + 1, n)  # how many of the rest belong to the first set
    for k in range(union - common_ + 1):
        some = values[more == k]
        x, y = (np.sort(z, 1) for z in (some[:, : common_ + k], np.concatenate([some[:, :common_], some[:, common_ + k :]], 1)))
        if min(x.shape[1], y.shape[1]) > near_dups.SMALL:
            continue
        (a, la), (b, lb) = (near_dups.prefix_keys(z.ravel(), np.arange(len(z) + 1) * z.shape[1], 75) for z in (x, y))
        a, b = a.reshape(len(x), -1), b.reshape(len(y), -1)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()


def test_links_of_short_texts(spark):
    """Thousands of pairs of seven and eight words, at three of four shingles: all are linked."""
    g = random.Random(12)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(4000):
        w = [word() for _ in range(8)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:7]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(4000))


def test_common_counts():
    g = np.random.default_rng(0)
    sets = [np.unique(g.integers(0, 60, g.integers(1, 50))).astype(np.uint64) for _ in range(70)]
    assert (common(sets) == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]).all()


def test_shingles_of_short_texts():
    got = [np.diff(off).tolist() for _, off in shingle_sets(pa.array(["", None, "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a"]))]
    assert got == [[0, 0, 1, 1, 1, 2, 1]]


def test_components(spark):
    g = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(g.randrange(200, 260), g.randrange(200, 260)) for _ in range(40)]
    links = [(min(a, b), max(a, b)) for a, b in links if a != b]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test"), "c").collect()}
    low = {x: x for p in links for x in p}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low


@pytest.mark.parametrize("unit", [True, False])
def test_neighbours_against_all_products(spark, unit):
    g = np.random.default_rng(2)
    v = g.standard_normal((1500, 24)).astype(np.float32)
    v[700:760] = v[3]
    v[800] = 2 * v[20]
    if unit:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(v)]
    rows += [(5000, None, ""), (5020, [0.0] * 24, ""), (5040, [float("nan")] * 24, ""), (5060, [None] + [1.0] * 23, ""), (5080, [1.0], ""), (None, [1.0] * 24, ""), (5100, [float("inf")] * 24, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = nearest(df, df.filter("vec_id % 20 = 0")).collect()
    w = v.astype(float)
    recall = []
    assert {r.query_id for r in got} == set(range(0, 1500, 20))
    for q in range(0, 1500, 20):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        s = (w * w[q]).sum(1)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in [i for _, i, _ in mine]
        assert [x for _, _, x in mine] == [s[i] for _, i, _ in mine]
        assert [(-x, i) for _, i, x in mine] == sorted((-x, i) for _, i, x in mine)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        recall.append(len(set(best.tolist()) & {i for _, i, _ in mine}) / 20)
    assert np.mean(recall) >= 0.9
    copies = [r.vec_id for r in sorted((r for r in got if r.query_id == 700), key=lambda r: r["rank"])]
    assert copies == [3, *range(701, 720)] or not unit


@pytest.mark.parametrize("norms", ["one of 2", "one of 4", "sigma 0.2", "sigma 0.5", "sigma 0.5, one of 1e6"])
def test_neighbours_of_unequal_norms(spark, norms):
    g = np.random.default_rng(6)
    v = g.standard_normal((20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if "sigma" in norms:
        v *= np.exp(float(norms.split()[1].strip(",")) * g.standard_normal((len(v), 1)))
    if "one of" in norms:
        v[777] *= float(norms.split()[-1])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))})).repartition(3)
    found = {}
    for r in nearest(df, df.filter("vec_id % 200 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    s = v[::200] @ v.T
    s[np.arange(len(s)), np.arange(0, len(v), 200)] = -np.inf
    best = np.argpartition(-s, 20, 1)[:, :20]
    assert np.mean([len(set(b.tolist()) & found[200 * i]) / 20 for i, b in enumerate(best)]) >= 0.9


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.5])], kind)
    got = nearest(df, df.filter("vec_id % 20 = 0")).collect()
    assert {r.vec_id for r in got} == {1, 2} and len(got) == 2
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_few_rows_are_all_candidates(spark):
    v = np.random.default_rng(3).standard_normal((15, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [int(i) for i in np.argsort(-(v @ v[0])) if i]


@pytest.mark.parametrize("n", [500, 1500, 5000])
def test_recall_comes_from_hashing(spark, n):
    """However few rows there are, not all of them are compared, and recall holds."""
    g = np.random.default_rng(n)
    v = g.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))})).repartition(3)
    found = {}
    for r in nearest(df, df.filter("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    s = v[::20] @ v.T
    s[np.arange(len(s)), np.arange(0, n, 20)] = -np.inf
    best = np.argpartition(-s, 20, 1)[:, :20]
    assert np.mean([len(set(b.tolist()) & found[20 * i]) / 20 for i, b in enumerate(best)]) >= 0.9
    turn = neighbours.Rotations(64, neighbours.norm_bands({0: n}), 20)
    seen = np.zeros((len(s), n), bool)
    for t in range(neighbours.TABLES):
        sizes = np.bincount(turn.bucket(v, t), minlength=2 * turn.size)
        seen |= turn.probed(v[::20], t, turn.probes(n, 20), sizes, 21)[:, turn.bucket(v, t)]
    assert seen.mean() < 0.85


@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 30))
@settings(max_examples=100, deadline=None)
def test_parts_hold_every_bucket_once(sizes, rows):
    p = neighbours.Parts(np.array(sizes), rows)
    for b, n in enumerate(sizes):
        own = [i for i, x in enumerate(p.buckets) if b in x]
        assert own == list(range(p.first[b], p.first[b] + p.cut[b])) and len(own) == (0 if not n else -(-n // rows))
        assert not n or (p.buckets[own[0]][p.place[b]] == b)
    assert all(len(x) == 1 or sum(sizes[b] for b in x) <= rows for x in p.buckets)


def test_queries_go_to_the_parts_they_probe(spark, monkeypatch):
    """Parts of one row's size: results are as with large ones."""
    v = np.random.default_rng(8).standard_normal((900, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = lambda: sorted(map(tuple, nearest(df, df.filter("vec_id % 20 = 0"), 5).collect()))
    whole = rows()
    monkeypatch.setattr(neighbours, "PART", 1)
    monkeypatch.setattr(neighbours, "LEAST", 40)
    assert rows() == whole


def test_smallest_copies():
    v = np.array([[1.0], [1.0], [2.0], [1.0], [1.0]])
    assert smallest_copies(v, np.array([9, 4, 1, 4, 7]), 2).tolist() == [1, 2, 4]


def passages(seed=5):
    g = random.Random(seed)
    vocabulary = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7))) for _ in range(900)]
    common_ = vocabulary[:25]
    say = lambda n: [g.choice(common_) if g.random() < 0.35 else g.choice(vocabulary) for _ in range(n)]
    return g, say


def test_leaks(spark):
    g, say = passages()
    items = [say(g.randint(14, 60)) for _ in range(30)] + [say(150)]
    bench = [(i, " ".join(x[:-4]) + ". " + " ".join(x[-4:]) + ".") for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "...")]
    docs, truth = [], set()
    for d in range(300):
        w = say(g.randint(5, 400))
        if d % 6 == 0:
            i = g.randrange(30)
            x = list(items[i])
            for _ in range(len(x) // 10 if d % 12 else 0):
                x[g.randrange(len(x) - 4)] = g.choice(say(1))
            at = g.randrange(len(w))
            w = w[:at] + x + w[at:]
            truth.add((d, i))
        docs.append((d, " ".join(w).upper(), "clash"))
    docs += [(500, " ".join(items[30][40:110]), ""), (None, " ".join(items[0]), ""), (501, None, ""), (502, "", ""), (503, " ".join(items[2]), ""), (503, " ".join(items[2]), "")]
    truth |= {(500, 30), (None, 0), (503, 2)}
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth and len(rows) == len(truth)
    assert all(0.6 <= r.similarity <= 1 for r in rows)


def subsequence(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_leaks(docs, items):
    """(doc, item) by the definition, over every place of every document; items: their passages and answers, as words.

    Windows that don't hold 0.6 of a passage's number of its words are passed over: no subsequence is longer.
    """
    out = set()
    for d, words in docs:
        for i, passage, answer in items:
            m = len(passage)
            width = decontamination.span(m)
            member = np.isin(np.array(words, dtype=object).astype(str), passage) if words else np.zeros(0, bool)
            held = np.concatenate([[0], np.cumsum(member)])
            at = np.arange(max(1, len(words) - width + 1))
            for a in at[held[np.minimum(at + width, len(words))] - held[at] >= 0.6 * m]:
                c = subsequence(passage, words[a : a + width])
                if c >= 0.85 * m or (c >= 0.6 * m and subsequence(answer, words[max(0, a - len(answer)) : a + width + len(answer)]) >= 0.6 * len(answer)):
                    out.add((d, i))
                    break
    return out


def edited(g, words, rate, say):
    """words with a share of places replaced, dropped or followed by another word."""
    out = []
    for w in words:
        if g.random() >= rate:
            out.append(w)
            continue
        kind = g.randrange(3)
        out += [say(1)[0]] if kind == 0 else [] if kind == 1 else [w, say(1)[0]]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2, 0.3])
def test_leaks_by_brute_force(spark, rate):
    """Every window of every document against every item: what is found is right, and at each rate of edits nearly all is found."""
    g, say = passages(20 + int(rate * 10))
    items = {i: say(g.randint(20, 60)) for i in range(20)}
    bench = [(i, " ".join(w[:-5]) + ". " + " ".join(w[-5:]) + ".") for i, w in items.items()]
    docs = []
    for d in range(90):
        w = say(g.randint(20, 160))
        if d % 2 == 0:
            at = g.randrange(len(w))
            w = w[:at] + edited(g, items[g.randrange(20)], rate, say) + w[at:]
        docs.append((d, w))
    want = brute_leaks(docs, [(i, w, w[-5:]) for i, w in items.items()])
    rows = leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(want) > 30 and got <= want and len(got) >= 0.9 * len(want)


def test_benchmark_in_groups(spark, monkeypatch):
    g, say = passages(30)
    items = [say(30) for _ in range(12)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(say(40) + (items[d % 12] if d < 24 else []) + say(40))) for d in range(80)], "doc_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "GROUP_TERMS", 90)
    assert len(list(decontamination.groups((i, " ".join(x)) for i, x in enumerate(items)))) > 2
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == whole == {(d, d % 12) for d in range(24)}


def test_latent_basis_is_the_svd_s():
    """The projection onto the sketch gives the eigenvectors of A^T A."""
    g = np.random.default_rng(1)
    a = g.standard_normal((400, 300)) * (0.9 ** np.arange(300))
    o = g.standard_normal((300, decontamination.RANK + decontamination.OVERSAMPLE))
    basis = decontamination.latent_basis(a.T @ (a @ o), o)
    _, _, right = np.linalg.svd(a, full_matrices=False)
    assert np.abs(basis[:20] @ right[:20].T).diagonal() == pytest.approx(np.ones(20), abs=1e-2)
    assert basis @ basis.T == pytest.approx(np.eye(len(basis)), abs=1e-4)


def test_answers_decide_on_paraphrases(spark):
    g, say = passages(8)
    body, answer = say(36), ["zz1", "zz2", "zz3", "zz4"]
    bench = spark.createDataFrame([(1, " ".join(body) + ". " + " ".join(answer))], "item_id long, text string")
    other = list(body)
    for i in range(0, 36, 4):
        other[i] = f"q{i}"
    docs = [(1, " ".join(other + answer)), (2, " ".join(other + say(4)))] + [(10 + i, " ".join(say(80))) for i in range(60)]
    got = {r.doc_id for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1}


def test_leak_that_a_third_of_the_passages_hold(spark):
    """The leak itself lifts all words of its item over the share from which on words carry no weight."""
    g, say = passages(11)
    items = [say(30) for _ in range(4)]
    rare = [f"rare{i}" for i in range(30)]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(7, " ".join(rare))]
    docs = [(d, " ".join(rare if d % 3 == 0 else say(40))) for d in range(240)] + [(900, " ".join(items[1])), (901, " ".join(say(70) + rare[:27] + say(70)))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 7) for d in range(0, 240, 3)} | {(900, 1), (901, 7)}
    assert all(r.cosine > 0.4 for r in got)


@pytest.mark.parametrize("common", [7, 10, 12, 13, 14, 17])
def test_leaks_that_keep_the_lightest_words(spark, common):
    """Items of 24 words, 30 to 70 % of them frequent; their leaks keep all frequent words and the fewest others."""
    g, say = passages(40 + common)
    often = [f"of{i}" for i in range(40)]
    filler = lambda n: [g.choice(often) if g.random() < 0.3 else say(1)[0] for _ in range(n)]
    items, docs = {}, [(d, filler(120)) for d in range(100)]
    for i in range(20):
        w = g.sample(often, common) + [f"item{i}x{j}" for j in range(24 - common - 4)]
        g.shuffle(w)
        items[i] = w + [f"answer{i}x{j}" for j in range(4)]
        keep = [w for w in items[i] if w in often or w.startswith("answer")]
        more = max(0, 15 - len(keep))
        keep += [w for w in items[i] if w not in keep][:more]
        docs.append((500 + i, say(30) + [w for w in items[i] if w in keep] + say(30)))
    bench = [(i, " ".join(w[:-4]) + ". " + " ".join(w[-4:]) + ".") for i, w in items.items()]
    want = brute_leaks(docs, [(i, w, w[-4:]) for i, w in items.items()])
    assert {(500 + i, i) for i in items} <= want
    got = leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_leak_of_frequent_words_only(spark):
    g, say = passages(12)
    often = [f"of{i}" for i in range(12)]
    item = [g.choice(often) for _ in range(20)]
    bench = [(0, " ".join(say(30))), (1, " ".join(item))]
    docs = [(d, " ".join(g.choice(often) if g.random() < 0.4 else say(1)[0] for _ in range(120))) for d in range(100)]
    docs += [(500, " ".join(say(30) + item + say(30))), (501, " ".join(item))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(500, 1), (501, 1)}
    assert all(r.similarity == 1 for r in got if r.doc_id >= 500)


def test_no_benchmark_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert leaks(docs, bench.limit(0)).count() == 0 and leaks(docs.limit(0), bench).count() == 0
