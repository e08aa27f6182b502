"""Quality, LM scores, licences, mixing and URL filters."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import catalog, licenses, quality
from tributary.llm import pseudo_likelihood as pl
from tributary.llm.licenses import license_scan
from tributary.llm.mixing import mix
from tributary.llm.pseudo_likelihood import lm_scores
from tributary.llm.quality import NEIGHBOURS, classify
from tributary.llm.ragged import hash_word
from tributary.llm.url_filter import Rule, url_filter

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, name) for p, name in PHRASES.items() for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({n for _, n in at}))


def test_base_phrases(spark):
    g = random.Random(1)
    bits = [*"the gnu general public license apache mit cc by".split(), "É", "cc-by", "2", "License,", "MIT\nLicense", "x"]
    rows = [(i, " ".join(g.choice(bits) for _ in range(g.randint(0, 40)))) for i in range(400)] + [(900, None), (901, ""), (None, "mit license"), (902, "mit license" * 2), (902, "mit license" * 2), (903, "Éapache license é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string").repartition(3)
    got = license_scan(df).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(i, *base(x)) for i, x in rows], key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert license_scan(df.limit(0)).count() == 0


def test_templates_by_position(spark):
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit" and t.keys)
    w = mit.text.split()
    changed = " ".join("word" if i in (14, 17) else x for i, x in enumerate(w))
    no_key = " ".join("word" if i in (2, 4) else x for i, x in enumerate(w))
    shuffled = " ".join(sorted(w))
    rows = [(1, "before " + mit.text), (2, changed), (3, no_key), (4, shuffled), (5, " ".join(w[:13])), (6, "Copyright. All rights reserved.")]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "", 4: "", 5: "mit", 6: "all-rights-reserved"}


def test_template_without_its_rarest_words(spark):
    """A text cut off before the words that are the rarest of all, and one in which these are altered."""
    bsd = next(t for t in licenses.TEMPLATES if t.label == "bsd")
    w = bsd.text.split()
    altered = " ".join("word" if x in ("redistribution", "source", "binary") else x for x in w)
    often = " ".join(x for x in dict.fromkeys(w) if x not in ("redistribution", "source", "binary"))
    rows = [(1, " ".join(w[7:])), (2, altered), (3, " ".join(w[:13])), (4, " ".join(w[9:])), (5, bsd.text)] + [(10 + i, " ".join(reversed(often.split()))) for i in range(60)]
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x for i, x in got.items() if x} == {1: "bsd", 2: "bsd", 3: "bsd", 5: "bsd"}


def brute_labels(text):
    """Labels by the definition: every template at every offset of the text."""
    w, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), set()
    for t in licenses.TEMPLATES:
        own = t.text.split()
        m = len(own)
        for at in range(-m, len(w)):
            if not t.keys:
                if at >= 0 and w[at : at + m] == own:
                    out.add(t.label)
                continue
            agree = sum(0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(own))
            near = w[max(0, at - m) : max(0, at + 2 * m)]
            if agree / m >= licenses.AGREE and any(near[i : i + len(k)] == k for k in (key.split() for key in t.keys) for i in range(len(near))):
                out.add(t.label)
    return ",".join(sorted(out))


def test_labels_by_brute_force(spark):
    g = random.Random(21)
    rows = []
    for i in range(250):
        w = g.choice(licenses.TEMPLATES).text.split()
        if i % 3:
            w = w[g.randrange(len(w)) // 2 :] if g.random() < 0.5 else w[: 1 + g.randrange(len(w))]
        w = [g.choice(["the", "software", "license", "x"]) if g.random() < 0.1 else x for x in w]
        if g.random() < 0.2:
            w.insert(g.randrange(len(w) + 1), "word")
        rows.append((i, " ".join([*g.choices(["the", "of", "a", "public", "software"], k=g.randrange(8)), *w, *g.choices(["and", "license"], k=g.randrange(5))])))
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: brute_labels(t) for i, t in rows} and len(set(got.values())) > 10


def test_anchors_miss_no_alignment():
    for m in range(1, 60):
        assert (m - licenses.anchors(m)) / m < licenses.AGREE <= (m - licenses.anchors(m) + 1) / m


def prose(g, n):
    return " ".join(("".join(g.choice("etaoinshr") for _ in range(g.randint(1, 8)))).capitalize() if i % 9 == 0 else "".join(g.choice("etaoinshr") for _ in range(g.randint(1, 8))) for i in range(n)) + "."


def junk(g, n):
    return g.choice([lambda: " | ".join(prose(g, 1) for _ in range(n)), lambda: prose(g, n).upper().replace(" ", "!! "), lambda: " ".join([prose(g, 1)] * n)])()


def test_held_out_accuracy(spark):
    g = random.Random(2)
    docs = [(i, (prose if i % 3 else junk)(g, g.randint(20, 200)), "x") for i in range(600)] + [(1000, None, "x"), (1001, "", "x"), (None, prose(g, 50), "x"), (0, "repeat", "x")]
    labels = [(i, int(bool(i % 3)), 0) for i in range(500)] + [(1, None, 0), (None, 1, 0), (7777, 1, 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify(d, lab).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 500 and r.doc_id]
    assert np.mean([r.predicted == int(bool(r.doc_id % 3)) for r in held]) > 0.95
    # labels of held-out rows, sources and languages change nothing
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in classify(d, flipped).collect()} == {(r.doc_id, r.score) for r in got}


def test_votes_against_brute_force():
    from tributary.llm.quality import SIZE, Voter

    g = np.random.default_rng(0)
    counts = g.poisson(0.3, (300, SIZE)).astype(np.float32)
    labels = (counts[:, 0] > 0).astype(np.float32)
    v = Voter(counts[:200], labels[:200])
    z = v.latent(counts[200:])
    for a, s in zip(z, v.scores(counts[200:]), strict=True):
        near = np.argsort(-(v.vectors @ a), kind="stable")[:NEIGHBOURS]
        w = np.maximum(v.vectors[near] @ a, 0).astype(float) ** 4
        assert s == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-4)


def test_ties_at_the_last_neighbour_all_vote():
    from tributary.llm.quality import SIZE, Voter

    counts = np.zeros((60, SIZE), np.float32)
    counts[:, 0], counts[:, 5] = 1, np.arange(60) < 30
    labels = np.arange(60) % 3 == 0
    for order in (np.arange(60), np.arange(60)[::-1]):
        v = Voter(counts[order], labels[order].astype(np.float32))
        assert v.scores(counts[:1]) == pytest.approx([1 / 3], abs=1e-6)


def test_contradicting_labels_and_repeated_ids(spark):
    d = spark.createDataFrame([(1, "good text here"), (1, "another one"), (2, "bad!!!"), (3, "fine words")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (None, 0)], "doc_id long, quality int")
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3))
    v = quality.fit(d, lab)
    assert v.labels.tolist() == [1, 1]


def test_words_tell_labels_apart(spark):
    """Texts of one style, whose words alone differ."""
    g = random.Random(5)
    good, bad = (["".join(g.choice("etaoinshr") for _ in range(5)) for _ in range(60)] for _ in range(2))
    rows = [(i, " ".join(g.choice(good if i % 2 else bad) for _ in range(60))) for i in range(500)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    got = [r for r in classify(d, lab).collect() if r.held_out]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 1) for r in got]) > 0.95


def test_quality_without_rows(spark):
    d, lab = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert classify(d.limit(0), lab).count() == 0 and [r.score for r in classify(d, lab).collect()] == [0.5]


def odd_corpus(seed=3):
    g = random.Random(seed)
    rows = [(i, " ".join(g.choice("abcdefgh") * g.randint(1, 3) for _ in range(g.randint(1, 60))), "clash") for i in range(80)]
    rows += [(100 + i, " ".join(g.choice(["the", "of", "Rare%d" % g.randint(0, 300), "word%ding" % g.randint(0, 40)]) for _ in range(50)), "") for i in range(30)]
    return rows + [(90, None, ""), (91, "", ""), (None, "a b", ""), (1, "a a", ""), (1, "a a", ""), (92, "long " * 30000, "")]


def test_lm_scores_by_brute_force(spark, monkeypatch):
    """Sums over words one by one: classes, leaves and neighbours read from the definition, networks' tables as they are."""
    monkeypatch.setattr(pl, "VOCABULARY", 100)
    rows = odd_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, log_likelihood string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.log_likelihood) for r in lm_scores(df.repartition(3)).collect()))
    texts = [[w.lower() for w in (t or "").split()] for _, t, _ in rows]
    count = Counter(w for t in texts for w in t)
    hashed = {w: hash_word(w) for w in count}
    signed = {w: h - (1 << 64) if h >> 63 else h for w, h in hashed.items()}
    top = sorted(count, key=lambda w: (-count[w], signed[w]))
    least = min((n for n in set(count.values()) if sum(c >= n for c in count.values()) <= 100), default=None)
    own = {w: i for i, w in enumerate(w for w in top if count[w] >= least) if i < pl.OWN}

    def leaf(w):
        b = np.frombuffer(w.encode(), np.uint8)
        return own[w] if w in own else int(pl.end_leaf(b, np.array([0]), np.array([len(b)]))[0])

    def near(t, i):
        if not 0 <= i < len(t):
            return pl.PAD
        w = t[i]
        return own[w] if own.get(w, pl.TOP) < pl.TOP else pl.TOP + (0 if w in own else pl.LENGTHS) + min(pl.LENGTHS - 1, (len(w) - 1) // 2)

    def far(t, i):
        if not 0 <= i < len(t):
            return 0
        return 1 if own.get(t[i], pl.TOP) < pl.TOP else 2 + 2 * (t[i] not in own) + (len(t[i]) > pl.SHORT)

    windows, pairs = (np.zeros(x, np.int64) for x in pl._STATISTICS)
    places = []
    for t in texts:
        for i, w in enumerate(t):
            pair = near(t, i - 1) * pl.NEAR + near(t, i + 1)
            window = (pair * pl.FAR + far(t, i - 2)) * pl.FAR + far(t, i + 2)
            windows[window, leaf(w) // pl.WITHIN] += 1
            pairs[pair, leaf(w)] += 1
            places.append((window, pair))
    mass = Counter()
    for w, n in count.items():
        mass[leaf(w)] += n
    model = pl.Model(pl.Lexicon([(signed[w], count[w]) for w in top if count[w] >= least]), windows, pairs)
    kinds, leaves = pl._tables(model.nets)
    at, want = iter(places), []
    for (d, _, _), t in zip(rows, texts, strict=True):
        total = 0.0
        for w in t:
            window, pair = next(at)
            total += float(kinds[window, leaf(w) // pl.WITHIN]) + float(leaves[pair, leaf(w)]) + np.log(count[w] / mass[leaf(w)])
        want.append((-1 if d is None else d, len(t), total))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-3)
    # all words of the corpus share the whole probability in each place
    for window, pair in random.Random(1).sample(places, 20):
        p = sum(np.exp(kinds[window, leaf(w) // pl.WITHIN] + leaves[pair, leaf(w)]) * n / mass[leaf(w)] for w, n in count.items())
        assert p == pytest.approx(1, abs=1e-3)


def test_lm_scores_do_not_hang_on_partitions(spark):
    df = spark.createDataFrame(odd_corpus(), "doc_id long, text string, log_likelihood string")
    one, many = ({(r.doc_id, r.n_words, r.log_likelihood) for r in lm_scores(df.repartition(n, "text")).collect()} for n in (1, 7))
    assert one == many


def test_lm_scores_of_odd_rows(spark):
    df = spark.createDataFrame(odd_corpus(), "doc_id long, text string, log_likelihood string").repartition(2)
    got = lm_scores(df).collect()
    assert len(got) == df.count() and lm_scores(df.limit(0)).count() == 0
    empty = [r for r in got if r.doc_id in (90, 91)]
    assert all((r.n_words, r.log_likelihood, r.mean_log_likelihood) == (0, 0.0, None) for r in empty)
    assert all(r.log_likelihood <= 0 and r.mean_log_likelihood == pytest.approx(r.log_likelihood / r.n_words) for r in got if r.n_words)
    assert len({r.log_likelihood for r in got if r.doc_id == 1 and r.n_words == 2}) == 1


def test_network_probabilities():
    net = pl.Network(pl.PAIR, pl.CLASSES)
    _, z = net.forward(net.inputs(np.array([0, 7, pl.NEAR * pl.NEAR - 1])))
    assert np.exp(z).sum(2) == pytest.approx(np.ones((3, pl.CLASSES)), abs=1e-4)


def test_network_learns_its_contexts():
    """After training, predictions come close to the counted shares, where the counts are large."""
    g = np.random.default_rng(1)
    found = np.zeros((pl.NEAR * pl.NEAR, pl.LEAVES), np.int64)
    some = g.choice(len(found), 300, replace=False)
    found[some[:, None], g.integers(0, 64, (300, 3))] += 1000 + g.integers(0, 3000, (300, 3))
    net = pl.Network(pl.PAIR, pl.CLASSES)
    net.train(some, lambda lo, hi: found[some[lo:hi]].astype(np.float32))
    got, same = net.table()[some].reshape(300, pl.CLASSES, -1), found[some].reshape(300, pl.CLASSES, -1)
    flat = same.sum(0) / np.maximum(same.sum((0, 2))[:, None], 1)
    learnt, unlearnt = -(same * got).sum() / same.sum(), -(same * np.log(np.maximum(flat, 1e-9))[None]).sum() / same.sum()
    assert learnt < unlearnt - 0.3


def test_network_learns_both_sides(spark):
    """A word that its neighbours decide is likelier in its place than elsewhere."""
    g = random.Random(4)
    triple = [("aa", "mid1", "bb"), ("cc", "mid2", "dd")]
    rows = [(i, " ".join(w for _ in range(40) for w in (*g.choice(triple), g.choice(["x", "y", "z"])))) for i in range(1500)]
    rows += [(3000, "x aa mid1 bb y " * 5), (3001, "x aa mid2 bb y " * 5)]
    got = {r.doc_id: r.mean_log_likelihood for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got[3000] > got[3001] + 0.3 and np.mean([v for k, v in got.items() if k < 3000]) > -1.8


def test_words_of_the_same_leaf_differ_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(pl, "VOCABULARY", 4)
    rows = [(i, "the of and to " * 20 + f"once{i}abc") for i in range(40)] + [(100 + i, "the of and to " * 20 + "twiceabc") for i in range(2)]
    got = {r.doc_id: r.log_likelihood for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] - got[0] == pytest.approx(np.log(2), abs=1e-3)


def waterfill(tree, budget, path=()):
    """Budgets of leaves by repeated rounds: tree is {name: (weight, room or subtree)}."""
    room = lambda t: t if isinstance(t, int) else sum(room(x) if w else 0 for w, x in t.values())
    if isinstance(tree, int):
        return {path: min(budget, tree)}
    out, left, open_ = dict.fromkeys(tree, 0.0), min(budget, room(tree)), {n for n, (w, _) in tree.items() if w}
    while left > 1e-9 and open_:
        share = {n: left * tree[n][0] / sum(tree[m][0] for m in open_) for n in open_}
        for n in sorted(open_):
            give = min(share[n], room(tree[n][1]) - out[n])
            out[n] += give
            left -= give
        open_ = {n for n in open_ if room(tree[n][1]) - out[n] > 1e-9}
    return {k: v for n, (_, t) in tree.items() for k, v in waterfill(t, out[n], (*path, n)).items()}


def test_mixing_budgets(spark):
    g = random.Random(6)
    weights = [{"a": 5, "b": 1, "z": 0}, {"p": 3, "q": 0}]
    rows = [(i, "t" * g.randint(0, 400), g.choice("aabbz"), g.choice(["p", "q", "r", "r", "s", None]), "clash") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string, y string, _take string")
    got = mix(df, {"x": F.col("x"), "y": F.col("y")}, weights, (3, 4), max_epochs=2).collect()
    assert len(got) == len(rows) and "_take" in got[0].asDict()
    have, took = {}, {}
    for r in got:
        leaf = (r._x, r._y)
        have[leaf] = have.get(leaf, 0) + r._n_tokens
        took[leaf] = took.get(leaf, 0) + r._take
    tree = {}
    for (x, y), n in have.items():
        tree.setdefault(x, (weights[0].get(x, 1), {}))[1][y] = (weights[1].get(y, 1), 2 * n)
    expected = waterfill(tree, sum(have.values()) * 3 // 4)
    assert all(abs(took[k] - v) <= 3 for k, v in expected.items()), (took, expected)
    for leaf in have:
        own = sorted((r for r in got if (r._x, r._y) == leaf), key=lambda r: -r._copies)
        assert own[0]._copies - own[-1]._copies <= 1
        assert sum(r._take not in (r._copies * r._n_tokens, 0) for r in own) <= 1


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, "abcd" * 9, "a"), (1, "abcd" * 9, "a"), (None, None, None), (2, "", "b")], "doc_id long, text string, x string")
    got = mix(df, {"x": F.col("x")}, [{}], (1, 1), max_epochs=1).collect()
    assert sorted(r._take for r in got) == [1, 1, 9, 9] and all(r._copies == 1 for r in got)
    assert mix(df.limit(0), {"x": F.col("x")}, [{}], (1, 2)).count() == 0
    none = mix(df, {"x": F.col("x")}, [{}], (0, 1)).collect()
    assert all(r._copies == 0 and r._take == 0 for r in none)


@pytest.fixture(scope="module")
def url_rows():
    g = random.Random(9)
    hosts = ["a.example.net", "example.org", "b.org", "Shop.Example.COM", "x.example.com", "net", "internet", "q.example.net:80"]
    urls = [f"{g.choice(['http', 'HTTPS'])}://{g.choice(hosts)}{g.choice(['', '/', '/en/1', '/fr/x/2', '/de/a', '/de/b/c/d/e', '/en', '/a//b', '/en/y?u=/x', '#/en/'])}" for _ in range(500)]
    return [(i, u, "clash") for i, u in enumerate(urls)] + [(600, None, ""), (601, "no scheme", ""), (602, "://", ""), (603, "", ""), (604, "x://h?q://z", ""), (None, "http://net/", ""), (1, "http://net/", "")]


def test_urls_against_sql(spark, url_rows):
    df = spark.createDataFrame(url_rows, "page_id long, url string, verdict string")
    got = url_filter(df, catalog.RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, verdict VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", url_rows)
    key = lambda x: str(tuple(x))
    assert sorted(map(key, got)) == sorted(map(key, c.execute(catalog.ORACLE_SQL["op6_url_templates"]).fetchall()))
    for r, (i, u, _) in zip(sorted(got, key=lambda r: str(r.page_id)), sorted(url_rows, key=lambda r: str(r[0])), strict=True):
        if i not in (1, None):
            assert (r.page_id, r.rule) == (i, rule_of(u))


def rule_of(url):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r.pattern for r in catalog.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=len, default=None)


def test_templates_follow_labels(spark):
    rules = [Rule("block", "h.org/spam/a/"), Rule("allow", "h.org/news/")]
    rows = [(i, f"http://h.org/spam/a/{i}") for i in range(40)] + [(100 + i, f"http://h.org/spam/b{i}/x") for i in range(2)] + [(200 + i, f"http://h.org/news/{i}") for i in range(60)] + [(300 + i, f"http://h.org/other/{i}") for i in range(60)] + [(400, "http://h.org/spam/a")]
    got = {r.page_id: r.verdict for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[0] == "block" and got[200] == "allow" and got[300] == "allow" and len(got) == len(rows)
    assert url_filter(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_templates_at_any_depth(spark):
    """Six segments deep, what is blocked and what is allowed differ only in the last one; unlabelled pages follow their own."""
    rules = [Rule("block", "d.org/a/b/c/d/e/bad/x"), Rule("allow", "d.org/a/b/c/d/e/good/x")]
    rows = [(100 * k + i, f"http://d.org/a/b/c/d/e/{name}/{s}{i}") for k, (name, s) in enumerate([("bad", "x"), ("good", "x"), ("bad", "y"), ("good", "y")]) for i in range(60)]
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(got[i] == ("block", rules[0].pattern) and got[100 + i] == ("allow", rules[1].pattern) and got[200 + i] == ("block", None) and got[300 + i] == ("allow", None) for i in range(60))


def test_purity_counts_labelled_pages_only(spark):
    """More pages without a label than with one in a template don't hide that all its labelled ones are blocked."""
    rules = [Rule("block", "p.org/t/1"), Rule("allow", "p.org/ok/")]
    rows = [(i, f"http://p.org/t/1{i}") for i in range(100)] + [(1000 + i, f"http://p.org/t/2{i}") for i in range(400)] + [(2000 + i, f"http://p.org/ok/{i}") for i in range(100)] + [(3000 + i, f"http://p.org/u/{i}") for i in range(300)]
    got = {r.page_id: r.verdict for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[1000 + i] for i in range(400)} == {"block"} and {got[3000 + i] for i in range(300)} == {"allow"}


def test_rare_names_are_one_branch(spark):
    rules = [Rule("block", "r.org/bad/")]
    rows = [(i, f"http://r.org/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}/home") for i in range(400)] + [(1000 + i, f"http://r.org/bad/{i}") for i in range(60)]
    got = {r.page_id: r.template for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[i] for i in range(400)} == {"*/home"}
