"""Judges, evidence, routes, coverage, references."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tributary.functions import text
from tributary.operators import judge, references

JUDGED = "label string, judge string, key string, process_plausible boolean, inputs_outputs_correct boolean, hs_codes_correct boolean, overall_correct boolean, error_mode string, rationale string"


def records(spark, rows):
    return spark.createDataFrame(rows, JUDGED)


def test_pooled_kappa(spark):
    bits = list(zip([True, False, True, True], [True, True, True, False], strict=True))
    rows = [("l1" if i < 2 else "l2", j, str(i), b[k], b[k], b[k], b[k], None, None) for i, b in enumerate(bits) for k, j in enumerate("ab")]
    got = {r.criterion: r for r in judge.agreement(records(spark, rows), "a", "b", []).collect()}["overall_correct"]
    pe = 0.75 * 0.75 + 0.25 * 0.25
    assert (got.n, got.agreement) == (4, 0.5) and got.kappa == pytest.approx((0.5 - pe) / (1 - pe))


def test_kappa_is_zero_without_variation(spark):
    rows = [("l", j, "1", True, True, True, True, None, None) for j in "ab"]
    assert {r.kappa for r in judge.agreement(records(spark, rows), "a", "b", ["label"]).collect()} == {0.0}


def test_inconsistencies(spark):
    rows = [("l", "a", "1", True, True, True, False, None, None), ("l", "a", "2", True, False, True, True, None, None), ("l", "a", "3", False, True, True, False, None, "All criteria are met"), ("l", "a", "4", None, True, True, False, None, "")]
    assert judge.summary(records(spark, rows)).first().inconsistent_count == 3


def test_error_modes_are_not_counted_twice(spark):
    rows = [("x", "a", "1", True, True, True, False, "", None), ("y", "a", "1", True, True, True, False, None, None), ("y", "a", "2", True, True, True, True, "m", None)]
    got = judge.error_modes(records(spark, rows)).collect()
    assert sorted((r.pooled, r.label or "", r.mode, r.n) for r in got) == [(0, "x", "unspecified", 1), (0, "y", "unspecified", 1), (1, "", "unspecified", 2)]
    assert [(r.label, r.mode, r.n) for r in judge.modes_of_any(records(spark, rows)).collect()] == [("y", "m", 1)]


def test_reconstructed_kappa(spark):
    s = spark.createDataFrame([("l", "a", 0.6), ("l", "b", 0.5), ("m", "a", 0.1)], "label string, judge string, precision double")
    a = spark.createDataFrame([("l", 10, 0.8)], "label string, n_both int, agreement double")
    r = judge.pooled_kappa(s, a).first()
    assert (r.n_total, r.agreement) == (10, 0.8) and r.kappa == pytest.approx(0.6)
    half = judge.pooled_kappa(s, a.union(spark.createDataFrame([("m", 10, 0.8)], a.schema))).first()
    assert half.n_total == 20 and half.agreement == pytest.approx(0.4)


def test_bootstrap_interval():
    """The same draws as Python's generator, one choice at a time."""
    assert judge.interval([], 10, 0) == (0.0, 0.0) and judge.interval([1, 1], 10, 0) == (1.0, 1.0)
    g = random.Random(9)
    for n, n_boot, seed in ((3, 2000, 0), (7, 400, 0), (64, 300, 5), (100, 300, 1)):
        bits = [g.randrange(2) for _ in range(n)]
        one = random.Random(seed)
        means = sorted(sum(one.choice(bits) for _ in range(n)) / n for _ in range(n_boot))
        assert judge.interval(bits, n_boot, seed) == (means[int(0.025 * n_boot)], means[int(0.975 * n_boot) - 1])
    lo, hi = judge.interval([1, 0, 1])
    assert 0 <= lo <= 2 / 3 <= hi <= 1


def test_bootstrap_in_the_order_of_records(spark):
    rows = [("l", "a", i, i % 3 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "label string, judge string, key int, overall_correct boolean").repartition(4)
    assert tuple(judge.bootstrap_ci(df, 300).first()[2:]) == judge.interval([int(r[3]) for r in rows], 300, 0)
    lo, hi = judge.binomial_ci(df).first()[2:]
    assert 0.15 < lo < 17 / 50 < hi < 0.55


def test_state_audit(spark):
    e = spark.createDataFrame([(1, "100000"), (1, "x"), (2, "200000"), (3, None)], "process int, code string")
    m = spark.createDataFrame([("100000",), ("300000",)], "code string")
    assert tuple(judge.state_audit(e, m, m.limit(1)).first()) == (2, 1, 3, 1)


def test_side_terms(spark):
    e = spark.createDataFrame([(1, "in", "100000", "Borax Ore!"), (1, "out", None, "salt"), (1, "out", "200000", "B2O3")], "process int, side string, code string, name string")
    m = spark.createDataFrame([("100000", "Natural borates", ["tincal", "ore"])], "code string, name string, aliases array<string>")
    r = judge.side_terms(e, m).first()
    assert (r.ins, r.outs) == (["borax ore", "natural borates", "tincal"], ["b2o3"])


@pytest.mark.parametrize(("names", "terms"), [(["salt"], []), (["table salt"], ["table salt"]), (["Boric acid", "H3BO3", "boric  acid"], ["boric acid", "h3bo3"]), (["ab", "a b"], ["a b"])])
def test_terms(spark, names, terms):
    col = text.usable_terms(F.transform(F.array(*map(F.lit, names)), text.norm))
    assert spark.range(1).select(col).first()[0] == terms


def test_evidence(spark):
    texts = spark.createDataFrame([(1, "borax is treated with sulfuric acid to give boric acid."), (1, ""), (2, "ask the chatbot for help"), (3, "only borax here")], "process int, text string")
    terms = spark.createDataFrame([(1, ["sulfuric acid"], ["boric acid"]), (2, ["atb"], ["output"]), (3, ["borax"], ["h3bo3"]), (4, ["a+b"], [])], "process int, ins array<string>, outs array<string>")
    got = {r.process: (r.any_mention, r.grounded) for r in judge.evidence(texts, terms).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False)}


def test_evidence_is_every_term_between_boundaries(spark):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("aab1+-  ") for _ in range(n))
    texts = [(i % 30, say(rng.randrange(0, 14))) for i in range(60)]
    terms = [(i, [say(rng.randrange(1, 4)).strip() or "a" for _ in range(2)], [say(rng.randrange(1, 4)).strip() or "b"]) for i in range(30)]
    got = {r.process: (r.any_mention, r.grounded) for r in judge.evidence(spark.createDataFrame(texts, "process int, text string"), spark.createDataFrame(terms, "process int, ins array<string>, outs array<string>")).collect()}
    named = lambda x, t: any(re.search(f"(?<![a-z0-9]){re.escape(y)}(?![a-z0-9])", x) for y in t)
    want = {}
    for i, a, b in terms:
        hits = [(named(x, a), named(x, b)) for p, x in texts if p == i]
        want[i] = (any(x or y for x, y in hits), any(x and y for x, y in hits))
    assert got == want and len(set(want.values())) == 3


@pytest.mark.parametrize("bytes_at_most", [1 << 24, -1])
def test_evidence_in_raw_texts(spark, monkeypatch, bytes_at_most):
    """Texts as they are, with letters that are ASCII in lower case only, against norm() and a regex for each term; no regex
    runs over the texts themselves."""
    monkeypatch.setattr(judge, "BROADCAST_TERMS", bytes_at_most)
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("aAbK\u212a\u0130İé1+-,. \n\t\x00😀") for _ in range(n))
    texts = spark.createDataFrame([(i % 40, say(rng.randrange(0, 60)) if i % 17 else None) for i in range(120)], "process int, text string")
    terms = spark.createDataFrame([(i, ["".join(rng.choice("aabki1+- ") for _ in range(rng.randrange(1, 4))) for _ in range(2)], ["".join(rng.choice("abk1+ ") for _ in range(2))] if i % 9 else None) for i in range(42)], "process int, ins array<string>, outs array<string>")
    normal = texts.select("process", text.norm(F.col("text")).alias("text")).collect()
    assert [r.text for r in normal if r.text is not None] == [text.norm_bytes(r.text.encode()).decode() for r in texts.collect() if r.text is not None]
    named = lambda x, t: any(re.search(f"(?<![a-z0-9]){re.escape(y)}(?![a-z0-9])", x) for y in t or [])
    want = {}
    for i, a, b in terms.collect():
        hits = [(named(x, a), named(x, b)) for p, x in normal if p == i and x]
        want[i] = (any(x or y for x, y in hits), any(x and y for x, y in hits))
    got = judge.evidence(texts, terms, raw=True)
    assert {r.process: (r.any_mention, r.grounded) for r in got.collect()} == want and len(set(want.values())) == 3
    assert {r.process: (r.any_mention, r.grounded) for r in judge.evidence(spark.createDataFrame(normal, "process int, text string"), terms).collect()} == want
    assert "regexp" not in got._jdf.queryExecution().toString().lower()


def test_routes(spark):
    raw = spark.createDataFrame([("a", "100000|200000", "300000"), ("b", "100000|900000", "300000"), ("c", "700000", "800000"), ("d", "x", "300000"), ("e", "", "300000")], "route string, input_hs string, output_hs string")
    good, bad = judge.valid_routes(raw)
    assert {r.route for r in bad.collect()} == {"d", "e"}
    procs = spark.createDataFrame([(1, ["100000", "200000", "500000"], ["300000"]), (2, ["900000"], ["300000"])], "process int, ins array<string>, outs array<string>")
    assert {r.route: r.status for r in judge.route_recall(good, procs).collect()} == {"a": "strict", "b": "lenient", "c": "miss"}


def test_coverage(spark):
    counts = spark.createDataFrame([("252800",), ("281000",), ("280450",)], "code string")
    r = judge.coverage(counts, spark.createDataFrame([("252800",), ("281000",), ("284019",)], "code string")).first()
    assert (r.overlap, r.only_here) == (2, 1) and r.fraction_only == pytest.approx(1 / 3)
    assert judge.coverage(counts.limit(0), counts).first().fraction_only == 0


REFS = "process int, pos int, url string, source_score double, content_score double"


def greedy(refs, min_refs, min_domains):
    """The selection as nested loops."""
    reviewed = sorted((r for r in refs if r[3] is not None and r[4] is not None), key=lambda r: -(r[4] * min(r[3] * 2, 1.0)))
    if len(reviewed) < min_refs:
        return {r[1] for r in reviewed}
    top, seen = [], set()
    for r in reviewed:
        d = r[2].split("/")[2].lower() if "://" in r[2] else None
        if d and d not in seen and len(top) < min_domains:
            top.append(r)
            seen.add(d)
    if len(top) >= min_domains:
        for r in reviewed:
            if len(top) >= min_refs:
                break
            if all((r[2], r[3], r[4]) != (x[2], x[3], x[4]) for x in top):
                top.append(r)
    return {r[1] for r in top}


def test_selection_against_loops(spark):
    g = random.Random(1)
    rows = [(p, i, g.choice(["https://a.org/x", "https://b.org:80/y", "http://A.org/z", "nowhere", "https://c.org/"]), g.choice([None, 0.2, 0.5, 0.9]), g.choice([None, 0.1, 0.5, 0.8])) for p in range(60) for i in range(g.randint(1, 8))]
    got = references.selected(spark.createDataFrame(rows, REFS), 3, 2).collect()
    for p in range(60):
        assert {r.pos for r in got if r.process == p} == greedy([r for r in rows if r[0] == p], 3, 2), p


def test_scores_and_purges(spark):
    refs = spark.createDataFrame([(1, 0, "https://a.org/", 0.5, 0.8), (1, 1, "https://b.org/", 0.25, 0.8), (2, 0, "https://a.org/", None, 0.8), (3, 0, "https://a.org/", 0.5, 0.1)], REFS)
    got = {r.process: r.score for r in references.process_scores(refs).collect()}
    assert got[1] == pytest.approx((0.8 + 0.4) / 2) and got[2] is None and got[3] is None
    procs = spark.createDataFrame([(1, 0.9, 0.6), (2, 0.9, None), (3, 0.1, None), (4, None, 0.2)], "process int, scale double, score double")
    reasons = {r.process: r.reasons for r in references.purge_reasons(procs, refs).collect()}
    assert reasons == {3: "too few reviewed references and scale below threshold", 4: "score below threshold"}
    kept, scored = references.purge_low_references(refs, procs.fillna({"score": 0.7}))
    assert kept.count() == 3 and {r.process: r.score for r in scored.collect()}[3] is None
    assert {r.process for r in references.purge_low_scale(procs)[1].collect()} == {3}


def test_routes_against_all_pairs(spark):
    """Sides of several codes, copies, nulls and empty sides."""
    import random

    rng = random.Random(3)
    side = lambda: rng.sample(["1", "2", "3", "4", "5"], rng.choice([0, 1, 1, 2, 3]))
    processes = [(i, side(), side()) for i in range(12)] * 2
    routes = [(i, side() + rng.choice([[], [], [None]]), side()) for i in range(60)]

    def status(ins, outs):
        found = [(set(ins) <= set(a) and set(outs) <= set(b)) for _, a, b in processes if set(ins) & set(a) and set(outs) & set(b)]
        return "strict" if any(found) else "lenient" if found else "miss"

    kind = "ins array<string>, outs array<string>"
    got = judge.route_recall(spark.createDataFrame(routes, f"route int, {kind}"), spark.createDataFrame(processes, f"process int, {kind}"))
    assert {r.route: r.status for r in got.collect()} == {i: status(a, b) for i, a, b in routes}
