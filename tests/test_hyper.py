"""Hypergraph semantics on the worked four-edge example."""

import random

import pytest
from pyspark.sql import functions as F

from tributary import fixtures
from tributary.operators import hyper
from tributary.plans import catalog

EDGES = [("e1", [1, 2], [3]), ("e2", [3], [4, 5]), ("e3", [4, 6], [7]), ("e4", [8], [4])]


def code(i):
    return f"{i:<06d}"


@pytest.fixture(scope="module")
def h4(spark):
    rows = [(e, "in", code(x), "") for e, s, _ in EDGES for x in s] + [(e, "out", code(x), "") for e, _, t in EDGES for x in t]
    entries = spark.createDataFrame(rows, "process string, side string, code string, name string")
    registry = spark.createDataFrame([(code(i), "m") for i in range(1, 10)], "code string, name string")
    return hyper.build(entries, registry)


def values(df):
    return {r[0] for r in df.collect()}


def test_precursors(h4):
    assert values(hyper.precursors(h4)) == {code(i) for i in (1, 2, 6, 8)}


@pytest.mark.parametrize(("starts", "removed", "expected"), [([1, 2, 6, 8, 4], [], [3, 4, 5, 7]), ([1, 2, 6, 8, 4], [3], [4, 7]), ([1], [], [])])
def test_reach(spark, h4, starts, removed, expected):
    s = spark.createDataFrame([("x", code(i)) for i in starts], "scenario string, v string")
    r = spark.createDataFrame([("x", code(i)) for i in removed], "scenario string, v string")
    assert values(hyper.reachable(h4, s, r).select("v")) == {code(i) for i in expected}


def test_criticality(spark, h4):
    base = spark.createDataFrame([(code(4),)], "v string")
    got = {r.code: r.criticality for r in hyper.criticality(h4, base).collect()}
    assert got == {code(i): c for i, c in {1: 2, 2: 2, 3: 2, 6: 1, 7: 1, 5: 1, 8: 0, 9: 0}.items()}


def test_ranks_leave_gaps(spark, h4):
    base = spark.createDataFrame([(code(4),)], "v string")
    rated, reached = hyper.criticality_and_reach(h4, base)
    rows = hyper.ranked(rated, h4, reached).collect()
    assert sorted(r["rank"] for r in rows) == [1, 1, 1, 4, 4, 4, 7, 7]
    assert {r.code for r in rows if r.in_reach} | {code(4)} >= values(hyper.reach(h4, base)) and any(not r.in_reach for r in rows)
    one = hyper.report_summary(rated, h4, reached).first()
    assert (one.reach, one.n_tied_with_third, one.top1_code, one.top3_criticality) == (len(values(reached)), 3, code(1), 2)
    with pytest.raises(ValueError):
        hyper.checked_base(h4, "999999")


def brute_criticality(edges, vertices, base):
    """Reach again from the start without each vertex."""
    made_by = [(set(a), set(b)) for a, b in edges]
    start = {v for a, _ in made_by for v in a} - {v for _, b in made_by for v in b} | {base}

    def reach(without):
        there, made = start - {without}, set()
        while True:
            new = {v for a, b in made_by if a <= there | made for v in b} - {without}
            if new == made:
                return made
            made = new

    whole = len(reach(None))
    return {v: whole - len(reach(v)) for v in vertices if v != base}


@pytest.mark.parametrize("seed", range(4))
def test_criticality_is_what_a_new_start_gives(spark, seed):
    """Cycles, several ways to one vertex, edges without sources, the base among targets."""
    rng = random.Random(seed)
    n = 14
    edges = [(rng.sample(range(n), rng.choice([0, 1, 1, 2, 3])), rng.sample(range(n), rng.choice([1, 1, 2]))) for _ in range(rng.choice([10, 18, 26]))]
    rows = [(f"e{i}", side, code(10 + v), "") for i, (a, b) in enumerate(edges) for side, part in (("in", a), ("out", b)) for v in part]
    registry = spark.createDataFrame([(code(10 + v), "m") for v in range(n)], "code string, name string")
    g = hyper.build(spark.createDataFrame(rows, "process string, side string, code string, name string"), registry)
    base = rng.randrange(n)
    rated, reached = hyper.criticality_and_reach(g, spark.createDataFrame([(code(10 + base),)], "v string"))
    assert "Cartesian" not in rated._jdf.queryExecution().toString() and "NestedLoop" not in rated._jdf.queryExecution().toString()
    assert {r.code: r.criticality for r in rated.collect()} == {code(10 + v): c for v, c in brute_criticality(edges, range(n), base).items()}
    assert values(reached) == values(hyper.reach(g, spark.createDataFrame([(code(10 + base),)], "v string")))


def test_codes_that_grow_with_the_table(spark):
    d = "/root/testdata/sf0.001"
    edges = {}
    for r in fixtures.view(spark, d, "wide").collect():
        edges.setdefault(r.process, ([], []))[r.side == "out"].append(r.code)
    edges = [e for e in edges.values() if e[1]]
    codes = {r.code for r in fixtures.view(spark, d, "wide").select("code").collect()}
    base = min(v for _, b in edges for v in b)
    got = {r.code: r.criticality for r in catalog.QUERIES["criticality_wide"](spark, d).collect()}
    assert got == brute_criticality(edges, codes, base) and max(got.values()) > 3


def test_sides_and_names(spark):
    kind = "process string, side string, code string, name string"
    e = spark.createDataFrame([("p", "in", "x1", "a"), ("p", "in", None, "b"), ("p", "out", None, "c"), ("q", "in", None, "d"), ("r", "in", None, "")], kind)
    assert {r.process: (r.ins, r.outs) for r in hyper.sides(e).collect()} == {"p": (["x1"], [])}
    assert {r.process: (r.tail, r["head"]) for r in hyper.dihypergraph(e).collect()} == {"p": (["b", "x1"], ["c"]), "q": (["d"], [])}


@pytest.mark.parametrize(("seed", "fallen"), [(3, [3, 5]), (1, [1, 3, 5]), (6, [6, 7]), (8, [8])])
def test_propagate(spark, h4, seed, fallen):
    s = spark.createDataFrame([("x", code(seed))], "scenario string, v string")
    assert values(hyper.propagate(h4, s).select("v")) == {code(i) for i in fallen}


def test_sourceless(spark):
    rows = [("p1", "in", None, "ore"), ("p1", "out", code(1), ""), ("p2", "in", code(1), ""), ("p2", "out", code(2), ""), ("p3", "in", code(2), ""), ("p3", "out", code(3), "")]
    entries = spark.createDataFrame(rows, "process string, side string, code string, name string")
    registry = spark.createDataFrame([(code(i), "m") for i in range(1, 5)], "code string, name string")
    base = spark.createDataFrame([(code(4),)], "v string")
    kept, dropped = hyper.build(entries, registry), hyper.build(entries, registry, drop_sourceless=True)
    assert {r.code: r.criticality for r in hyper.criticality(kept, base).collect()}[code(1)] == 3
    assert values(hyper.precursors(kept)) == set()
    assert {r.code: r.criticality for r in hyper.criticality(dropped, base).collect()}[code(1)] == 2
    assert values(hyper.precursors(dropped)) == {code(1)}


def test_audit_counts(spark):
    rows = [("p1", "in", " 100000 ", "a"), ("p1", "in", None, "bare"), ("p1", "out", code(2), ""), ("p2", "in", "999999", ""), ("p2", "out", "Unknown", "")]
    entries = spark.createDataFrame(rows, "process string, side string, code string, name string")
    registry = spark.createDataFrame([(code(1), "m"), (code(2), "m"), ("bad", "m")], "code string, name string")
    r = hyper.audit(entries, registry).first()
    assert (r.n_vertices, r.n_processes, r.n_edges, r.n_untyped, r.n_unregistered, r.n_no_target) == (2, 2, 1, 2, 1, 1)


def test_degrees_are_zero_filled(h4):
    got = {r.v: (r.in_degree, r.out_degree) for r in hyper.degrees(h4).collect()}
    assert got[code(9)] == (0, 0) and got[code(4)] == (2, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "process string, side string, code string, name string")
    registry = spark.createDataFrame([], "code string, name string")
    g = hyper.build(none, registry)
    starts = spark.createDataFrame([], "scenario string, v string")
    assert hyper.reachable(g, starts).count() == 0
    assert hyper.propagate(g, starts).count() == 0


def test_report(spark, h4):
    registry = spark.createDataFrame([(code(i), "m") for i in range(1, 5)] + [("x", "bad")], "code string, name string")
    dom = spark.createDataFrame([(code(3), 10.0, 5, 0.9, True), (code(1), 4.0, 5, 0.1, False)], "code string, total double, top_partner long, share double, dominated boolean")
    rows = {r.code: r for r in hyper.disruption(h4, registry, dom).collect()}
    assert rows["x"].status == "invalid" and rows[code(2)].status == "absent"
    assert rows[code(3)].n_dependents == 1 and rows[code(3)].dependents == code(5) and rows[code(3)].dependents_frac == pytest.approx(1 / 8)
    assert rows[code(1)].n_dependents is None
    s = hyper.summary(hyper.disruption(h4, registry, dom)).first()
    assert (s.n_codes, s.n_invalid, s.n_absent, s.n_in_trade, s.n_dominated, s.n_cascading, s.max_code) == (5, 1, 2, 2, 1, 1, code(3))
    empty = hyper.summary(hyper.disruption(h4, registry, dom.limit(0)).filter(F.lit(False))).first()
    assert empty.n_codes == 0 and empty.max_code == ""


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_of_joins_are_the_same(spark, monkeypatch, seed):
    """Random hypergraphs, with edges without sources and vertices without edges, in memory and by joins."""
    import random

    g = random.Random(seed)
    rows = [(p, side, code(g.randrange(1, 15)), "") for p in range(18) for side in ("in", "out") for _ in range(g.randint(0 if side == "in" else 1, 3))]
    entries = spark.createDataFrame(rows, "process int, side string, code string, name string")
    registry = spark.createDataFrame([(code(i), "m") for i in range(1, 17)], "code string, name string")
    h = hyper.build(entries, registry)
    base = spark.createDataFrame([(code(1),)], "v string")
    starts = spark.createDataFrame([(s, code(i)) for s in ("x", "y") for i in g.sample(range(1, 17), 6)], "scenario string, v string")
    removed = spark.createDataFrame([("y", code(3)), ("z", code(16))], "scenario string, v string")
    seeds = h.vertices.selectExpr("v AS scenario", "v")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    measures = [lambda: hyper.reachable(h, starts, removed), lambda: hyper.criticality(h, base), lambda: hyper.propagate(h, seeds), lambda: hyper.reach(h, base)]
    small = [pairs(m()) for m in measures]
    monkeypatch.setattr(hyper, "BROADCAST_ENDS", -1)
    assert [pairs(m()) for m in measures] == small


def test_copies_of_edges_are_followed_once(spark, monkeypatch):
    """Forty copies of each edge reach, and fall, as one does, and don't make the hypergraph a large one."""
    rows = [(f"{e}/{i}", side, code(x), "") for i in range(40) for e, s, t in EDGES for side, part in (("in", s), ("out", t)) for x in part]
    registry = spark.createDataFrame([(code(i), "m") for i in range(1, 10)], "code string, name string")
    g = hyper.build(spark.createDataFrame(rows, "process string, side string, code string, name string"), registry)
    assert hyper.patterns(g).edges.count() == len(EDGES)
    monkeypatch.setattr(hyper, "BROADCAST_ENDS", 12)
    monkeypatch.setattr(hyper, "made_in_round", None)  # the rounds of a large one
    base = spark.createDataFrame([(code(1),)], "v string")
    got = {r.code: r.criticality for r in hyper.criticality(g, base).collect()}
    assert got == {code(v): c for v, c in brute_criticality([(s, t) for _, s, t in EDGES], range(1, 10), 1).items()}
