"""Graph operators on hand-worked graphs and against plain Python."""

import itertools
import random

import pytest

from tributary.operators import dists, graphs

EDGE = "src int, dst int"


def table(spark, edges):
    return spark.createDataFrame(edges, EDGE)


@pytest.fixture(scope="module")
def sample():
    g = random.Random(5)
    return sorted({(g.randrange(12), g.randrange(12)) for _ in range(26)} - {(i, i) for i in range(12)})


def bfs(edges, s):
    dist, paths, order = {s: 0}, {s: 1.0}, [s]
    for v in order:
        for a, b in edges:
            if a == v:
                if b not in dist:
                    dist[b], paths[b] = dist[v] + 1, 0.0
                    order.append(b)
                if dist[b] == dist[v] + 1:
                    paths[b] += paths[v]
    return dist, paths, order


def test_betweenness_against_brandes(spark, sample):
    node, edge = dict.fromkeys(set(itertools.chain(*sample)), 0.0), dict.fromkeys(sample, 0.0)
    for s in node:
        dist, paths, order = bfs(sample, s)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v, x in sample:
                if x == w and v in dist and dist[v] + 1 == dist[w]:
                    c = paths[v] / paths[w] * (1 + delta[w])
                    edge[v, w] += c
                    delta[v] += c
            if w != s:
                node[w] += delta[w]
    got_nodes, got_edges = graphs.betweenness(table(spark, sample))
    assert {r.v: pytest.approx(r.value) for r in got_nodes.collect()} == node
    assert {(r.src, r.dst): pytest.approx(r.value) for r in got_edges.collect()} == edge


def test_closure_components_and_paths(spark, sample):
    df = table(spark, sample)
    reach = {v: set(bfs(sample, v)[0]) - {v} for v in set(itertools.chain(*sample))}
    assert {r.v: r.descendants for r in graphs.reach_counts(df).collect()} == {v: len(x) for v, x in reach.items()}
    strong = {v: min([v, *[u for u in reach[v] if v in reach[u]]]) for v in reach}
    assert {r.v: r.component for r in graphs.strong_components(df).collect()} == strong
    both = sample + [(b, a) for a, b in sample]
    weak = {v: min(bfs(both, v)[0]) for v in reach}
    assert {r.v: r.component for r in graphs.weak_components(df).collect()} == weak


def test_components_of_a_long_chain(spark):
    df = table(spark, [(i, i + 1) for i in range(40)])
    assert {r.component for r in graphs.weak_components(df).collect()} == {0}
    s = graphs.component_stats(graphs.weak_components(table(spark, [(0, 1), (2, 3), (3, 4)]))).first()
    assert (s.components, s.smallest, s.largest, s.n_smallest, s.n_largest) == (2, 2, 3, 1, 1)


def test_cores_and_clustering(spark):
    df = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 6)])
    assert {r.v: r.core for r in graphs.core_numbers(df).collect()} == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    got = {r.v: round(r.coefficient, 6) for r in graphs.clustering(df).collect()}
    assert got[0] == 1.0 and got[2] == round(1 / 3, 6) and got[4] == 0
    assert graphs.core_numbers(table(spark, [(1, 1), (1, 2)])).collect() == []  # cores aren't defined with loops


def test_path_stats(spark):
    r = graphs.path_stats(table(spark, [(0, 1), (1, 2), (2, 3), (8, 9)])).first()
    assert r.diameter == 3 and r.mean_path == pytest.approx((3 * 1 + 2 * 2 + 3) / 6)


def test_pagerank(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 0)]
    rank = dict.fromkeys(range(4), 0.25)
    for _ in range(100):
        rank = {v: 0.15 / 4 + 0.85 * sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v) for v in rank}
    got = {r.v: r["rank"] for r in graphs.pagerank(table(spark, edges), tol=1e-7).collect()}
    assert got == {v: pytest.approx(x, abs=1e-6) for v, x in rank.items()}
    sink = {r.v: r["rank"] for r in graphs.pagerank(table(spark, [(0, 1)]), tol=1e-7).collect()}
    assert sum(sink.values()) == pytest.approx(1)


def test_hits_and_eigenvector(spark):
    got = {r.v: r for r in graphs.hits(table(spark, [(0, 2), (1, 2)])).collect()}
    assert got[0].hub == pytest.approx(0.5) and got[2].authority == pytest.approx(1)
    cycle = {r.v: r.value for r in graphs.eigenvector(table(spark, [(0, 1), (1, 2), (2, 0)])).collect()}
    assert cycle == {i: pytest.approx(3**-0.5) for i in range(3)}


def test_density(spark):
    r = graphs.density_reciprocity(table(spark, [(0, 1), (1, 0), (1, 2)])).first()
    assert (r.n, r.m) == (3, 3) and r.density == pytest.approx(0.5) and r.reciprocity == pytest.approx(2 / 3)


def test_random_graphs(spark):
    full = graphs.random_graph(spark, 10, 1.0)
    assert full.count() == 90 and graphs.random_graph(spark, 10, 0.0).count() == 0
    assert graphs.small_world(spark, 20, 4, 0.0).count() == 40
    with pytest.raises(ValueError):
        graphs.small_world(spark, 20, 3, 0.1)
    assert len(graphs.preferential(30, 2)) == 56
    assert graphs.small_world_added(spark, 20, 4, 0.0).count() == 40 < graphs.small_world_added(spark, 20, 4, 1.0).count()
    even = graphs.regular(12, 3, 1)
    assert all(sum(v in e for e in even) == 3 for v in range(12)) and len(set(even)) == 18
    with pytest.raises(ValueError):
        graphs.regular(3, 3)
    dense = graphs.clustered(60, 3, 1.0)
    assert len(dense) == len(set(dense)) == 57 * 3


def test_histogram(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (None,)], "x double")
    assert [r.n for r in dists.histogram(df, "x", 4).orderBy("bin").collect()] == [1, 1, 0, 1]
    one = dists.histogram(spark.createDataFrame([(3.0,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r.left, r.right, r.n) for r in one] == [(2.5, 3.0, 0), (3.0, 3.5, 1)]
    assert dists.histogram(df.limit(0), "x", 2).count() == 0


def test_average_against_numpy(spark):
    import numpy as np

    made = {"a": ([0, 1, 2, 4], [1, 2, 1]), "b": ([1, 3, 5], [0, 4])}
    rows = [("k", i, float(e[j]), float(e[j + 1]), c[j]) for i, (e, c) in made.items() for j in range(len(c))]
    got = dists.average(spark.createDataFrame(rows, "key string, id string, left double, right double, n int"), 7).orderBy("bin").collect()
    grid = np.linspace(0, 5, 8)
    mid = (grid[1:] + grid[:-1]) / 2
    lines = [np.interp(mid, (np.array(e[1:]) + e[:-1]) / 2, np.array(c) / sum(c), left=0, right=0) for e, c in made.values()]
    assert [r.mean for r in got] == pytest.approx(np.mean(lines, 0).tolist())
    assert [r["std"] for r in got] == pytest.approx(np.std(lines, 0).tolist())


def test_integers(spark):
    h = spark.createDataFrame([(0.5, 2.0, 3.0, 1.0)], "left double, right double, mean double, std double")
    got = {r.degree: (r.mean, r["std"]) for r in dists.to_integers(h).collect()}
    assert got[0] == (pytest.approx(1.0), pytest.approx(1 / 3)) and got[1] == (pytest.approx(2.0), pytest.approx(2 / 3))


@pytest.fixture
def large(monkeypatch):
    """Every graph counts as too large to broadcast."""
    monkeypatch.setattr(graphs, "BROADCAST_EDGES", -1)


def test_searches_by_joins_are_the_same(spark, sample, monkeypatch):
    df = table(spark, sample)
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    measures = [graphs.reach_counts, graphs.path_stats, lambda e: graphs.path_stats(e, True), lambda e: graphs.betweenness(e)[0], lambda e: graphs.betweenness(e, True)[1], graphs.pagerank, graphs.hits, graphs.eigenvector]
    small = [rows(m(df)) for m in measures]
    monkeypatch.setattr(graphs, "BROADCAST_EDGES", -1)
    for a, m in zip(small, measures, strict=True):
        for x, y in zip(a, rows(m(df)), strict=True):
            assert list(x) == [pytest.approx(v, abs=1e-5) if isinstance(v, float) else v for v in y]


def test_brandes_by_joins(spark, sample, large):
    test_betweenness_against_brandes(spark, sample)


def test_power_iterations_by_joins(spark, large):
    test_pagerank(spark)
    test_hits_and_eigenvector(spark)


def test_strong_components_in_a_row(spark):
    """Cycles that lead to each other, with tails in and out, and a loop."""
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 9), (9, 8), (7, 0), (5, 5), (8, 6), (6, 8)]
    got = {r.v: r.component for r in graphs.strong_components(table(spark, edges)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 6, 9: 9}
    assert {tuple(r) for r in graphs.largest_strong_component(table(spark, edges)).collect()} == {(0, 1), (1, 2), (2, 0)}


@pytest.mark.parametrize("most", [1 << 20, 60, 6])
def test_components_by_tasks(spark, monkeypatch, most):
    """Random graphs with hubs, cycles, single links and loops, all of their edges in one task and few in each, by joins in the end."""
    monkeypatch.setattr(graphs, "GROUPED_EDGES", most)
    monkeypatch.setattr(graphs, "HUB", 8)
    g = random.Random(most)
    edges = sorted({(g.randrange(40), g.randrange(40)) for _ in range(45)} | {(0, i) for i in range(20, 32)} | {(i, 0) for i in range(26, 36)} | {(60 + i, 60 + (i + 1) % 9) for i in range(9)} | {(70, 71), (80, 80), (81, 60)})
    ends = set(itertools.chain(*edges))
    reach = {v: set(bfs(edges, v)[0]) for v in ends}
    both = edges + [(b, a) for a, b in edges]
    weak, strong = ({r.v: r.component for r in c.collect()} for c in graphs.both_components(table(spark, edges * 2).repartition(3)))
    assert weak == {v: min(bfs(both, v)[0]) for v in ends} == {r.v: r.component for r in graphs.weak_components(table(spark, edges)).collect()}
    assert strong == {v: min(u for u in reach[v] if v in reach[u]) for v in ends} == {r.v: r.component for r in graphs.strong_components(table(spark, edges)).collect()}


def test_components_of_names_in_few_jobs(spark):
    """A long chain and a cycle take as many jobs as any graph of their size; they took one and more for each edge."""
    edges = [(f"ü{i:03}", f"ü{i + 1:03}") for i in range(60)] + [("é1", "é2"), ("é2", "é1")]
    before = spark.range(1).rdd.id()
    got = graphs.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert spark.range(1).rdd.id() - before < 200
    assert {r.v: r.component for r in got} == {f"ü{i:03}": f"ü{i:03}" for i in range(61)} | {"é1": "é1", "é2": "é1"}


def test_fallback_to_the_largest_strong_component(spark):
    """An eigenvector that two vertices of a chain don't settle within few rounds."""
    df = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (0, 3), (3, 4)])
    with pytest.raises(graphs.NotConverged):
        graphs.eigenvector(df, max_iter=3)
    got = {r.v: r.value for r in graphs.or_largest_strong(df, graphs.eigenvector, max_iter=3).collect()}
    assert got == {i: pytest.approx(3**-0.5) for i in range(3)}


def test_core_shares_and_connection(spark):
    df = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)])
    got = {r.core: (r.n, r.share, r.min_core, r.max_core) for r in graphs.core_shares(graphs.core_numbers(df)).collect()}
    assert got == {2: (3, 0.5, 1, 2), 1: (3, 0.5, 1, 2)}
    assert graphs.average_clustering(df).first()[0] == pytest.approx((1 + 1 + 1 / 3 + 0) / 4)
    assert not graphs.is_connected(df).first()[0] and graphs.is_connected(df.filter("src < 5")).first()[0]


@pytest.fixture(scope="module")
def doubled():
    """A digraph in which vertices repeat: 0 to 9 as they come, 10 and more with the edges of one of those, and one with a loop only."""
    g = random.Random(8)
    one = {(g.randrange(10), g.randrange(10)) for _ in range(18)}
    of = lambda v: [v, *[v + 10 * i for i in range(1, 1 + v % 3)]]
    return sorted({(a, b) for x, y in one if x != y for a in of(x) for b in of(y)} | {(99, 99)})


def test_twins_share_their_neighbours(spark, doubled):
    got = {r.v: (r.rep, r["size"]) for r in graphs.twins(table(spark, doubled)).collect()}
    near = {v: (frozenset(b for a, b in doubled if a == v != b), frozenset(a for a, b in doubled if b == v != a)) for v in set(itertools.chain(*doubled))}
    groups = {x: [v for v in near if near[v] == x] for x in near.values()}
    assert got == {v: (min(groups[x]), len(groups[x])) for v, x in near.items()}
    assert any(n > 1 for _, n in got.values())


def test_betweenness_of_twins(spark, doubled, monkeypatch):
    """One search serves all twins: as many searches as groups of them, with the sums of a search from each vertex."""
    searched = []
    run = graphs.searched
    monkeypatch.setattr(graphs, "searched", lambda edges, graph, *more: searched.append(len(graph.names)) or run(edges, graph, *more))
    test_betweenness_against_brandes(spark, [e for e in doubled if e[0] != e[1]])
    assert searched[0] <= 10


def test_reach_and_paths_of_twins(spark, doubled):
    """Twins reach each other where they come back to themselves; each counts in the mean of the paths."""
    reach = {v: len(bfs(doubled, v)[0]) - 1 for v in set(itertools.chain(*doubled))}
    assert {r.v: r.descendants for r in graphs.reach_counts(table(spark, doubled)).collect()} == reach
    for directed in (True, False):
        inside = [e for e in doubled if 99 not in e]
        around = inside if directed else inside + [(b, a) for a, b in inside]
        weak = {v: min(bfs(inside + [(b, a) for a, b in inside], v)[0]) for v in set(itertools.chain(*inside))}
        top = min(set(weak.values()), key=lambda k: (-list(weak.values()).count(k), k))
        hops = [h for v in weak if weak[v] == top for h in bfs(around, v)[0].values() if h]
        r = graphs.path_stats(table(spark, doubled), directed).first()
        assert (r.diameter, r.mean_path) == (max(hops), pytest.approx(sum(hops) / len(hops)))


def brandes(edges, n):
    """Values of n vertices and of the edges by one search from each vertex."""
    near = [[b for a, b in edges if a == v] for v in range(n)]
    node, edge = dict.fromkeys(range(n), 0.0), dict.fromkeys(edges, 0.0)
    for s in node:
        dist, paths, order = bfs(edges, s)
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in near[v]:
                if dist[w] == dist[v] + 1:
                    c = paths[v] / paths[w] * (1 + delta[w])
                    edge[v, w] += c
                    delta[v] += c
            node[v] += delta[v] if v != s else 0
    return node, edge


def around_hubs(g, hubs, others):
    """A digraph of hubs and vertices that have edges with hubs only."""
    mixed = {(g.randrange(hubs), v) if g.random() < 0.5 else (v, g.randrange(hubs)) for v in range(hubs, hubs + others) for _ in range(g.randrange(4))}
    return sorted(mixed | {x for x in ((g.randrange(hubs), g.randrange(hubs)) for _ in range(hubs)) if x[0] != x[1]})


@pytest.mark.parametrize("seed", range(8))
def test_covers_against_brandes(monkeypatch, seed):
    """Hubs, any graphs, long chains; blocks and batches of few and of many; a core that is too large."""
    import numpy as np

    from tributary.operators import covers

    g = random.Random(seed)
    for name, few in (("SOURCES", 3), ("CLASSES", 3), ("ROWS", 2), ("PAIRS", 2)):
        monkeypatch.setattr(covers, name, few if seed % 2 else getattr(covers, name))
    chain = [(i, i + 1) for i in range(150)] + [(g.randrange(151), g.randrange(151)) for _ in range(3)]
    for edges, n in ((around_hubs(g, 4, 30), 34), ([(g.randrange(15), g.randrange(15)) for _ in range(40)], 15), (chain, 151)):
        edges = sorted({e for e in edges if e[0] != e[1]})
        a, b = np.array(edges).T
        cover, *where = covers.covered(a, b, n)
        half = cover.searches // 2
        sums = covers.sums(cover, np.arange(half)) + covers.sums(cover, np.arange(half, cover.searches))
        value, flow = covers.assembled(cover, *where, sums, a, b, n)
        node, edge = brandes(edges, n)
        assert value.tolist() == pytest.approx([node[v] for v in range(n)]) and flow.tolist() == pytest.approx([edge[e] for e in edges])
        assert covers.covered(a, b, n, len(cover.one) - 1) is None


def test_betweenness_searches_among_hubs(spark, monkeypatch):
    """Vertices around hubs are searched from once for all with the same targets; each was a search through the whole graph."""
    edges = around_hubs(random.Random(3), 5, 60)
    made, run = [], graphs.added_up
    monkeypatch.setattr(graphs, "added_up", lambda spark, shared, search, n, step: made.append(n) or run(spark, shared, search, n, step))
    nodes, flows = graphs.betweenness(table(spark, [*edges, (90, 90), (7, 7)]))
    node, edge = brandes(edges, 65)
    there = {*itertools.chain(*edges), 7, 90}
    assert {r.v: pytest.approx(r.value) for r in nodes.collect()} == {v: node.get(v, 0.0) for v in there}
    assert {(r.src, r.dst): pytest.approx(r.value) for r in flows.collect()} == edge
    targets = {frozenset(b for a, b in edges if a == v) for v in range(5, 65)} - {frozenset()}
    assert made == [5 + len(targets)]


def test_reach_searches_between_strong_components(spark, monkeypatch):
    """Cycles with tails in and out and between them: each vertex of a cycle was searched from by itself."""
    edges = [(i, (i + 1) % 150) for i in range(150)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 203), (300, 4), (301, 4), (205, 310), (310, 311), (400, 401), (402, 402)]
    made, run = [], graphs.added_up
    monkeypatch.setattr(graphs, "added_up", lambda spark, shared, search, n, step: made.append(len(shared[0].names)) or run(spark, shared, search, n, step))
    got = {r.v: (r.descendants, r.ancestors) for r in graphs.reach_counts(table(spark, edges)).collect()}
    reach = {v: set(bfs(edges, v)[0]) - {v} for v in set(itertools.chain(*edges))}
    assert got == {v: (len(x), sum(v in y for y in reach.values())) for v, x in reach.items()}
    assert made == [7, 7]
    monkeypatch.setattr(graphs, "BROADCAST_EDGES", -1)
    assert {r.v: (r.descendants, r.ancestors) for r in graphs.reach_counts(table(spark, edges)).collect()} == got


def test_paths_without_rows_for_pairs(spark, monkeypatch):
    """A graph of more than BROADCAST_EDGES edges, each direction one, was searched by joins, a row for each pair."""
    g = random.Random(4)
    edges = sorted({(g.randrange(90), g.randrange(90)) for _ in range(140)})
    both = edges + [(b, a) for a, b in edges]
    weak = {v: frozenset(bfs(both, v)[0]) for v in set(itertools.chain(*edges))}
    top = max(set(weak.values()), key=len)
    monkeypatch.setattr(graphs, "BROADCAST_EDGES", 60)
    monkeypatch.setattr(graphs, "distances", None)
    hops = [h for v in top for h in bfs(both, v)[0].values() if h]
    r = graphs.path_stats(table(spark, edges)).first()
    assert (r.diameter, r.mean_path) == (max(hops), pytest.approx(sum(hops) / len(hops)))


def test_sums_count_every_pair(spark, monkeypatch):
    """What edges carry less what vertices do is a path's end for each pair that is connected; no search is made by a vertex."""
    df = table(spark, around_hubs(random.Random(11), 6, 80))
    monkeypatch.setattr(graphs, "searched", None)
    nodes, flows = graphs.betweenness(df)
    pairs = sum(r.descendants for r in graphs.reach_counts(df).collect())
    assert sum(r.value for r in flows.collect()) - sum(r.value for r in nodes.collect()) == pytest.approx(pairs)
