"""Estimates of reach and distances against searches from every vertex."""

import random
from collections import deque

from tributary.operators import sketches


def searched(edges):
    """{v: {w: steps}} for all w that v reaches, itself left out."""
    out, names = {}, {v for e in edges for v in e}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    far = {}
    for v in names:
        seen, todo = {v: 0}, deque([v])
        while todo:
            x = todo.popleft()
            for y in out.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        far[v] = {w: d for w, d in seen.items() if w != v}
    return far


def test_estimates_are_near(spark):
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(1500)}", f"v{rng.randrange(1500)}") for _ in range(2300)] + [("v1", "v1"), ("v2", "v3"), ("v2", "v3")]
    far = searched(edges)
    df = spark.createDataFrame([*edges, (None, "v5"), ("v6", None)], "src string, dst string")
    got = {r.v: r for r in sketches.reach_estimates(df).collect()}
    back = {v: 0 for v in far}
    for x in far.values():
        for w in x:
            back[w] += 1
    assert set(got) >= set(far) and max(map(len, far.values())) > 400
    error = lambda a, b: abs(a - b) / max(b, 20)
    assert max(error(got[v].descendants, len(far[v])) for v in far) < 0.08
    assert max(error(got[v].ancestors, back[v]) for v in far) < 0.08
    assert all(got[v].descendants == len(far[v]) for v in far if len(far[v]) < 100)  # few vertices are counted exactly
    one = sketches.distance_estimates(df).first()
    steps = sorted(d for x in far.values() for d in x.values())
    assert error(one.pairs, len(steps)) < 0.05 and abs(one.average_distance - sum(steps) / len(steps)) < 0.05 * sum(steps) / len(steps)
    assert abs(one.effective_diameter - steps[int(0.9 * len(steps))]) <= 1 and one.longest <= steps[-1]


def test_bounded_rounds_and_empty_graphs(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert [tuple(r) for r in sketches.reach_estimates(path, max_rounds=2).orderBy("v").collect()] == [(i, min(2, 6 - i), min(2, i)) for i in range(7)]
    assert tuple(sketches.distance_estimates(path).first()) == (21.0, 56 / 21, 5, 6)
    none = path.limit(0)
    assert sketches.reach_estimates(none).count() == 0 and sketches.distance_estimates(none).first().pairs == 0
