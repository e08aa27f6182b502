"""Small-world graphs against exact search."""

import numpy as np
import pytest

from tributary.operators import search, smallworld


def rows(n, d, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x if not clusters else rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.4 * x


def built(x):
    units = smallworld._unit(x).astype(np.float32)
    level = np.sort(np.floor(-np.log(np.random.default_rng(1).random(len(x))) / np.log(16)).astype(int))[::-1]
    return units, level, smallworld.build(units, level)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_one_graph(clusters):
    units, level, layers = built(rows(3000, 32, clusters=clusters))
    assert [len(x) for x in layers] == [int((level >= i).sum()) for i in range(level.max() + 1)]
    q = units[::10]
    exact = np.argsort(-(q @ units.T), 1)[:, :5]
    found, value = smallworld.search(units, layers, q, 64)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found[:, :5], exact, strict=True)]) > 0.95
    assert (np.diff(value, axis=1) <= 0).all()
    for links in layers:  # no row links to itself or twice to another, and none beyond its layer
        for i, r in enumerate(links.tolist()):
            r = [x for x in r if x >= 0]
            assert i not in r and len(set(r)) == len(r) and max(r, default=0) < len(links)


@pytest.mark.parametrize("part", [1 << 14, 300])
def test_graph_knn(spark, tmp_path, part):
    x = rows(1500, 24)
    x[7] = x[8] = x[1000]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [1.0] * 3), (2003, [float("nan")] * 24), (2004, [])]
    index = spark.createDataFrame(data, "id long, vector array<double>").repartition(3)
    path = str(tmp_path / "index")
    smallworld.graph_index(index, part=part).write.parquet(path)
    kept = spark.read.parquet(path)
    assert kept.count() == 1500 and kept.select("part").distinct().count() == -(-1500 // part)
    asked = index.filter("id % 20 = 0").selectExpr("id AS query", "vector")
    found = smallworld.graph_knn(kept, asked)
    assert found.columns == ["query", "rank", "id", "score"]
    exact = {}
    for r in search.knn(index.filter("id < 2000"), asked, 5, "cosine").collect():
        exact.setdefault(r["query"], {})[r["id"]] = r["score"]
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], {})[r["id"]] = r["score"]
    assert set(got) == {i for i in range(0, 1500, 20)}
    assert np.mean([len(set(exact[q]) & set(got[q])) / 5 for q in got]) > 0.95
    assert all(abs(got[q][i] - exact[q][i]) < 1e-9 for q in got for i in set(got[q]) & set(exact[q]))
    again = smallworld.graph_index(index.repartition(7), part=part)  # the graph doesn't hang on the order of rows
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_small_and_empty_indexes(spark):
    empty = spark.createDataFrame([], "id string, vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("w", None)], "query string, vector array<float>")
    assert smallworld.graph_knn(smallworld.graph_index(empty), asked).count() == 0
    three = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "id string, vector array<float>")
    found = smallworld.graph_knn(smallworld.graph_index(three), asked, k=9).orderBy("rank").collect()
    assert [(r["query"], r["rank"], r["id"]) for r in found] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")]
    assert [r["id"] for r in smallworld.graph_knn(smallworld.graph_index(three), asked, k=0).collect()] == ["a"]
