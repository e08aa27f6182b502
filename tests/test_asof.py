"""As-of joins against a scan of all pairs."""

import datetime as dt
import operator
import random

import pytest

from tributary.operators import asof

OPS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}


def brute(left, right, op, how):
    out = []
    for k, t, i in left:
        fits = [(rt, ri) for rk, rt, ri in right if None not in (k, t, rk, rt) and rk == k and OPS[op](t, rt)]
        if fits:
            near = max(x[0] for x in fits) if op[0] == ">" else min(x[0] for x in fits)
            out.append((i, max((x for x in fits if x[0] == near), key=lambda x: x[1])[1]))
        elif how == "left":
            out.append((i, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("op", list(OPS))
@pytest.mark.parametrize("how", ["inner", "left"])
def test_asof_is_the_nearest_of_all_pairs(spark, op, how):
    rng = random.Random(op + how)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "only left", None])
    left = [(key(), rng.choice([None, *range(90)]), i) for i in range(300)]
    right = [(key() if rng.random() < 0.9 else "only right", rng.choice([None, *range(0, 90, 3)]), i) for i in range(150)]
    a = spark.createDataFrame(left, "k string, t long, id long").repartition(3)
    b = spark.createDataFrame(right, "k string, t long, id long").repartition(2)
    for rows in (1 << 20, 20):  # one bucket, and many for the hot key
        found = asof.asof_join(a, b, "t", "t", ["k"], op, how, bucket_rows=rows)
        assert found.columns == ["k", "t", "id", "t_right", "id_right"]
        assert sorted(((r["id"], r["id_right"]) for r in found.collect()), key=str) == brute(left, right, op, how)


def test_kinds_of_times(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    for make, kind in ((day, "date"), (at, "timestamp"), (float, "double")):
        a = spark.createDataFrame([(1, make(5), "x"), (1, make(1), "y"), (2, make(5), "z")], f"k int, t {kind}, v string")
        b = spark.createDataFrame([(1, make(2), 20), (1, make(4), 40), (1, make(6), 60)], f"k int, u {kind}, w int")
        assert sorted((r.v, r.w, r.u) for r in asof.asof_join(a, b, "t", "u", ["k"], bucket_rows=1).collect()) == [("x", 40, make(4))]
        assert sorted((r.v, r.w) for r in asof.asof_join(a, b, "t", "u", ["k"], "<=", bucket_rows=1).collect()) == [("x", 60), ("y", 20)]


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 5)], "k int, t long")
    none = a.limit(0)
    assert [tuple(r) for r in asof.asof_join(a, none, "t", "t", ["k"], how="left").collect()] == [(1, 5, None)]
    assert asof.asof_join(none, a, "t", "t", ["k"]).count() == asof.asof_join(none, none, "t", "t", ["k"], how="left").count() == 0
