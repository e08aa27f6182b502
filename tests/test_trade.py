"""Trade: dominance, aggregates, coverage, shares."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tributary.operators import trade

FLOW = "partner long, reporter long, code string, year long, value decimal(18,2)"


def flows(spark, rows):
    return spark.createDataFrame([(p, r, c, 2020, None if v is None else Decimal(v)) for p, r, c, v in rows], FLOW)


@pytest.mark.parametrize(("rows", "share", "dominated"), [
    ([(1, 10, "100000", 40), (1, 11, "100000", 40), (2, 10, "100000", 50)], 80 / 130, True),
    ([(1, 10, "100000", 50), (2, 10, "100000", 50)], 0.5, False),
    ([(1, 10, "100000", 60), (2, 10, "100000", 40)], 0.6, True),
])
def test_dominance(spark, rows, share, dominated):
    r = trade.dominance(trade.partner_totals(flows(spark, rows), [0, 97]), [899], 0.6).first()
    assert (r.top_partner, r.dominated) == (1, dominated) and r.share == pytest.approx(share)


def test_aggregates_count_in_the_total_only(spark):
    rows = [(1, 97, "100000", 500), (1, 10, "100000", 50), (899, 10, "100000", 940)]
    r = trade.dominance(trade.partner_totals(flows(spark, rows), [0, 97]), [899], 0.6).first()
    assert (r.top_partner, r.total, r.dominated) == (1, 990.0, False) and r.share == pytest.approx(50 / 990)


def test_null_reporters_stay_and_null_codes_go(spark):
    got = trade.partner_totals(flows(spark, [(1, None, "100000", 5), (1, 10, None, 7), (None, 10, "100000", 9)]), [97]).collect()
    assert [(r.code, r.partner, r.value) for r in got] == [("100000", 1, Decimal(5))]


def test_coverage_ignores_zero_flows(spark):
    rows = [(1, 10, "100000", 5), (1, 11, "100000", 0), (1, 12, "300000", 5), (1, 97, "300000", 5)]
    got = {r.code: (r.n_reporters, r.n_all) for r in trade.reporter_coverage(flows(spark, rows), [0, 97]).collect()}
    assert got == {"100000": (1, 2), "300000": (1, 2)}


def test_shares_and_ranks(spark):
    rows = [(9, 842, "100000", 30), (1, 842, "100000", 30), (2, 842, "100000", 70), (3, 842, "200000", None), (1, 1, "100000", 99)]
    buckets = spark.createDataFrame([("a", "100000", "clean"), ("b", "100000", "shared"), ("b", "200000", "clean")], "material string, code string, quality string")
    partners = spark.createDataFrame([(1, "One", "ONE", False), (2, "Two", None, False), (3, "Group", "GRP", True)], "code long, name string, iso3 string, is_group boolean")
    got = trade.import_share(flows(spark, rows).coalesce(1).withColumn("pos", F.monotonically_increasing_id()), buckets, partners, 842).collect()
    of_a = sorted((r.exporter_rank, r.exporter, r.exporter_iso3, r.import_share_pct) for r in got if r.material == "a")
    assert of_a == [(1, "Two", "", 53.85), (2, "Unknown (9)", "", 23.08), (3, "One", "ONE", 23.08)]
    zero = next(r for r in got if r.hs_bucket == "200000")
    assert (zero.import_share_pct, zero.exporter) == (0.0, "Unknown (3)")


def test_ranks_go_by_rounded_shares(spark):
    """Shares that differ beyond two digits tie; who was encountered first is ahead."""
    kind = "partner long, reporter long, code string, year int, value decimal(18,3), pos long"
    rows = [(5, 842, "100000", 2020, Decimal("10000.001"), 0), (4, 842, "100000", 2020, Decimal("10000.004"), 1), (6, 842, "100000", 2020, Decimal("80000"), 2)]
    got = trade.import_share(spark.createDataFrame(rows, kind), spark.createDataFrame([("a", "100000", "clean")], "material string, code string, quality string"), spark.createDataFrame([], "code long, name string, iso3 string, is_group boolean"), 842).collect()
    assert sorted((r.exporter_rank, r.exporter, r.import_share_pct, r.import_value_usd) for r in got) == [(1, "Unknown (6)", 80.0, 80000.0), (2, "Unknown (5)", 10.0, 10000.0), (3, "Unknown (4)", 10.0, 10000.0)]


def test_lookups_of_codes_and_partners(spark):
    rows = spark.createDataFrame([(1, "AAA", "old", 0), (1, "BBB", "new", 1), (2, None, "x", 0)], "code int, iso3 string, name string, pos int")
    assert {tuple(r) for r in trade.partner_table(rows, "pos").collect()} == {(1, "BBB", "new"), (2, None, "x")}
    codes = spark.createDataFrame([("1", "own"), ("2", "own"), ("3", "own")], "code string, description string")
    texts = spark.createDataFrame([("1", "listed"), ("3", None)], "code string, text string")
    assert {r.code: r.description for r in trade.described(codes, texts).collect()} == {"1": "listed", "2": "own", "3": None}
    assert trade.distinct_codes(codes.union(codes)).first()[0] == 3 and trade.perspective("US") == 842
    with pytest.raises(ValueError):
        trade.perspective("EU")


def test_first_dominant_keeps_encounter_order(spark):
    rows = [("m", "b", Decimal(5), 0), ("m", "a", Decimal(5), 1), ("z", "a", Decimal(0), 0)]
    got = trade.first_dominant(spark.createDataFrame(rows, "code string, supplier string, value decimal(10,2), pos long"), 0.5).collect()
    assert [(r.code, r.supplier) for r in got] == [("m", "b")]


def test_newest_file_wins(spark):
    df = spark.createDataFrame([(2020, 0, 1), (2020, 1, 2), (2019, 0, 3)], "year int, file_pos int, x int")
    assert {r.x for r in trade.newest_file_wins(df).collect()} == {2, 3}


@pytest.mark.parametrize("name", ["rbo_vs_aggregate", "dominant_report"])
def test_trade_is_read_once(spark, name):
    """What is summed up from the lines is kept: the rest of the query doesn't join them again."""
    from tributary.plans import catalog

    assert "l_extendedprice" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
