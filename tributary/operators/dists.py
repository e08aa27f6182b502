"""Distributions: histograms, metrics over documents, averages on a common grid, integer bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Per group and bin (from 0): lower edge, upper edge, count; equal widths, the last bin closed, a range of width 0 widened by 0.5."""
    by = by or []
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(*by, v.alias("v"))
    lo, hi = F.min("v"), F.max("v")
    edges = rows.groupBy(*by).agg(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi")).filter("lo IS NOT NULL")
    joined = rows.join(F.broadcast(edges), by) if by else rows.crossJoin(F.broadcast(edges))  # a row for each group
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = joined.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """key, n, mean, std (population), min, max of numeric columns; booleans count as 0 and 1, nulls not at all."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in keys])).alias("x")).select("x.key", "x.v").filter("v IS NOT NULL")
    return flat.groupBy("key").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def average(distributions: DataFrame, bins: int = 25) -> DataFrame:
    """key, bin, left, mean, std of distributions (key, id, left, right, n) on a grid common to each key.

    Counts become shares; their values between bin centres are interpolated, 0 beyond the outer centres.
    """
    keyed = distributions.withColumn("c", (F.col("left") + F.col("right")) / 2)
    total = keyed.groupBy("key", "id").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("c", "n"))).alias("points"))  # a row's bins
    edge = distributions.groupBy("key").agg(F.min("left").alias("lo"), F.max("right").alias("hi"))
    one = total.join(edge, "key").select("key", "id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "points", "total")
    width = (F.col("hi") - F.col("lo")) / bins
    x = F.col("lo") + (F.col("bin") + 0.5) * width
    pts = F.filter(F.transform("points", lambda p: F.struct(p["c"].alias("c"), F.when(F.col("total") > 0, p["n"] / F.nullif(F.col("total"), F.lit(0))).otherwise(p["n"]).cast("double").alias("y"))), lambda p: p["c"].isNotNull())
    one = one.withColumn("x", x).withColumn("p", pts)
    below = F.element_at(F.filter("p", lambda q: q["c"] <= F.col("x")), -1)
    above = F.get(F.filter("p", lambda q: q["c"] >= F.col("x")), F.lit(0))
    some = F.exists("p", lambda q: q["c"] <= F.col("x")) & F.exists("p", lambda q: q["c"] >= F.col("x"))
    one = one.withColumn("b", F.when(some, below)).withColumn("a", F.when(some, above))
    gap = F.col("a.c") - F.col("b.c")
    y = F.when(F.col("b").isNull(), 0.0).when(gap == 0, F.col("b.y")).otherwise(F.col("b.y") + (F.col("a.y") - F.col("b.y")) * (F.col("x") - F.col("b.c")) / F.nullif(gap, F.lit(0.0)))
    return one.withColumn("y", y).groupBy("key", "bin").agg(F.min(F.col("lo") + F.col("bin") * width).alias("left"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def to_integers(hist: DataFrame) -> DataFrame:
    """degree, mean, std: bins (left, right, mean, std) dealt to whole numbers by overlap; deviations add in quadrature."""
    ends = hist.agg(F.floor(F.min("left")).alias("lo"), (F.ceil(F.max("right")) - 1).alias("hi")).filter("hi >= lo").select(F.explode(F.sequence("lo", "hi")).alias("degree"))
    own = hist.withColumn("degree", F.explode(F.sequence(F.floor("left"), F.greatest(F.floor("left"), F.ceil("right") - 1))))
    part = F.greatest(F.lit(0.0), F.least(F.col("right"), F.col("degree") + 1.0) - F.greatest(F.col("left"), F.col("degree").cast("double"))) / (F.col("right") - F.col("left"))
    sums = own.withColumn("w", part).filter("w > 0").groupBy("degree").agg(F.sum(F.col("mean") * F.col("w")).alias("m"), F.sqrt(F.sum(F.pow(F.col("std") * F.col("w"), F.lit(2)))).alias("s"))
    return ends.join(sums, "degree", "left").select("degree", F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("s", F.lit(0.0)).alias("std"))
