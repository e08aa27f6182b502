"""Numbers of the reports: ties at the top, examples, cascades, pooled rates, ranges, stand-in scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain

#: Stand-in bands of source quality by the kind of a host, best first; a table of scores may replace them.
SOURCE_BANDS = [(1.0, "(\\.gov|\\.edu|europa\\.eu)$"), (0.8, "(nature\\.com|sciencedirect\\.com|springer\\.com|wiley\\.com|acs\\.org)$"), (0.6, "\\.org$"), (0.4, "\\.(com|net)$"), (0.0, ".*")]


def tied_with_third(ranked: DataFrame, value: str) -> DataFrame:
    """One row: the third-highest value (of rows, not of distinct values) and how many rows share it; null with fewer than three."""
    third = ranked.orderBy(F.desc(value)).limit(3).agg(F.when(F.count("*") == 3, F.min(value)).alias("third"))
    return ranked.crossJoin(F.broadcast(third)).groupBy("third").agg(F.count_if(F.col(value) == F.col("third")).alias("n_tied"))  # third: one row


def examples(counts: DataFrame, by: str, n: str, key: str, first: int = 10) -> DataFrame:
    """The rows of each group with the largest n, ties by key."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(n), key))
    return counts.withColumn("place", place).filter(F.col("place") <= first)


def cascades(report: DataFrame, first: int = 10) -> DataFrame:
    """place, code, n_dependents of dominated codes with dependents, most first, ties by code."""
    hit = report.filter(F.col("dominated") & (F.col("n_dependents") > 0)).select("code", "n_dependents")
    top = hit.orderBy(F.desc("n_dependents"), "code").limit(first)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_dependents"), "code"))).select("place", "code", "n_dependents")


def primary_count(summaries: DataFrame, primary: str) -> DataFrame:
    """Per label the number of verdicts of the primary judge, else of the first one by name, and whether judges disagree on it."""
    of = F.max(F.when(F.col("judge") == primary, F.col("n")))
    return summaries.groupBy("label").agg(F.coalesce(of, F.min_by("n", "judge")).alias("n"), (F.count_distinct("n") > 1).alias("differ"))


def pooled_precision(summaries: DataFrame) -> DataFrame:
    """Per judge the sum of correct verdicts over the sum of all."""
    return summaries.groupBy("judge").agg(F.sum("n").alias("n"), F.sum("overall_correct").alias("k")).select("judge", "n", F.coalesce(F.col("k") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("precision"))


def percent_range(df: DataFrame, value: str) -> DataFrame:
    """One row: least and greatest of the values as whole percents."""
    p = F.round(F.col(value) * 100).cast("int")
    return df.agg(F.min(p).alias("low"), F.max(p).alias("high"))


def score_stats(df: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"))


def source_score(url: Column) -> Column:
    """A stand-in for the URL scorer: a band by the host; null without a host."""
    host, out = F.regexp_replace(F.regexp_replace(domain(url), "^[^@]*@", ""), ":[0-9]*$", ""), F.lit(None).cast("double")
    for score, pattern in reversed(SOURCE_BANDS):
        out = F.when(host.rlike(pattern), score).otherwise(out)
    return out


def cached(materials: DataFrame, buckets: DataFrame) -> DataFrame:
    """Materials with the bucket cached under their name in lower case with _ for blanks, null without one."""
    key = F.regexp_replace(F.lower("material"), " ", "_")
    return materials.withColumn("key", key).join(buckets, "key", "left").drop("key")


def sampled(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """n rows at random; with a seed those whose keys come first by a hash, however the rows are partitioned."""
    if seed is None:
        return df.orderBy(F.rand()).limit(n)
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
