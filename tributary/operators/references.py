"""References of processes: selection, scores, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import combined_score, domain


def selected(refs: DataFrame, min_refs: int = 2, min_domains: int = 2) -> DataFrame:
    """Per process its top references (process, pos, url, combined): the best of each of min_domains domains first, then by score up to min_refs.

    A process with fewer reviewed references than min_refs keeps all of them; one with too few domains only the seeds.
    Ties keep the order of pos. References without a domain never seed; exact repeats of a chosen one aren't filled in.
    """
    reviewed = refs.filter(F.col("source_score").isNotNull() & F.col("content_score").isNotNull())
    reviewed = reviewed.withColumn("combined", combined_score(F.col("content_score"), F.col("source_score"))).withColumn("domain", domain(F.col("url")))
    all_of = Window.partitionBy("process")
    by_score = all_of.orderBy(F.desc("combined"), "pos")
    first_of_domain = F.row_number().over(Window.partitionBy("process", "domain").orderBy(F.desc("combined"), "pos")) == 1
    first_equal = F.row_number().over(Window.partitionBy("process", "url", "source_score", "content_score").orderBy("pos")) == 1
    rows = reviewed.withColumn("n", F.count("*").over(all_of)).withColumn("lead", F.col("domain").isNotNull() & first_of_domain).withColumn("once", first_equal)
    rows = rows.withColumn("seed_no", F.when(F.col("lead"), F.sum(F.col("lead").cast("int")).over(by_score)))
    rows = rows.withColumn("seed", F.coalesce(F.col("seed_no") <= min_domains, F.lit(False)))
    seeds = F.sum(F.col("seed").cast("int")).over(all_of)
    rows = rows.withColumn("seeds", seeds)
    spare = ~F.col("seed") & F.col("once")
    rows = rows.withColumn("fill_no", F.when(spare, F.sum(spare.cast("int")).over(by_score)))
    fill = (F.col("seeds") >= min_domains) & F.coalesce(F.col("fill_no") <= min_refs - F.col("seeds"), F.lit(False))
    keep = (F.col("n") < min_refs) | F.col("seed") | fill
    return rows.filter(keep).select("process", "pos", "url", "combined", "domain")


def process_scores(refs: DataFrame, min_refs: int = 2, min_domains: int = 2) -> DataFrame:
    """Per process: mean combined score of its top references; null unless all are reviewed, there are enough, and of enough domains."""
    top = selected(refs, min_refs, min_domains).groupBy("process").agg(F.count("*").alias("n_top"), F.sum(F.col("combined").cast("decimal(20,10)")).alias("total"), F.count_distinct("domain").alias("domains"))
    state = refs.groupBy("process").agg(F.count_if(F.col("source_score").isNull() | F.col("content_score").isNull()).alias("n_unreviewed"))
    fine = (F.col("n_unreviewed") == 0) & (F.col("n_top") >= min_refs) & (F.col("domains") >= min_domains)
    return state.join(top, "process", "left").select("process", F.coalesce("n_top", F.lit(0)).alias("n_top"), "n_unreviewed", F.when(fine, F.col("total").cast("double") / F.col("n_top")).alias("score"))


def purge_reasons(processes: DataFrame, refs: DataFrame, score_below: float = 0.5, scale_below: float = 0.4) -> DataFrame:
    """Processes to purge with their reasons: no score although every reference is reviewed (also without any), a low score, a low scale."""
    state = refs.groupBy("process").agg(F.count_if(F.col("source_score").isNull() | F.col("content_score").isNull()).alias("open"))
    rows = processes.join(state, "process", "left")
    reasons = [
        F.when(F.col("score").isNull() & (F.coalesce("open", F.lit(0)) == 0), "too few reviewed references"),
        F.when(F.col("score") < score_below, "score below threshold"),
        F.when(F.col("scale") < scale_below, "scale below threshold"),
    ]
    return rows.withColumn("reasons", F.concat_ws(" and ", *reasons)).filter("reasons <> ''").select("process", "reasons")


def purge_low_scale(processes: DataFrame, scale_below: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """Processes that stay, and the ids of those whose scale lies below; a null scale stays."""
    low = F.coalesce(F.col("scale") < scale_below, F.lit(False))
    return processes.filter(~low), processes.filter(low).select("process")


def purge_low_references(refs: DataFrame, processes: DataFrame, min_content: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """References without those of low content score, and processes with their score reset where one went."""
    low = F.coalesce(F.col("content_score") < min_content, F.lit(False))
    hit = refs.filter(low).select("process").distinct().withColumn("hit", F.lit(True))
    scored = processes.join(hit, "process", "left").withColumn("score", F.when(F.col("hit").isNull(), F.col("score"))).drop("hit")
    return refs.filter(~low), scored
