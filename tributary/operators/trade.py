"""Bilateral trade: import shares, exporter ranks, supplier dominance, coverage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Value columns are decimal where sums must not hang on their order; shares are doubles.


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the largest ordinal of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(ordinal)))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def partner_names(partners: DataFrame, keep_groups: bool = False) -> DataFrame:
    """code, name, iso3 of partner areas; groups go unless they are kept, a missing iso3 is empty."""
    out = partners if keep_groups else partners.filter(~F.coalesce("is_group", F.lit(False)))
    return out.select("code", "name", F.coalesce("iso3", F.lit("")).alias("iso3"))


def imports(trade: DataFrame, reporter: int, codes: DataFrame | None = None) -> DataFrame:
    """Flows into one reporter, on demand only of the codes (a table with the column code)."""
    out = trade.filter(F.col("reporter") == reporter)
    return out if codes is None else out.join(codes.select("code").distinct(), "code", "left_semi")


def import_share(trade: DataFrame, buckets: DataFrame, partners: DataFrame, reporter: int, ordinal: str = "pos") -> DataFrame:
    """Per material, code and year the exporters' shares of a reporter's imports, with ranks.

    A value counts for every material that claims its code. Values and shares are rounded to two digits; ranks go by the
    rounded share, ties by who was encountered first (the smallest ordinal of the flows). Codes' claims and partners are
    dimension tables: Spark broadcasts them if they are small, and joins by sort beyond that.
    """
    flows = imports(trade, reporter).groupBy("code", "partner", "year").agg(F.sum(F.coalesce("value", F.lit(0))).alias("value"), F.min(ordinal).alias("pos"))
    claimed = flows.join(buckets.select("material", "code", "quality"), "code")
    sums = claimed.groupBy("material", "code", "quality", "partner", "year").agg(F.sum("value").alias("value"), F.min("pos").alias("pos"))
    group = Window.partitionBy("material", "code", "year")
    total = F.sum("value").over(group).cast("double")
    ranked = sums.withColumn("import_share_pct", F.round(share_of(F.col("value").cast("double"), total), 2))
    ranked = ranked.withColumn("exporter_rank", F.row_number().over(group.orderBy(F.desc("import_share_pct"), "pos", "partner")))
    named = ranked.join(partner_names(partners).withColumnRenamed("code", "partner"), "partner", "left")
    return named.select(
        "material", F.col("code").alias("hs_bucket"), F.col("quality").alias("hs_bucket_quality"), "year",
        F.coalesce("name", F.format_string("Unknown (%d)", "partner")).alias("exporter"), F.coalesce("iso3", F.lit("")).alias("exporter_iso3"),
        F.round("value", 2).cast("double").alias("import_value_usd"), "import_share_pct", "exporter_rank",
    )


def partner_totals(trade: DataFrame, agg_reporters: Iterable[int]) -> DataFrame:
    """Exports by code and partner without aggregate reporters; rows without code or partner go, null reporters stay."""
    real = F.coalesce(~F.col("reporter").isin(list(agg_reporters)), F.lit(True))
    return trade.filter(real & F.col("code").isNotNull() & F.col("partner").isNotNull()).groupBy("code", "partner").agg(F.sum("value").alias("value"))


def reporter_coverage(trade: DataFrame, agg_reporters: Iterable[int], codes: DataFrame | None = None) -> DataFrame:
    """Distinct reporters with positive flows by code, and over all codes before they are restricted (n_all)."""
    real = trade.filter(F.coalesce(~F.col("reporter").isin(list(agg_reporters)), F.lit(True)) & (F.col("value") > 0)).select("code", "reporter").distinct()
    everyone = real.agg(F.count_distinct("reporter").alias("n_all"))
    of = real if codes is None else real.join(codes.select("code").distinct(), "code", "left_semi")
    return of.groupBy("code").agg(F.count("reporter").alias("n_reporters")).crossJoin(F.broadcast(everyone))  # everyone: one row


def dominance(totals: DataFrame, agg_partners: Iterable[int], threshold: float) -> DataFrame:
    """Per code the total of all partners, the largest partner that is no aggregate, its share, and whether it dominates.

    Codes without a positive total or without such a partner go. Ties go to the smaller partner code.
    """
    total = totals.groupBy("code").agg(F.sum("value").alias("total"))
    real = totals.filter(~F.col("partner").isin(list(agg_partners)))
    top = real.groupBy("code").agg(F.max(F.struct("value", (-F.col("partner")).alias("minus"))).alias("top"))
    out = total.filter("total > 0").join(top, "code")
    share = F.col("top.value").cast("double") / F.col("total").cast("double")
    return out.select("code", F.col("total").cast("double").alias("total"), (-F.col("top.minus")).alias("top_partner"), share.alias("share"), (share >= threshold).alias("dominated"))


def first_dominant(flows: DataFrame, threshold: float) -> DataFrame:
    """Per code the supplier encountered first (by pos) whose share of the total reaches the threshold; code, supplier, share."""
    by = cut(flows.groupBy("code", "supplier").agg(F.sum("value").alias("value"), F.min("pos").alias("pos")))  # flows are read once
    total = by.groupBy("code").agg(F.sum("value").alias("total")).filter("total <> 0")
    share = F.col("value").cast("double") / F.col("total").cast("double")
    hit = by.join(total, "code").withColumn("share", share).filter(F.col("share") >= threshold)
    return hit.groupBy("code").agg(F.min(F.struct("pos", "supplier", "share")).alias("m")).select("code", "m.supplier", "m.share")


def exports_by_year(trade: DataFrame, partners: DataFrame) -> DataFrame:
    """Per code and year the flows (from, to, value; largest first, ties by names) and their total."""
    names = partner_names(partners).select("code", "iso3")
    pairs = trade.groupBy("code", "year", "partner", "reporter").agg(F.sum("value").alias("value"))
    out = pairs.join(names.select(F.col("code").alias("partner"), F.col("iso3").alias("from")), "partner", "left")
    out = out.join(names.select(F.col("code").alias("reporter"), F.col("iso3").alias("to")), "reporter", "left")
    out = out.withColumns({"from": F.coalesce("from", F.format_string("UNK_%d", "partner")), "to": F.coalesce("to", F.format_string("UNK_%d", "reporter"))})
    flow = F.struct((-F.col("value")).alias("minus"), "from", "to")
    nested = out.groupBy("code", "year").agg(F.sort_array(F.collect_list(flow)).alias("f"), F.sum("value").cast("double").alias("total"))
    return nested.select("code", "year", F.transform("f", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), (-x["minus"]).cast("double").alias("value"))).alias("exports"), "total")


def newest_file_wins(flows: DataFrame, year: str = "year", position: str = "file_pos") -> DataFrame:
    """Rows of each year's last file: a later file replaces an earlier one for its years."""
    last = flows.groupBy(year).agg(F.max(position).alias(position))
    return flows.join(last, [year, position], "left_semi")


def share_of(value: Column, total: Column) -> Column:
    """In percent; 0 without a total."""
    return F.when(total > 0, value / total * 100).otherwise(0.0)


def partner_table(rows: DataFrame, ordinal: str) -> DataFrame:
    """code, iso3, name of all partner areas, groups too; of a code that repeats the last row counts."""
    return last_wins(rows, ["code"], ordinal).select("code", "iso3", "name")


def described(codes: DataFrame, descriptions: DataFrame, fallback: str = "description") -> DataFrame:
    """codes with the nomenclature's text for their code; a column of their own only where the nomenclature lacks the code."""
    known = descriptions.select("code", F.col("text").alias("_text"), F.lit(True).alias("_known"))
    out = codes.join(known, "code", "left")
    return out.withColumn(fallback, F.when(F.col("_known"), F.col("_text")).otherwise(F.col(fallback))).drop("_text", "_known")


def distinct_codes(buckets: DataFrame) -> DataFrame:
    """One row: how many codes all materials' buckets hold."""
    return buckets.agg(F.count_distinct("code").alias("n_codes"))


def dominant_report(flows: DataFrame, graph, threshold: float = 0.75) -> DataFrame:
    """code, supplier, share, n_dependents: codes with a dominant supplier and how many others fall with each of them."""
    from . import hyper

    found = first_dominant(flows, threshold)
    fell = hyper.propagate(graph, found.select(F.col("code").alias("scenario"), F.col("code").alias("v")).join(graph.vertices, "v", "left_semi"))
    others = fell.filter("scenario <> v").groupBy(F.col("scenario").alias("code")).agg(F.count("*").alias("n_dependents"))
    return found.join(others, "code", "left").select("code", "supplier", "share", F.coalesce("n_dependents", F.lit(0)).alias("n_dependents"))


def perspective(name: str) -> int:
    """The reporter of a perspective; only the United States' is supported."""
    if name != "US":
        raise ValueError(f"perspective {name} isn't supported")
    return 842
