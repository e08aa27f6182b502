"""Predicates and classes of product codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIX_DIGITS = "^[0-9]{6}$"

#: The sections of the Harmonized System, as first chapter, last chapter, numeral.
SECTIONS = [
    (1, 5, "I"), (6, 14, "II"), (15, 15, "III"), (16, 24, "IV"), (25, 27, "V"), (28, 38, "VI"), (39, 40, "VII"),
    (41, 43, "VIII"), (44, 46, "IX"), (47, 49, "X"), (50, 63, "XI"), (64, 67, "XII"), (68, 70, "XIII"), (71, 71, "XIV"),
    (72, 76, "XV"), (78, 83, "XV"), (84, 85, "XVI"), (86, 89, "XVII"), (90, 92, "XVIII"), (93, 93, "XIX"), (94, 96, "XX"), (97, 97, "XXI"),
]


def is_six_digits(code: Column) -> Column:
    return F.coalesce(code.rlike(SIX_DIGITS), F.lit(False))


def typed_code(code: Column) -> Column:
    """The trimmed code if it has six digits, else null."""
    return F.when(is_six_digits(F.trim(code)), F.trim(code))


def has_code(code: Column) -> Column:
    """Any code that is neither null nor empty."""
    return F.coalesce(code != "", F.lit(False))


def entry_class(code: Column, registered: Column) -> Column:
    """untyped, unregistered or ok; the code isn't trimmed."""
    return F.when(~is_six_digits(code), "untyped").when(F.coalesce(registered, F.lit(False)), "ok").otherwise("unregistered")


def chapter(code: Column) -> Column:
    """The first two characters as a number; null where they aren't one."""
    return F.substring(code, 1, 2).try_cast("int")


def legend(codes: DataFrame) -> DataFrame:
    """section, chapters: the ranges of chapters that the codes lie in, each once."""
    spans = F.lit(None).cast("string")
    for lo, hi, _ in reversed(SECTIONS):
        spans = F.when(chapter(F.col("code")).between(lo, hi), f"{lo:02d}-{hi:02d}").otherwise(spans)
    return codes.select(section(F.col("code")).alias("section"), spans.alias("chapters")).filter("section IS NOT NULL").distinct()


def section(code: Column) -> Column:
    """The section of a code; null for chapters without one."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(SECTIONS):
        out = F.when(chapter(code).between(lo, hi), name).otherwise(out)
    return out


def sections(spark) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "lo int, hi int, section string")
