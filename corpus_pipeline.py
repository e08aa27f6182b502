"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, token files.

Each stage works on all that its predecessor kept; run() writes each one's rows to the shared folder and reads them
again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.decontamination import leaks
from tributary.llm.mixing import mix
from tributary.llm.near_dups import near_duplicates
from tributary.llm.quality import fit, score
from tributary.llm.tables import Workspace, table
from tributary.llm.token_ids import token_ids

#: Share of all tokens that mixing draws, and its weights by language; sources of a language weigh the same.
SHARE, WEIGHTS = (9, 10), [{"en": 5, "fr": 2, "de": 2, "es": 1}, {}]


def whole(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and document: all columns, out of reach of names that operators add."""
    return docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("document"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks 0 go; it learns from all labelled documents outside the held-out fifth.

    Every row is judged by its whole text alone, so repeated rows and rows without doc_id are; null and empty texts have a
    score as well. An empty table stays empty; columns are carried along under names of their own, so none can clash.
    """
    voter = fit(docs, table(spark, sf_dir, "labels"))
    # one pass carries the documents along, under names of their own: no join brings verdicts and texts together
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = score(docs.select(*[F.col(c).alias(a) for c, a in own.items()]), voter, own["doc_id"], own["text"], tuple(own.values()))
    return judged.filter("predicted = 1").select(*[F.col(a).alias(c) for c, a in own.items()])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id.

    Rows of one doc_id are one document and stay together, but of those with equal texts one stays, as of rows without
    doc_id with equal texts: that whose columns are the smallest as JSON. Only such rows are grouped.
    """
    ws = Workspace(spark, "pipeline-near")
    verdicts = ws.keep(near_duplicates(docs).select("doc_id", "kept"), "verdicts")
    rest = docs.join(verdicts.filter("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = verdicts.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    if again.isEmpty() and verdicts.filter("doc_id IS NULL").isEmpty():
        return rest
    again = ws.keep(again, "again")
    once = rest.filter("doc_id IS NOT NULL").join(again, "doc_id", "left_anti").select(*docs.columns)
    more = rest.join(again, "doc_id", "left_semi").select(*docs.columns).union(rest.filter("doc_id IS NULL"))
    row = F.struct(*docs.columns)
    one = more.groupBy("doc_id", F.md5("text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.union(one.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy or a paraphrase of a benchmark item go.

    Rows of one doc_id go together, rows without doc_id by their text; null and empty texts hold nothing and stay. Very long
    texts are searched whole; an empty table stays empty; other columns, whatever their names, are kept as they are.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5("text")))
    gone = leaks(docs.select(key.alias("key"), "text"), table(spark, sf_dir, "benchmark"), doc_id="key", kind="string")
    gone = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, key == gone["_gone"], "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn, at most once each, to the target weights of languages and sources.

    Null languages and sources are groups of their own. Rows of one doc_id have one place in the order and are drawn together,
    as are rows without one; a null or empty text has no tokens and is drawn by its place like any other. A very long text is
    one document; an empty table stays empty. Columns are carried as one struct, so their names can't clash.
    """
    drawn = mix(whole(docs), {"lang": F.col("lang"), "source": F.col("source")}, WEIGHTS, SHARE, max_epochs=1)
    return drawn.filter("_copies > 0").select("document.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of what is left, read again: a row for each document, rows of one doc_id or of none each their own.

    A null or empty text is its end id alone; very long texts are encoded whole; an empty table gives no rows; other columns
    are left out.
    """
    return token_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dups),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mixing),
    ("token-ID output", tokens),
]

#: SQL can express neither the classifier nor the tokens; a test holds run() against a brute-force version of all stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
