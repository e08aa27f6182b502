"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import spread
from .alignment import alignment
from .collocations import collocations, collocations_sql
from .decontamination import leaks
from .licenses import license_scan
from .mixing import mix, mix_sql
from .near_dups import near_duplicates
from .neighbours import nearest
from .ngram_join import ngram_join, ngram_join_sql
from .pseudo_likelihood import lm_scores
from .quality import classify
from .tables import table
from .token_counts import token_counts
from .token_ids import token_ids
from .url_filter import Rule, url_filter, url_filter_sql


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of op6's contract.
RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]

#: op3's tree: domains are groups of sources; weights of names that aren't listed are 1; half of all tokens are drawn.
DOMAINS = ("web", "books", "forums", "news")
MIX_WEIGHTS = [{"web": 4, "books": 3, "forums": 2, "news": 1}, {"en": 5, "fr": 2, "de": 2, "es": 1}, {}]
MIX_SHARE = (1, 2)


def domain_of(source):
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS bigint)") if source is None else source
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.coalesce(n, F.lit(0)) % len(DOMAINS) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' id and text, for the operators that read no more."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, {"domain": domain_of(None), "lang": F.col("lang"), "source": F.col("source")}, MIX_WEIGHTS, MIX_SHARE)
    return out.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_n_tokens").alias("n_tokens"), F.col("_copies").alias("copies"), F.col("_take").alias("take"))


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_masked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op11_sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op12_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_level_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread(table(spark, sf_dir, "documents").select("text", "lang")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_token_ids": op2_token_ids,
    "op3_mixing": op3_mixing,
    "op4_masked_windows": op4_masked_windows,
    "op5_rare_words": op5_rare_words,
    "op6_url_templates": op6_url_templates,
    "op7_latent_leaks": op7_latent_leaks,
    "op8_min_max_dedup": op8_min_max_dedup,
    "op9_neighbour_votes": op9_neighbour_votes,
    "op10_cross_polytope": op10_cross_polytope,
    "op11_sparse_product": op11_sparse_product,
    "op12_byte_owners": op12_byte_owners,
    "op13_level_passes": op13_level_passes,
}

_DOMAIN_SQL = f"list_extract({list(DOMAINS)}, (coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1)::INTEGER)"

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mix_sql({"domain": _DOMAIN_SQL, "lang": "lang", "source": "source"}, MIX_WEIGHTS, MIX_SHARE),
    "op6_url_templates": url_filter_sql(RULES),
    "op11_sparse_product": ngram_join_sql(),
    "op13_level_passes": collocations_sql(),
}
