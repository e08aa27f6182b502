"""Judges' verdicts: rates, agreement, error modes, evidence, route recall, coverage."""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import entry_class, has_code, is_six_digits
from ..functions.text import RUNS_ALONE, contradicts, ended_terms, norm, norm_bytes, stands, usable_terms
from ..plans.lineage import cut

CRITERIA = ["process_plausible", "inputs_outputs_correct", "hs_codes_correct", "overall_correct"]
#: Bytes of the terms of all processes that are broadcast at most.
BROADCAST_TERMS = 1 << 24


def yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def rate(condition: Column) -> Column:
    return F.count_if(condition) / F.count("*")


def summary(judged: DataFrame) -> DataFrame:
    """Per label and judge: number, precision, rates of the criteria, and verdicts that contradict themselves."""
    odd = contradicts(F.col("overall_correct"), [F.col(c) for c in CRITERIA[:3]], F.col("rationale"))
    return judged.groupBy("label", "judge").agg(
        F.count("*").alias("n"), F.count_if(yes("overall_correct")).alias("overall_correct"), rate(yes("overall_correct")).alias("precision"),
        rate(yes("process_plausible")).alias("plausible_rate"), rate(yes("inputs_outputs_correct")).alias("io_rate"), rate(yes("hs_codes_correct")).alias("hs_rate"),
        F.count_if(odd).alias("inconsistent_count"),
    )


def kappa(n: Column, same: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Agreement and Cohen's kappa from counts; 0 where chance agreement is 1."""
    po, pa, pb = same / n, a / n, b / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return po, F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - F.when(pe != 1, pe)))


def agreement(judged: DataFrame, first: str, second: str, by: list[str], criteria: list[str] = CRITERIA) -> DataFrame:
    """Per group and criterion: matched keys, agreement and kappa of two judges. Pooled over labels without groups."""
    of = lambda judge, side: judged.filter(F.col("judge") == judge).select("label", "key", *[yes(c).alias(f"{side}_{c}") for c in criteria])
    both = of(first, "a").join(of(second, "b"), ["label", "key"])
    flat = both.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in criteria])).alias("x"))
    sums = flat.groupBy(*by, "x.criterion").agg(
        F.count("*").alias("n"), F.count_if(F.col("x.a") == F.col("x.b")).alias("same"), F.count_if(F.col("x.a")).alias("na"), F.count_if(F.col("x.b")).alias("nb")
    )
    po, k = kappa(F.col("n"), F.col("same"), F.col("na"), F.col("nb"))
    return sums.select(*by, "criterion", "n", po.alias("agreement"), k.alias("kappa"))


def pooled_kappa(summaries: DataFrame, agreements: DataFrame) -> DataFrame:
    """Kappa over all labels from per-label summaries (label, judge, precision) and agreements (label, n_both, agreement).

    Labels without exactly two judges add nothing to the sums but stay in the denominator.
    """
    pair = summaries.groupBy("label").agg(F.count_distinct("judge").alias("k"), F.min_by("precision", "judge").alias("pa"), F.max_by("precision", "judge").alias("pb"))
    rows = agreements.join(pair, "label", "left").withColumn("w", F.when(F.col("k") == 2, F.col("n_both")).otherwise(0))
    one = rows.agg(F.sum("n_both").alias("n"), *[F.sum(F.coalesce(F.col(c) * F.col("w"), F.lit(0.0))).alias(c) for c in ("agreement", "pa", "pb")])
    po, k = kappa(F.col("n"), F.col("agreement"), F.col("pa"), F.col("pb"))
    return one.filter("n > 0").select(F.col("n").alias("n_total"), po.alias("agreement"), k.alias("kappa"))


def error_modes(judged: DataFrame) -> DataFrame:
    """Modes of verdicts that aren't correct, per label (label given) and pooled (label null); empty ones are unspecified."""
    mode = F.coalesce(F.nullif(F.col("error_mode"), F.lit("")), F.lit("unspecified"))
    wrong = judged.filter(~yes("overall_correct")).withColumn("mode", mode)
    return wrong.groupingSets([["label", "judge", "mode"], ["judge", "mode"]], "label", "judge", "mode").agg(F.count("*").alias("n"), F.grouping("label").alias("pooled"))


def modes_of_any(judged: DataFrame) -> DataFrame:
    """Modes of every record that names one, whatever its verdict."""
    return judged.filter(F.coalesce(F.col("error_mode") != "", F.lit(False))).groupBy("label", F.col("error_mode").alias("mode")).agg(F.count("*").alias("n"))


def bootstrap_ci(judged: DataFrame, n_boot: int = 2000, seed: int = 0, order: str = "key") -> DataFrame:
    """Percentile interval of each label's and judge's precision by resampling its verdicts in their order.

    The resamples are those of Python's seeded generator, one choice a draw. For this a group's verdicts meet in one task,
    a byte each: a judge's cache of one label, which is bounded by what its verdicts cost. Larger groups: binomial_ci().
    """
    bits = judged.select("label", "judge", F.col(order).alias("o"), yes("overall_correct").cast("byte").alias("bit"))

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("o", kind="stable")
        return pd.DataFrame([(f.label.iloc[0], f.judge.iloc[0], *interval(f.bit.to_numpy(), n_boot, seed))], columns=["label", "judge", "ci_lo", "ci_hi"])

    return bits.groupBy("label", "judge").applyInPandas(draw, "label string, judge string, ci_lo double, ci_hi double")


def interval(bits, n_boot: int = 2000, seed: int = 0) -> tuple[float, float]:
    """The interval of the bits' mean; (0, 0) without any.

    Choices of Python's generator are its 32-bit numbers cut to the bits that n needs, those of n and more passed over;
    numpy draws the same numbers many at a time.
    """
    bits = np.asarray(bits, np.int64)
    n = len(bits)
    if not n:
        return 0.0, 0.0
    state = random.Random(seed).getstate()[1]
    source = np.random.RandomState()
    source.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    shift = np.uint32(32 - n.bit_length())
    means, held = [], np.zeros(0, np.int64)
    step = max(1, (1 << 22) // n)
    while len(means) < n_boot:
        want = min(step, n_boot - len(means)) * n
        while len(held) < want:
            raw = source.randint(0, 1 << 32, size=want, dtype=np.uint32) >> shift
            held = np.concatenate([held, raw[raw < n].astype(np.int64)])
        means += (bits[held[:want]].reshape(-1, n).sum(1) / n).tolist()
        held = held[want:]
    means.sort()
    return means[int(0.025 * n_boot)], means[int(0.975 * n_boot) - 1]


def binomial_ci(judged: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """As bootstrap_ci() for groups of any size: a resample's correct verdicts are a binomial draw from the group's two
    counts, which is all that travels. Seeded by the group's names."""
    counts = judged.groupBy("label", "judge").agg(F.count("*").alias("n"), F.count_if(yes("overall_correct")).alias("k"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                g = np.random.default_rng([seed, zlib.crc32(f"{r.label}/{r.judge}".encode())])
                means = np.sort(g.binomial(r.n, r.k / r.n, n_boot) / r.n)
                out.append((r.label, r.judge, means[int(0.025 * n_boot)], means[int(0.975 * n_boot) - 1]))
            yield pd.DataFrame(out, columns=["label", "judge", "ci_lo", "ci_hi"])

    return counts.mapInPandas(draw, "label string, judge string, ci_lo double, ci_hi double")


def gate_audit(entries: DataFrame, processes: DataFrame, registry: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: processes, those unscored or below the threshold, and those with untyped or unregistered entries."""
    known = registry.select("code").distinct().withColumn("known", F.lit(True))
    kind = entries.join(known, "code", "left").withColumn("class", entry_class(F.col("code"), F.col("known")))
    flags = kind.groupBy("process").agg(F.bool_or(F.col("class") == "untyped").alias("u"), F.bool_or(F.col("class") == "unregistered").alias("r"))
    return processes.join(flags, "process", "left").agg(
        F.count("*").alias("n_processes"), F.count_if(F.col("score").isNull()).alias("n_unscored"), F.count_if(F.col("score") < threshold).alias("n_below_tau"),
        F.count_if(yes("u")).alias("n_untyped_edges"), F.count_if(yes("r")).alias("n_unregistered_edges"),
    )


def invalid_edges(entries: DataFrame, nomenclature: DataFrame) -> DataFrame:
    """Processes with an entry whose code is given but not in the nomenclature."""
    return entries.filter(has_code(F.col("code"))).join(nomenclature.select("code"), "code", "left_anti").select("process").distinct()


def state_audit(entries: DataFrame, registry: DataFrame, nomenclature: DataFrame) -> DataFrame:
    """One row: registered materials, how many of these the nomenclature has, processes, and those with an invalid code."""
    known = registry.select("code").join(nomenclature.select("code").distinct().withColumn("ok", F.lit(True)), "code", "left")
    materials = known.agg(F.count("*").alias("n_registered"), F.count_if(yes("ok")).alias("n_valid"))
    edges = entries.agg(F.count_distinct("process").alias("n_processes"))
    bad = invalid_edges(entries.filter(is_six_digits(F.col("code"))), nomenclature).agg(F.count("*").alias("n_invalid_edges"))
    return materials.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(bad))  # one row each


def judge_on(judged: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per judge: verdicts on these keys, how many are correct, and their share (0 without any)."""
    hit = judged.join(keys, "key", "left_semi")
    every = judged.select("judge").distinct()
    sums = hit.groupBy("judge").agg(F.count("*").alias("n"), F.count_if(yes("overall_correct")).alias("k"))
    return every.join(sums, "judge", "left").select("judge", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("n_correct"), F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)).alias("fraction"))


def evidence(texts: DataFrame, terms: DataFrame, raw: bool = False) -> DataFrame:
    """Per process: whether any reference names a term of either side, and whether one names both.

    texts: process, text (normalised; raw: to be normalised here, which is faster than norm()); terms: process, ins and outs
    (arrays of normalised terms). Texts meet only their process's terms, which are broadcast if they have BROADCAST_TERMS
    bytes at most. A text is cut into words once, however many its terms are; only terms with blanks or signs whose words all
    stand in it are looked for.
    """
    terms = cut(terms)
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda t: F.concat(t, F.lit("\0"))), ""), F.lit("")).cast("binary")
    own = cut(terms.select("process", joined("ins").alias("ins"), joined("outs").alias("outs")))
    size = own.agg(F.sum(F.octet_length("ins") + F.octet_length("outs") + 16)).first()[0] or 0
    rows = texts.filter("text <> ''").select("process", F.col("text").cast("binary").alias("text")).join(F.broadcast(own) if size <= BROADCAST_TERMS else own, "process")
    kind = rows.schema["process"].dataType.simpleString()
    hits = rows.mapInArrow(lambda batches: _mentioned(batches, raw), f"process {kind}, i boolean, o boolean")
    got = hits.groupBy("process").agg(F.bool_or(F.col("i") | F.col("o")).alias("any_mention"), F.bool_or(F.col("i") & F.col("o")).alias("grounded"))
    return terms.select("process").join(got, "process", "left").select("process", yes("any_mention").alias("any_mention"), yes("grounded").alias("grounded"))


def _mentioned(batches: Iterator[pa.RecordBatch], raw: bool) -> Iterator[pa.RecordBatch]:
    """process, i, o: whether each text (process, text, ins, outs, terms with a zero after each) names a term of either side."""
    parsed = functools.lru_cache(1 << 12)(ended_terms)
    for batch in batches:
        for lo in range(0, len(batch), 256):  # texts that are Python's at a time
            part = batch.slice(lo, 256)
            found = [[], []]
            for text, *sides in zip(*(part.column(c).to_pylist() for c in ("text", "ins", "outs")), strict=True):
                text = norm_bytes(text) if raw else text
                words = frozenset(text.translate(RUNS_ALONE).split())
                for out, ended in zip(found, sides, strict=True):
                    single, other = parsed(ended)
                    out.append(bool(text) and (not single.isdisjoint(words) or any(runs <= words and stands(text, term) for term, runs in other)))
            yield pa.RecordBatch.from_arrays([part.column("process"), *[pa.array(x, pa.bool_()) for x in found]], ["process", "i", "o"])


def side_terms(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """process, ins, outs: the terms of each side's entries, for evidence().

    An entry's terms are its own name and, if its code is registered, the name and aliases there; normalised, distinct, and
    without terms too short or too common to ground a material.
    """
    known = registry.select("code", F.col("name").alias("_name"), "aliases")
    rows = entries.join(known, "code", "left")
    empty = F.array().cast("array<string>")
    names = F.concat(F.array("name", "_name"), F.coalesce("aliases", empty))
    terms = usable_terms(F.filter(F.transform(names, lambda x: norm(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    side = lambda k: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("side") == k, F.col("t"))))))
    return rows.withColumn("t", terms).groupBy("process").agg(side("in").alias("ins"), side("out").alias("outs"))


def evidence_summary(support: DataFrame) -> DataFrame:
    """One row: processes, and the shares of those with any mention and of those grounded by one reference."""
    share = lambda c: F.coalesce(F.count_if(F.col(c)) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return support.agg(F.count("*").alias("n_processes"), share("any_mention").alias("any_rate"), share("grounded").alias("grounded_rate"))


def ranked_modes(judged: DataFrame) -> DataFrame:
    """mode, n of all wrong verdicts, the most frequent first in place (ties by name)."""
    pooled = error_modes(judged).filter("pooled = 1").groupBy("mode").agg(F.sum("n").alias("n"))
    return pooled.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "mode")))


def route_recall(routes: DataFrame, processes: DataFrame) -> DataFrame:
    """Per route its best status: strict (both sides within a process's), lenient (both overlap) or miss.

    routes: route, ins, outs; processes: process, ins, outs (arrays of codes). Equal ones are looked at once. A route overlaps
    with a process that has one of its pairs of an input and an output; what holds it has each of them, so it is compared with
    the processes of its rarest pair, and with none if it has only one.
    """
    sides = [F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))).alias(c) for c in ("ins", "outs")]
    paired = lambda df: df.withColumn("i", F.explode("ins")).withColumn("o", F.explode("outs"))
    held = paired(processes.select(*sides).distinct())
    often = held.groupBy("i", "o").agg(F.count("*").alias("n"))
    # a null code is within no process
    unfit = F.coalesce(F.exists("ins", lambda x: x.isNull()) | F.exists("outs", lambda x: x.isNull()), F.lit(False))
    asked = routes.select("route", *sides, unfit.alias("unfit"))
    met = paired(asked.select("ins", "outs", "unfit").distinct()).join(often, ["i", "o"]).groupBy("ins", "outs", "unfit").agg(F.min(F.struct("n", "i", "o")).alias("rare"))
    several = met.filter("NOT unfit AND size(ins) * size(outs) > 1").select(F.col("ins").alias("a"), F.col("outs").alias("b"), "rare.i", "rare.o")
    within = F.size(F.array_except("a", "ins")) + F.size(F.array_except("b", "outs")) == 0
    strict = several.join(held, ["i", "o"]).filter(within).select(F.col("a").alias("ins"), F.col("b").alias("outs"), F.lit(True).alias("strict")).distinct()
    found = met.join(strict, ["ins", "outs"], "left").select("ins", "outs", "unfit", F.coalesce("strict", ~F.col("unfit") & (F.size("ins") * F.size("outs") == 1)).alias("strict"))
    best = asked.join(found, ["ins", "outs", "unfit"]).groupBy("route").agg(F.bool_or("strict").alias("strict"))
    return routes.select("route").join(best, "route", "left").select("route", F.when(yes("strict"), "strict").when(F.col("strict").isNotNull(), "lenient").otherwise("miss").alias("status"))


def valid_routes(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes with code sets parsed from texts split by |, and the ids of those with an empty side or a malformed code."""
    codes = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, "\\|"), lambda x: F.trim(x)), lambda x: x != ""))
    parsed = routes.withColumn("ins", codes(F.col("input_hs"))).withColumn("outs", codes(F.col("output_hs")))
    good = (F.size("ins") > 0) & (F.size("outs") > 0) & F.forall("ins", is_six_digits) & F.forall("outs", is_six_digits)
    return parsed.filter(good), parsed.filter(~F.coalesce(good, F.lit(False))).select("route")


def participation(entries: DataFrame) -> DataFrame:
    """Distinct processes of each six-digit code, whichever side it is on."""
    return entries.filter(is_six_digits(F.col("code"))).groupBy("code").agg(F.count_distinct("process").alias("n_processes"))


def coverage(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: codes of the hypergraph that a list holds, those it lacks, and their share."""
    flags = counts.join(listed.select("code").distinct().withColumn("in_list", F.lit(True)), "code", "left")
    return flags.agg(F.count_if(yes("in_list")).alias("overlap"), F.count_if(~yes("in_list")).alias("only_here"), F.coalesce(F.count_if(~yes("in_list")) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("fraction_only"))
