"""Command line over the library: trade, hypergraph, evaluation, state, reference, graph and SQL commands.

Each command is a function of the session and its parsed options; those with --out write a CSV (or, where the file's name
ends so, a Markdown table), the others print lines.
"""

from __future__ import annotations

import argparse
import functools
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graphs, hyper, instructions, judge, ranks, references, report, state, trade
from .plans.lineage import cut
from .sources import files, sinks
from .sqltool import SqlTool

BUCKET, PARTNER = "material string, code string, quality string", "code long, name string, iso3 string, is_group boolean"
ROUTE = "route string, input_hs string, output_hs string"
COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(*options: str, **more: dict):
    """Register a command: options are required texts, more are further options of argparse."""

    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = (f, [(o, {"required": True}) for o in options] + list(more.items()))
        return f

    return add


def written(df: DataFrame, out: str) -> None:
    if out.endswith(".md"):
        sinks.markdown(df).orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(out)
    else:
        sinks.write_csv(df, out)


@command("folder", "years", "buckets", "partners", "out", materials={}, pattern={"default": "{year}.parquet"}, perspective={"default": "US"}, reporter={"type": int})
def trade_export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Import shares and ranks of a reporter; years without a file are named and skipped."""
    reporter = a.reporter or trade.perspective(a.perspective)
    flows, missing = files.yearly_trade(spark, a.folder, files.parse_years(a.years), a.pattern)
    for year in missing:
        print(f"no file for {year}", file=sys.stderr)
    if flows is None:
        raise SystemExit("no trade files")
    buckets = files.read_csv(spark, a.buckets, BUCKET)
    if a.materials:
        buckets = buckets.filter(F.col("material").isin(files.parse_materials(a.materials)))
    flows = trade.newest_file_wins(flows).withColumn("pos", F.monotonically_increasing_id())
    written(trade.import_share(flows, buckets, files.read_csv(spark, a.partners, PARTNER), reporter), a.out)


@command("buckets", "out")
def buckets(spark: SparkSession, a: argparse.Namespace) -> None:
    """The codes of each material with their quality, and how many codes there are."""
    rows = files.read_csv(spark, a.buckets, BUCKET)
    print(f"{trade.distinct_codes(rows).first()[0]} codes")
    written(sinks.bucket_mapping(rows), a.out)


def _graph(spark: SparkSession, path: str, a: argparse.Namespace) -> tuple[hyper.Hypergraph, dict]:
    doc = files.state(spark, path)
    return hyper.build(doc["entries"], doc["materials"], a.include_unregistered, a.drop_sourceless), doc


FLAGS = {"include_unregistered": {"action": "store_true"}, "drop_sourceless": {"action": "store_true"}}


def _base(g: hyper.Hypergraph, code: str) -> DataFrame:
    try:
        return hyper.checked_base(g, code)
    except ValueError as e:
        raise SystemExit(str(e)) from e


@command("state", "base", "out", **FLAGS)
def criticality(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every vertex with its criticality and rank."""
    g, _ = _graph(spark, a.state, a)
    rated, reached = hyper.criticality_and_reach(g, _base(g, a.base))
    written(hyper.ranked(rated, g, reached).orderBy("rank", "code"), a.out)


@command("state", "base", "out", **FLAGS)
def criticality_summary(spark: SparkSession, a: argparse.Namespace) -> None:
    """One row: reach, precursors, the build's counts, the first three codes."""
    g, doc = _graph(spark, a.state, a)
    rated, reached = hyper.criticality_and_reach(g, _base(g, a.base))
    one = hyper.report_summary(rated, g, reached)
    written(one.crossJoin(hyper.audit(doc["entries"], doc["materials"])), a.out)  # one row each


def _disruption(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    g, doc = _graph(spark, a.state, a)
    totals = trade.partner_totals(files.data_table(spark, a.trade), [int(x) for x in a.reporters.split(",")])
    dominated = trade.dominance(totals, [int(x) for x in a.groups.split(",") if x], a.threshold)
    crit = hyper.criticality(g, _base(g, a.base)) if a.base else None
    return hyper.disruption(g, doc["materials"], dominated, crit)


TRADE = {
    "threshold": {"type": float, "default": 0.6}, "base": {}, "reporters": {"default": "0,97", "help": "aggregate reporters, which are dropped"},
    "groups": {"default": "", "help": "aggregate partners, which count in totals only"}, **FLAGS,
}


@command("state", "trade", "out", **TRADE)
def disruption(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every registered code: status, dominance, what falls with it, and with a base its loss of reach."""
    written(_disruption(spark, a), a.out)


@command("state", "trade", "out", **TRADE)
def disruption_summary(spark: SparkSession, a: argparse.Namespace) -> None:
    written(hyper.summary(_disruption(spark, a)), a.out)


@command("states", "base", "out", p={"type": float, "default": 0.98}, k={"type": int, "default": 10}, samples={"type": int, "default": 1000}, seed={"type": int, "default": 0}, **FLAGS)
def rank_stability(spark: SparkSession, a: argparse.Namespace) -> None:
    """Criticality of several states (a comma list of paths) against each other and against their aggregates.

    Four tables: the comparisons' statistics, and beside it the Borda order (-aggregate), each run against either aggregate
    (-runs) and the degrees over all runs (-degrees).
    """
    lists, sides = [], []
    for i, path in enumerate(a.states.split(",")):
        g, _ = _graph(spark, path, a)
        run = F.lit(f"{i:04d}").alias("run")
        lists.append(hyper.criticality(g, _base(g, a.base)).select(run, F.col("code").alias("item"), F.col("criticality").alias("score")))
        degrees = hyper.degrees(g)
        sides += [degrees.select(run, F.lit(k).alias("side"), F.col(f"{k}_degree").alias("degree")) for k in ("in", "out")]
    runs = functools.reduce(DataFrame.union, lists)
    borda = ranks.borda(runs)
    number = F.row_number().over(Window.orderBy("left_run", "right_run"))  # pairs of a few runs
    pairs = ranks.run_pairs(runs).withColumn("seed", a.seed + 99 + number)
    each = cut(ranks.against(runs, {"borda": borda, "critsum": ranks.critsum(runs)}, a.p, a.k, a.samples, a.seed))
    kinds = each.select("rbo", "overlap", F.col("aggregate").alias("kind"))
    both = ranks.tie_averaged(runs, pairs, a.p, a.k, a.samples).select("rbo", "overlap", F.lit("pairwise").alias("kind")).union(kinds)
    written(ranks.stability(both, ["kind"]), a.out)
    written(ranks.aggregate_order(runs, borda), f"{a.out}-aggregate")
    written(each, f"{a.out}-runs")
    written(ranks.degree_table(functools.reduce(DataFrame.union, sides)), f"{a.out}-degrees")


@command("caches", "out")
def judge_summary(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rates of the judges' caches (label:judge:path, comma list), with intervals of their precision."""
    judged = _judged(spark, a.caches)
    written(judge.summary(judged).join(judge.bootstrap_ci(judged, order="pos"), ["label", "judge"]), a.out)


@command("caches", "first", "second", "out")
def judge_agreement(spark: SparkSession, a: argparse.Namespace) -> None:
    """Agreement and kappa of two judges, by label and pooled (label *)."""
    judged = _judged(spark, a.caches)
    each = judge.agreement(judged, a.first, a.second, ["label"])
    pooled = judge.agreement(judged, a.first, a.second, []).select(F.lit("*").alias("label"), "criterion", "n", "agreement", "kappa")
    written(each.union(pooled).orderBy("label", "criterion"), a.out)


@command("caches", "out")
def error_modes(spark: SparkSession, a: argparse.Namespace) -> None:
    written(judge.error_modes(_judged(spark, a.caches)).orderBy("pooled", "label", "judge", F.desc("n"), "mode"), a.out)


def _judged(spark: SparkSession, caches: str) -> DataFrame:
    parts = []
    for x in caches.split(","):
        label, judge_, path = x.split(":", 2)
        parts.append(files.judge_records(spark, path).withColumn("label", F.lit(label)).withColumn("judge", F.lit(judge_)))
    return functools.reduce(DataFrame.unionByName, parts)


@command("state", "nomenclature", "out")
def hs_validity(spark: SparkSession, a: argparse.Namespace) -> None:
    """Registered and valid materials, processes, and those with an invalid code."""
    doc = files.state(spark, a.state)
    written(judge.state_audit(doc["entries"], doc["materials"], files.six_digit_codes(spark, a.nomenclature)), a.out)


@command("state", "contents", "out", summary={"action": "store_true"})
def evidence(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whether references name the inputs and outputs of each process; with --summary the rates."""
    doc = files.state(spark, a.state)
    texts = files.reference_texts(doc["refs"], files.contents(spark, a.contents)).select("process", F.col("content").alias("text"))
    got = judge.evidence(texts, judge.side_terms(doc["entries"], doc["materials"]), raw=True)
    written(judge.evidence_summary(got) if a.summary else got, a.out)


@command("state", "routes", "out")
def route_recall(spark: SparkSession, a: argparse.Namespace) -> None:
    """Known routes: strict, lenient or missed; malformed ones are named."""
    good, bad = judge.valid_routes(files.read_csv(spark, a.routes, ROUTE))
    for r in bad.collect():  # a user's list
        print(f"malformed route {r[0]}", file=sys.stderr)
    written(judge.route_recall(good, hyper.sides(files.state(spark, a.state)["entries"])), a.out)


@command("state", "listed", "out")
def coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    """Codes of the hypergraph against a list of critical ones."""
    counts = judge.participation(files.state(spark, a.state)["entries"])
    written(judge.coverage(counts, files.listed_codes(spark, a.listed)), a.out)


@command("state", "out")
def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    doc = files.state(spark, a.state)
    written(judge.gate_audit(doc["entries"], doc["processes"], doc["materials"]), a.out)


@command("state", "out", min_refs={"type": int, "default": 3}, min_domains={"type": int, "default": 2})
def scores(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores of the processes from their reviewed references."""
    written(references.process_scores(files.state(spark, a.state)["refs"], a.min_refs, a.min_domains), a.out)


@command("state", "out")
def duplicates(spark: SparkSession, a: argparse.Namespace) -> None:
    written(state.duplicate_processes(files.state(spark, a.state)["entries"]), a.out)


@command("state", "instructions", "out")
def edit(spark: SparkSession, a: argparse.Namespace) -> None:
    """Documents of the processes (JSON lines) after a file of instructions (JSON lines); what is refused is named."""
    doc = files.state(spark, a.state)
    todo = spark.read.schema(instructions.INSTRUCTION).json(a.instructions)
    after, messages = instructions.folded(instructions.documents_of(doc["processes"], doc["entries"], doc["refs"]), todo)
    for r in messages.orderBy("pos").collect():  # a user's list
        print(f"{r.pos} {r.process}: {r.message}", file=sys.stderr)
    after.write.mode("overwrite").json(a.out)


@command("state", "code", "out")
def processes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Processes that a material takes part in, with its role."""
    code = spark.createDataFrame([(a.code,)], "code string")
    written(state.linked_processes(files.state(spark, a.state)["entries"], code), a.out)


@command("state", "out", codes={})
def materials(spark: SparkSession, a: argparse.Namespace) -> None:
    """Materials to research: those that aren't mined, on demand of a comma list of codes."""
    rows = state.unmined(files.state(spark, a.state)["materials"])
    written(state.wanted(rows, files.parse_materials(a.codes) if a.codes else None).select("code", "name").orderBy("code"), a.out)


@command("folder", failed={"action": "store_true"})
def list_references(spark: SparkSession, a: argparse.Namespace) -> None:
    """URLs of the cached references; with --failed also those that couldn't be fetched."""
    raw = spark.read.text(f"{a.folder}/*.json", wholetext=True).select(F.from_json("value", "url string, error string").alias("r")).select("r.*").filter("url IS NOT NULL")
    for r in state.listed_references(raw, a.failed).orderBy("url").toLocalIterator():
        print(r.line)


@command("folder", "out")
def metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mean, deviation and range of the numbers in a folder's JSON documents; unreadable ones are named."""
    rows, bad = files.metric_documents(spark, a.folder)
    for r in bad.toLocalIterator():
        print(f"unreadable {r.path}", file=sys.stderr)
    c = F.col("value")
    written(rows.groupBy("key").agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).orderBy("key"), a.out)


@command("path", "out", kind={})
def graph(spark: SparkSession, a: argparse.Namespace) -> None:
    """Degrees, PageRank, components and betweenness of a graph file's vertices."""
    edges = files.read_graph(spark, a.path, a.kind)
    rows = graphs.degrees(edges)
    for part in (graphs.pagerank(edges), graphs.weak_components(edges), graphs.betweenness(edges)[0].withColumnRenamed("value", "betweenness")):
        rows = rows.join(part, "v")
    written(rows, a.out)


@command("path", "to", "to_kind", kind={})
def convert_graph(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_edges(files.read_graph(spark, a.path, a.kind), a.to, a.to_kind)


@command("table", "macro", "out")
def macros(spark: SparkSession, a: argparse.Namespace) -> None:
    """Names and values of a one-row report, for a document."""
    written(sinks.macros(files.data_table(spark, a.table), a.macro), a.out)


@command("table", "n", "key", "out", seed={"type": int})
def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    written(report.sampled(files.data_table(spark, a.table), int(a.n), a.key, a.seed), a.out)


@command("path", "query")
def sql(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """A query over one table as JSON; an error is a row."""
    rows = SqlTool(spark, a.path).query(a.query)
    print(json.dumps(rows, default=str))
    return rows


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict] | None:
    top = argparse.ArgumentParser(prog="tributary", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        p = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0], description=f.__doc__)
        for option, how in options:
            p.add_argument(f"--{option.replace('_', '-')}", **how)
    a = top.parse_args(argv)
    return COMMANDS[a.command][0](spark or SparkSession.builder.appName("tributary").getOrCreate(), a)


if __name__ == "__main__":
    main()
