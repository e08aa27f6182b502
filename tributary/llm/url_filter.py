"""URL filters: rules first, then a tree of path templates for each host, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by nature: those with a digit.
VARIABLE = "[0-9]"
#: Children from which on rare ones (at most RARE of the parent's pages) are taken for a variable segment.
CHILDREN, RARE = 20, 0.05
#: Quantile of chi square (two degrees of freedom, 95 %) under which a branch counts as similar to its siblings.
SIMILAR = 5.991464547107979
#: Labelled pages' worth of the host's share in a template's purity, and of the corpus's in a host's; purity from which on it is rejected.
PRIOR, REJECT = 5.0, 0.5


@dataclass(frozen=True)
class Rule:
    """verdict block or allow for a host with its subdomains and the paths that start with path (it begins with /)."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern[: self.pattern.index("/")]

    @property
    def path(self) -> str:
        return self.pattern[self.pattern.index("/") :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The pattern of the longest rule that fits, else null."""
    out = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.pattern)) for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))]
    return F.coalesce(*out, F.lit(None).cast("string"))


def _nodes(tree: DataFrame, key: str) -> DataFrame:
    """Each key's segments as rows: level, segment, and prefix, which stands for the segments before it."""
    parts = F.split(key, "/")
    at = tree.select("host", key, "n", "bad", "good", parts.alias("parts"), F.posexplode(parts).alias("level", "segment"))
    return at.withColumn("prefix", F.md5(F.array_join(F.slice("parts", 1, F.col("level")), "/"))).drop("parts")


def _named(tree: DataFrame, key: str, name, alias: str) -> DataFrame:
    """host, key and its segments' new names, joined; name(): a segment's, from counts of the child and its parent."""
    nodes = _nodes(tree, key)
    child = nodes.groupBy("host", "prefix", "segment").agg(*[F.sum(c).alias(f"c_{c}") for c in ("n", "bad", "good")])
    parent = child.groupBy("host", "prefix").agg(F.count("*").alias("kids"), *[F.sum(f"c_{c}").alias(f"p_{c}") for c in ("n", "bad", "good")])
    names = child.join(parent, ["host", "prefix"]).select("host", "prefix", "segment", name().alias("name"))
    each = nodes.select("host", key, "level", "prefix", "segment").join(names, ["host", "prefix", "segment"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), "/")
    return each.groupBy("host", key).agg(whole.alias(alias))


def _wildcard() -> Column:
    return F.when((F.col("kids") > CHILDREN) & (F.col("c_n") <= RARE * F.col("p_n")), "*").otherwise(F.col("segment"))


def _merged() -> Column:
    """Chi square of a branch's pages that are blocked, allowed and without label, against its parent's shares."""
    chi = F.lit(0.0)
    none = (F.col("c_n") - F.col("c_bad") - F.col("c_good"), F.col("p_n") - F.col("p_bad") - F.col("p_good"))
    for c, p in ((F.col("c_bad"), F.col("p_bad")), (F.col("c_good"), F.col("p_good")), none):
        want = F.col("c_n") * (p.cast("double") / F.col("p_n"))
        chi = chi + F.when(p > 0, (c - want) * (c - want) / want).otherwise(0.0)
    return F.when((F.col("kids") > 1) & (F.col("segment") != "*") & (chi <= SIMILAR), "~").otherwise(F.col("segment"))


def url_filter(df: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of df: page_id, host, path, rule, verdict (block or allow), template and purity.

    Rows that a rule fits have its verdict and serve as labels. For the rest each host's paths form a tree of all their
    segments: segments with a digit, and rare ones among many siblings, become *; siblings whose shares of blocked,
    allowed and unlabelled pages don't differ from their parent's merge into ~. A template's purity is its blocked pages
    among its labelled ones, drawn towards the host's share by PRIOR pages; from REJECT on it is blocked. The host's share
    is that of all its pages known to be blocked (drawn towards the corpus's by PRIOR pages): pages without a label count
    there, else one blocked directory would reject all others of its host.

    A null url, or one without ://, has an empty host and path and no rule. All rows stay, repeated ones and those without
    page_id too, and weigh by their number; an empty table gives no rows; other columns are left out, so their names can't
    clash. A very long path is a row for each of its segments. Segments that are literally * or ~ count as such names.

    The tree is built on counts of (host, generalised path) that combine before their shuffle, so a host with a third of
    the pages is no hot spot. Its nodes are counted for all levels at once, so the number of shuffles doesn't grow with
    the paths' depth.
    """
    host, path = host_and_path(F.col("url"))
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    blocks = [r.pattern for r in rules if r.verdict == "block"]
    ruled = F.when(F.col("rule").isin(blocks), "block").when(F.col("rule").isNotNull(), "allow") if blocks else F.when(F.col("rule").isNotNull(), "allow")
    rows = rows.withColumn("ruled", ruled)
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))
    rows = rows.withColumn("key", F.array_join(segments, "/"))
    labelled = [F.sum(F.when(F.col("ruled") == x, 1).otherwise(0)).alias(c) for x, c in (("block", "bad"), ("allow", "good"))]
    ws = Workspace(df.sparkSession, "urls")
    tree = ws.keep(rows.groupBy("host", "key").agg(F.count("*").alias("n"), *labelled), "keys")
    wild = ws.keep(tree.join(_named(tree, "key", _wildcard, "wild"), ["host", "key"]), "wild")
    paths = wild.groupBy("host", "wild").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    paths = ws.keep(paths.join(_named(paths, "wild", _merged, "template"), ["host", "wild"]), "templates")
    total = paths.agg(F.sum("n").alias("gn"), F.sum("bad").alias("gb"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("bad").alias("hb"))
    templates = paths.groupBy("host", "template").agg(F.sum("bad").alias("tb"), (F.sum("bad") + F.sum("good")).alias("tl"))
    of_host = (F.col("hb") + PRIOR * (F.col("gb") / F.col("gn"))) / (F.col("hn") + PRIOR)
    purity = (F.col("tb") + PRIOR * of_host) / (F.col("tl") + PRIOR)
    judged = templates.join(hosts, "host").crossJoin(F.broadcast(total)).select("host", "template", purity.alias("purity"))  # total: one row
    found = wild.select("host", "key", "wild").join(paths.select("host", "wild", "template"), ["host", "wild"]).join(judged, ["host", "template"])
    return rows.join(found, ["host", "key"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )


def _named_sql(tree: str, key: str, name: str, alias: str) -> list[str]:
    return [
        f"""{alias}_nodes AS (SELECT host, {key}, n, bad, good, i AS level, parts[i] AS segment, md5(array_to_string(parts[1:i - 1], '/')) AS prefix
            FROM (SELECT *, string_split({key}, '/') AS parts, unnest(generate_series(1, len(string_split({key}, '/')))) AS i FROM {tree}))""",
        f"{alias}_child AS (SELECT host, prefix, segment, sum(n) AS c_n, sum(bad) AS c_bad, sum(good) AS c_good FROM {alias}_nodes GROUP BY ALL)",
        f"{alias}_parent AS (SELECT host, prefix, count(*) AS kids, sum(c_n) AS p_n, sum(c_bad) AS p_bad, sum(c_good) AS p_good FROM {alias}_child GROUP BY ALL)",
        f"{alias}_names AS (SELECT host, prefix, segment, {name} AS name FROM {alias}_child JOIN {alias}_parent USING (host, prefix))",
        f"{alias}_of AS (SELECT host, {key}, string_agg(name, '/' ORDER BY level) AS {alias} FROM {alias}_nodes JOIN {alias}_names USING (host, prefix, segment) GROUP BY host, {key})",
    ]


def url_filter_sql(rules: list[Rule]) -> str:
    """DuckDB SQL for url_filter() on the table pages, without template and purity."""
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.pattern}'"
        for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    )
    blocks = ", ".join(f"'{r.pattern}'" for r in rules if r.verdict == "block")

    def square(c: str, p: str) -> str:
        return f"CASE WHEN {p} > 0 THEN ({c} - c_n * ({p}::DOUBLE / p_n)) * ({c} - c_n * ({p}::DOUBLE / p_n)) / (c_n * ({p}::DOUBLE / p_n)) ELSE 0 END"

    chi = " + ".join(square(c, p) for c, p in (("c_bad", "p_bad"), ("c_good", "p_good"), ("(c_n - c_bad - c_good)", "(p_n - p_bad - p_good)")))
    out = [
        "cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)",
        f"""hosted AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
            coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM cut)""",
        f"fitted AS (SELECT *, CASE {fits} END AS rule FROM hosted)",
        f"""keyed AS (SELECT *, CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
            array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END), '/') AS key FROM fitted)""",
        "tree AS (SELECT host, key, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad, count(*) FILTER (ruled = 'allow') AS good FROM keyed GROUP BY host, key)",
        *_named_sql("tree", "key", f"CASE WHEN kids > {CHILDREN} AND c_n <= {RARE} * p_n THEN '*' ELSE segment END", "wild"),
        "paths AS (SELECT host, wild, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM tree JOIN wild_of USING (host, key) GROUP BY host, wild)",
        *_named_sql("paths", "wild", f"CASE WHEN kids > 1 AND segment <> '*' AND {chi} <= {SIMILAR} THEN '~' ELSE segment END", "template"),
        "total AS (SELECT sum(n)::DOUBLE AS gn, sum(bad)::DOUBLE AS gb FROM tree)",
        "hosts AS (SELECT host, sum(n)::DOUBLE AS hn, sum(bad)::DOUBLE AS hb FROM tree GROUP BY host)",
        "templates AS (SELECT host, template, sum(bad)::DOUBLE AS tb, (sum(bad) + sum(good))::DOUBLE AS tl FROM paths JOIN template_of USING (host, wild) GROUP BY host, template)",
        f"judged AS (SELECT host, template, (tb + {PRIOR} * ((hb + {PRIOR} * (gb / gn)) / (hn + {PRIOR}))) / (tl + {PRIOR}) AS purity FROM templates JOIN hosts USING (host), total)",
        "found AS (SELECT host, key, purity FROM wild_of JOIN template_of USING (host, wild) JOIN judged USING (host, template))",
    ]
    return "WITH " + ",\n".join(out) + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN found USING (host, key)"""
