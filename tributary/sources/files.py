"""Files of the research folders: nomenclature, yearly trade, judge records, states, cached contents, routes, graphs."""

from __future__ import annotations

import json
import re
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import is_six_digits
from ..functions.text import url_key
from .arrow import read_arrow


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, value: a file's lines in their order. Files are read whole, so that the order is theirs; for files of a driver's size."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("l"))
    return whole.select("path", F.posexplode("l").alias("pos", "value"))


def nomenclature(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """pos, code, description of lines with a colon, split at the first; without repeats the last line of a code counts."""
    split = F.split("value", ":", 2)
    rows = lines(spark, path).filter(F.instr("value", ":") > 0).select("pos", F.trim(split[0]).alias("code"), F.trim(split[1]).alias("description"))
    if not unique:
        return rows
    return rows.groupBy("code").agg(F.max_by(F.struct("pos", "description"), "pos").alias("x")).select("x.pos", "code", "x.description")


def six_digit_codes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes at the start of lines; continuation lines have none."""
    code = F.regexp_extract("value", "^([0-9]{6}):", 1)
    return lines(spark, path).select(code.alias("code")).filter("code <> ''").distinct()


def yearly_trade(spark: SparkSession, folder: str, years: list[int], pattern: str = "{year}.parquet") -> tuple[DataFrame | None, list[int]]:
    """Flows of the years that have a file, with the file's place in the list (file_pos), and the years without one."""
    there = [(i, f"{folder}/{pattern.format(year=y)}") for i, y in enumerate(years)]
    found = [(i, p) for i, p in there if exists(spark, p)]
    missing = [y for (i, p), y in zip(there, years, strict=True) if (i, p) not in found]
    out = None
    for i, p in found:
        df = (read_arrow(spark, p) if p.endswith((".arrow", ".ipc")) else spark.read.parquet(p)).withColumn("file_pos", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, missing


def judge_records(spark: SparkSession, path: str, key: str | None = "key") -> DataFrame:
    """Records of a JSON-lines cache; the last line of each key counts (without a key all lines do). Blank lines go."""
    rows = lines(spark, path).filter(F.trim("value") != "")
    schema = "key string, process_id string, description string, process_plausible boolean, inputs_outputs_correct boolean, hs_codes_correct boolean, overall_correct boolean, error_mode string, rationale string, judged_at_utc string, judge_model string"
    parsed = rows.select("path", "pos", F.from_json("value", schema).alias("r")).select("path", "pos", "r.*")
    if key is None:
        return parsed.drop("path")
    rank = F.row_number().over(Window.partitionBy("path", key).orderBy(F.desc("pos")))
    return parsed.withColumn("_r", rank).filter("_r = 1").drop("_r", "path")


def _entries(doc: DataFrame, field: str, side: str) -> DataFrame:
    raw = doc.selectExpr("process", f"'{side}' AS side", f"posexplode(cast(variant_get(p, '$.{field}') AS array<variant>)) AS (pos, e)")
    text = F.expr("schema_of_variant(e) = 'STRING'")
    get = lambda f: F.expr(f"try_variant_get(e, '$.{f}', 'string')")
    return raw.select("process", "side", "pos", F.when(~text, get("hs_code")).alias("code"), F.when(text, F.expr("cast(e AS string)")).otherwise(get("name")).alias("name"), text.alias("bare"))


def state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """materials, processes, entries and refs of a state document; entries and references may be bare strings or objects."""
    doc = spark.read.text(path, wholetext=True).selectExpr("parse_json(value) AS d")
    of_field = lambda f: doc.selectExpr(f"posexplode(cast(variant_get(d, '$.{f}') AS map<string, variant>)) AS (pos, key, value)")
    p = of_field("processes").selectExpr("key AS process", "value AS p")
    m = of_field("materials").selectExpr("pos", "key AS code", "value AS m")
    of = lambda f, kind: f"try_variant_get(m, '$.{f}', '{kind}') AS {f}"
    materials = m.selectExpr("pos", "code", of("name", "string"), of("mined", "boolean"), of("aliases", "array<string>"), of("hs_description", "string"))
    processes = p.selectExpr("process", "try_variant_get(p, '$.description', 'string') AS description", "try_variant_get(p, '$.scale', 'double') AS scale", "try_variant_get(p, '$.process_score', 'double') AS score")
    entries = _entries(p, "precursors", "in").union(_entries(p, "products", "out"))
    r = p.selectExpr("process", "posexplode(cast(variant_get(p, '$.references') AS array<variant>)) AS (pos, e)")
    text = F.expr("schema_of_variant(e) = 'STRING'")
    get = lambda f, kind: F.when(~text, F.expr(f"try_variant_get(e, '$.{f}', '{kind}')"))
    refs = r.select("process", "pos", F.when(text, F.expr("cast(e AS string)")).otherwise(F.expr("try_variant_get(e, '$.url', 'string')")).alias("url"), get("source_quality_score", "double").alias("source_score"), get("content_quality_score", "double").alias("content_score"))
    return {"materials": materials, "processes": processes, "entries": entries, "refs": refs}


def process_records(state_: dict[str, DataFrame]) -> DataFrame:
    """A state's processes as records: process, description, scale, score, precursors and products (name, hs_code; a bare
    name without a code) and references (url, source_score, content_score), each in its order."""
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("x")))), lambda r: r["x"])  # noqa: E731  a process's own
    out = state_["processes"]
    for name, rows in (("precursors", state_["entries"].filter("side = 'in'")), ("products", state_["entries"].filter("side = 'out'"))):
        out = out.join(rows.groupBy("process").agg(ordered(F.struct("name", F.col("code").alias("hs_code"))).alias(name)), "process", "left")
    return out.join(state_["refs"].groupBy("process").agg(ordered(F.struct("url", "source_score", "content_score")).alias("references")), "process", "left")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """key, url, content of cached pages; those with an error, without content or malformed are left out. key is the file's stem."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*)\\.json$", 1).alias("key"), F.from_json("value", "url string, content string, error string").alias("r"))
    return raw.select("key", "r.url", "r.content", "r.error").filter("error IS NULL AND content IS NOT NULL AND content <> ''").drop("error")


def reference_texts(refs: DataFrame, cached: DataFrame) -> DataFrame:
    """References with the content cached under their URL's key, null without one."""
    return refs.withColumn("key", url_key(F.col("url"))).join(cached.select("key", "content"), "key", "left").drop("key")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header as text columns; a missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def data_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Arrow, JSON or Parquet by the file's extension; others raise ValueError."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind == ".json":
        # a document of an array, or a document a line
        first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
        return spark.read.option("multiLine", bool(first) and first[0]["value"].lstrip().startswith("[")).json(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".arrow", ".ipc"):
        return read_arrow(spark, path)
    raise ValueError(f"no reader for {kind or path}")


def listed_codes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "commodity string, hs_code string").filter(is_six_digits(F.col("hs_code"))).select("commodity", F.col("hs_code").alias("code")).distinct()


def graph_kind(path: str, head: str) -> str:
    """By content, else by extension, else edgelist."""
    start = head.lstrip().lower()
    if "<graphml" in start or "<gexf" in start:
        return "graphml" if "<graphml" in start else "gexf"
    if start.startswith("{"):
        return "json"
    if start.startswith("graph ["):
        return "gml"
    if start.startswith("*vertices"):
        return "pajek"
    return {".graphml": "graphml", ".gexf": "gexf", ".gml": "gml", ".net": "pajek", ".adjlist": "adjlist", ".json": "json"}.get(Path(path).suffix.lower(), "edgelist")


def read_graph(spark: SparkSession, path: str, kind: str | None = None, directed: bool | None = None) -> DataFrame:
    """Edges (src, dst) of a graph file. Edge and adjacency lists are read by Spark; the others, of a driver's size, by the driver.

    An undirected graph has each edge in both directions, once; unless it is said, only adjacency lists are undirected.
    """
    kind, edges = _edges(spark, path, kind)
    if kind == "adjlist" if directed is None else not directed:
        return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edges


def _edges(spark: SparkSession, path: str, kind: str | None) -> tuple[str, DataFrame]:
    if kind is None:
        head = "\n".join(r["value"] for r in spark.read.text(path).limit(40).collect())[:2048]
        kind = graph_kind(path, head)
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT trim(value) LIKE '#%'").select(F.split(F.trim("value"), "\\s+").alias("w"))
    if kind == "edgelist":
        return kind, rows.filter(F.size("w") >= 2).select(F.col("w")[0].alias("src"), F.col("w")[1].alias("dst"))
    if kind == "adjlist":
        return kind, rows.select(F.col("w")[0].alias("src"), F.explode(F.slice("w", 2, 1 << 30)).alias("dst"))
    text = spark.read.text(path, wholetext=True).first()[0]
    return kind, spark.createDataFrame(parse_graph(text, kind), "src string, dst string")


def parse_graph(text: str, kind: str) -> list[tuple[str, str]]:
    if kind == "json":
        try:
            d = json.loads(text)
            links = d.get("links", d.get("edges", [d] if "source" in d else []))
        except ValueError:  # a link a line
            links = [json.loads(row) for row in text.splitlines() if row.strip()]
        return [(str(x["source"]), str(x["target"])) for x in links]
    if kind in ("graphml", "gexf"):
        return [(e.get("source"), e.get("target")) for e in ElementTree.fromstring(text).iter() if e.tag.rpartition("}")[2] == "edge"]
    if kind == "gml":
        names = {i: x for i, x in re.findall(r'node\s*\[[^\]]*?id\s+(\S+)\s+label\s+"([^"]*)"', text)}
        ends = re.findall(r'edge\s*\[[^\]]*?source\s+"?([^\s"]+)"?\s+target\s+"?([^\s"]+)"?', text)
        return [(names.get(x, x), names.get(y, y)) for x, y in ends]
    if kind == "pajek":
        out, inside, label = [], False, {}
        for row in text.splitlines():
            parts = row.split()
            if row.startswith("*"):
                inside = row.lower().startswith(("*arcs", "*edges"))
            elif inside and len(parts) >= 2:
                out.append((label.get(parts[0], parts[0]), label.get(parts[1], parts[1])))
            elif parts:
                label[parts[0]] = parts[1].strip('"') if len(parts) > 1 else parts[0]
        return out
    raise ValueError(f"no reader for {kind}")


def parse_years(text: str) -> list[int]:
    """2017-2025 with both ends, or 2019,2021."""
    if "-" in text:
        a, b = text.split("-", 1)
        return list(range(int(a), int(b) + 1))
    return [int(x) for x in text.split(",") if x.strip()]


def parse_materials(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", ",").split(",") if x.strip()]


def html_text(html):
    """A page's text without markup, scripts and styles; null if it has 100 characters or fewer."""
    plain = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "(?s)<[^>]*>", " "), "\\s+", " "))
    return F.when(F.length(plain) > 100, plain)


#: Elements that aren't content, with all that is in them.
_OUTSIDE = ("head", "script", "style", "nav", "footer", "header", "form", "button")
#: A page's markup as Markdown, one replacement after the other (groups as \\1); patterns that Java and RE2 read alike.
MARKDOWN_RULES: list[tuple[str, str]] = [
    ("(?s)<!--.*?-->", ""),
    *[(f"(?is)<{x}\\b[^>]*>.*?</{x}>", "") for x in _OUTSIDE],
    ("(?i)<input\\b[^>]*>", ""),
    ("[ \\t\\r\\n]+", " "),
    *[(f"(?i)<h{n}\\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    ("(?i)</h[1-6]>", "\n\n"),
    ("(?i)<li\\b[^>]*>", "\n* "),
    ("(?i)<br\\b[^>]*>", "\n"),
    ("(?i)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|pre)\\b[^>]*>", "\n\n"),
    ('(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>(.*?)</a>', "[\\2](\\1)"),
    ("(?i)</?(?:b|strong)\\b[^>]*>", "**"),
    ("(?i)</?(?:i|em)\\b[^>]*>", "*"),
    ("<[^>]*>", ""),
    *[(f"&{name};", char) for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&"))],
    ("[ \\t]+", " "),
    (" ?\\n ?", "\n"),
    ("\\n{3,}", "\n\n"),
    ("^[ \\n]+", ""),
    ("[ \\n]+\\z", ""),
]


def html_markdown(html):
    """A page as Markdown: headings, lists, links and emphasis, without scripts, menus, forms and comments; null stays null."""
    for pattern, to in MARKDOWN_RULES:
        html = F.regexp_replace(html, pattern, re.sub(r"\\(\d)", r"$\1", to))
    return html


def markdown_sql(html: str) -> str:
    """html_markdown() in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for pattern, to in MARKDOWN_RULES:
        html = f"regexp_replace({html}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return html


def metric_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(path, key, value) of the numbers in a folder's JSON documents, booleans as 0 and 1, and the paths of those that can't be read."""
    docs = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.expr("try_parse_json(value)").alias("d"))
    good = docs.filter("d IS NOT NULL AND startswith(schema_of_variant(d), 'OBJECT')")
    rows = good.selectExpr("path", "explode(cast(d AS map<string, variant>)) AS (key, v)")
    number = F.expr("coalesce(try_cast(v AS double), cast(try_variant_get(v, '$', 'boolean') AS double))")
    plain = F.expr("schema_of_variant(v) IN ('BIGINT', 'DOUBLE', 'BOOLEAN') OR startswith(schema_of_variant(v), 'DECIMAL')")
    return rows.filter(plain).select("path", "key", number.alias("value")), docs.join(good.select("path"), "path", "left_anti").select("path")


def config(spark: SparkSession, path: str) -> dict:
    """A small JSON document of settings, by any store's path."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
