"""Queries that go through files in the shared folder, and queries of single functions and edits; each with its SQL.

A file query writes a table in the format that a source reads, reads it back through the source and returns its rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import codes, text
from ..operators import dists, graphs, hyper, judge, ranks, search, smallworld, state, trade
from ..sources import arrow, files, sinks
from ..sqltool import SqlTool
from .catalog import _CRIT, _REMOVED, _REPORT_MORE, _SCENARIOS, _SECTION, _base, _dominance, _fixpoint, _hyper, _knn_sql, query, t, v
from .lineage import cut, shared_dir, spread


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks


def _lines(spark: SparkSession, d: str) -> str:
    """Parts as lines code: name; a code repeats, and some lines have no colon or no code."""
    path = _folder(spark, "lines")
    rows = v(spark, d, "coded").select("p_partkey", F.concat("code", F.lit(": "), "p_name", F.lit(":x")).alias("value"))
    more = rows.filter("p_partkey % 50 = 0").select("p_partkey", F.lit("no colon here").alias("value"))
    rows.union(more).orderBy("p_partkey", "value").select("value").coalesce(1).write.text(path)
    return path


@query(fx.sql("SELECT code, arg_max(p_name, p_partkey) || ':x' AS description FROM coded GROUP BY code", "coded"))
def source_nomenclature(spark: SparkSession, d: str) -> DataFrame:
    return files.nomenclature(spark, _lines(spark, d)).select("code", "description")


@query(fx.sql("SELECT code, p_name || ':x' AS description FROM coded", "coded"))
def source_nomenclature_repeats(spark: SparkSession, d: str) -> DataFrame:
    return files.nomenclature(spark, _lines(spark, d), unique=False).select("code", "description")


@query(fx.sql("SELECT DISTINCT code FROM coded", "coded"))
def source_six_digit_codes(spark: SparkSession, d: str) -> DataFrame:
    return files.six_digit_codes(spark, _lines(spark, d))


@query(fx.sql("SELECT year, (year - 1990)::INT AS file_pos, count(*) AS n, sum(value)::DOUBLE AS value FROM trade WHERE year <> 1994 GROUP BY year", "trade"))
def source_yearly_trade(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "years")
    v(spark, d, "trade").filter("year <> 1994").withColumn("y", F.col("year")).write.partitionBy("y").parquet(path)
    found, missing = files.yearly_trade(spark, path, list(range(1990, 2003)), "y={year}")
    assert 1994 in missing
    return found.groupBy("year", "file_pos").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def source_arrow(spark: SparkSession, d: str) -> DataFrame:
    """The nations (a table of fixed size) as an Arrow file; the format's reader maps files, so the folder is a mounted one."""
    path = _folder(spark, "arrow").removeprefix("file://") + ".arrow"
    made = t(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")).toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, made.schema) as w:
        w.write_table(made, max_chunksize=7)
    return arrow.read_arrow(spark, path)


@query("SELECT kind, count(*) AS n, count(DISTINCT c_custkey) AS keys, max(c_name) AS last FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS kind) GROUP BY kind")
def source_tables(spark: SparkSession, d: str) -> DataFrame:
    rows, out = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), None
    for kind in ("csv", "json", "parquet"):
        path = f"{_folder(spark, 'table')}.{kind}"
        rows.write.format(kind).option("header", True).save(path)
        got = files.data_table(spark, path).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("keys"), F.max("c_name").alias("last")).select(F.lit(kind).alias("kind"), "*")
        out = got if out is None else out.union(got)
    return out


def _cache(spark: SparkSession, d: str) -> str:
    """Verdicts as a JSON-lines cache, appended to: each key's first line says the opposite of its last."""
    path = _folder(spark, "cache")
    rows = v(spark, d, "judged").filter("judge = 'a'").select(F.col("key").cast("string").alias("key"), F.concat(F.lit("p"), F.col("key") % 50).alias("process_id"), "overall_correct", "error_mode")
    sinks.append_records(rows.withColumn("overall_correct", ~F.col("overall_correct")).withColumn("turn", F.lit(0)).union(rows.withColumn("turn", F.lit(1))).orderBy("turn", "key").drop("turn").coalesce(1), path)
    return path


@query(fx.sql("SELECT key::VARCHAR AS key, overall_correct, error_mode FROM judged WHERE judge = 'a'", "judged"))
def source_judge_records(spark: SparkSession, d: str) -> DataFrame:
    return files.judge_records(spark, _cache(spark, d)).select("key", "overall_correct", "error_mode")


@query(fx.sql("SELECT 'p' || (key % 50) AS process_id, arg_max(overall_correct, key::VARCHAR) AS overall_correct FROM judged WHERE judge = 'a' GROUP BY key % 50", "judged"))
def source_judge_processes(spark: SparkSession, d: str) -> DataFrame:
    return files.judge_records(spark, _cache(spark, d), "process_id").select("process_id", "overall_correct")


@query(fx.sql("SELECT count(*) * 2 AS n, count(DISTINCT key) AS keys FROM judged WHERE judge = 'a'", "judged"))
def source_judge_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.judge_records(spark, _cache(spark, d), None).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def _document(spark: SparkSession, d: str) -> str:
    """A state document of the entries and the registry; entries without a code are bare names."""
    path = _folder(spark, "state")
    entry = F.when(F.col("code").isNull(), F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(F.to_json(F.struct(F.col("code").alias("hs_code"), "name")))
    side = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("pos", "e")))), lambda x: x["e"]), ",")
    own = v(spark, d, "entries").withColumn("e", entry).groupBy("process").agg(side("in").alias("i"), side("out").alias("o"))
    one = own.select(F.format_string('"%d":{"scale":0.5,"precursors":[%s],"products":[%s],"references":["u%d#x"]}', "process", "i", "o", "process").alias("p"))
    named = v(spark, d, "registry").select(F.concat(F.lit('"'), "code", F.lit('":'), F.to_json(F.struct("name"))).alias("m"))
    # one document of a driver's size, as the format is
    whole = one.agg(F.array_join(F.collect_list("p"), ",").alias("p")).crossJoin(F.broadcast(named.agg(F.array_join(F.collect_list("m"), ",").alias("m"))))
    whole.select(F.concat(F.lit('{"materials":{'), "m", F.lit('},"processes":{'), "p", F.lit("}}"))).coalesce(1).write.text(path)
    return path


@query(fx.sql("SELECT process::VARCHAR AS process, side, code, name, code IS NULL AS bare FROM entries", "entries"))
def source_state_entries(spark: SparkSession, d: str) -> DataFrame:
    return files.state(spark, _document(spark, d))["entries"].select("process", "side", "code", "name", "bare")


@query(fx.sql("SELECT code, name FROM registry", "registry"))
def source_state_materials(spark: SparkSession, d: str) -> DataFrame:
    return files.state(spark, _document(spark, d))["materials"].select("code", "name")


@query(fx.sql("SELECT DISTINCT process::VARCHAR AS process, 0.5::DOUBLE AS scale, 'u' || process || '#x' AS url FROM entries", "entries"))
def source_state_processes(spark: SparkSession, d: str) -> DataFrame:
    got = files.state(spark, _document(spark, d))
    return got["processes"].join(got["refs"], "process").select("process", "scale", "url")


_PIPES = """SELECT process, coalesce(string_agg(DISTINCT code, '|' ORDER BY code) FILTER (side = 'in'), '') AS input_hs, coalesce(string_agg(DISTINCT code, '|' ORDER BY code) FILTER (side = 'out'), '') AS output_hs FROM entries GROUP BY process"""


@query(fx.sql(f"SELECT process::VARCHAR AS route, len(string_split(input_hs, '|'))::INT AS n_in, len(string_split(output_hs, '|'))::INT AS n_out FROM ({_PIPES}) WHERE input_hs <> '' AND output_hs <> '' AND process % 7 <> 0", "entries"))
def source_routes(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "routes")
    side = lambda k: F.concat_ws("|", F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("code")))))
    rows = v(spark, d, "entries").groupBy("process").agg(side("in").alias("input_hs"), side("out").alias("output_hs"))
    rows = rows.select(F.col("process").cast("string").alias("route"), F.when(F.col("process") % 7 == 0, "12ab").otherwise(F.col("input_hs")).alias("input_hs"), "output_hs")
    sinks.write_csv(rows, path)
    good, _ = judge.valid_routes(files.read_csv(spark, path, "route string, input_hs string, output_hs string"))
    return good.select("route", F.size("ins").alias("n_in"), F.size("outs").alias("n_out"))


@query(fx.sql("SELECT DISTINCT 'c' || (brand_no % 3) AS commodity, code FROM coded WHERE p_partkey % 11 <> 0", "coded"))
def source_listed_codes(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "listed")
    rows = v(spark, d, "coded").select(F.concat(F.lit("c"), F.col("brand_no") % 3).alias("commodity"), F.when(F.col("p_partkey") % 11 == 0, "12").otherwise(F.col("code")).alias("hs_code"))
    sinks.write_csv(rows, path)
    return files.listed_codes(spark, path)


@query("SELECT count(*) * 0 AS n FROM region")
def source_missing_csv(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, _folder(spark, "none"), "a string").agg(F.count("*").alias("n"))


@query("SELECT kind, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation, (SELECT unnest(['edgelist', 'adjlist', 'json', 'gml', 'graphml']) AS kind)")
def source_graph_files(spark: SparkSession, d: str) -> DataFrame:
    edges, out = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")), None
    for kind in ("edgelist", "adjlist", "json", "gml", "graphml"):
        path = _folder(spark, "graph")
        sinks.write_edges(edges.coalesce(1), path, kind)
        got = files.read_graph(spark, path, kind, directed=True).select(F.lit(kind).alias("kind"), "src", "dst")
        out = got if out is None else out.union(got)
    return out


@query("SELECT page_id, url, length(html)::INT AS n FROM pages p JOIN (SELECT md5(split_part(url, '#', 1)) AS k, min(page_id) AS first FROM pages GROUP BY ALL) ON k = md5(split_part(url, '#', 1)) AND first = page_id WHERE html <> ''")
def source_contents(spark: SparkSession, d: str) -> DataFrame:
    """Pages as cached contents by their URL's key: of pages with one key the first is cached; then every page's content is looked up."""
    rows = t(spark, d, "pages").withColumn("key", text.url_key(F.col("url")))
    cached = trade.first_wins(rows, ["key"], "page_id").select("key", F.col("html").alias("content"), F.col("page_id").alias("first"))
    got = files.reference_texts(rows.drop("key"), cached).join(cached.select(F.col("first").alias("page_id")), "page_id", "left_semi")
    return got.filter("content <> ''").select("page_id", "url", F.length("content").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    sinks.write_csv(t(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_name"), path)
    kind = t(spark, d, "customer").schema["c_custkey"].dataType.simpleString()
    return files.read_csv(spark, path, f"c_custkey {kind}, c_name string")


@query(fx.sql("""SELECT material, '[' || string_agg('{"code":"' || code || '","quality":"' || quality || '"}', ',' ORDER BY code, quality) || ']' AS hs_codes FROM buckets GROUP BY material""", "buckets"))
def sink_bucket_mapping(spark: SparkSession, d: str) -> DataFrame:
    return sinks.bucket_mapping(v(spark, d, "buckets"))


@query(fx.sql("SELECT code, year, total FROM (SELECT code, year, sum(value)::DOUBLE AS total FROM trade GROUP BY code, year) WHERE code IN (SELECT code FROM registry)", "trade", "registry"))
def sink_state_exports(spark: SparkSession, d: str) -> DataFrame:
    made = sinks.state_with_exports(v(spark, d, "registry").select("code"), trade.exports_by_year(v(spark, d, "trade"), v(spark, d, "partners")))
    parsed = made.select("code", F.explode(F.from_json("doc", "total_exports map<string, double>")["total_exports"]).alias("year", "total"))
    return parsed.withColumn("year", F.col("year").cast("long"))


@query("SELECT region.r_regionkey::INT AS pos, '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def sink_markdown(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown(t(spark, d, "region").select("r_regionkey", "r_name")).filter("pos > 1").select((F.col("pos") - 2).cast("int").alias("pos"), "line")


@query("SELECT count(*) AS n, count(*) AS n_before FROM nation")
def sink_saved_state(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "saved")
    nations = {"nations": t(spark, d, "nation")}
    sinks.save_state(nations, path)
    old = sinks.save_state(nations, path)
    now, before = (sinks.saved_state(spark, p, ("nations",))["nations"].agg(F.count("*").alias("n")) for p in (path, old))
    return now.crossJoin(F.broadcast(before.withColumnRenamed("n", "n_before")))  # one row each


@query(fx.sql("SELECT process::VARCHAR AS process, count(*) FILTER (side = 'in')::INT AS n_in, count(*) FILTER (side = 'out')::INT AS n_out, arg_min(name, pos) FILTER (side = 'in') AS first_in, 'u' || process || '#x' AS url FROM entries GROUP BY process", "entries"))
def source_process_records(spark: SparkSession, d: str) -> DataFrame:
    got = files.process_records(files.state(spark, _document(spark, d)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(n(c))
    return got.select("process", size("precursors").alias("n_in"), size("products").alias("n_out"), F.get("precursors", F.lit(0))["name"].alias("first_in"), F.get("references", F.lit(0))["url"].alias("url"))


@query("SELECT src, dst FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)")
def source_undirected_graph(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "graph")
    sinks.write_edges(t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")), path, "adjlist")
    return files.read_graph(spark, path, "adjlist")


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 1 THEN 'newer' ELSE r_name END AS r_name FROM region")
def sink_cached_rows(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "cached")
    rows = t(spark, d, "region").select("r_regionkey", "r_name")
    sinks.cached_rows(rows, path, "r_regionkey")
    sinks.cached_rows(rows.filter("r_regionkey % 2 = 1").withColumn("r_name", F.lit("newer")), path, "r_regionkey")
    return sinks.saved_state(spark, path, ("rows",))["rows"]


@query(_knn_sql("cosine"))
def kept_index(spark: SparkSession, d: str) -> DataFrame:
    """An index of graphs built once for its source and kept under the hash of its path; its vectors, read again, searched exactly."""
    rows = spread(v(spark, d, "vectors").select("id", "vector"))
    folder, built = _folder(spark, "index"), []

    def build(path: str) -> DataFrame:
        built.append(path)
        return smallworld.graph_index(rows)

    kept = [search.kept_index(spark, folder, f"{d}/embeddings.parquet", build) for _ in range(2)][1]
    assert len(built) == 1
    return search.knn(spread(kept).select("id", "vector"), rows.filter("id % 20 = 0").select(F.col("id").alias("query"), "vector"), 5, "cosine").select("query", "rank", "id")


# ---------------------------------------------------------------- functions


@query(fx.sql("SELECT process, CASE WHEN score IS NULL THEN '#ccc' WHEN score <= 0.49 THEN 'rgb(255, ' || round(165 * (score / 0.49))::INT || ', 0)' ELSE 'rgb(' || round(144 - 144 * ((score - 0.5) / 0.5))::INT || ', ' || round(238 - 110 * ((score - 0.5) / 0.5))::INT || ', ' || round(144 - 144 * ((score - 0.5) / 0.5))::INT || ')' END AS colour FROM processes", "processes"))
def score_colours(spark: SparkSession, d: str) -> DataFrame:
    return v(spark, d, "processes").select("process", text.score_colour(F.col("score")).alias("colour"))


@query(fx.sql("SELECT DISTINCT " + _SECTION + " AS section, CASE " + " ".join(f"WHEN try_cast(substr(code, 1, 2) AS INTEGER) BETWEEN {a} AND {b} THEN '{a:02d}-{b:02d}'" for a, b, _ in codes.SECTIONS) + " END AS chapters FROM coded WHERE (" + _SECTION + ") IS NOT NULL", "coded"))
def section_legend(spark: SparkSession, d: str) -> DataFrame:
    return codes.legend(v(spark, d, "coded"))


@query("""WITH obs AS (SELECT 'value' AS key, event_type AS id, value::DOUBLE AS value FROM events UNION ALL SELECT 'user', event_type, user_id::DOUBLE FROM events UNION ALL SELECT 'month', event_type, month(ts)::DOUBLE FROM events),
ends AS (SELECT key, id, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM obs WHERE value IS NOT NULL GROUP BY key, id), tally AS (SELECT key, id, least(floor((value - lo) / ((hi - lo) / 15)), 14)::INT AS b, count(*) AS n FROM obs JOIN ends USING (key, id) GROUP BY ALL),
h AS (SELECT key, id, b, lo + b * ((hi - lo) / 15) AS l, lo + (b + 1) * ((hi - lo) / 15) AS r, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(0, 15))::INT AS b FROM ends) LEFT JOIN tally USING (key, id, b)),
p AS (SELECT key, id, (l + r) / 2 AS c, n::DOUBLE / sum(n) OVER (PARTITION BY key, id) AS y FROM h), span AS (SELECT key, min(l) AS lo, max(r) AS hi FROM h GROUP BY key),
x AS (SELECT key, id, bin, lo + bin * ((hi - lo) / 25) AS "left", lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 25) AS x FROM (SELECT key, id, unnest(range(0, 25)) AS bin FROM ends) JOIN span USING (key)),
near AS (SELECT x.key, x.id, bin, "left", x, max(c) FILTER (c <= x) AS c0, min(c) FILTER (c >= x) AS c1 FROM x JOIN p USING (key, id) GROUP BY ALL),
v AS (SELECT near.key, bin, "left", CASE WHEN c0 IS NULL OR c1 IS NULL THEN 0 WHEN c0 = c1 THEN a.y ELSE a.y + (b.y - a.y) * (x - c0) / (c1 - c0) END AS y FROM near LEFT JOIN p a ON a.key = near.key AND a.id = near.id AND a.c = c0 LEFT JOIN p b ON b.key = near.key AND b.id = near.id AND b.c = c1)
SELECT key, bin::INT AS bin, round(min("left"), 6) AS "left", round(avg(y), 9) AS mean, round(stddev_pop(y), 9) AS std FROM v GROUP BY key, bin""")
def average_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Several named distributions of each event type, averaged by name."""
    own = {"value": F.col("value"), "user": F.col("user_id"), "month": F.month("ts")}
    obs = t(spark, d, "events").select(F.col("event_type").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("value")) for k, c in own.items()])).alias("o")).select("id", "o.key", "o.value")
    got = dists.average(dists.histogram(obs, "value", 15, ["key", "id"]))
    return got.select("key", "bin", F.round("left", 6).alias("left"), F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name || ' (' || p_type || ')', '\\s*\\([^)]*\\)', '', 'g'))) AS plain, upper(substr(p_type, 1, 1)) || substr(p_type, 2) AS capital,
  CASE WHEN p_size = 1 THEN 'N/A' ELSE printf('%.1f%%', 100.0 * 7 / p_size) END AS share, substr(p_name, 1, 4) AS head FROM part""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    whole = F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size"))
    named = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return t(spark, d, "part").select("p_partkey", text.plain_name(named).alias("plain"), text.capitalised(F.col("p_type")).alias("capital"), text.percent(F.lit(7), whole).alias("share"), F.substring("p_name", 1, 4).alias("head"))


@query(fx.sql("""SELECT process, trim(regexp_replace(lower(substr(max(name), 1, 120)), '\\s+', ' ', 'g')) || '|||' || coalesce(string_agg(code, ',' ORDER BY code) FILTER (side = 'in'), '') || '|||' || coalesce(string_agg(code, ',' ORDER BY code) FILTER (side = 'out'), '') AS key FROM entries GROUP BY process""", "entries"))
def judge_keys(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("code")))  # noqa: E731  a process's entries
    rows = v(spark, d, "entries").groupBy("process").agg(F.max("name").alias("name"), of("in").alias("ins"), of("out").alias("outs"))
    return rows.select("process", text.judge_key(F.col("name"), F.col("ins"), F.col("outs")).alias("key"))


@query("""SELECT d::INT AS depth, round(1 - pow(0.98, d - 1) + 0.02 / 0.98 * d * (ln(1 / 0.02) - coalesce((SELECT sum(pow(0.98, i) / i) FROM range(1, d) x(i)), 0)), 9) AS weight FROM (SELECT unnest(range(1, 61)) AS d)""")
def rbo_weights(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, round(text.rbo_weight(i, 0.98), 9)) for i in range(1, 61)], "depth int, weight double")


@query(fx.sql("SELECT process, pos, content_score * least(source_score * 2, 1) AS combined FROM refs", "refs"))
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    return v(spark, d, "refs").select("process", "pos", text.combined_score(F.col("content_score"), F.col("source_score")).alias("combined"))


def _score_sql(value: str, order: str) -> str:
    return f"(SELECT a.id AS query, b.id, {value} AS value, row_number() OVER (PARTITION BY a.id ORDER BY {order}, b.id) AS r FROM vectors a, vectors b WHERE a.id % 20 = 0)"


_L2, _COS = "(list_distance(a.vector::DOUBLE[], b.vector::DOUBLE[]) ** 2)", "list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])"


@query(fx.sql(f"""SELECT 'raw' AS measure, query, r::INT AS rank, id, round(value, 5) AS score FROM {_score_sql(_L2, _L2)} WHERE r <= 6
UNION ALL SELECT 'l2', query, r::INT, id, round(1 / (1 + value), 5) FROM {_score_sql(_L2, _L2)} WHERE r <= 5 UNION ALL SELECT 'cosine', query, r::INT, id, round(value, 5) FROM {_score_sql(_COS, _COS + ' DESC')} WHERE r <= 5""", "vectors"))
def knn_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(v(spark, d, "vectors").select("id", "vector"))
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    parts = [search.knn(rows, asked, k, m).select(F.lit(m).alias("measure"), "query", "rank", "id", F.round("score", 5).alias("score")) for m, k in (("raw", 6), ("l2", 5), ("cosine", 5))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT c_nationkey, round(avg(c_acctbal::DOUBLE), 6) AS mean, round(coalesce(stddev_samp(c_acctbal::DOUBLE), 0), 6) AS sd, round(stddev_pop(c_acctbal::DOUBLE), 6) AS sd_pop, min(c_acctbal)::DOUBLE AS min, max(c_acctbal)::DOUBLE AS max FROM customer GROUP BY c_nationkey")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    got = ranks.stats(t(spark, d, "customer"), "c_acctbal", ["c_nationkey"])
    return got.select("c_nationkey", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sd_pop")], "min", "max")


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def first_and_last(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    one = lambda f, name: f(rows, ["o_custkey"], "o_orderkey").select("o_custkey", F.col("o_totalprice").alias(name))
    return one(trade.first_wins, "first").join(one(trade.last_wins, "last"), "o_custkey")


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")
def sql_tool(spark: SparkSession, d: str) -> DataFrame:
    return SqlTool(spark, t(spark, d, "orders"), "orders_of_tool").frame_of("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders_of_tool GROUP BY o_orderstatus")


# ---------------------------------------------------------------- edits


@query("SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'new' ELSE r_name END AS name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 100 + r_regionkey, 'added' FROM region")
def state_insert_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))
    more = state.insert(rows, rows.select((F.col("k") + 100).alias("k"), F.lit("added").alias("name")), "k")
    some = state.replace(more, rows.filter("k % 2 = 0").select("k", F.lit("new").alias("name")), "k")
    return state.remove(some, rows.filter("k = 3").select("k"), "k")


_IDENT = "coalesce(code, lower(name))"


@query(fx.sql(f"""WITH_NEW SELECT process, side, {_IDENT} AS e, count(*) AS n FROM (SELECT process, side, code, name FROM entries UNION ALL SELECT process, side, code, name FROM (
  SELECT process, side, code, name, row_number() OVER (PARTITION BY process, side, {_IDENT} ORDER BY name) AS r FROM (SELECT process + 1 AS process, side, code, name FROM entries) x
  WHERE NOT EXISTS (SELECT 1 FROM entries o WHERE o.process = x.process AND coalesce(o.code, lower(o.name)) = coalesce(x.code, lower(x.name)))) WHERE r = 1) GROUP BY ALL""".replace("WITH_NEW ", ""), "entries"))
def state_add_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = v(spark, d, "entries").select("process", "side", "code", "name")
    both, _ = state.add_entries(rows, rows.withColumn("process", F.col("process") + 1))
    return both.groupBy("process", "side", F.coalesce("code", F.lower("name")).alias("e")).agg(F.count("*").alias("n"))


@query(fx.sql("SELECT process, side, code, name FROM entries WHERE code IS NULL OR NOT (side = 'out' AND code LIKE '%1')", "entries"))
def state_remove_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = v(spark, d, "entries").select("process", "side", "code", "name")
    return state.remove_entries(rows, rows.filter("side = 'out' AND code LIKE '%1'"))


@query(fx.sql("SELECT process, split_part(url, '#', 1) AS url FROM refs r WHERE NOT EXISTS (SELECT 1 FROM refs g WHERE g.pos % 3 = 0 AND g.process = r.process AND split_part(g.url, '#', 1) = split_part(r.url, '#', 1))", "refs"))
def state_remove_references(spark: SparkSession, d: str) -> DataFrame:
    refs = v(spark, d, "refs")
    return state.remove_references(refs, refs.filter("pos % 3 = 0")).select("process", text.without_fragment(F.col("url")).alias("url"))


@query(fx.sql("""WITH_G SELECT process FROM (SELECT DISTINCT process FROM entries) WHERE process NOT IN (SELECT process FROM sig JOIN (SELECT ins, outs, min(process) AS first FROM sig GROUP BY ins, outs HAVING count(*) > 1) USING (ins, outs) WHERE process <> first)""".replace("WITH_G ", ""), "entries",
    more=""", sig AS (SELECT process, coalesce(string_agg(code, ',' ORDER BY code) FILTER (side = 'in'), '') AS ins, coalesce(string_agg(code, ',' ORDER BY code) FILTER (side = 'out'), '') AS outs FROM entries GROUP BY process)"""))
def state_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = v(spark, d, "entries")
    return state.merge_duplicates(rows, rows.select("process").distinct(), state.duplicate_processes(rows))[1]


@query("""SELECT p_partkey, array_to_string(CASE WHEN list_contains(l, p_brand) THEN l ELSE list_append(l, p_brand) END, '|') AS added, array_to_string([l[1], p_brand, l[3]], '|') AS replaced,
  array_to_string([l[2], l[3]], '|') AS removed, array_to_string(list_filter(l, lambda x: x <> p_type), '|') AS without FROM (SELECT *, [p_name, p_type, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END] AS l FROM part)""")
def list_edits(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").withColumn("l", F.array("p_name", "p_type", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name"))))
    made = {"added": state.append_absent(F.col("l"), F.col("p_brand")), "replaced": state.replaced_at(F.col("l"), 1, F.col("p_brand")), "removed": state.removed_at(F.col("l"), 0), "without": state.without(F.col("l"), F.col("p_type"))}
    return rows.select("p_partkey", *[F.array_join(c, "|").alias(n) for n, c in made.items()])


# ---------------------------------------------------------------- bundles


@query(fx.sql(f"SELECT r.code, c.criticality AS reach_loss FROM report r LEFT JOIN ({_CRIT}) c ON c.code = r.code WHERE r.dominated", "trade", "entries", "registry", more=_REPORT_MORE + _fixpoint(_SCENARIOS, _REMOVED)))
def disruption_reach_loss(spark: SparkSession, d: str) -> DataFrame:
    g = _hyper(spark, d)
    rows = hyper.disruption(g, v(spark, d, "registry"), _dominance(spark, d), hyper.criticality(g, _base(g)))
    return rows.filter("dominated").select("code", "reach_loss")


_LINKS = ", e AS (SELECT src, dst FROM net WHERE src <> dst UNION SELECT dst, src FROM net WHERE src <> dst), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src), weak AS (SELECT src AS v, min(dst) AS k FROM c GROUP BY src), big AS (SELECT k FROM weak GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)"


@query(fx.sql("""SELECT avg(CASE WHEN n > 1 THEN 2.0 * tri / (n * (n - 1)) ELSE 0 END)::DOUBLE AS average FROM (SELECT v, (SELECT count(*) FROM e WHERE src = v) AS n,
  (SELECT count(*) FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst JOIN e x ON x.src = a.dst AND x.dst = b.dst WHERE a.src = v) AS tri FROM weak WHERE k IN (SELECT k FROM big))""", "net", more=_LINKS, recursive=True))
def average_clustering(spark: SparkSession, d: str) -> DataFrame:
    return graphs.average_clustering(v(spark, d, "net"))


@query(fx.sql("""SELECT 'weak' AS kind, count(DISTINCT k) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM weak GROUP BY k)) AS largest FROM weak
UNION ALL SELECT 'strong', count(DISTINCT k), (SELECT max(n) FROM (SELECT count(*) AS n FROM strong GROUP BY k)) FROM strong""", "net",
    more=_LINKS + ", closure(src, dst) AS (SELECT src, dst FROM net UNION SELECT c.src, n.dst FROM closure c JOIN net n ON c.dst = n.src), strong AS (SELECT v, least(v, (SELECT min(a.dst) FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src WHERE a.src = v)) AS k FROM weak)", recursive=True))
def connectivity(spark: SparkSession, d: str) -> DataFrame:
    weak, strong = graphs.both_components(cut(v(spark, d, "net")))
    one = lambda kind, rows: graphs.component_stats(rows).select(F.lit(kind).alias("kind"), "components", "largest")
    return one("weak", weak).union(one("strong", strong))


@query("""SELECT year(ts) AS y, month(ts) AS m, count(*) AS n, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) + 2 AS near,
  max(len(list_distinct([event_type, 'x', 'x']))) AS kinds, max(CAST(json_extract('{"a": [1, ' || user_id || ']}', '$.a[1]') AS BIGINT)) AS top, min(date_diff('day', DATE '1990-01-01', CAST(ts AS DATE))) AS days FROM events GROUP BY ALL""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Dates, quantiles, approximate counts, lists and JSON in one SQL text."""
    return spark.sql(
        """SELECT cast(year(ts) AS bigint) AS y, cast(month(ts) AS bigint) AS m, count(*) AS n, count(DISTINCT user_id) AS users, round(percentile(value, 0.5), 6) AS median, round(percentile(value, 0.9), 6) AS p90,
  abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) + 2 AS near, cast(max(size(array_distinct(array(event_type, 'x', 'x')))) AS bigint) AS kinds,
  max(cast(get_json_object(to_json(named_struct('a', array(1, user_id))), '$.a[1]') AS bigint)) AS top, cast(min(datediff(cast(ts AS date), DATE '1990-01-01')) AS bigint) AS days FROM {events} GROUP BY 1, 2""",
        events=t(spark, d, "events"),
    )


@query("SELECT y::INT AS y FROM (SELECT unnest(range(2017, 2026)) AS y)")
def parsed_years(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(y,) for y in files.parse_years("2017-2025")], "y int")
