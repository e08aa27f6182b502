"""Writers: CSV with a header, JSON lines, nested exports, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import latex


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> bool:
    """Write rows with a header; nothing, and False, without any. one_file is for reports, of which each is small."""
    if df.isEmpty():
        return False
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)
    return True


def append_records(df: DataFrame, path: str) -> None:
    """Append to a JSON-lines cache."""
    df.write.mode("append").json(path)


def bucket_mapping(buckets: DataFrame) -> DataFrame:
    """material, and its codes with their quality as a JSON text."""
    return buckets.groupBy("material").agg(F.to_json(F.sort_array(F.collect_list(F.struct("code", "quality")))).alias("hs_codes"))


def state_with_exports(materials: DataFrame, exports: DataFrame) -> DataFrame:
    """code, and a JSON text of its exports by year and their totals; exports: code, year, exports, total."""
    by = exports.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("year", "exports"))).alias("exports"), F.map_from_entries(F.collect_list(F.struct("year", "total"))).alias("total_exports"))
    return materials.join(by, "code", "left").select("code", F.to_json(F.struct("exports", "total_exports")).alias("doc"))


def write_edges(edges: DataFrame, path: str, kind: str = "edgelist") -> None:
    """An edge list, an adjacency list, node-link JSON lines, or gml or graphml, which are one document in one file."""
    if kind in ("gml", "graphml"):
        _write_document(edges, path, kind)
        return
    if kind == "edgelist":
        out = edges.select(F.concat_ws(" ", "src", "dst").alias("value"))
    elif kind == "adjlist":
        out = edges.groupBy("src").agg(F.concat_ws(" ", F.sort_array(F.collect_list("dst"))).alias("d")).select(F.concat_ws(" ", "src", "d").alias("value"))
    elif kind == "json":
        out = edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("value"))
    else:
        raise ValueError(f"no writer for {kind}")
    out.write.mode("overwrite").text(path)


def _write_document(edges: DataFrame, path: str, kind: str) -> None:
    """Nodes, then edges, between the document's first and last line, in order within one file."""
    node, ends = edges.select(F.col("src").cast("string").alias("v")).union(edges.select(F.col("dst").cast("string"))).distinct(), edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    if kind == "gml":
        numbered = node.withColumn("i", F.row_number().over(Window.orderBy("v")) - 1)
        number = lambda c: numbered.select(F.col("v").alias(c), F.col("i").alias(f"{c}_i"))
        ends = ends.join(number("a"), "a").join(number("b"), "b")
        nodes = numbered.select(F.lit(1).alias("k"), F.col("v").alias("x"), F.format_string('  node [ id %d label "%s" ]', "i", F.replace("v", F.lit('"'), F.lit("&quot;"))).alias("value"))
        links = ends.select(F.lit(2), F.concat_ws(" ", "a", "b"), F.format_string("  edge [ source %d target %d ]", "a_i", "b_i"))
        first, last = "graph [\n  directed 1", "]"
    else:
        quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
        nodes = node.select(F.lit(1).alias("k"), F.col("v").alias("x"), F.format_string('<node id="%s"/>', quoted(F.col("v"))).alias("value"))
        links = ends.select(F.lit(2), F.concat_ws(" ", "a", "b"), F.format_string('<edge source="%s" target="%s"/>', quoted(F.col("a")), quoted(F.col("b"))))
        first, last = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "</graph></graphml>"
    frame = edges.sparkSession.createDataFrame([(0, "", first), (3, "", last)], "k int, x string, value string")
    # coalesce(1) keeps the order of the sort: the format's document is one file
    nodes.union(links).union(frame).orderBy("k", "x").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON object."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def save_state(state: dict[str, DataFrame], path: str, backup: bool = True) -> str | None:
    """Each table of a state under path; what was there is kept beside it under the next free number, whose path is returned."""
    spark = next(iter(state.values())).sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = f"{path}.new"
    for name, table in state.items():
        table.write.mode("overwrite").parquet(f"{fresh}/{name}")
    old = None
    if store.exists(at):
        if backup:
            n = 1
            while store.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.{n}")):
                n += 1
            old = f"{path}.{n}"
            store.rename(at, jvm.org.apache.hadoop.fs.Path(old))
        else:
            store.delete(at, True)
    store.rename(jvm.org.apache.hadoop.fs.Path(fresh), at)
    return old


def cached_rows(df: DataFrame, path: str, key: str) -> None:
    """Rows of a cache by their key: those of the keys in df take the place of older ones, others stay."""
    spark = df.sparkSession
    jvm = spark._jvm
    store = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = df
    if store.exists(jvm.org.apache.hadoop.fs.Path(path)):
        old = spark.read.parquet(f"{path}/rows")
        whole = old.join(df.select(key), key, "left_anti").select(*df.columns).union(df)
    save_state({"rows": whole}, path, backup=False)


def saved_state(spark: SparkSession, path: str, names: tuple[str, ...] = ("materials", "processes", "entries", "refs")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def tree_document(tree: DataFrame) -> DataFrame:
    """One row, a JSON text of a component tree (parent, child, kind): its nodes once and its edges once for each parent."""
    nodes = tree.select(F.col("child").alias("id"), "kind").distinct()
    of = lambda df, *c: df.agg(F.sort_array(F.collect_list(F.struct(*c))).alias("x"))  # noqa: E731  a document of one product
    both = of(nodes, "id", "kind").withColumnRenamed("x", "nodes").crossJoin(F.broadcast(of(tree, "parent", "child")))
    return both.select(F.to_json(F.struct("nodes", F.col("x").alias("edges"))).alias("document"))


def markdown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pos, line: a report as a Markdown table, rows in the order of its first column."""
    columns = columns or df.columns
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))
    rows = df.select((F.row_number().over(Window.orderBy(*columns)) + 1).alias("pos"), cells.alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "pos int, line string")
    return head.union(rows)


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A report's rows as those of a LaTeX table, with what LaTeX reads as commands escaped."""
    cells = F.concat_ws(" & ", *[latex(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return df.select(*columns, F.concat(cells, F.lit(" \\\\")).alias("line"))


def macros(report: DataFrame, prefix: str) -> DataFrame:
    """name, value of a one-row report's columns, as the text of a document takes them."""
    pairs = F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in report.columns])
    return report.select(F.explode(pairs).alias("x")).select("x.name", "x.value")
