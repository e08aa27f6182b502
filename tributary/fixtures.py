"""Stand-in views: the data model's tables, derived from whole tables of the test data.

Each is one SQL text that Spark and DuckDB both run, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Reporters and partners that stand for aggregates.
AGG_REPORTERS, AGG_PARTNERS = (0,), (0, 7, 13)
REPORTER, DOMINANCE = 3, 0.10

VIEWS: dict[str, str] = {
    # a part's six-digit code: chapter from its brand, heading from its type
    "coded": """SELECT p_partkey, p_name, p_size, cast(substr(p_brand, 7) AS int) AS brand_no,
        concat(lpad(cast(cast(substr(p_brand, 7) AS int) * 4 - 3 AS string), 2, '0'),
          lpad(cast(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS string), 4, '0')) AS code
        FROM part""",
    "registry": "SELECT code, min(p_name) AS name FROM coded WHERE brand_no NOT IN (3, 13) GROUP BY code",
    # five parts on end are a process; bare strings have no code
    "entries": """SELECT cast(floor(p_partkey / 5) AS bigint) AS process, CASE WHEN p_size % 2 = 0 THEN 'in' ELSE 'out' END AS side,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE code END AS code, p_name AS name, p_partkey AS pos FROM coded""",
    # the same with a code for each part, so that codes grow with the table: inputs are the parts two thirds down the list
    "wide": """SELECT cast(floor(p_partkey / 5) AS bigint) AS process, CASE WHEN p_size % 2 = 0 THEN 'in' ELSE 'out' END AS side,
        lpad(cast(CASE WHEN p_size % 2 = 0 THEN cast(floor(p_partkey * 2 / 3) AS bigint) ELSE p_partkey END % 1000000 AS string), 6, '0') AS code, p_name AS name FROM part""",
    "processes": """SELECT process, cast(process % 11 AS double) / 10 AS scale, CASE WHEN process % 5 = 0 THEN NULL ELSE cast(process % 13 AS double) / 12 END AS score
        FROM entries GROUP BY process""",
    "trade": """SELECT cast(s_nationkey AS bigint) AS partner, cast(c_nationkey AS bigint) AS reporter, code, cast(year(l_shipdate) AS bigint) AS year,
        cast(l_extendedprice AS decimal(18,2)) * (1 - cast(l_discount AS decimal(4,2))) AS value, l_orderkey * 10 + l_linenumber AS pos
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN coded ON l_partkey = p_partkey""",
    "partners": "SELECT cast(n_nationkey AS bigint) AS code, n_name AS name, concat('N', lpad(cast(n_nationkey AS string), 2, '0')) AS iso3, n_nationkey % 12 = 5 AS is_group FROM nation",
    # materials claim the codes of their brands; brand 4 belongs to two of them
    "buckets": """SELECT DISTINCT concat('material ', cast(brand_no % 4 AS string)) AS material, code, CASE WHEN brand_no % 2 = 0 THEN 'clean' ELSE 'shared' END AS quality FROM coded
        UNION SELECT 'material 9', code, 'shared' FROM coded WHERE brand_no = 4""",
    "judged": """SELECT d.lang AS label, j.judge, d.doc_id AS key, CASE WHEN j.judge = 'a' THEN l.quality = 1 ELSE l.toxic = 0 END AS overall_correct,
        CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.doc_id % 4 <> 0 END AS process_plausible, d.doc_id % 5 <> 0 AS inputs_outputs_correct, d.doc_id % 3 <> 0 AS hs_codes_correct,
        CASE d.doc_id % 4 WHEN 0 THEN 'wrong inputs' WHEN 1 THEN 'wrong codes' WHEN 2 THEN '' ELSE NULL END AS error_mode,
        CASE WHEN d.doc_id % 6 = 0 THEN 'The verdict should be TRUE.' ELSE 'fine' END AS rationale
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (SELECT 'a' AS judge UNION ALL SELECT 'b' AS judge) j""",
    # ten pages are the references of a process
    "refs": """SELECT cast(floor(page_id / 10) AS bigint) AS process, page_id AS pos, url, CASE WHEN page_id % 13 = 0 THEN NULL ELSE cast(page_id % 11 AS double) / 10 END AS source_score,
        CASE WHEN page_id % 17 = 0 THEN NULL ELSE cast(length(html) % 11 AS double) / 10 END AS content_score FROM pages""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label FROM embeddings",
    "runs": "SELECT year AS run, code AS item, cast(sum(value) AS decimal(38,4)) AS score FROM trade GROUP BY year, code",
    # the component tree: every code's parts, by halving
    "tree": "SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE cast(floor((p_partkey - 1) / 4) AS bigint) END AS parent, p_name AS name FROM part",
    # the projection of the hypergraph: inputs to their process, the process to its outputs; and inputs to outputs
    "net": """SELECT DISTINCT src, dst FROM (SELECT CASE WHEN side = 'in' THEN coalesce(code, name) ELSE concat('process ', cast(process AS string)) END AS src,
          CASE WHEN side = 'in' THEN concat('process ', cast(process AS string)) ELSE coalesce(code, name) END AS dst FROM entries
        UNION ALL SELECT a.code, b.code FROM entries a JOIN entries b ON a.process = b.process WHERE a.side = 'in' AND b.side = 'out' AND a.code <> b.code) links""",
}

#: Views that a view reads.
NEEDS = {
    "registry": ["coded"], "entries": ["coded"], "processes": ["entries"], "trade": ["coded"], "buckets": ["coded"], "runs": ["trade"], "net": ["entries"],
}


def needed(name: str) -> list[str]:
    """The views under name and itself, in order."""
    out: list[str] = []
    for x in NEEDS.get(name, []):
        out += [y for y in needed(x) if y not in out]
    return [*out, name]


def with_views(*names: str) -> str:
    """A WITH clause (without the word) of these views for an SQL text."""
    order: list[str] = []
    for name in names:
        order += [x for x in needed(name) if x not in order]
    return ",\n".join(f"{x} AS ({VIEWS[x]})" for x in order)


def sql(body: str, *names: str, more: str = "", recursive: bool = False) -> str:
    """body over these views, as one text; more: further clauses that start with a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_views(*names)}{more}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables of sf_dir; tables are bound by path, not by registered names."""
    text = f"WITH {with_views(name)} SELECT * FROM {name}"
    for t in TABLES:
        # names of tables stand alone in the texts; each becomes a named parameter's place
        text = _bound(text, t)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **frames)


def _bound(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", text)
