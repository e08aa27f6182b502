"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

Nodes of the tree are the values of the level columns (say domain, language, source). The budget of tokens flows from
the root: siblings share their parent's in proportion to their weights, none takes more than its documents hold in
max_epochs; what one can't take goes to its siblings, and only what all of them can't take was withheld from their
parent before, so that it went to the parent's siblings. A leaf takes whole epochs, and of one more epoch, whose order is
seeded by its number, the documents at the head until its tokens are spent.

Budgets are whole numbers and weights are whole, so the shares don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace

SEED, MAX_EPOCHS = 3, 2
#: Hexadecimal digits of the order that make the buckets in which a leaf's tokens are summed: 4096 of them.
DIGITS = 3


def byte_tokens(text: Column) -> Column:
    """Tokens as a quarter of the UTF-8 bytes, rounded up, 1 at least; a null text has 1."""
    return F.greatest(F.lit(1), F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4)).cast("long")


def weight(level: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(level == name, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], total: Column, max_epochs: int, default: int = 1) -> DataFrame:
    """Per leaf of leaves (level columns, tokens): its budget. total: of the root, in terms of tokens of all leaves (column all)."""
    able = F.col("tokens") * max_epochs
    for level, w in zip(levels, weights, strict=True):
        able = F.when(weight(F.col(level), w, default) > 0, able).otherwise(0)
    leaves = leaves.withColumn("room", able)
    up = leaves.agg(F.sum("tokens").alias("all"), F.sum("room").alias("room")).select(F.least(total.cast("long"), F.col("room")).alias("budget"))
    for i, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("room").alias("room")).withColumn("w", weight(F.col(level), weights[i], default))
        nodes = nodes.crossJoin(up) if i == 0 else nodes.join(up, levels[:i])
        group = Window.partitionBy(*levels[:i]) if i else Window.partitionBy(F.lit(0))
        # in ascending order of room / weight a sibling is full if its room is at most its share of what is left
        ordered = group.orderBy(F.when(F.col("w") > 0, F.col("room") / F.col("w")).asc_nulls_last(), F.col(level))
        before = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest_w = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("before", before).withColumn("rest_w", rest_w)
        wide = "decimal(38,0)"
        full = (F.col("w") == 0) | (F.col("room").cast(wide) * F.col("rest_w") <= F.col("w").cast(wide) * (F.col("budget") - F.col("before")))
        nodes = nodes.withColumn("full", full)
        taken = F.sum(F.when(F.col("full") & (F.col("w") > 0), F.col("room")).otherwise(0)).over(group)
        open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(group)
        nodes = nodes.withColumn("left", F.col("budget") - taken).withColumn("open_w", open_w)
        share = F.expr("CASE WHEN w = 0 THEN 0 WHEN full THEN room ELSE cast(floor(cast(cast(w AS decimal(19,0)) * cast(left AS decimal(19,0)) AS decimal(38,0)) div open_w) AS bigint) END")
        up = nodes.select(*levels[: i + 1], share.alias("budget"))
    return leaves.join(up, levels)


def mix(df: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], share: tuple[int, int], doc_id: str = "doc_id", tokens: Column | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """df with its columns as they are and _n_tokens, _copies (epochs that take the document) and _take (tokens taken).

    levels: names and columns of the tree from the top (null counts as ''); weights: for each level the weights of names,
    whole numbers, 1 for a name that isn't there; share: the budget as a fraction (numerator, denominator) of all tokens.
    The last document taken may have a part of its tokens taken. Rows of one doc_id stand in one place of the order and
    are taken together, as are rows without one; null and empty texts have no tokens and are taken by their place. A very
    long text counts by its bytes like any other; an empty table gives no rows. Columns of df that start with _ are left out:
    these names are the operator's.

    Leaves may be of any size: what decides on a leaf's documents is one row (its epochs, the last place of the order
    that is taken), found from sums over 4096 buckets of the order and the rows of one bucket. Those rows join documents
    on the leaf, of which there are as many as the tree has, whatever the data's size.
    """
    names = [f"_{n}" for n in levels]
    own = [c for c in df.columns if not c.startswith("_")]
    size = byte_tokens(F.col("text")) if tokens is None else tokens
    rows = df.select(*own).withColumn("_n_tokens", size).withColumns({n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values(), strict=True)})
    narrow = rows.select(F.col(doc_id).alias("_id"), "_n_tokens", *names)
    ws = Workspace(df.sparkSession, "mix")
    narrow = ws.keep(narrow, "documents")
    leaves = narrow.groupBy(*names).agg(F.sum("_n_tokens").alias("tokens"))
    total = F.floor(F.col("all").cast("decimal(38,0)") * share[0] / share[1])
    plan = budgets(leaves, names, weights, total, max_epochs)
    plan = plan.withColumn("_full", F.expr("budget div tokens")).withColumn("_rest", F.expr("budget - (budget div tokens) * tokens"))
    plan = ws.keep(plan.select(*names, "_full", "_rest"), "leaves")

    place = order(F.col("_full") + 1, F.col("_id"), seed)
    placed = narrow.join(plan, names).filter("_rest > 0").select(*names, "_n_tokens", "_rest", place.alias("_place"))
    bucket = F.substring("_place", 1, DIGITS)
    sums = placed.groupBy(*names, "_rest", bucket.alias("_bucket")).agg(F.sum("_n_tokens").alias("n"))
    in_order = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    edge = sums.filter("_before < _rest AND _before + n >= _rest").select(*names, "_bucket", "_before")
    last = placed.withColumn("_bucket", bucket).join(edge, [*names, "_bucket"])
    by_place = last.groupBy(*names, "_place", "_before", "_rest").agg(F.sum("_n_tokens").alias("n"))
    running = Window.partitionBy(*names).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    by_place = by_place.withColumn("_start", F.col("_before") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    cut = by_place.filter("_start < _rest AND _start + n >= _rest").select(*names, F.col("_place").alias("_cut"), (F.col("_rest") - F.col("_start")).alias("_part"))
    plan = ws.keep(plan.join(cut, names, "left"), "cuts")

    out = rows.join(plan, names)
    place = order(F.col("_full") + 1, F.col(doc_id), seed)
    out = out.withColumn("_place", F.when(F.col("_cut").isNotNull(), place))
    extra = F.when(F.col("_place") < F.col("_cut"), F.col("_n_tokens")).when(F.col("_place") == F.col("_cut"), F.least("_n_tokens", "_part")).otherwise(0)
    out = out.withColumn("_copies", (F.col("_full") + F.when(F.col("_place") <= F.col("_cut"), 1).otherwise(0)).cast("int"))
    return out.withColumn("_take", F.col("_full") * F.col("_n_tokens") + extra).select(*own, *names, "_n_tokens", "_copies", "_take")


def order(epoch: Column, doc_id: Column, seed: int) -> Column:
    """A document's place in the order of an epoch, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix_sql(levels: dict[str, str], weights: list[dict[str, int]], share: tuple[int, int], seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> str:
    """DuckDB SQL for mix() on the table documents: doc_id, the levels, n_tokens, copies and take."""
    names = list(levels)

    def w(name: str, of: dict[str, int]) -> str:
        return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in of.items()) + " ELSE 1 END" if of else "1"

    all_names = ", ".join(names)
    zero = " OR ".join(f"({w(n, x)}) = 0" for n, x in zip(names, weights, strict=True))
    out = [
        "rows AS (SELECT doc_id, greatest(1, (coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS n_tokens, " + ", ".join(f"coalesce({e}, '') AS {n}" for n, e in levels.items()) + " FROM documents)",
        f"leaves AS (SELECT {all_names}, sum(n_tokens)::BIGINT AS tokens, CASE WHEN {zero} THEN 0 ELSE sum(n_tokens)::BIGINT * {max_epochs} END AS room FROM rows GROUP BY {all_names})",
        f"up0 AS (SELECT least((sum(tokens)::HUGEINT * {share[0]}) // {share[1]}, sum(room))::BIGINT AS budget FROM leaves)",
    ]
    for i, n in enumerate(names, 1):
        cols, above = ", ".join(names[:i]), ", ".join(names[: i - 1])
        part = f"PARTITION BY {above}" if above else ""
        rank = f"{part} ORDER BY CASE WHEN w > 0 THEN room::DOUBLE / w END ASC NULLS LAST, {n}"
        out += [
            f"node{i} AS (SELECT {cols}, sum(room)::BIGINT AS room, {w(n, weights[i - 1])} AS w FROM leaves GROUP BY {cols})",
            f"with{i} AS (SELECT * FROM node{i} JOIN up{i - 1} USING ({above}))" if above else f"with{i} AS (SELECT * FROM node{i}, up0)",
            f"""line{i} AS (SELECT *, coalesce(sum(room) OVER ({rank} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(w) OVER ({rank} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM with{i})""",
            f"flag{i} AS (SELECT *, w = 0 OR room::HUGEINT * rest_w <= w::HUGEINT * (budget - before) AS is_full FROM line{i})",
            f"""share{i} AS (SELECT *, budget - sum(CASE WHEN is_full AND w > 0 THEN room ELSE 0 END) OVER ({part}) AS rest,
                sum(CASE WHEN NOT is_full THEN w ELSE 0 END) OVER ({part}) AS open_w FROM flag{i})""",
            f"up{i} AS (SELECT {cols}, CASE WHEN w = 0 THEN 0 WHEN is_full THEN room ELSE (w::HUGEINT * rest) // open_w END::BIGINT AS budget FROM share{i})",
        ]
    out += [
        f"plan AS (SELECT {all_names}, budget // tokens AS full_epochs, budget % tokens AS rest FROM leaves JOIN up{len(names)} USING ({all_names}))",
        f"placed AS (SELECT *, md5('{seed}:' || (full_epochs + 1) || ':' || doc_id) AS place FROM rows JOIN plan USING ({all_names}))",
        f"started AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {all_names} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)",
    ]
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, {all_names}, n_tokens, (full_epochs + CASE WHEN start < rest THEN 1 ELSE 0 END)::INTEGER AS copies,
  (full_epochs * n_tokens + greatest(0, least(n_tokens, rest - start)))::BIGINT AS take FROM started"""
