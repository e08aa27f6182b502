"""The pipeline on the smallest tables, against its stages by hand."""

import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tributary.llm import decontamination, quality
from tributary.llm.catalog import ORACLE_SQL, QUERIES
from tributary.llm.mixing import mix_sql
from tributary.llm.ragged import chunks

sys.path.insert(0, str(Path(__file__).parent))
from test_duplicates import brute, brute_leaks  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")] == sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) and len(QUERIES) == 13


def test_stages(spark):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[4] < counts[3] and counts[-1] > 0
    kept = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == kept


def test_stages_take_odd_rows_and_clashing_columns(spark):
    names = "score predicted held_out document kept component_id item_id similarity _copies _take _lang n_tokens start".split()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (None, "some plain words of a text", None, "src1", 1), (3, "", "en", None, None), (3, "", "en", None, None), (7001, "word " * 30000, "en", "src2", 5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    docs = docs.checkpoint()
    for at in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, at, SMALL)
            assert got.columns == docs.columns
            assert got.filter("similarity <> 7 OR start <> 12").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, at, SMALL).count() == at.count()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_run_against_brute_force(spark):
    """Every stage again without Spark: votes, sets, subsequences, SQL and the library."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    # quality: the fitted vectors, every vote counted by itself
    voter = quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = []
    for r in docs:
        z = voter.latent(np.concatenate([quality.features(t) for t in chunks(pa.array([r[1] or ""]))]))[0]
        near = sorted(((round(float(v @ z), 6), y) for v, y in zip(voter.vectors, voter.labels, strict=True)), reverse=True)
        votes = [(max(c, 0) ** quality.POWER, y) for c, y in near if c >= near[min(quality.NEIGHBOURS, len(near)) - 1][0]]
        total = sum(w for w, _ in votes)
        if (sum(w * y for w, y in votes) / total if r[1] and total > 1e-12 else voter.prior) >= 0.3:
            kept.append(r)
    # near-duplicates: all pairs of sets
    low = brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if low[r[0]] == r[0]]
    # leaks: every window of every document against every passage
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    items = []
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        sentences = [words(x) for x in re.split(r"[.!?\n]+", r.text) if words(x)]
        half = decontamination.PASSAGE // 2
        items += [(r.item_id, w[at : at + 2 * half], sentences[-1]) for at in (range(0, max(1, len(w) - half), half) if len(w) > 2 * half else [0]) if w]
    gone = {d for d, _ in brute_leaks([(r[0], words(r[1])) for r in kept], items)}
    assert gone
    kept = [r for r in kept if r[0] not in gone]
    # mixing: its SQL
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", kept)
    drawn = {r[0] for r in c.execute(f"SELECT doc_id FROM ({mix_sql({'lang': 'lang', 'source': 'source'}, corpus_pipeline.WEIGHTS, corpus_pipeline.SHARE, max_epochs=1)}) WHERE copies > 0").fetchall()}
    # tokens: the library
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for r in sorted(r for r in kept if r[0] in drawn):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_equal_rows_are_one(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars int"
    text = "one two three four five six seven eight"
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, "other", "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None), (4, text, "en", "a", 1), (4, text, "en", "a", 1), (4, "another text", "en", "a", 1), (5, text, "en", "a", 1), (6, "", "en", "a", 1)]
    got = corpus_pipeline.near_dups(spark, spark.createDataFrame(rows, kind), SMALL).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("None", text), ("None", "other"), ("None", "None"), ("4", text), ("4", "another text"), ("6", "")])


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1")
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert kept.join(labels, "doc_id").count() >= 0.99 * docs.join(labels, "doc_id").count()


def test_duplicates_and_leaks_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    extra = docs.filter("doc_id = 5").withColumn("doc_id", docs.doc_id + 9000)
    both = docs.union(extra).checkpoint()
    assert corpus_pipeline.near_dups(spark, both, SMALL).filter("doc_id = 9005").count() == 0
    rows = [(9100, f"before {item} after", "en", "src1", 1), (9101, None, None, None, None), (None, f"some more {item}", "en", "src1", 1), (None, "a clean text", "en", "src1", 2), (None, None, "en", "src1", 3)]
    leak = spark.createDataFrame(rows, docs.schema)
    got = corpus_pipeline.decontaminate(spark, docs.union(leak), SMALL).collect()
    assert 9100 not in {r.doc_id for r in got} and 9101 in {r.doc_id for r in got}
    assert sorted(r.n_chars for r in got if r.doc_id is None) == [2, 3]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    got = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))) == sorted(map(str, got.fetchall()))
