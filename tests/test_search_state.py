"""Search, chunks, streaming, state edits, sources and the SQL tool."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.functions import codes, text
from tributary.operators import instructions, search, state
from tributary.sources import arrow, files, sinks
from tributary.sqltool import SqlTool
from tributary.streaming import ingest


def test_knn(spark):
    index = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)] + [(9, None)], "id int, vector array<float>")
    q = spark.createDataFrame([(1, [1.2, 0.0])], "query int, vector array<float>")
    got = search.knn(index, q, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and got[0].score == pytest.approx(1 / 1.04)
    assert [r.id for r in search.knn(index, q, 0, "raw").collect()] == [1]
    assert [r.id for r in search.knn(index, q, 9, "cosine").orderBy("rank").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (299, []), (300, [300]), (500, [500]), (700, [500]), (725, [500, 300]), (5000, [500] * 11 + [325])])
def test_chunks(spark, n, sizes):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "id int, text string")
    got = search.chunks(df, "id", "text").orderBy("chunk").collect()
    assert [r.tokens for r in got] == sizes and [r.chunk for r in got] == list(range(len(sizes)))


def test_stream_takes_each_chunk_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, body in enumerate(["a b c d", "a b c d"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"url": "u", "content": body, "error": None}))
    (tmp_path / "in" / "2.json").write_text(json.dumps({"url": "x", "content": "a b c", "error": "no"}))
    for _ in range(2):
        made = ingest.chunk_stream(ingest.stream(spark, str(tmp_path / "in")), shortest=1, longest=3)
        ingest.append_to(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.chunk_url: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"u#chunk0": "a b c", "u#chunk1": "c d"}


def test_state_edits(spark):
    procs = spark.createDataFrame([("p1",), ("p2",)], "process string")
    with pytest.raises(ValueError):
        state.insert(procs, procs.limit(1), "process")
    with pytest.raises(ValueError):
        state.replace(procs, spark.createDataFrame([("p9",)], "process string"), "process")
    assert state.insert(procs, procs, "process", overwrite=True).count() == 2
    assert state.remove(procs, procs.limit(1), "process").count() == 1
    refs = spark.createDataFrame([("p1", 0, "u#a")], "process string, pos int, url string")
    new = spark.createDataFrame([("p1", 1, "u#b"), ("p1", 2, "w#1"), ("p1", 3, "w#2")], refs.schema)
    assert {r.url for r in state.add_references(refs, new).collect()} == {"u#a", "w#1"}
    assert state.remove_references(refs, new).count() == 0


def test_entries(spark):
    kind = "process string, side string, code string, name string"
    held = spark.createDataFrame([("p", "in", "100000", "a"), ("p", "out", None, "Slag")], kind)
    new = spark.createDataFrame([("p", "out", "100000", "a"), ("p", "in", "100000", "a"), ("p", "in", None, "slag"), ("p", "in", "200000", "b")], kind)
    out, rejected = state.add_entries(held, new)
    assert out.count() == 3 and rejected.count() == 2
    assert state.remove_entries(out, new.filter("code = '200000'")).count() == 2
    dup = spark.createDataFrame([(i, s, c) for i in (1, 2) for s, c in (("in", "a"), ("out", "b"))] + [(3, "in", None), (4, "out", None)], "process int, side string, code string")
    groups = state.duplicate_processes(dup)
    assert sorted((r.process, r["first"], r.n) for r in groups.collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2)]
    assert {r.process for r in state.merge_duplicates(dup, dup.select("process").distinct(), groups)[1].collect()} == {1, 3}


def test_materials(spark):
    kind = "code string, name string, aliases array<string>"
    got = state.add_materials(spark.createDataFrame([("1", "Borax", ["tincal"])], kind), spark.createDataFrame([("1", "Sodium borate", ["tincal", "Borax"]), ("2", "X", None)], kind))
    assert {r.code: (r.name, r.aliases) for r in got.collect()} == {"1": ("Borax", ["tincal", "Sodium borate"]), "2": ("X", [])}
    m = spark.createDataFrame([("1", "a", ["b"], 0), ("2", "b", ["c"], 1), ("b", "z", [], 2)], "code string, name string, aliases array<string>, pos int")
    asked = spark.createDataFrame([("b",), ("c",), ("q",)], "asked string")
    assert {r.asked: r.code for r in state.find_material(m, asked).collect()} == {"b": "b", "c": "2"}


def state_of(spark, docs):
    return spark.createDataFrame(docs, instructions.DOCUMENT)


def todo(spark, *rows):
    """Instructions from (kind, process, options)."""
    names = "side description scale ins outs refs".split()
    return spark.createDataFrame([(i, kind, process, *(o.get(n) for n in names)) for i, (kind, process, o) in enumerate(rows)], instructions.INSTRUCTION)


def test_instructions_in_their_order(spark):
    docs = state_of(spark, [("p", "old", 0.5, [("100000", "a")], [(None, "slag")], ["u"]), ("q", None, None, [], [], []), ("r", None, 0.1, [], [], [])])
    asked = todo(
        spark,
        ("AddProcess", "n", {"description": "new", "scale": 0.7, "outs": [("200000", "b")], "ins": [("300000", "c")], "refs": ["x#1", "x"]}),
        ("AddProcess", "p", {"description": "again"}),
        ("SetProcess", "p", {"description": "set"}),
        ("AddMaterial", "p", {"side": "out", "ins": [("400000", "d")]}),
        ("AddMaterial", "p", {"side": "out", "ins": [("100000", "other name")]}),
        ("AddMaterial", "p", {"side": "in", "ins": [("400000", "d")]}),
        ("RemoveMaterial", "p", {"side": "in", "ins": [("100000", None)]}),
        ("AddMaterial", "p", {"side": "out", "ins": [("100000", "a")]}),
        ("AddReference", "p", {"refs": ["u#top", "w"]}),
        ("RemoveProcess", "q", {}),
        ("AddReference", "q", {"refs": ["z"]}),
        ("RemoveProcess", "none", {}),
        ("Nonsense", "p", {}),
    )
    after, messages = instructions.folded(docs, asked)
    got = {r.process: r for r in after.collect()}
    assert set(got) == {"n", "p", "r"} and got["r"].scale == 0.1
    assert (got["n"].description, got["n"].scale, [tuple(x) for x in got["n"].ins], [tuple(x) for x in got["n"].outs]) == ("new", 0.7, [("300000", "c")], [("200000", "b")])
    assert got["n"].refs == ["x#1", "x"]
    p = got["p"]
    assert (p.description, p.scale, p.ins, [tuple(x) for x in p.outs], p.refs) == ("set", 0.5, [], [(None, "slag"), ("400000", "d"), ("100000", "a")], ["u", "w"])
    assert sorted(r.pos for r in messages.collect()) == [1, 4, 5, 10, 11, 12]


def test_refused_addition_keeps_what_went_before(spark):
    asked = todo(spark, ("AddProcess", "n", {"outs": [("200000", "b")], "ins": [("100000", "a"), ("200000", "b"), ("300000", "c")], "refs": ["u"]}))
    after, messages = instructions.folded(state_of(spark, []), asked)
    r = after.first()
    assert [tuple(x) for x in r.outs] == [("200000", "b")] and [tuple(x) for x in r.ins] == [("100000", "a")] and r.refs == [] and messages.count() == 1


def test_documents_of_tables(spark):
    p = spark.createDataFrame([(1, "d", 0.5), (2, None, None)], "process long, description string, scale double")
    e = spark.createDataFrame([(1, "in", "100000", "a", 1), (1, "in", None, "ore", 0), (1, "out", "200000", "b", 0)], "process long, side string, code string, name string, pos int")
    r = spark.createDataFrame([(1, "v", 1), (1, "u", 0)], "process long, url string, pos int")
    got = {x.process: x for x in instructions.documents_of(p, e, r).collect()}
    assert [tuple(x) for x in got["1"].ins] == [(None, "ore"), ("100000", "a")] and got["1"].refs == ["u", "v"] and got["2"].ins == [] and got["2"].refs == []


def test_lookups(spark):
    m = spark.createDataFrame([("1", 0, "x", "a", None), ("2", 1, "x", "b", ""), ("3", 2, None, "c", "b")], "code string, pos int, id string, name string, label string")
    assert {r.key: r.code for r in state.material_lookup(m).collect()} == {"x": "2", "a": "1", "b": "3", "c": "3"}
    e = spark.createDataFrame([(1, "in", "1"), (1, "out", "1"), (2, "out", "1"), (2, "in", "9")], "process int, side string, code string")
    assert {(r.process, r.role) for r in state.linked_processes(e, m).collect()} == {(1, "precursor"), (2, "product")}
    assert {r.code for r in state.unknown(e, m).collect()} == {"9"}
    mined = m.select("code", (F.col("code") == "1").alias("mined"))
    assert {r.code for r in state.unmined(mined).collect()} == {"2", "3"} and state.wanted(m, None).count() == 3 and state.wanted(m, ["2"]).count() == 1
    refs = spark.createDataFrame([("u", None), ("v", "404")], "url string, error string")
    assert [r.line for r in state.listed_references(refs).collect()] == ["- u"]
    assert sorted(r.line for r in state.listed_references(refs, failed=True).collect()) == ["- [FAILED] v", "- u"]
    scored = spark.createDataFrame([("1", 0.5), ("1", None), ("2", 0.1)], "code string, score double")
    assert {r.code: r.settled for r in state.settled(scored).collect()} == {"1": False, "2": True}


def test_component_tree(spark):
    rows = [("root", "a", "part"), ("root", "root", "part"), ("a", "b", "raw"), ("a", "c", "part"), ("b", "never", "part"), ("c", "d", "part"), ("d", "deep", "part"), ("root", "c", "part")]
    got = state.component_tree(spark.createDataFrame(rows, "parent string, child string, kind string"), "root")
    assert sorted((r.parent, r.child, r.level) for r in got.collect()) == [("a", "b", 2), ("a", "c", 2), ("c", "d", 2), ("c", "d", 3), ("d", "deep", 3), ("root", "a", 1), ("root", "c", 1)]
    doc = json.loads(sinks.tree_document(got).first()[0])
    assert len(doc["edges"]) == 7 and {n["id"] for n in doc["nodes"]} == {"a", "b", "c", "d", "deep"}


def test_saved_states_are_kept_beside(spark, tmp_path):
    path, one = str(tmp_path / "state"), {"materials": spark.range(1)}
    assert sinks.save_state(one, path) is None
    assert sinks.save_state({"materials": spark.range(2)}, path).endswith("state.1") and sinks.save_state({"materials": spark.range(3)}, path).endswith("state.2")
    assert sinks.saved_state(spark, path, ("materials",))["materials"].count() == 3 and spark.read.parquet(f"{path}.1/materials").count() == 1


def test_metric_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "y": 2.5, "ok": true, "name": "n", "nested": {"z": 1}}')
    (tmp_path / "b.json").write_text("{")
    rows, bad = files.metric_documents(spark, str(tmp_path))
    assert {(r.key, r.value) for r in rows.collect()} == {("x", 1.0), ("y", 2.5), ("ok", 1.0)} and [r.path[-6:] for r in bad.collect()] == ["b.json"]
    assert files.config(spark, str(tmp_path / "a.json"))["name"] == "n"


@pytest.mark.parametrize("kind", ["gml", "graphml", "edgelist", "adjlist", "json"])
def test_graphs_are_read_as_written(spark, tmp_path, kind):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    sinks.write_edges(edges, str(tmp_path / "g"), kind)
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    if kind == "json":
        got = {(json.loads(x)["source"], json.loads(x)["target"]) for x in whole.split()}
    elif kind in ("gml", "graphml"):
        got = set(files.parse_graph(whole, kind))
    else:
        (tmp_path / f"g.{kind}").write_text(whole)
        got = {tuple(r) for r in files.read_graph(spark, str(tmp_path / f"g.{kind}"), kind, directed=True).collect()}
    assert got == {("a", "b"), ("b", "c"), ("a", "c")}


def test_report_tables(spark):
    df = spark.createDataFrame([("a|b", 1), ("c_d", None)], "name string, n int")
    assert [r.line for r in sinks.markdown(df).orderBy("pos").collect()] == ["| name | n |", "| --- | --- |", "| a\\|b | 1 |", "| c_d |  |"]
    assert {r.line for r in sinks.latex_rows(df, ["name", "n"]).collect()} == {"a|b & 1 \\\\", "c\\_d &  \\\\"}


def test_nomenclature(spark, tmp_path):
    (tmp_path / "h").write_text("010121: Horses: live\n  continued: text\n\n010121: later\nno colon\n1234567: x\n")
    rows = {r.code: r.description for r in files.nomenclature(spark, str(tmp_path / "h")).collect()}
    assert rows == {"010121": "later", "continued": "text", "1234567": "x"}
    assert {r.code for r in files.six_digit_codes(spark, str(tmp_path / "h")).collect()} == {"010121"}


def test_judge_cache(spark, tmp_path):
    (tmp_path / "j").write_text('{"key":"a","overall_correct":false}\n\n{"key":"b"}\n{"key":"a","overall_correct":true}\n')
    assert {r.key: r.overall_correct for r in files.judge_records(spark, str(tmp_path / "j")).collect()} == {"a": True, "b": None}
    assert files.judge_records(spark, str(tmp_path / "j"), None).count() == 3


def test_state_document(spark, tmp_path):
    doc = {"materials": {"252800": {"name": "Borax", "mined": True, "aliases": ["tincal"]}}, "processes": {"p1": {"scale": 0.5, "precursors": [{"hs_code": "252800", "name": "Borax"}, "ore"], "products": [], "references": ["u#x", {"url": "w", "source_quality_score": 0.5}]}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = files.state(spark, str(tmp_path / "s.json"))
    assert [(r.code, r.name, r.mined, r.aliases) for r in got["materials"].collect()] == [("252800", "Borax", True, ["tincal"])]
    assert sorted((r.side, r.pos, r.code, r.name, r.bare) for r in got["entries"].collect()) == [("in", 0, "252800", "Borax", False), ("in", 1, None, "ore", True)]
    assert sorted((r.pos, r.url, r.source_score) for r in got["refs"].collect()) == [(0, "u#x", None), (1, "w", 0.5)]
    assert got["processes"].first().scale == 0.5


def test_cached_contents(spark, tmp_path):
    import hashlib

    key = hashlib.md5(b"https://e.org/b").hexdigest()
    (tmp_path / f"{key}.json").write_text(json.dumps({"url": "https://e.org/b", "content": "text", "error": None}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "err.json").write_text(json.dumps({"url": "x", "content": "y", "error": "404"}))
    refs = spark.createDataFrame([("https://e.org/b#top",), ("https://e.org/none",)], "url string")
    got = {r.url: r.content for r in files.reference_texts(refs, files.contents(spark, str(tmp_path))).collect()}
    assert got == {"https://e.org/b#top": "text", "https://e.org/none": None}


def test_arrow_source(spark, tmp_path):
    t = pa.table({"partnerCode": pa.array([1, 2, 3]), "cmdCode": ["010121", "x", None], "value": [1.5, None, 2.0]})
    for i in range(2):
        with pa.ipc.new_file(str(tmp_path / f"{i}.arrow"), t.schema) as w:
            w.write_table(t, max_chunksize=2)
    got = arrow.read_arrow(spark, *(str(tmp_path / f"{i}.arrow") for i in range(2)))
    assert got.count() == 6 and got.filter("cmdCode = '010121'").count() == 2 and got.agg(F.sum("value")).first()[0] == 7.0
    with pytest.raises(ValueError):
        files.data_table(spark, "x.xlsx")


def test_yearly_files(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "2019.parquet"))
    got, missing = files.yearly_trade(spark, str(tmp_path), [2018, 2019])
    assert got.count() == 2 and missing == [2018]


@pytest.mark.parametrize(("name", "body"), [("g.txt", "a b\n# no\nb c 1.0\n"), ("g.adjlist", "a b\nb c\n"), ("g.json", '{"links":[{"source":"a","target":"b"},{"source":"b","target":"c"}]}'), ("g.graphml", '<graphml xmlns="x"><graph><edge source="a" target="b"/><edge source="b" target="c"/></graph></graphml>'), ("g.gml", "graph [ edge [ source a target b ] edge [ source b target c ] ]"), ("g.net", '*Vertices 3\n1 "a"\n2 "b"\n3 "c"\n*Arcs\n1 2\n2 3\n')])
def test_graph_files(spark, tmp_path, name, body):
    (tmp_path / name).write_text(body)
    assert {(r.src, r.dst) for r in files.read_graph(spark, str(tmp_path / name), directed=True).collect()} == {("a", "b"), ("b", "c")}
    both = files.read_graph(spark, str(tmp_path / name)).count()
    assert both == (4 if name == "g.adjlist" else 2) and files.read_graph(spark, str(tmp_path / name), directed=False).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert not sinks.write_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.write_csv(df, str(tmp_path / "csv"))
    for kind in ("edgelist", "adjlist", "json"):
        sinks.write_edges(df, str(tmp_path / kind), kind)
    assert spark.read.text(str(tmp_path / "edgelist")).first()[0] == "a b"
    assert sinks.macros(df, "x").count() == 2


def test_sql_tool(spark):
    tool = SqlTool(spark, spark.createDataFrame([(1, "a")], "id int, text string"))
    assert tool.query("SELECT id + 1 AS x FROM data") == [{"x": 2}]
    assert list(tool.query("SELECT nothing FROM data")[0]) == ["error"]


def test_codes(spark):
    df = spark.createDataFrame([("010121",), (" 281000 ",), ("7712",), ("ab",), (None,)], "c string")
    got = df.select(codes.typed_code(F.col("c")).alias("t"), codes.section(F.col("c")).alias("s")).collect()
    assert [r.t for r in got] == ["010121", "281000", None, None, None] and [r.s for r in got] == ["I", "I", None, None, None]


#: Names and the short forms that reports give them.
SHORT = {
    "Sodium perborate and other perborates": "Sodium perborate and other perborates",
    "Methyl chloride (chloromethane, CH3Cl)": "Methyl chloride (chloromethane, CH3Cl)",
    "Gadolinium gallium garnet, gallium-based garnet magnets": "Gadolinium gallium garnet",
    "Calcium oxide (quicklime), industrial/technical grade": "Calcium oxide (quicklime)",
    "Gallium in ores and concentrates (trace by-product in bauxite and zinc ores)": "Gallium in ores and concentrates",
    "Aluminum oxide (Al2O3) refined industrial grade powder blend": "Aluminum oxide (Al2O3) refined industria...",
    "a) b (c, d) e, f": "a) b (c, d) e",
    " Boric acid; crystals": "Boric acid",
    "": "",
}


def test_short_names(spark):
    rows = spark.createDataFrame([(x,) for x in [*SHORT, None, "A" * 60, "B (" + "c" * 60 + ")", "(" * 5 + "d" * 50]], "s string")
    got = {r.s: r.short for r in rows.select("s", text.shortened(F.col("s")).alias("short")).collect()}
    assert {k: got[k] for k in SHORT} == SHORT and got[None] is None and got["A" * 60] == "A" * 40 + "..."
    assert all(x is None or (x.count("(") == x.count(")") or s in SHORT) and len(x) <= 43 for s, x in got.items())


def test_half_weight_depth():
    for p in (0.5, 0.9, 0.98):
        d = text.half_weight_depth(p)
        assert text.rbo_weight(d, p) >= 0.5 and (d == 1 or text.rbo_weight(d - 1, p) < 0.5)


def test_json_scanner():
    assert text.last_json_object('x {"a": 1} {"b"} {"a": 2, "b": {"c": 3}} y', ("a",)) == '{"a": 2, "b": {"c": 3}}'
    assert text.last_json_object(None) is None and text.last_json_object("{broken") is None


def test_text_functions(spark):
    s = lambda c: spark.range(1).select(c).first()[0]
    assert s(text.domain(F.lit("https://User@A.org:80/x"))) == "user@a.org:80" and s(text.domain(F.lit("a.org/x"))) is None
    assert s(text.plain_name(F.lit("Borax (natural) "))) == "borax"
    assert s(text.alternatives(F.lit("zinc or tin and lead"))) == ["zinc", "tin", "lead"]
    assert s(text.alternatives(F.lit("salts (a or b) and c"))) == ["salts (a or b) and c"]
    assert s(text.quality_class(F.lit("Boron; other"), F.array(F.lit("boron")))) == "shared" and s(text.quality_class(F.lit(None).cast("string"), F.array(F.lit("x")))) == "shared"
    assert s(text.percent(F.lit(1), F.lit(0))) == "N/A" and s(text.capitalised(F.lit("aB"))) == "AB"
    assert files.parse_years("2017-2019") == [2017, 2018, 2019] and files.parse_materials("a, b,") == ["a", "b"]


def test_list_edits(spark):
    s = lambda c: spark.range(1).select(c).first()[0]
    a = F.array(F.lit("a"), F.lit("b"))
    assert s(state.append_absent(a, F.lit("b"))) == ["a", "b"] and s(state.append_absent(a, F.lit("c"))) == ["a", "b", "c"]
    assert s(state.replaced_at(a, 1, F.lit("x"))) == ["a", "x"] and s(state.replaced_at(a, 9, F.lit("x"))) == ["a", "b"]
    assert s(state.removed_at(a, 0)) == ["b"] and s(state.without(a, F.lit("b"))) == ["a"]
    rows = spark.createDataFrame([("u", "text"), ("w", ""), ("z", "text")], "url string, content string")
    got = state.looked_up(rows, spark.createDataFrame([("u", 0.5), ("w", 0.9)], "url string, score double"), "url", "content")
    assert {r.url: r.score for r in got.collect()} == {"u": 0.5, "w": 0.0, "z": None}


def test_refine_loop():
    heat = []
    out = state.refined(0, lambda s, t: heat.append(t) or s + 1, lambda s, t: (s, s < 2), 3, 10)
    assert out == 3 and heat == [1.0, 0.9, 0.8]
    assert state.refined(0, lambda s, t: s + 1, lambda s, t: (s, True), 1, 4) == 4


def test_markdown(spark):
    page = """<html><head><title>t</title></head><body><nav><a href="/x">menu</a></nav><!-- no -->
<h1 class="a">Boric  acid</h1><p>Made of <b>borax</b> &amp; <em>acid</em>,<br>see <a class="r" href="https://e.org/a?b=1">this &lt;page&gt;</a>.</p>
<ul><li>one</li><li>two</li></ul><h3>More</h3>
<form><input name="q"><button>go</button></form><pre>x  y</pre><script>var a = "</p>";</script></body></html>"""
    want = "# Boric acid\n\nMade of **borax** & *acid*,\nsee [this <page>](https://e.org/a?b=1).\n\n* one\n* two\n\n### More\n\nx y"
    got = spark.createDataFrame([(page,), ("",), (None,), ("plain",)], "html string").select(files.html_markdown(F.col("html"))).collect()
    assert [r[0] for r in got] == [want, "", None, "plain"]


def test_command_line(spark, tmp_path):
    from tributary.__main__ import main

    (tmp_path / "t").mkdir()
    flow = "partner long, reporter long, code string, year long, value double"
    spark.createDataFrame([(1, 842, "100000", 2020, 3.0), (2, 842, "100000", 2020, 1.0)], flow).write.parquet(str(tmp_path / "t/2020.parquet"))
    (tmp_path / "b.csv").write_text("material,code,quality\nboron,100000,clean\nzinc,100000,shared\n")
    (tmp_path / "p.csv").write_text("code,name,iso3,is_group\n1,One,ONE,false\n")
    out = str(tmp_path / "out")
    main(["trade-export", "--folder", str(tmp_path / "t"), "--years", "2019-2020", "--materials", "boron", "--buckets", str(tmp_path / "b.csv"), "--partners", str(tmp_path / "p.csv"), "--out", out], spark)
    rows = spark.read.option("header", True).csv(out).collect()
    assert sorted((r.material, r.exporter, r.import_share_pct) for r in rows) == [("boron", "One", "75.0"), ("boron", "Unknown (2)", "25.0")]
    doc = {"materials": {c: {"name": c} for c in ("100000", "200000", "300000")}, "processes": {"p": {"precursors": [{"hs_code": "100000"}], "products": [{"hs_code": "200000"}]}, "q": {"precursors": [{"hs_code": "200000"}], "products": [{"hs_code": "300000"}]}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    main(["criticality", "--state", str(tmp_path / "s.json"), "--base", "200000", "--out", str(tmp_path / "c")], spark)
    assert {r.code: r.criticality for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"100000": "1", "300000": "1"}
    with pytest.raises(SystemExit):
        main(["criticality", "--state", str(tmp_path / "s.json"), "--base", "999999", "--out", out], spark)
    main(["disruption", "--state", str(tmp_path / "s.json"), "--trade", str(tmp_path / "t/2020.parquet"), "--threshold", "0.6", "--out", str(tmp_path / "d")], spark)
    assert {r.code: r.n_dependents for r in spark.read.option("header", True).csv(str(tmp_path / "d")).collect()}["100000"] == "2"
    (tmp_path / "g.txt").write_text("a b\nb c\n")
    main(["graph", "--path", str(tmp_path / "g.txt"), "--out", str(tmp_path / "g")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).count() == 3
    assert main(["sql", "--path", str(tmp_path / "b.csv"), "--query", "SELECT count(*) AS n FROM data"], spark) == [{"n": 2}]


def test_more_commands(spark, tmp_path, capsys):
    from tributary.__main__ import COMMANDS, main

    assert len(COMMANDS) >= 25
    doc = {"materials": {c: {"name": n} for c, n in (("100000", "borax"), ("200000", "boric acid"), ("300000", "boron"))}, "processes": {
        "p": {"scale": 0.5, "precursors": [{"hs_code": "100000", "name": "borax"}], "products": [{"hs_code": "200000", "name": "boric acid"}], "references": ["https://e.org/a"]},
        "q": {"scale": 0.1, "precursors": [{"hs_code": "200000"}], "products": [{"hs_code": "300000"}, {"hs_code": "999999"}], "references": []}}}
    state_path = str(tmp_path / "s.json")
    (tmp_path / "s.json").write_text(json.dumps(doc))
    (tmp_path / "cache").mkdir()
    import hashlib

    (tmp_path / "cache" / (hashlib.md5(b"https://e.org/a").hexdigest() + ".json")).write_text(json.dumps({"url": "https://e.org/a", "content": "borax gives boric acid", "error": None}))
    (tmp_path / "cache" / "x.json").write_text(json.dumps({"url": "https://e.org/x", "content": None, "error": "404"}))
    (tmp_path / "h.txt").write_text("100000: a\n200000: b\n300000: c\n")
    (tmp_path / "routes.csv").write_text("route,input_hs,output_hs\nr1,100000,200000\nr2,300000,100000\nr3,bad,100000\n")
    (tmp_path / "listed.csv").write_text("commodity,hs_code\nboron,300000\n")
    (tmp_path / "j1").write_text("".join(json.dumps({"key": f"k{i}", "overall_correct": i % 2 == 0, "error_mode": "codes"}) + "\n" for i in range(6)))
    (tmp_path / "j2").write_text("".join(json.dumps({"key": f"k{i}", "overall_correct": True}) + "\n" for i in range(6)))
    todo = [{"pos": 0, "kind": "RemoveProcess", "process": "q"}, {"pos": 1, "kind": "AddMaterial", "process": "p", "side": "out", "ins": [{"code": "100000", "name": "x"}]}]
    (tmp_path / "todo").write_text("".join(json.dumps(x) + "\n" for x in todo))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"x": 1}')
    (tmp_path / "g.txt").write_text("a b\nb c\n")
    caches = f"l:a:{tmp_path / 'j1'},l:b:{tmp_path / 'j2'}"

    def run(name, *options):
        out = str(tmp_path / f"out-{name}")
        main([name, *options, *(["--out", out] if "out" in [o for o, _ in COMMANDS[name][1]] else [])], spark)
        return spark.read.option("header", True).csv(out).collect() if "out" in [o for o, _ in COMMANDS[name][1]] and name != "edit" else out

    one = run("criticality-summary", "--state", state_path, "--base", "200000")[0]
    assert (one.reach, one.n_pre, one.n_edges) == ("2", "1", "2")
    assert run("rank-stability", "--states", f"{state_path},{state_path}", "--base", "200000", "--samples", "3")[0].kind in ("borda", "pairwise")
    beside = {k: spark.read.option("header", True).csv(f"{tmp_path}/out-rank-stability-{k}").collect() for k in ("aggregate", "runs", "degrees")}
    assert [(r["rank"], r.item, r.n_runs_present) for r in sorted(beside["aggregate"], key=lambda r: int(r["rank"]))] == [("1", "100000", "2"), ("2", "300000", "2")]
    assert {(r.aggregate, r.run, r.n_items, r.overlap) for r in beside["runs"]} == {(x, y, "2", "2.0") for x in ("borda", "critsum") for y in ("0000", "0001")}
    assert {(r.degree, r.in_mean, r.out_sd) for r in beside["degrees"]} == {("0", "1.0", "0.0"), ("1", "2.0", "0.0")}
    assert {r.judge: r.ci_hi for r in run("judge-summary", "--caches", caches)}["b"] == "1.0"
    assert {r.label for r in run("judge-agreement", "--caches", caches, "--first", "a", "--second", "b")} == {"l", "*"}
    assert {(r["mode"], r.n) for r in run("error-modes", "--caches", caches)} == {("codes", "3")}
    assert tuple(run("hs-validity", "--state", state_path, "--nomenclature", str(tmp_path / "h.txt"))[0]) == ("3", "3", "2", "1")
    assert {r.process: r.grounded for r in run("evidence", "--state", state_path, "--contents", str(tmp_path / "cache"))} == {"p": "true", "q": "false"}
    assert {r.route: r.status for r in run("route-recall", "--state", state_path, "--routes", str(tmp_path / "routes.csv"))} == {"r1": "strict", "r2": "miss"}
    assert run("coverage", "--state", state_path, "--listed", str(tmp_path / "listed.csv"))[0].overlap == "1"
    assert run("audit", "--state", state_path)[0].n_processes == "2"
    assert {r.role for r in run("processes", "--state", state_path, "--code", "200000")} == {"precursor", "product"}
    assert len(run("materials", "--state", state_path, "--codes", "100000,300000")) == 2
    assert run("metrics", "--folder", str(tmp_path / "m"))[0].key == "x"
    run("edit", "--state", state_path, "--instructions", str(tmp_path / "todo"))
    edited = [json.loads(x) for p in sorted((tmp_path / "out-edit").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["process"] for x in edited] == ["p"] and "1 p:" in capsys.readouterr().err
    main(["list-references", "--folder", str(tmp_path / "cache"), "--failed"], spark)
    assert capsys.readouterr().out.splitlines() == ["- https://e.org/a", "- [FAILED] https://e.org/x"]
    main(["convert-graph", "--path", str(tmp_path / "g.txt"), "--to", str(tmp_path / "g.json"), "--to-kind", "json"], spark)
    assert spark.read.json(str(tmp_path / "g.json")).count() == 2
    main(["audit", "--state", state_path, "--out", str(tmp_path / "audit.md")], spark)
    assert spark.read.text(str(tmp_path / "audit.md")).count() == 3


def test_knn_on_odd_vectors(spark):
    """Copies, zeros, nulls and other lengths against the definition; ties to the smaller id, and no row for a pair."""
    import math
    import random

    rng = random.Random(4)
    vectors = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, 2.0]), (103, [0.0, 0.0, 0.0])]
    index = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    asked = [r for r in rows if r[0] % 7 == 0 or r[0] > 99]

    def value(a, b, measure):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        if measure == "raw":
            return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        if not any(a) or not any(b):
            return None
        one, two = ([x / math.sqrt(sum(y * y for y in v)) for x in v] for v in (a, b))
        return -sum(x * y for x, y in zip(one, two, strict=True))

    for measure in ("raw", "cosine"):
        got = search.knn(index, spark.createDataFrame(asked, "query long, vector array<float>"), 4, measure)
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        near = {q: sorted((value(a, b, measure), i) for i, b in rows if value(a, b, measure) is not None)[:4] for q, a in asked}
        want = {(q, n + 1, i) for q, x in near.items() for n, (_, i) in enumerate(x)}
        assert {(r.query, r["rank"], r.id) for r in got.collect()} == want


def test_folding_takes_processes_many_at_a_time(spark):
    from tributary.plans import catalog

    assert "CoGroup" not in catalog.QUERIES["folded_instructions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_every_reference_and_every_refusal_is_folded(spark):
    """The query's rows by a plain loop over all instructions; references weren't instructions, and refusals were dropped."""
    from tributary.plans import catalog

    d = "/root/testdata/sf0.001"
    entries, refs, processes = (catalog.v(spark, d, n).collect() for n in ("entries", "refs", "processes"))
    held = {str(r.process): ([], [], []) for r in processes}
    for r in sorted(entries, key=lambda r: r.pos):
        held[str(r.process)][r.side == "out"].append((r.code, r.name))
    for r in sorted(refs, key=lambda r: r.pos):
        if str(r.process) in held:
            held[str(r.process)][2].append(r.url)
    asked = [(r.pos * 3, str(r.process + 1), r) for r in entries] + [(r.pos * 3 + 1, str(r.process), r) for r in refs] + [(r.process * 15, str(r.process), None) for r in processes if r.scale < 0.2]
    refused = {}
    for _, process, r in sorted(asked, key=lambda x: x[0]):
        ok = process in held
        if ok and r is None:
            del held[process]
        elif ok and "url" in r:
            plain = r.url.split("#")[0]
            held[process][2].extend([r.url] if plain not in held[process][2] else [])
        elif ok:
            here, there = held[process][r.side == "out"], held[process][r.side == "in"]
            same = lambda x: x[0] == r.code if r.code else x[1] == r.name  # noqa: B023, E731
            ok = not any(map(same, there))
            if ok and not any(map(same, here)):
                here.append((r.code, r.name))
        if not ok:
            refused[process] = refused.get(process, 0) + 1
    sizes = {p: tuple(map(len, x)) for p, x in held.items()}
    want = {p: (*sizes.get(p, (None,) * 3), refused.get(p, 0)) for p in sizes.keys() | refused}
    got = {r.process: (r.n_ins, r.n_outs, r.n_refs, r.n_refused) for r in catalog.QUERIES["folded_instructions"](spark, d).collect()}
    assert got == want and {str(r.process) for r in refs} <= set(got)


def test_trees_larger_than_the_limit_of_recursion(spark):
    from tributary.plans import catalog

    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {r.depth: (r.n, r.first) for r in catalog.QUERIES["sql_recursive_tree"](spark, "/root/testdata/sf0.001").collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got[0] == (1, 0) and got[1] == (4, 1) and got[2] == (16, 5) and sum(n for n, _ in got.values()) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
