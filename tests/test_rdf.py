"""Readers, writers and inference."""

import pytest

from shapeloom.sources import rdf, turtle
from shapeloom.sources.terms import RDF, XSD, Node, iri, literal

P = "@prefix : <http://e/> .\n"


def test_turtle_terms():
    got = turtle.parse(P + ':a :p 1, 2.5, 1e3, true, "x"@EN, "a\\"b\\u00e9", """l\n1""" ; a :C ; :q [ :r (1 :b) ] . _:x :p <http://e/y> .')
    o = [t[2] for t in got]
    assert literal("1", XSD + "integer") in o and literal("2.5", XSD + "decimal") in o and literal("1e3", XSD + "double") in o
    assert literal("x", lang="en") in o and literal('a"bé') in o and literal("l\n1") in o
    assert any(t[1] == RDF + "rest" and t[2] == iri(RDF + "nil") for t in got)
    assert (Node(1, "x"), "http://e/p", iri("http://e/y")) in got


def test_turtle_base_and_set():
    assert turtle.parse("@base <http://b/x/> . <a> <p> <#f>, <#f> .") == [(iri("http://b/x/a"), "http://b/x/p", iri("http://b/x/#f"))]


@pytest.mark.parametrize("bad", [":a :p 1 .", P + '"x" :p 1 .', P + ":a :p .", P + ":a :p 1"])
def test_turtle_errors(bad):
    with pytest.raises(SyntaxError):
        turtle.parse(bad)


def test_formats_agree():
    want = {(iri("http://e/a"), "http://e/p", literal("1", XSD + "integer")), (iri("http://e/a"), RDF + "type", iri("http://e/C")), (iri("http://e/a"), "http://e/q", literal("x", lang="en"))}
    texts = {
        "turtle": P + ':a a :C ; :p 1 ; :q "x"@en .',
        "n-quads": f'<http://e/a> <{RDF}type> <http://e/C> <http://g> . <http://e/a> <http://e/p> "1"^^<{XSD}integer> . <http://e/a> <http://e/q> "x"@en .',
        "trig": P + ':g { :a a :C ; :p 1 } GRAPH :h { :a :q "x"@en . }',
        "rdf/json": '{"http://e/a": {"' + RDF + 'type": [{"type": "uri", "value": "http://e/C"}], "http://e/p": [{"type": "literal", "value": "1", "datatype": "' + XSD + 'integer"}], "http://e/q": [{"type": "literal", "value": "x", "lang": "en"}]}}',
        "rdf/xml": f'<rdf:RDF xmlns:rdf="{RDF}" xmlns="http://e/"><C rdf:about="http://e/a"><p rdf:datatype="{XSD}integer">1</p><q xml:lang="en">x</q></C></rdf:RDF>',
        "json-ld": '{"@context": {"@vocab": "http://e/"}, "@id": "http://e/a", "@type": "C", "p": 1, "q": {"@value": "x", "@language": "en"}}',
    }
    for kind, data in texts.items():
        assert set(rdf.parse(data, kind)) == want, kind


def test_ntriples_roundtrip(spark, tmp_path):
    triples = [(iri("http://e/a"), "http://e/p", literal('x "\\ \n é')), (Node(1, "b"), "http://e/p", literal("1", XSD + "integer")), (iri("http://e/a"), "http://e/p", literal("x", lang="en-GB"))]
    rdf.write(rdf.frame(spark, triples), f"{tmp_path}/g")
    back = {(Node(*r["s"]), r["p"], Node(*r["o"])) for r in rdf.read(spark, f"{tmp_path}/g").collect()}
    assert back == set(triples)


def test_ntriples_bad_line(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# note\n\n<http://e/a> <http://e/p> "1" .\nno triple\n')
    with pytest.raises(Exception, match="not a triple"):
        rdf.read(spark, str(tmp_path / "g.nt")).collect()
    assert rdf.read(spark, str(tmp_path / "g.nt"), strict=False).count() == 1


def test_infer_and_merge(spark):
    g = rdf.from_string(spark, P + "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :A rdfs:subClassOf :B . :B rdfs:subClassOf :A . :x a :A . :p rdfs:subPropertyOf :q . :x :p :y . :q rdfs:range :R .")
    got = {(r["s"]["lex"], r["p"], r["o"]["lex"]) for r in rdf.infer(g, "rdfs").collect()}
    e = "http://e/"
    assert {(e + "x", RDF + "type", e + "B"), (e + "x", e + "q", e + "y"), (e + "y", RDF + "type", e + "R")} <= got
    assert rdf.infer(g, "NONE") is g
    b = rdf.from_string(spark, P + "_:x :p 1 .")
    assert rdf.merge(b, b).count() == 2


def test_loader_visits_once():
    seen = []
    texts = {"a": ["b", "a"], "b": ["a"]}
    rdf.Loader(lambda x: seen.append(x) or texts[x]).load("a", lambda got: got)
    assert seen == ["a", "b"]


def test_files_are_parsed_by_tasks(spark, tmp_path):
    """Every format from files as from text; blank nodes of different files stay apart."""
    from shapeloom.more_queries import _FORMATS

    for f, data in _FORMATS.items():
        folder = tmp_path / f.replace("/", "-")
        folder.mkdir()
        (folder / "a").write_text(data)
        got = {(Node(*r["s"]), r["p"], Node(*r["o"])) for r in rdf.from_path(spark, str(folder), f).collect()}
        assert got == set(rdf.parse(data, f)), f
    (tmp_path / "two").mkdir()
    for x in "ab":
        (tmp_path / "two" / x).write_text("@prefix : <http://e/> . _:n :p 1 .")
    assert rdf.from_path(spark, str(tmp_path / "two")).count() == 2
    with pytest.raises(ValueError):
        rdf.from_path(spark, str(tmp_path / "two"), "nothing")


def test_tables_keep_fractions_and_are_sets(spark, tmp_path):
    """Instants differ by their fractions; tables whose keys repeat still give sets of triples."""
    from shapeloom.sources.tables import Tables

    rows = [(1, "2024-01-01 00:00:00.1"), (1, "2024-01-01 00:00:00.9"), (1, "2024-01-01 00:00:00.9"), (2, "2024-01-01 00:00:05"), (3, "2024-01-01 00:00:10.250")]
    spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp) ts").write.parquet(f"{tmp_path}/events.parquet")
    graph = Tables(spark, str(tmp_path)).graph("events", "events.ts")
    got = sorted((r["s"]["lex"], r["o"]["lex"]) for r in graph.collect())
    assert got == sorted([("urn:t/events/1", "2024-01-01T00:00:00.1"), ("urn:t/events/1", "2024-01-01T00:00:00.9"), ("urn:t/events/2", "2024-01-01T00:00:05"), ("urn:t/events/3", "2024-01-01T00:00:10.25"), *((f"urn:t/events/{i}", "urn:c/events") for i in (1, 2, 3))])
    assert Tables(spark, str(tmp_path), unique=True).graph("events.ts").count() == 5


def test_graphs_are_dealt_out_in_small_pieces(spark, tmp_path, monkeypatch):
    """A graph's plans merge partitions to a few MB and have more of them for larger tables; the caller's settings stay."""
    from shapeloom import shared
    from shapeloom.sources.tables import Tables

    lines = [(k, k % 3, f"{k}") for k in range(100)] * 2 + [(None, 1, "x"), (1, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(shared, "FILE_A_PART", 100, raising=False)
    of = lambda s: [s.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "adaptive.advisoryPartitionSizeInBytes", "files.maxPartitionBytes")]
    before = of(spark)
    holds = Tables(spark, str(tmp_path)).links("lineitem", "l_orderkey", "l_partkey", "urn:p/holds")
    got = of(holds.sparkSession)
    assert int(got[0]) > 8 and [int(x.rstrip("b")) for x in got[1:]] == [shared.DEALT, shared.READ] and of(spark) == before
    assert {(r["s"]["lex"], r["o"]["lex"]) for r in holds.collect()} == {(f"urn:t/orders/{k}", f"urn:t/part/{k % 3}") for k in range(100)} and holds.count() == 100
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    assert shared.fine(own).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16k"


def test_inference_does_not_deal_out_by_predicate(spark):
    """Rules about predicates go to every task; otherwise one task would get all arcs of a predicate."""
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    g = rdf.from_string(own, P + "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :A rdfs:subClassOf :B . :p rdfs:subPropertyOf :q . :x :p :y . :q rdfs:range :A .")
    plan = rdf.infer(g, "RDFS")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [p#" in plan and "SortMergeJoin [p#" not in plan


HARD = [
    P + ':a :p """x .\n"y". ""\n\\""" .\n""" ; :q \'\'\'.\n\' .\n\'\'\' . # "\n:b :p 5.\n:c :p 1.5 , :x\\. , <http://e/#.> .',
    P + '_:x :p [ :q 1 ; :r (\n:a .5e1 ) ;\n:s "a # \\" ." ] .\n_:x :p _:y .\n[ :p 3\n] .\nPREFIX : <http://f/>\n:a :p "\'" , \'"\' .\r\n:a :p """1\r\n2""".\n<http://e/a> <http://e/p> _:x .',
    P + ':g {\n:a :p 1 .\n:a :q """}\n.""" .\n}\n{ :b :p 2 }\nGRAPH :h\n{ :c :p 3 .\n}',
    "", "# only a note",
]


@pytest.mark.parametrize("data", HARD)
def test_turtle_by_lines(data):
    """Whatever the parts, lines give what the whole text gives."""
    want = set(turtle.parse(data, "http://b/", "s"))
    for least in (0, 30, 1 << 16):
        parts = list(turtle.stream(iter(data.split("\n")), "http://b/", "s", least))
        assert {t for ts in parts for t in ts} == want
        if least == 0 and data.count("\n") > 2:
            assert len(parts) > 2
    with pytest.raises(SyntaxError):
        list(turtle.stream([P, ":a :p", "1"], least=0))


def test_turtle_files_pass_by_statements(spark, tmp_path):
    """No task parses a file's text as a whole, also where it is read in pieces; prefixes and blank nodes go on from piece to piece."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    own.conf.set("spark.sql.files.openCostInBytes", "1")
    texts = {x: P + "".join(f':{x}{i} :p """line\n. {i}""" , _:n ;\n  :q {i} .\n' for i in range(300)) for x in "ab"}
    for x, data in texts.items():
        (tmp_path / x).write_text(data)
    got = rdf.from_path(own, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" in plan, "files were held whole"
    assert got.count() == 1800 and got.filter("o.kind = 1").select("o.lex").distinct().count() == 2
    rows = {(r["s"]["lex"], r["p"], r["o"]["lex"]) for r in got.filter("o.kind = 2").collect()}
    assert rows == {(s.lex, p, o.lex) for data in texts.values() for s, p, o in turtle.parse(data) if o.kind == 2}
