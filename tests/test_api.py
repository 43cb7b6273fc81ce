"""Facade, conversions, inference, answer-set programs, graph export, SPARQL, streams and the command line."""

import pytest
from pyspark.sql import functions as F

from shapeloom import __main__ as cli
from shapeloom import api
from shapeloom.operators import asp, convert, infer, shacl, shapemap, shex, sparql, viz
from shapeloom.plans import shapes as S
from shapeloom.plans import slang
from shapeloom.sources import rdf
from shapeloom.sources.terms import SH, XSD, constant, iri
from shapeloom.streaming import nodes as streaming

TTL = "@prefix : <http://e/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
PRE = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
DATA = TTL + ":a :p 1 ; :q :b . :b :p 'x' ."


def test_facade(spark):
    r = api.validate(spark, DATA, PRE + ":S { :p xsd:integer }", shape_map="<http://e/a>@<http://e/S>")
    assert r.valid and r.message == "Valid"
    r = api.validate(spark, DATA, PRE + ":S { :p xsd:integer }", shape_map="<http://e/b>@<http://e/S>, <http://e/a>@!<http://e/S>")
    assert not r.valid and r.result_map.count() == 2 and '"valid": false' in r.show("json")
    r = api.validate(spark, DATA, TTL + ":S sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:datatype xsd:integer ] .", schema_format="turtle", engine="shacl", trigger="TargetDecls")
    assert not r.valid and r.violations.count() == 1 and "violations: 1" in r.message
    assert api.validate(spark, DATA, TTL + ":S a sh:NodeShape .", schema_format="turtle", engine="shacl-tq", trigger="ShapeMap").errors
    assert api.validate(spark, DATA + " :S sh:targetNode :b .", PRE + ":S { :p xsd:integer }", trigger="TargetDecls").valid is False
    assert api.validate(spark, DATA, PRE + "start = { :p . }", trigger="NodeStart", node="<http://e/a>").valid
    with pytest.raises(ValueError):
        api.lookup("none")


def test_formats_and_info(spark):
    s = api.schema(PRE + ":S { :p @:T* } :T { }")
    for f in ("ShExC", "ShExJ"):
        assert api.schema(s.serialize(f), f).shapes == s.shapes
    assert api.schema(s.serialize("Turtle"), "turtle").shapes == s.shapes
    assert s.info()["wellFormed"] and s.shapes == ["http://e/S", "http://e/T"]
    k = api.schema(s.convert("SHACL"), "turtle", "SHACL")
    assert set(k.shapes) >= {"<http://e/S>", "<http://e/T>"} and "http://e/S" in k.convert("ShEx")
    own = api.schema_from_graph(rdf.from_string(spark, DATA + " :S a sh:NodeShape ; sh:targetNode :a ; sh:nodeKind sh:Literal ."), "SHACL")
    assert own.shapes == ["<http://e/S>"]


CONVERT = [":S { :p xsd:integer ; :q IRI* }", ":S CLOSED { :p [1 2]? }", ":S EXTRA :p { :p [1] ; :r .+ }", ":S { :p MININCLUSIVE 2 LENGTH 1 } OR NOT { :q . }", ":S { :p @:T? } :T { :r [ :x~ 'a' ] }", ":S { ^:q IRI }"]


@pytest.mark.parametrize("text", CONVERT)
def test_shex_to_shacl_agrees(spark, text):
    g = rdf.from_string(spark, TTL + ":a :p 1 ; :q :b . :b :p 5, 1 ; :r 'a' . :c :p :b . :d :q :a ; :r 1 . :e :p 'z' ; :zz 1 . :f :r :xyz .")
    nodes = [iri(f"http://e/{x}") for x in "abcdef"]
    schema = shex.load(PRE + text)
    found = [shapemap.Association(n, "http://e/S") for n in nodes]
    want = {r["node"] for r in shapemap.results(shex.Validator(g, schema).validate(shapemap.fix(g, found).select("node", "shape"))).filter("status <> 'conformant'").collect()}
    shapes = S.read(convert.shex_to_shacl(schema, found))
    got = {r["focus"] for r in shacl.Validator(g, shapes).validate(only=[iri("http://e/S")]).flat().collect()}
    assert got == want
    back, _ = convert.shacl_to_shex(shapes)
    again = {r["node"] for r in shapemap.results(shex.Validator(g, shex.Schema(back)).validate(shapemap.fix(g, found).select("node", "shape"))).filter("status <> 'conformant'").collect()}
    assert again == want


@pytest.mark.parametrize("text", [":S { :p . | :q . }", ":S { (:p . ; :q .){2} }", ":S { :p . ; :p . }", ":S { :p TOTALDIGITS 2 }", ":S { :p [ :x~ - :xy ] }", ":S { :p . %:a{ %} }"])
def test_shex_to_shacl_refuses(text):
    with pytest.raises(convert.NotSupported):
        convert.shex_to_shacl(shex.load(PRE + text))


def test_targets_to_map():
    shapes = shacl.shapes_of(TTL + ":S sh:targetNode :a ; sh:targetClass :C ; sh:targetSubjectsOf :p ; sh:targetObjectsOf :q .")
    assert len(convert.target_map(shapes)) == 4 and all("@<http://e/S>" in shapemap.show(a) for a in convert.target_map(shapes))
    with pytest.raises(convert.NotSupported):
        convert.shacl_to_shex(shacl.shapes_of(TTL + ":S sh:targetNode :a ; sh:property [ sh:path (:p :q) ] ."))


def test_inference(spark):
    g = rdf.from_string(spark, TTL + ":a :p 1, 2 ; :l 'x'@en ; :m :b ; :k 'y' . :b :p 3 ; :l 'y'@en ; :m _:z ; :k 4 . :p <http://www.w3.org/2000/01/rdf-schema#label> 'pee'@en .")
    nodes = spark.range(1).select(constant(iri("http://e/a")).alias("node")).unionByName(spark.range(1).select(constant(iri("http://e/b")).alias("node")))
    got = {r["p"][-1]: (r["constraint"], r["datatype"], r["lang"], r["min"], r["max"], r["max_number"]) for r in infer.predicates(g, nodes).collect()}
    assert got == {"p": ("datatype", XSD + "integer", "", 0, -1, 2), "l": ("lang", "", "en", 1, 1, 1), "m": ("any", "", "", 1, 1, 1), "k": ("literal", "", "", 1, 1, 1)}
    body, followed = infer.infer(g, nodes, "http://e/S", infer.Options(label=True, support=True, follow={"http://e/m": "http://e/M"}, max_follow=2, prefixes={"": "http://e/"}))
    assert followed == [("http://e/m", "http://e/M")] and [s["id"] for s in body["shapes"]] == ["http://e/S", "http://e/M"] and "pee" in str(body)
    assert shex.Validator(g, shex.Schema(body)).validate(nodes.withColumn("shape", F.lit("http://e/S"))).filter("not conforms").count() == 0


def test_asp(spark):
    g = rdf.from_string(spark, DATA + " :far :p 1 .")
    schema = shex.load(PRE + ":S CLOSED { :p xsd:integer ; :q @:S* }")
    facts, text = asp.program(g, slang.lower(schema), [(iri("http://e/a"), "http://e/S")])
    lines = {r[0] for r in facts.collect()}
    assert 'iri("http://e/b").' in lines and not any("far" in x for x in lines)
    assert 'asked("http://e/a", "http://e/S").' in text and 'P != "http://e/p", P != "http://e/q"' in text and "#count" in text


def test_graph_export(spark):
    g = rdf.from_string(spark, DATA + " :a a :C .")
    dot = [r["value"] for r in viz.dot(g, {"": "http://e/"}).orderBy("part", "value").collect()]
    assert dot[0] == "digraph {" and dot[-1] == "}" and any('label="a"' in x for x in dot) and any('label=":a"' in x for x in dot)
    assert viz.to_json(g).count() == 5 + 4
    assert [r["id"] for r in viz.nodes(g).orderBy(F.length("id"), "id").collect()] == [f"N{i}" for i in range(5)]


def test_sparql(spark):
    g = rdf.from_string(spark, TTL + ":a :p 1, 2 ; :q 'x'@en . :b :p 3 . :c :r :a .")
    run = lambda q: sorted((tuple(x["lex"] if x else None for x in r) for r in sparql.select(g, "PREFIX : <http://e/> " + q).collect()), key=str)
    e = "http://e/"
    assert run("SELECT ?x WHERE { ?x :p ?v . FILTER (?v >= 2 && ?v != 3) }") == [(e + "a",)]
    assert run("SELECT ?x ?l WHERE { ?x :p ?v OPTIONAL { ?x :q ?l } }") == [(e + "a", "x"), (e + "a", "x"), (e + "b", None)]
    assert run("SELECT ?x WHERE { ?x :p ?v . FILTER NOT EXISTS { ?x :q ?l } }") == [(e + "b",)]
    assert run("SELECT ?x WHERE { { ?x :q ?v } UNION { ?x :r ?v } }") == [(e + "a",), (e + "c",)]
    assert run("SELECT ?y WHERE { ?x :r/:q ?v . BIND (CONCAT(str(?v), '!') AS ?y) }") == [("x!",)]
    for bad in ("SELECT ?x WHERE { SERVICE <x> { ?x :p ?y } }", "SELECT ?x WHERE { GRAPH :g { ?x :p ?y } }", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?x :p ?y }", "SELECT ?x WHERE { VALUES ?x { UNDEF } ?x :p ?y }", "CONSTRUCT { } WHERE { }"):
        with pytest.raises(sparql.NotSupported):
            run(bad)
    assert run("SELECT ?x WHERE { ?x :p ?v MINUS { ?x :q ?l } }") == [(e + "b",)]
    assert run("SELECT ?x ?v WHERE { VALUES (?x ?v) { (:a 2) (:b 3) (:c 1) } ?x :p ?v }") == [(e + "a", "2"), (e + "b", "3")]
    assert run("SELECT ?x ?n WHERE { ?x :p ?any . { SELECT ?x (COUNT(DISTINCT ?v) AS ?n) WHERE { ?x :p ?v } GROUP BY ?x } FILTER (?n > 1) }") == [(e + "a", "2")] * 2
    assert run("SELECT (COUNT(*) AS ?n) WHERE { ?x :p ?v }") == [("3",)] and run("SELECT DISTINCT ?x WHERE { ?x :p ?v }") == [(e + "a",), (e + "b",)]
    assert run("SELECT ?x WHERE { ?x :r ?y FILTER EXISTS { :b :p 3 } }") == [(e + "c",)] and run("SELECT ?x WHERE { ?x :r ?y FILTER NOT EXISTS { :b :p 3 } }") == []
    for inner in ("VALUES ?x { :a }", "MINUS { $this :q ?z }", "{ SELECT $this WHERE { $this :p ?y } }"):
        with pytest.raises(sparql.NotSupported):
            sparql.Query("PREFIX : <http://e/> SELECT $this WHERE { $this :p ?v . " + inner + " }", bound=("this",))
    with pytest.raises(sparql.NotSupported):
        sparql.Query("SELECT $this WHERE { BIND (1 AS $this) }", bound=("this",))
    test = sparql.ask_column("ASK { FILTER (isLiteral($value) && langMatches(lang($value), $lang)) }")
    rows = g.filter(test(value=F.col("o"), lang=constant(rdf.literal("en"))))
    assert rows.count() == 1


def test_streaming(spark, tmp_path):
    g = rdf.from_string(spark, TTL + ":a :p 1, 20 . :b :p 3 .").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    g.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(g.schema).parquet(f"{tmp_path}/in")
    shape = shacl.shapes_of(TTL + ":S a sh:NodeShape ; sh:maxInclusive 10 .")[iri("http://e/S")]
    for i, rows in enumerate((streaming.leaves(stream, "http://e/p", shape), streaming.cardinality(stream, "http://e/p", "ts", "1 hour", "1 hour", high=1))):
        q = rows.writeStream.format("memory").queryName(f"s{i}").outputMode("append" if not i else "update").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(f"s{i}").collect()
        assert [r["focus"] for r in got] == ["<http://e/a>"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.ttl").write_text(DATA)
    (tmp_path / "s.shex").write_text(PRE + ":S { :p xsd:integer }")
    (tmp_path / "m.sm").write_text("<http://e/b>@<http://e/S>")
    args = ["--data", str(tmp_path / "d.ttl"), "--schema", str(tmp_path / "s.shex"), "--shapeMap", str(tmp_path / "m.sm")]
    assert cli.main([*args, "--showSchema", "--showClingo", "--time", "--dot", f"{tmp_path}/dot", "--outResult", f"{tmp_path}/out"], spark) == 1
    said = capsys.readouterr().out
    assert "Not valid" in said and "<http://e/S> {" in said and "asked(" in said and "Elapsed" in said
    assert cli.main(["--data", str(tmp_path / "d.ttl"), "--infer", "http://e/N", "--node", "<http://e/a>"], spark) == 0
    assert "<http://e/N>" in capsys.readouterr().out
    lines = iter([":help", ":load x", "?", ":quit"])
    cli.shell(lambda _: next(lines))
    assert "load x" in capsys.readouterr().out
    assert SH.endswith("#")


def test_node_numbers_do_not_depend_on_merged_partitions(spark):
    """Numbers are 0 to n - 1 in the order of the text where adaptive execution merges partitions in more than one way."""
    from pyspark.sql import functions as F

    from shapeloom.operators import viz
    from shapeloom.sources.terms import IRI, node

    own = spark.newSession()
    for k, v in (("shuffle.partitions", "8"), ("adaptive.advisoryPartitionSizeInBytes", "100k"), ("adaptive.coalescePartitions.minPartitionSize", "1")):
        own.conf.set(f"spark.sql.{k}", v)
    x = lambda ns, c: node(IRI, F.concat(F.lit(ns), c.cast("string")))
    graph = own.range(20_000).select(x("urn:x/", F.sha1(F.col("id").cast("string"))).alias("s"), F.lit("urn:p").alias("p"), x("urn:y/", F.col("id") % 7).alias("o"))
    numbered = viz.nodes(graph)
    assert [r["id"] for r in sorted(numbered.collect(), key=lambda r: r["node"]["lex"])] == [f"N{i}" for i in range(20_007)]
    assert viz.edges(graph, numbered).count() == 20_000
