"""SHACL validation: authored fixtures for every constraint component, paths, targets and reports."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shapeloom.operators import shacl
from shapeloom.plans import shapes as shapes_
from shapeloom.plans.shapes import ShapeError
from shapeloom.sources import rdf
from shapeloom.sources.terms import SH, TYPE, Node, iri, literal

P = """@prefix : <http://e/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
"""


def check(spark, data, shapes):
    """Counter of (focus, component, value)."""
    rows = shacl.validate(rdf.from_string(spark, P + data), P + shapes).flat().collect()
    short = lambda x: x.replace("http://e/", ":").replace("<", "").replace(">", "").split("^^")[0]
    return Counter((short(r["focus"]), short(r["component"]).removeprefix(SH).removesuffix("ConstraintComponent"), short(r["value"])) for r in rows)


CASES = {
    "bnodes fail lengths and patterns": ("_:b :p 1 .", ":S sh:targetSubjectsOf :p ; sh:minLength 0 ; sh:pattern '.*' .", [("_:b", "MinLength", "_:b"), ("_:b", "Pattern", "_:b")]),
    "numbers out of a type's range": (':a :p "many"^^xsd:short , "70000"^^xsd:short , 12 , "-3"^^xsd:short .', ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:datatype xsd:short ] .", [(":a", "Datatype", '"many"'), (":a", "Datatype", '"70000"'), (":a", "Datatype", '"12"')]),
    "incomparable values": (':a :p 4, 4.5, "x", :i .', ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:minExclusive 4 ] .", [(":a", "MinExclusive", '"4"'), (":a", "MinExclusive", '"x"'), (":a", "MinExclusive", ":i")]),
    "zones do not mix": (':a :p "2002-10-10T12:00:00"^^xsd:dateTime , "2002-10-10T12:00:01-05:00"^^xsd:dateTime .', ':S sh:targetNode :a ; sh:property [ sh:path :p ; sh:minInclusive "2002-10-10T12:00:00-05:00"^^xsd:dateTime ] .', [(":a", "MinInclusive", '"2002-10-10T12:00:00"')]),
    "in and hasValue by term": (":a :p 1 . :b :p 01 .", ":S sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:in (1) ; sh:hasValue 1 ] .", [(":b", "In", '"01"'), (":b", "HasValue", "")]),
    "languages": (':a :p "x"@en-GB, "y"@de, "z", :i .', ':S sh:targetNode :a ; sh:property [ sh:path :p ; sh:languageIn ("EN") ] .', [(":a", "LanguageIn", '"y"@de'), (":a", "LanguageIn", '"z"'), (":a", "LanguageIn", ":i")]),
    "unique languages": (':a :p "x"@en, "y"@EN, "z"@de, "u"@de, "v" .', ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:uniqueLang true ] .", [(":a", "UniqueLang", ""), (":a", "UniqueLang", "")]),
    "a sequence's values are a set": (":a :p :b, :c . :b :q 1 . :c :q 1 .", ":S sh:targetNode :a ; sh:property [ sh:path (:p :q) ; sh:maxCount 1 ] .", []),
    "nested properties are a bag": (":a :p :x . :b :p :x .", ":S sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; sh:property [ sh:path :q ; sh:minCount 1 ] ] .", [(":x", "MinCount", "")] * 2),
    "less than is a bag": (":a :p 1, 5 ; :q 2, 1 .", ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:lessThan :q ] .", [(":a", "LessThan", '"1"'), (":a", "LessThan", '"5"'), (":a", "LessThan", '"5"')]),
    "equals both ways": (":a :p 1, 2 ; :q 2, 3 .", ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:equals :q ] .", [(":a", "Equals", '"1"'), (":a", "Equals", '"3"')]),
    "disjoint on the node": (":a :p :a, :b .", ":S sh:targetNode :a ; sh:disjoint :p .", [(":a", "Disjoint", ":a")]),
    "xone counts a shape twice": (":a :p 1 .", ":S sh:targetNode :a ; sh:xone (:T :T) . :T sh:property [ sh:path :p ; sh:minCount 1 ] .", [(":a", "Xone", ":a")]),
    "sibling qualified shapes": (":a :p :t, :f, :f2 . :t a :T . :f a :F . :f2 a :F, :T .", ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:qualifiedValueShape [ sh:class :T ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 2 ] , [ sh:path :p ; sh:qualifiedValueShape [ sh:class :F ] ; sh:qualifiedMaxCount 2 ] .", [(":a", "QualifiedMinCount", "")]),
    "deactivated": (":a :p 1 .", ":S sh:targetNode :a ; sh:deactivated true ; sh:property [ sh:path :p ; sh:maxCount 0 ] .", []),
    "closed": (":a :p 1 ; :q 2 ; a :C .", ":S sh:targetNode :a ; sh:closed true ; sh:ignoredProperties (rdf:type) ; sh:property [ sh:path :p ] .", [(":a", "Closed", '"2"')]),
    "implicit class": (":C a rdfs:Class, sh:NodeShape . :D rdfs:subClassOf :C . :d a :D .", ":C a rdfs:Class, sh:NodeShape ; sh:property [ sh:path :p ; sh:minCount 1 ] .", [(":d", "MinCount", "")]),
    "literal and absent targets": ("", ':S sh:targetNode "x", :none ; sh:nodeKind sh:IRI ; sh:property [ sh:path :p ; sh:minCount 1 ] .', [('"x"', "NodeKind", '"x"'), ('"x"', "MinCount", ""), (":none", "MinCount", "")]),
    "closures end on cycles": (":a :n :b . :b :n :c . :c :n :a .", ":S sh:targetNode :a ; sh:property [ sh:path [ sh:oneOrMorePath :n ] ; sh:maxCount 2 ; sh:hasValue :a ] .", [(":a", "MaxCount", "")]),
    "inverse and alternatives": (":a :p :b . :c :q :b .", ":S sh:targetNode :b ; sh:property [ sh:path [ sh:alternativePath ([ sh:inversePath :p ] [ sh:inversePath :q ]) ] ; sh:maxCount 1 ] .", [(":b", "MaxCount", "")]),
    "a list wins over inversePath": (":a :p :b . :b :q 1 .", ":S sh:targetNode :a ; sh:property [ sh:path _:x ; sh:minCount 2 ] . _:x rdf:first :p ; rdf:rest (:q) ; sh:inversePath :p .", [(":a", "MinCount", "")]),
    "and, or, not over joins": (":a :p 1 . :b :q 1 .", ":S sh:targetNode :a, :b ; sh:and (:T) ; sh:not :U . :T sh:property [ sh:path :p ; sh:minCount 1 ] . :U sh:property [ sh:path :q ; sh:maxCount 0 ] .", [(":b", "And", ":b"), (":a", "Not", ":a")]),
    "classes through subclasses": (":x a :D . :D rdfs:subClassOf :C . :a :p :x, :y, 1 .", ":S sh:targetNode :a ; sh:property [ sh:path :p ; sh:class :C ] .", [(":a", "Class", ":y"), (":a", "Class", '"1"')]),
    "sparql": (':a :p 3, 8 ; :q 5 . :b :p 1 .', ''':S sh:targetSubjectsOf :p ; sh:sparql [ sh:select "SELECT $this ?value WHERE { $this <http://e/p> ?value ; <http://e/q> ?most . FILTER (?value > ?most) }" ] .''', [(":a", "SPARQL", '"8"')]),
    "components with an ASK validator": (':a :p "x"@en, "y"@de .', """:K a sh:ConstraintComponent ; sh:parameter [ sh:path :language ] , [ sh:path :other ; sh:optional true ] ; sh:validator [ sh:ask "ASK { FILTER (isLiteral($value) && langMatches(lang($value), $language)) }" ] .
:S sh:targetNode :a ; sh:property [ sh:path :p ; :language "en" ] ; sh:property [ sh:path :p ] .""", [(":a", ":K", '"y"@de')]),
    "components with a SELECT validator": (":a :p 1, 7 . :b :p 2 .", """:K a sh:ConstraintComponent ; sh:parameter [ sh:path :most ] ; sh:propertyValidator [ sh:select "SELECT $this ?value WHERE { $this $PATH ?value . FILTER (?value > $most) }" ] .
:S sh:targetSubjectsOf :p ; sh:property [ sh:path :p ; :most 5 ] .""", [(":a", ":K", '"7"')]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    data, shapes, want = CASES[name]
    assert check(spark, data, shapes) == Counter(want)


def test_severity_message_and_report(spark):
    r = shacl.validate(rdf.from_string(spark, P + ":a :p 1 ."), P + ':S sh:targetNode :a ; sh:severity sh:Warning ; sh:message "no" ; sh:nodeKind sh:Literal .')
    row = r.flat().first()
    assert not r.conforms() and row["severity"] == SH + "Warning" and row["message"] == "no"
    lines = {x[0] for x in rdf.lines(r.report()).collect()}
    assert any("#conforms" in x and '"false"' in x for x in lines) and any("#resultMessage" in x for x in lines)


@pytest.mark.parametrize("path", ["[ sh:inversePath :p ]", "(:p :q)", "[ sh:alternativePath (:p [ sh:inversePath :q ]) ]", "(:p [ sh:zeroOrMorePath (:q :p) ])", "[ sh:oneOrMorePath :q ]", "[ sh:zeroOrOnePath [ sh:alternativePath (:p :q) ] ]"])
def test_paths_in_the_report(spark, path):
    """A result's path, read back from the report, is the shape's; every result has its own."""
    shapes = shacl.shapes_of(P + f":S sh:targetNode :a, :b ; sh:property [ sh:path {path} ; sh:minCount 9 ] .")
    rows = shacl.Validator(rdf.from_string(spark, P + ":a :p 1 ."), shapes).validate().report().collect()
    triples = [(Node(*r["s"]), r["p"], Node(*r["o"])) for r in rows]
    heads = [o for _, p, o in triples if p == SH + "resultPath"]
    own = [x for i, h in enumerate(heads) for x in ((iri(f"http://e/T{i}"), SH + "path", h), (iri(f"http://e/T{i}"), TYPE, iri(SH + "PropertyShape")))]
    read = shapes_.read([*(x for x in triples if x[1] != TYPE), *own])
    want = next(s.path for s in shapes.values() if s.path is not None)
    assert len(set(heads)) == 2 and [read[iri(f"http://e/T{i}")].path for i in range(2)] == [want] * 2


@pytest.mark.parametrize("bad", [":S sh:targetNode :a ; sh:node :S .", ":S sh:targetNode :a ; sh:minCount 1 .", ":S sh:targetNode :a ; sh:property [ sh:path (:p) ] ."])
def test_ill_formed(spark, bad):
    with pytest.raises(ShapeError):
        shacl.validate(rdf.from_string(spark, P + ":a :p 1 ."), P + bad)


def test_unused_ill_formed_path(spark):
    assert check(spark, ":a :p 1 .", ":S sh:targetNode :a ; sh:property [ sh:path :p ] . _:x sh:zeroOrMorePath 5 .") == Counter()


def test_imports_once():
    texts = {"http://e/b": P + "<http://e/b> owl:imports <http://e/b> . :T a sh:NodeShape .".replace(":T", "<http://e/T>")}
    shapes = shacl.shapes_of(P + "<http://e/a> owl:imports <http://e/b> . <http://e/S> a sh:NodeShape .", fetch=texts.__getitem__)
    assert {iri("http://e/S"), iri("http://e/T")} <= set(shapes)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("pq"), st.integers(0, 3)), max_size=12))
def test_laws(spark, arcs):
    """not(not(S)) is S, De Morgan, and xone implies or; repeated triples change nothing."""
    triples = [(iri(f"http://e/{s}"), f"http://e/{p}", literal(str(o), "http://www.w3.org/2001/XMLSchema#integer")) for s, p, o in arcs]
    g = rdf.frame(spark, triples + triples)
    a, b = ":A sh:property [ sh:path :p ; sh:minCount 2 ] .", ":B sh:property [ sh:path :q ; sh:maxInclusive 1 ] ."
    t = "sh:targetNode :a, :b, :c ;"
    bad = lambda s: {r["focus"] for r in shacl.validate(g, P + a + b + f":S {t} {s} .").flat().collect()}
    assert bad("sh:node :A") == bad("sh:not [ sh:not :A ]")
    assert bad("sh:or (:A :B)") == bad("sh:not [ sh:and ([ sh:not :A ] [ sh:not :B ]) ]")
    assert bad("sh:or (:A :B)") <= bad("sh:xone (:A :B)")
    for x in "abc":
        n = len({o for s, p, o in arcs if (s, p) == (x, "p")})
        assert (f"<http://e/{x}>" in bad("sh:node :A")) == (n < 2)
