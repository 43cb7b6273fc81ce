"""More registered queries: node constraints of ShEx, schema-level features, custom components, inference, conversion, formats, export and streams.

They register in the same tables as those of `queries`, whose helpers they use. What a query does on the driver
(parsing, checking, linting and converting schemas) it returns as a small table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, shared
from .operators import asp, convert, infer, lint, shacl, shapemap, shex, viz
from .operators import sparql as sq
from .plans import shexc, slang
from .plans import paths as P
from .queries import PREFIXES, QUERIES, SHEX, SQL, _iri, _ontology, _shex, _status, _titles, _violations, query
from .sources import rdf
from .sources.tables import Tables, prop, row
from .sources.terms import BNODE, IRI, LANGSTRING, LITERAL, RDFS, SH, XSD, constant, iri, node, text
from .streaming import nodes as streaming

SIZES, SIZED = ["part.p_size"], "{FOCUS p:p_size _}@:S"
NAMES = {"c": "urn:c/", "p": "urn:p/", "t": "urn:t/", "": "urn:shape/"}


def _values(*rows) -> str:
    """SQL rows of constants."""
    show = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _owners(t: Tables) -> DataFrame:
    """An arc from each customer to a blank node, an IRI or a string, by its key."""
    k = F.col("c_custkey")
    x = F.concat(F.lit("o"), k.cast("string"))
    owner = F.when(k % 3 == 0, node(BNODE, x)).when(k % 3 == 1, node(IRI, F.concat(F.lit("urn:o/"), x))).otherwise(node(LITERAL, x, XSD + "string"))
    return t.table("customer").select(row("customer", k).alias("s"), F.lit(prop("owner")).alias("p"), owner.alias("o"))


def _doc_titles(t: Tables) -> DataFrame:
    """An arc from each document to a title in its language (null: a plain string)."""
    lang = F.coalesce("lang", F.lit(""))
    o = node(LITERAL, F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.when(lang == "", XSD + "string").otherwise(LANGSTRING), lang)
    return t.table("documents").select(row("documents", F.col("doc_id")).alias("s"), F.lit(prop("title")).alias("p"), o.alias("o"))


def _decimals(t: Tables) -> DataFrame:
    """An arc from each part to a decimal with one digit after the point, or two where the size is odd."""
    lex = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".5").otherwise(".25"))
    return t.table("part").select(row("part", F.col("p_partkey")).alias("s"), F.lit(prop("price")).alias("p"), node(LITERAL, lex, XSD + "decimal").alias("o"))


# sources


@query(f"SELECT {_iri('events', 'event_id')} AS focus, 'MinInclusive' AS component FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00.5'")
def event_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with fractions of a second are compared as they are."""
    shape = 'c:S sh:targetSubjectsOf p:ts ; sh:property [ sh:path p:ts ; sh:minInclusive "2024-01-15T12:00:00.5"^^xsd:dateTime ; sh:maxCount 1 ] .'
    out = shacl.validate(Tables(spark, sf_dir).graph("events.ts"), PREFIXES + shape).flat()
    return out.select("focus", F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component"))


@query("SELECT rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') AS lex, count(*) AS n FROM events GROUP BY 1")
def event_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).graph("events.ts").distinct().groupBy(F.col("o")["lex"].alias("lex")).agg(F.count("*").alias("n"))


_violations("event_order", lambda t: [t.column("events", "ts"), t.column("events", "ts").withColumn("p", F.lit(prop("seen"))).withColumn("s", F.col("s"))], "c:S sh:targetSubjectsOf p:ts ; sh:property [ sh:path p:ts ; sh:equals p:seen ; sh:lessThan p:seen ] .", f"SELECT {_iri('events', 'event_id')} AS focus, 'LessThan' AS component FROM events")

_FORMATS = {
    "Turtle": "@prefix e: <urn:e/> . e:a e:p e:b , 5 ; e:q 'x'@en .",
    "TriG": "@prefix e: <urn:e/> . { e:a e:p e:b , 5 . } e:g { e:a e:q 'x'@en . }",
    "N-Triples": f'<urn:e/a> <urn:e/p> <urn:e/b> .\n<urn:e/a> <urn:e/p> "5"^^<{XSD}integer> .\n<urn:e/a> <urn:e/q> "x"@en .',
    "N-Quads": f'<urn:e/a> <urn:e/p> <urn:e/b> <urn:e/g> .\n<urn:e/a> <urn:e/p> "5"^^<{XSD}integer> .\n<urn:e/a> <urn:e/q> "x"@en .',
    "RDF/JSON": json.dumps({"urn:e/a": {"urn:e/p": [{"type": "uri", "value": "urn:e/b"}, {"type": "literal", "value": "5", "datatype": XSD + "integer"}], "urn:e/q": [{"type": "literal", "value": "x", "lang": "en"}]}}),
    "RDF/XML": f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e/"><rdf:Description rdf:about="urn:e/a"><e:p rdf:resource="urn:e/b"/><e:p rdf:datatype="{XSD}integer">5</e:p><e:q xml:lang="en">x</e:q></rdf:Description></rdf:RDF>',
    "JSON-LD": json.dumps({"@id": "urn:e/a", "urn:e/p": [{"@id": "urn:e/b"}, {"@value": "5", "@type": XSD + "integer"}], "urn:e/q": {"@value": "x", "@language": "en"}}),
}


@query("SELECT f AS format, line FROM (SELECT unnest(['Turtle', 'TriG', 'N-Triples', 'N-Quads', 'RDF/JSON', 'RDF/XML', 'JSON-LD']) AS f), (VALUES " + _values(("<urn:e/a> <urn:e/p> <urn:e/b> .",), (f'<urn:e/a> <urn:e/p> "5"^^<{XSD}integer> .',), ('<urn:e/a> <urn:e/q> "x"@en .',)) + ") AS t(line)")
def rdf_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph read from texts in every format."""
    out = None
    for f, data in _FORMATS.items():
        one = rdf.lines(rdf.from_string(spark, data, f)).select(F.lit(f).alias("format"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT '<urn:t/nation/' || n_nationkey || '> <urn:p/n_regionkey> <urn:t/region/' || n_regionkey || '> .' AS line FROM nation")
def nquads_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as N-Quads in the shared folder, and read back by its lines."""
    path = shared.path(spark, "nquads")
    rdf.write(Tables(spark, sf_dir).graph("nation.n_regionkey"), path, "N-Quads", "urn:g")
    return rdf.lines(rdf.from_path(spark, path, "N-Quads")).select(F.col("value").alias("line"))


@query("SELECT '<urn:t/orders/' || o_orderkey || '> <urn:p/o_custkey> <urn:t/customer/' || o_custkey || '> .' AS line FROM orders")
def turtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle files parsed on the executors, a task for each."""
    path, t = shared.path(spark, "turtle"), Tables(spark, sf_dir)
    files = max(6, t.table("orders").rdd.getNumPartitions())  # more files for larger tables, as one is the work of one task
    rdf.write(t.graph("orders.o_custkey").repartition(files), path, "Turtle")
    return rdf.lines(rdf.from_path(t.spark, path, "Turtle")).select(F.col("value").alias("line"))


@query("SELECT unnest(['url', 'endpoint']) AS source, '<urn:e/a> <urn:e/p> <urn:e/b> .' AS line")
def fetched_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL's and an endpoint's graph, by a fetch function of the caller."""
    line = "<urn:e/a> <urn:e/p> <urn:e/b> ."
    texts = {"urn:g": line, "urn:q?query=CONSTRUCT%20%7B%20%3Fs%20%3Fp%20%3Fo%20%7D%20WHERE%20%7B%20%3Fs%20%3Fp%20%3Fo%20%7D": line}
    a, b = rdf.from_url(spark, "urn:g", texts.__getitem__), rdf.from_endpoint(spark, "urn:q", texts.__getitem__)
    both = rdf.lines(a).withColumn("source", F.lit("url")).unionByName(rdf.lines(b).withColumn("source", F.lit("endpoint")))
    return both.select("source", F.col("value").alias("line"))


@query(f"SELECT {_iri('part', 'p_partkey')} AS focus, 'MaxInclusive' AS component FROM part WHERE p_size > 40 UNION ALL SELECT {_iri('part', 'p_partkey')}, 'MinInclusive' FROM part WHERE p_size < 5")
def shapes_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that owl:imports brings in, each text once."""
    owl = "http://www.w3.org/2002/07/owl#imports"
    more = {"urn:x/b": PREFIXES + f"<urn:x/b> <{owl}> <urn:x/a>, <urn:x/b> . c:T a sh:NodeShape ; sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:minInclusive 5 ] .", "urn:x/a": PREFIXES}
    shapes = shacl.shapes_of(PREFIXES + f"<urn:x/a> <{owl}> <urn:x/b> . c:S a sh:NodeShape ; sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:maxInclusive 40 ] .", fetch=more.__getitem__)
    out = shacl.Validator(Tables(spark, sf_dir).graph(*SIZES), shapes).validate().flat()
    return out.select("focus", F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component"))


@query(f"SELECT {_iri('part', 'p_partkey')} AS focus FROM part WHERE p_size > 40")
def schema_from_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that stand in the data graph itself."""
    own = rdf.from_string(spark, PREFIXES + "c:S a sh:NodeShape ; sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:maxInclusive 40 ] .")
    graph = Tables(spark, sf_dir).graph(*SIZES, own)
    return api.schema_from_graph(graph, "SHACL").validate(graph).violations.flat().select("focus")


# node constraints of ShEx

for _kind, _test in (("IRI", "c_custkey % 3 = 1"), ("BNODE", "c_custkey % 3 = 0"), ("LITERAL", "c_custkey % 3 = 2"), ("NONLITERAL", "c_custkey % 3 < 2")):
    _shex(f"shex_kind_{_kind.lower()}", lambda t: [_owners(t)], f":S {{ p:owner {_kind} }}", "{FOCUS p:owner _}@:S", _status("customer", "c_custkey", _test, "customer"))
_violations("blank_nodes", lambda t: [_owners(t)], "c:S sh:targetSubjectsOf p:owner ; sh:property [ sh:path p:owner ; sh:nodeKind sh:BlankNode ] .", f"SELECT {_iri('customer', 'c_custkey')} AS focus, 'NodeKind' AS component FROM customer WHERE c_custkey % 3 <> 0")
for _facet, _op in (("MININCLUSIVE", ">="), ("MINEXCLUSIVE", ">"), ("MAXINCLUSIVE", "<="), ("MAXEXCLUSIVE", "<")):
    _shex(f"shex_{_facet.lower()}", SIZES, f":S {{ p:p_size {_facet} 25 }}", SIZED, _status("part", "p_partkey", f"p_size {_op} 25", "part"))
for _facet, _op in (("LENGTH", "="), ("MINLENGTH", ">="), ("MAXLENGTH", "<=")):
    _shex(f"shex_{_facet.lower()}", ["part.p_name"], f":S {{ p:p_name LITERAL {_facet} 11 }}", "{FOCUS p:p_name _}@:S", _status("part", "p_partkey", f"length(p_name) {_op} 11", "part"))
_shex("shex_totaldigits", SIZES, ":S { p:p_size TOTALDIGITS 1 }", SIZED, _status("part", "p_partkey", "p_size < 10", "part"))
_shex("shex_fractiondigits", lambda t: [_decimals(t)], ":S { p:price FRACTIONDIGITS 1 }", "{FOCUS p:price _}@:S", _status("part", "p_partkey", "p_size % 2 = 0", "part"))
_shex("shex_pattern", ["part.p_brand"], ":S { p:p_brand /^brand.1[0-3]$/i }", "{FOCUS p:p_brand _}@:S", _status("part", "p_partkey", "regexp_matches(p_brand, '^Brand.1[0-3]$')", "part"))
_AT = "{FOCUS p:c_nationkey _}@:S"
_shex("shex_iri_stem", ["customer.c_nationkey"], ":S { p:c_nationkey [ <urn:t/nation/1>~ ] }", _AT, _status("customer", "c_custkey", "CAST(c_nationkey AS VARCHAR) LIKE '1%'", "customer"))
_shex("shex_iri_stem_minus", ["customer.c_nationkey"], ":S { p:c_nationkey [ <urn:t/nation/>~ - <urn:t/nation/1>~ - <urn:t/nation/3> ] }", _AT, _status("customer", "c_custkey", "CAST(c_nationkey AS VARCHAR) NOT LIKE '1%' AND c_nationkey <> 3", "customer"))
_shex("shex_wildcard_minus", ["customer.c_nationkey"], ":S { p:c_nationkey [ . - <urn:t/nation/2>~ - <urn:t/nation/7> ] }", _AT, _status("customer", "c_custkey", "CAST(c_nationkey AS VARCHAR) NOT LIKE '2%' AND c_nationkey <> 7", "customer"))
_SEG = "{FOCUS p:c_mktsegment _}@:S"
_shex("shex_literal_stem", ["customer.c_mktsegment"], ':S { p:c_mktsegment [ "M"~ "BUILDING" ] }', _SEG, _status("customer", "c_custkey", "c_mktsegment LIKE 'M%' OR c_mktsegment = 'BUILDING'", "customer"))
_shex("shex_literal_wildcard_minus", ["customer.c_mktsegment"], ':S { p:c_mktsegment [ . - "M"~ - "BUILDING" ] }', _SEG, _status("customer", "c_custkey", "NOT (c_mktsegment LIKE 'M%' OR c_mktsegment = 'BUILDING')", "customer"))
_TITLE = "{FOCUS p:title _}@:S"
_shex("shex_language", lambda t: [_doc_titles(t)], ":S { p:title [ @en @FR ] }", _TITLE, _status("documents", "doc_id", "coalesce(lang, '') IN ('en', 'fr')", "documents"))
_shex("shex_language_stem_minus", lambda t: [_doc_titles(t)], ":S { p:title [ @~ - @en - @de~ ] }", _TITLE, _status("documents", "doc_id", "coalesce(lang, '') NOT IN ('', 'en', 'de')", "documents"))
_violations("has_value_node", ["nation"], "c:S sh:targetClass c:nation ; sh:hasValue <urn:t/nation/3> .", f"SELECT {_iri('nation', 'n_nationkey')} AS focus, 'HasValue' AS component FROM nation WHERE n_nationkey <> 3")

# shapes and schemas

_xone = f"SELECT {_iri('part', 'p_partkey')} AS focus, 'Xone' AS component FROM part WHERE "
_violations("xone_repeated", SIZES, "c:S sh:targetSubjectsOf p:p_size ; sh:xone (c:T c:T c:U) . c:T sh:property [ sh:path p:p_size ; sh:minInclusive 20 ] . c:U sh:property [ sh:path p:p_size ; sh:minInclusive 10 ] .", _xone + "NOT (p_size BETWEEN 10 AND 19)")
_violations("deactivated", SIZES, "c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:deactivated true ; sh:maxCount 0 ], [ sh:path p:p_size ; sh:maxInclusive 40 ] . c:T sh:deactivated true ; sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:maxCount 0 ] .", f"SELECT {_iri('part', 'p_partkey')} AS focus, 'MaxInclusive' AS component FROM part WHERE p_size > 40")
_violations("path_list_over_inverse", ["customer.c_nationkey", "nation.n_regionkey"], "c:S sh:targetSubjectsOf p:c_nationkey ; sh:property [ sh:path _:x ; sh:in (<urn:t/region/1> <urn:t/region/2>) ] . _:x rdf:first p:c_nationkey ; rdf:rest (p:n_regionkey) ; sh:inversePath p:c_nationkey .", f"SELECT {_iri('customer', 'c_custkey')} AS focus, 'In' AS component, {_iri('region', 'n_regionkey')} AS value FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey NOT IN (1, 2)", True)
_violations("path_unused_ill_formed", SIZES, "c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:maxInclusive 40 ] . _:x sh:zeroOrMorePath 5 . _:y sh:alternativePath () .", f"SELECT {_iri('part', 'p_partkey')} AS focus, 'MaxInclusive' AS component FROM part WHERE p_size > 40")


@query(f"SELECT {_iri('part', 'p_partkey')} AS focus, 'too large' AS message, '{SH}Warning' AS severity FROM part WHERE p_size > 40")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = 'c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:maxInclusive 40 ; sh:message "too large" ; sh:severity sh:Warning ] .'
    return shacl.validate(Tables(spark, sf_dir).graph(*SIZES), PREFIXES + shape).flat().select("focus", "message", "severity")


def _checked(name: str, parts, schema: str, targets: str, sql: str, **kw) -> None:
    """Like `_shex`, for schemas that are loaded with more than their text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        graph = t.graph(*(parts(t) if callable(parts) else parts))
        fixed = shapemap.fix(graph, shapemap.parse(targets, NAMES))
        return shapemap.results(shex.Validator(graph, shex.load(SHEX + schema, **kw)).validate(fixed.select("node", "shape"))).select("node", "shape", "status")

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


_large = _status("part", "p_partkey", "p_size >= 25", "part")
_checked("shex_start", SIZES, "start = { p:p_size MININCLUSIVE 25 }", "{FOCUS p:p_size _}@START", _large.replace("'urn:shape/S'", "'START'"))
_checked("shex_import", SIZES, "IMPORT <urn:x/a> :S { p:p_size @:Large }", SIZED, _large, fetch={"urn:x/a": SHEX + "IMPORT <urn:x/b> :Other { }", "urn:x/b": SHEX + "IMPORT <urn:x/a> :Large MININCLUSIVE 25"}.__getitem__)
_checked("shex_external", lambda t: [_owners(t)], ":S { p:owner @:E } :E EXTERNAL", "{FOCUS p:owner _}@:S", _status("customer", "c_custkey", "c_custkey % 3 = 1", "customer"), external={"urn:shape/E": {"type": "NodeConstraint", "nodeKind": "iri"}})
_checked("shex_inclusion", ["customer.c_acctbal", "customer.c_mktsegment"], ":T { $:t ( p:c_acctbal MININCLUSIVE 0 ; p:c_mktsegment . ) } :S CLOSED { &:t }", _SEG, _status("customer", "c_custkey", "c_acctbal >= 0", "customer"))
_checked("shex_extends", ["part.p_size", "part.p_type"], ":T { p:p_size MININCLUSIVE 25 } :S EXTENDS @:T { p:p_type [ \"ECONOMY\" \"STANDARD\" ] }", SIZED, _status("part", "p_partkey", "p_size >= 25 AND p_type IN ('ECONOMY', 'STANDARD')", "part"))
_checked("shex_actions", SIZES, ":S { p:p_size MININCLUSIVE 25 %<urn:x/ok>{ seen %} } :T { p:p_size . %<urn:x/no>{ %} }", SIZED + ", {FOCUS p:p_size _}@:T", _large + f" UNION ALL SELECT {_iri('part', 'p_partkey')}, 'urn:shape/T', 'nonconformant' FROM part", actions={"urn:x/ok": lambda code: True, "urn:x/no": lambda code: False})
_checked("shape_map_node", SIZES, ":S { p:p_size MININCLUSIVE 25 }", "<urn:t/part/1>@:S, <urn:t/part/2>@:S, <urn:none>@:S", "SELECT '<urn:t/part/' || p_partkey || '>' AS node, 'urn:shape/S' AS shape, CASE WHEN p_size >= 25 THEN 'conformant' ELSE 'nonconformant' END AS status FROM part WHERE p_partkey IN (1, 2) UNION ALL SELECT '<urn:none>', 'urn:shape/S', 'nonconformant'")


@query(f"SELECT {_iri('part', 'p_partkey')} AS node, CASE WHEN p_size >= 25 THEN 'conformant' ELSE 'nonconformant' END AS status, 'nonconformant' AS expected, p_size < 25 AS as_expected FROM part")
def shape_map_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a negated association expects, beside what is found."""
    graph = Tables(spark, sf_dir).graph(*SIZES)
    out = api.schema(SHEX + ":S { p:p_size MININCLUSIVE 25 }").validate(graph, shape_map="{FOCUS p:p_size _}@!:S", prefixes=NAMES).result_map
    return out.select("node", "status", "expected", (F.col("status") == F.col("expected")).alias("as_expected"))


@query(f"SELECT {_iri('part', 'p_partkey')} AS node, CASE WHEN p_size >= 25 THEN 'conformant' ELSE 'nonconformant' END AS status FROM part WHERE p_partkey % 10 = 1")
def shex_target_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ShEx schema on the nodes that the data's sh:targetNode name."""
    t = Tables(spark, sf_dir)
    wanted = t.table("part").filter("p_partkey % 10 = 1").select(constant(iri("urn:shape/S")).alias("s"), F.lit(SH + "targetNode").alias("p"), row("part", F.col("p_partkey")).alias("o"))
    return api.schema(SHEX + ":S { p:p_size MININCLUSIVE 25 }").validate(t.graph(*SIZES, wanted), trigger="TargetDecls").result_map.select("node", "status")


@query("SELECT * FROM (VALUES " + _values(("NodeShape", "urn:shape/S"), ("NodeStart", "START"), ("ShapeMap", "urn:shape/S")) + ") AS t(\"trigger\", shape), (SELECT '<urn:t/part/1>' AS node, CASE WHEN p_size >= 25 THEN 'conformant' ELSE 'nonconformant' END AS status FROM part WHERE p_partkey = 1)")
def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node by each trigger that names nodes; names are resolved by prefixes."""
    graph, out = Tables(spark, sf_dir).graph(*SIZES), None
    schema = api.schema(SHEX + "start = @:S :S { p:p_size MININCLUSIVE 25 }")
    for trigger, kw in (("NodeShape", {"node": "t:part/1", "shape": ":S"}), ("NodeStart", {"node": "<urn:t/part/1>"}), ("ShapeMap", {"shape_map": "t:part\\/1@:S"})):
        kw = {"shape_map": "<urn:t/part/1>@:S"} if trigger == "ShapeMap" else kw
        one = schema.validate(graph, trigger, prefixes=NAMES, **kw).result_map.select(F.lit(trigger).alias("trigger"), "shape", "node", "status")
        out = one if out is None else out.unionByName(one)
    return out


def _rows(name: str, columns: str, sql_rows: list, make) -> None:
    """Register a query of a small table that the driver makes; `columns` are name type, ..."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(make(), columns)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, f"SELECT * FROM (VALUES {_values(*sql_rows)}) AS t({', '.join(json.dumps(c.split()[0]) for c in columns.split(','))})"


def _raises(f, *kinds) -> bool:
    try:
        f()
    except kinds:
        return True
    return False


_IRIS = [("<x>", "http://h/", "http://h/x"), ("t:part/1", "", "urn:t/part/1"), (":S", "", "urn:shape/S"), ("urn:t/1", "", "urn:t/1"), ("<urn:a>", "http://h/", "urn:a"), ("http://e/x", "", "http://e/x")]
_rows("resolved_names", "name string, base string, iri string", _IRIS, lambda: [(a, b, api.resolve(a, NAMES, b)) for a, b, _ in _IRIS])
_BROKEN = {"missing reference": ":S { p:p @:T }", "missing inclusion": ":S { &:x }", "negated itself": ":S NOT @:S", "negative cycle": ":S { p:p @:T } :T { p:q NOT @:S }", "negated through extra": ":S EXTRA p:p { p:p @:S }", "positive cycle": ":S { p:p @:T* } :T { p:q @:S? }", "stratified": ":S { p:p NOT @:T } :T { p:q . }"}
_rows("schema_checks", "schema string, refused boolean", [(k, k not in ("positive cycle", "stratified")) for k in _BROKEN], lambda: [(k, _raises(lambda s=s: shex.load(SHEX + s), shex.SchemaError)) for k, s in _BROKEN.items()])
_QUERIES = {"service": "SELECT ?x WHERE { SERVICE <x> { ?x <urn:p> ?y } }", "bound again": "SELECT $this WHERE { BIND (1 AS $this) }", "construct": "CONSTRUCT { } WHERE { }", "plain": "SELECT $this WHERE { $this <urn:p> ?y }"}
_rows("sparql_refused", "query string, refused boolean", [(k, k != "plain") for k in _QUERIES], lambda: [(k, _raises(lambda q=q: sq.Query(q, bound=("this",)), ValueError, SyntaxError)) for k, q in _QUERIES.items()])
_rows("engine_names", "name string, engine string", [("ShEx", "ShEx"), ("JenaShEx", "ShEx"), ("SHACLex", "SHACL"), ("JenaSHACL", "SHACL"), ("SHACL_TQ", "SHACL")], lambda: [(x, api.lookup(x)) for x in ("ShEx", "JenaShEx", "SHACLex", "JenaSHACL", "SHACL_TQ")])
_LINTED = ":S { p:p @_:a ; p:q @_:b } _:a { p:x . } _:b { p:y @_:b* } _:c { }"
_rows("lint_usages", "label string, uses long", [("_:a", 1), ("_:b", 2), ("_:c", 0), ("urn:shape/S", 0)], lambda: sorted(lint.usages(shexc.parse(SHEX + _LINTED)).items()))
_rows("lint_inline", "label string", [("_:b",), ("_:c",), ("urn:shape/S",)], lambda: sorted((s["id"],) for s in lint.inline(shexc.parse(SHEX + _LINTED))["shapes"]))
_rows("schema_formats", "format string, labels string", [(f, "urn:shape/S urn:shape/T") for f in ("ShExC", "ShExJ", "Turtle")], lambda: [(f, " ".join(sorted(api.schema(api.schema(SHEX + ":S { p:p @:T* } :T { }").serialize(f), f).shapes))) for f in ("ShExC", "ShExJ", "Turtle")])
_rows("schema_info", "schema string, engine string, formed boolean, shapes long", [("a", "ShEx", True, 2), ("b", "SHACL", True, 1)], lambda: [(k, s.info()["engine"], s.info()["wellFormed"], len(s.shapes)) for k, s in (("a", api.schema(SHEX + ":S { p:p @:T* } :T { }")), ("b", api.schema(PREFIXES + "c:S a sh:NodeShape .", "Turtle", "SHACL")))])
_rows(
    "targets_to_shape_map", "association string",
    [("{FOCUS <http://www.w3.org/1999/02/22-rdf-syntax-ns#type>/(<http://www.w3.org/2000/01/rdf-schema#subClassOf>*) <urn:c/part>}@<urn:c/S>",), ("{FOCUS <urn:p/p> _}@<urn:c/S>",), ("{_ <urn:p/q> FOCUS}@<urn:c/S>",), ("<urn:t/part/1>@<urn:c/S>",)],
    lambda: [(shapemap.show(a),) for a in convert.target_map(shacl.shapes_of(PREFIXES + "c:S sh:targetNode <urn:t/part/1> ; sh:targetClass c:part ; sh:targetSubjectsOf p:p ; sh:targetObjectsOf p:q ."))],
)
_rows("conversion_refused", "schema string, refused boolean", [("choice", True), ("repeated group", True), ("repeated predicate", True), ("digits", True), ("flat", False), ("boolean", False)], lambda: [(k, _raises(lambda s=s: convert.shex_to_shacl(shex.load(SHEX + s)), convert.NotSupported)) for k, s in {"choice": ":S { p:p . | p:q . }", "repeated group": ":S { (p:p . ; p:q .){2} }", "repeated predicate": ":S { p:p . ; p:p . }", "digits": ":S { p:p TOTALDIGITS 2 }", "flat": ":S { p:p . ; p:q IRI* }", "boolean": ":S { p:p . } OR NOT { p:q . }"}.items()])
_rows(
    "asp_rules", "line string",
    [(x,) for x in ('root("urn:shape/S", 0).', 'asked("urn:t/part/1", "urn:shape/S").', "node(X) :- arc(X, _, _).", "node(X) :- arc(_, _, X).", "node(X) :- asked(X, _).", 'step(0, X, V) :- arc(X, "urn:p/p", V).', 'step(1, X, V) :- arc(X, P, V), P != "urn:p/p".',
     'fails(3, X) :- node(X), not iri(X).', 'fails(2, X) :- node(X), N = #count { V : step(0, X, V) }, #count { V : step(0, X, V), fails(3, V) } > N - 1.', 'fails(2, X) :- node(X), #count { V : step(0, X, V), not fails(3, V) } > 2.',
     'fails(4, X) :- step(0, X, V), fails(3, V).', 'fails(1, X) :- fails(2, X).', 'fails(1, X) :- fails(4, X).', 'fails(6, X) :- node(X), N = #count { V : step(1, X, V) }, #count { V : step(1, X, V), fails(7, V) } > N - 1.', 'fails(5, X) :- node(X), not fails(6, X).', 'fails(0, X) :- fails(1, X).', 'fails(0, X) :- fails(5, X).',
     'yes(X, L) :- asked(X, L), root(L, I), not fails(I, X).', 'no(X, L) :- asked(X, L), root(L, I), fails(I, X).', '#show yes/2.', '#show no/2.')],
    lambda: [(x,) for x in asp.Program(slang.lower(shex.load(SHEX + ":S CLOSED { p:p IRI {1,2} }"))).text([(iri("urn:t/part/1"), "urn:shape/S")]).splitlines()],
)


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey < 5), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))
SELECT 'arc("urn:t/customer/' || c_custkey || '", "urn:p/c_nationkey", "urn:t/nation/' || c_nationkey || '").' AS fact FROM c UNION ALL SELECT 'arc("urn:t/nation/' || n_nationkey || '", "urn:p/n_regionkey", "urn:t/region/' || n_regionkey || '").' FROM n
UNION ALL SELECT DISTINCT 'iri("urn:t/customer/' || c_custkey || '").' FROM c UNION ALL SELECT DISTINCT 'iri("urn:t/nation/' || n_nationkey || '").' FROM n UNION ALL SELECT DISTINCT 'iri("urn:t/region/' || n_regionkey || '").' FROM n""")
def asp_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of what some nodes reach, and of nothing else."""
    t = Tables(spark, sf_dir)
    start = t.table("customer").filter("c_custkey < 5").select(row("customer", F.col("c_custkey")).alias("node"))
    return asp.facts(t.graph("customer.c_nationkey", "nation.n_regionkey"), start).select(F.col("value").alias("fact"))


# SHACL-SPARQL

_over = f"SELECT {_iri('part', 'p_partkey')} AS focus, '%s' AS component FROM part WHERE p_size > 40"


def _component(name: str, shapes: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = shacl.validate(Tables(spark, sf_dir).graph(*SIZES), PREFIXES + shapes).flat()
        return out.select("focus", F.regexp_extract("component", "([A-Za-z]+?)(ConstraintComponent)?>?$", 1).alias("component"))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, _over % ("SPARQL" if "sh:sparql" in shapes else "Most")


_K = "c:Most a sh:ConstraintComponent ; sh:parameter [ sh:path c:most ] ; "
_component("component_path", _K + 'sh:propertyValidator [ sh:select "SELECT $this ?value WHERE { $this $PATH ?value . FILTER (?value > $most) }" ] . c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; c:most 40 ] .')
_component("component_ask", _K + 'sh:validator [ sh:ask "ASK { FILTER ($value <= $most) }" ] . c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; c:most 40 ] .')
_component("component_node", _K + 'sh:nodeValidator [ sh:select "SELECT $this WHERE { $this <urn:p/p_size> ?v . FILTER (?v > $most) }" ] . c:S sh:targetSubjectsOf p:p_size ; c:most 40 .')
_component("sparql_prefixes", 'c:O sh:declare [ sh:prefix "x" ; sh:namespace "urn:p/"^^xsd:anyURI ] . c:S sh:targetSubjectsOf p:p_size ; sh:sparql [ sh:prefixes c:O ; sh:select "SELECT $this WHERE { $this x:p_size ?v . FILTER (?v > 40) }" ] .')



@query(f"SELECT {_iri('customer', 'c_custkey')} AS x FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey IN (3, 4, 5) AND NOT c_acctbal < 0")
def sparql_values_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Tables(spark, sf_dir).graph("customer.c_nationkey", "customer.c_acctbal")
    out = sq.select(graph, "SELECT ?x WHERE { ?x <urn:p/c_nationkey> ?n . VALUES ?n { <urn:t/nation/3> <urn:t/nation/4> <urn:t/nation/5> } MINUS { ?x <urn:p/c_acctbal> ?b . FILTER (?b < 0) } }")
    return out.select(text(F.col("x")).alias("x"))


@query(f"SELECT {_iri('nation', 'n_nationkey')} AS nation, '\"' || n || '\"^^<{XSD}integer>' AS n, {_iri('region', 'n_regionkey')} AS region FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE n > 5")
def sparql_subselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Tables(spark, sf_dir).graph("customer.c_nationkey", "nation.n_regionkey")
    out = sq.select(graph, "SELECT ?m ?n ?r WHERE { ?m <urn:p/n_regionkey> ?r . { SELECT ?m (COUNT(?x) AS ?n) WHERE { ?x <urn:p/c_nationkey> ?m } GROUP BY ?m } FILTER (?n > 5) }")
    return out.select(text(F.col("m")).alias("nation"), text(F.col("n")).alias("n"), text(F.col("r")).alias("region"))


# the minimal language


def _slang(name: str, parts, shape, table: str, sql: str, **more) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        targets = t.types(table).select(F.col("s").alias("node"), F.lit("urn:shape/S").alias("shape"))
        shapes = {"urn:shape/S": shape} | {f"urn:shape/{k}": s for k, s in more.items()}
        return slang.show(slang.Validator(t.graph(*(parts(t) if callable(parts) else parts)), shapes).validate(targets))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql.replace("'conformant'", "'+'").replace("'nonconformant'", "'-'")


_own = P.Pred(prop("owner"))
_slang("slang_bnode", lambda t: [_owners(t)], slang.QualifiedArc(_own, slang.BNodeKind(), 1, 1), "customer", _status("customer", "c_custkey", "c_custkey % 3 = 0", "customer"))
_slang("slang_or", lambda t: [_owners(t)], slang.QualifiedArc(_own, slang.BNodeKind() | slang.IRIKind(), 1, 1), "customer", _status("customer", "c_custkey", "c_custkey % 3 < 2", "customer"))
_slang("slang_not", lambda t: [_owners(t)], ~slang.QualifiedArc(_own, slang.Datatype(XSD + "string"), 1, -1), "customer", _status("customer", "c_custkey", "c_custkey % 3 < 2", "customer"))
_slang("slang_ref", lambda t: [_owners(t)], slang.Ref("urn:shape/T") & slang.Ref("urn:shape/U"), "customer", _status("customer", "c_custkey", "c_custkey % 3 = 1", "customer"), T=slang.QualifiedArc(_own, ~slang.BNodeKind()), U=~slang.QualifiedArc(_own, slang.Datatype(XSD + "string")))
_slang("slang_count", lambda t: ["nation.n_regionkey"], slang.QualifiedArc(P.Inv(P.Pred(prop("n_regionkey"))), slang.IRIKind(), 5, 5), "region", _status("region", "r_regionkey", "n = 5", "(SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)"))


@query(_status("customer", "c_custkey", "c_mktsegment = 'MACHINERY' OR true", "customer").replace("'conformant'", "'+'").replace("'nonconformant'", "'-'"))
def slang_each_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ShEx conjunction lowered to the minimal language."""
    t = Tables(spark, sf_dir)
    shapes = slang.lower(shex.load(SHEX + ":S CLOSED EXTRA a { p:c_acctbal xsd:double ; (p:c_nationkey IRI ; p:c_mktsegment xsd:string) }"))
    graph = t.graph("customer.c_acctbal", "customer.c_nationkey", "customer.c_mktsegment")
    return slang.show(slang.Validator(graph, shapes).validate(t.types("customer").select(F.col("s").alias("node"), F.lit("urn:shape/S").alias("shape"))))


# inference


@query("SELECT * FROM (VALUES " + _values(("<urn:p/owner>", "any", "", ""), ("<urn:p/mixed>", "literal", "", ""), ("<urn:p/link>", "iri", "", ""), ("<urn:p/note>", "langstring", "", ""), ("<urn:p/en>", "lang", "", "en"), ("<urn:p/c_acctbal>", "datatype", XSD + "double", "")) + ') AS t(p, "constraint", datatype, lang)')
def infer_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least upper bound of what a predicate's objects are."""
    t = Tables(spark, sf_dir)
    c = t.table("customer")
    k = F.col("c_custkey")
    s, lex = row("customer", k).alias("s"), k.cast("string")
    objects = {
        "mixed": node(LITERAL, lex, F.when(k % 2 == 0, XSD + "integer").otherwise(XSD + "string")),
        "link": row("nation", F.col("c_nationkey")),
        "note": node(LITERAL, lex, LANGSTRING, F.when(k % 2 == 0, "en").otherwise("de")),
        "en": node(LITERAL, lex, LANGSTRING, "en"),
    }
    graph = t.graph("customer.c_acctbal", _owners(t), *(c.select(s, F.lit(prop(p)).alias("p"), o.alias("o")) for p, o in objects.items()))
    return infer.predicates(graph, c.select(s).withColumnRenamed("s", "node")).select(F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), "constraint", "datatype", "lang")


@query("""WITH m AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey))
SELECT 'urn:shape/C' AS shape, 0::BIGINT AS place, 'urn:p/c_acctbal' AS predicate, 'http://www.w3.org/2001/XMLSchema#double' AS value, 'balance' AS label UNION ALL SELECT 'urn:shape/C', 1, 'urn:p/c_nationkey', 'urn:shape/N', '' UNION ALL SELECT 'urn:shape/N', 0, 'urn:p/n_regionkey', 'urn:shape/R', '' UNION ALL SELECT 'urn:shape/R', 0, 'urn:p/r_name', 'http://www.w3.org/2001/XMLSchema#string', ''""")
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inferred schema with labels, its predicates in order, and the shapes that follow on."""
    t = Tables(spark, sf_dir)
    label = rdf.frame(spark, [(iri(prop("c_acctbal")), RDFS + "label", rdf.literal("balance", XSD + "string", "en"))])
    graph = t.graph("customer.c_acctbal", "customer.c_nationkey", "nation.n_regionkey", "region.r_name", label)
    follow = {prop("c_nationkey"): "urn:shape/N", prop("n_regionkey"): "urn:shape/R"}
    body, _ = infer.infer(graph, t.types("customer").select(F.col("s").alias("node")), "urn:shape/C", infer.Options(label=True, follow=follow, max_follow=3))
    out = []
    for s in shexc.parse(shexc.show(body))["shapes"]:
        e = s["expression"]
        for i, c in enumerate(e["expressions"] if e["type"] == "EachOf" else [e]):
            v = c["valueExpr"]
            notes = {a["predicate"]: a["object"]["value"] for a in c.get("annotations", [])}
            out.append((s["id"], i, c["predicate"], v if isinstance(v, str) else v["datatype"], notes.get(RDFS + "label", "")))
    return spark.createDataFrame(out, "shape string, place long, predicate string, value string, label string")


@query("SELECT unnest(['rdfs', 'xsd']) AS prefix")
def infer_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-known prefixes that an inferred schema uses."""
    t = Tables(spark, sf_dir)
    graph = t.graph(t.column("nation", "n_name").withColumn("p", F.lit(RDFS + "comment")))
    body, _ = infer.infer(graph, t.types("nation").select(F.col("s").alias("node")), "urn:shape/N")
    return spark.createDataFrame([(k,) for k in body["prefixes"]], "prefix string")


@query('SELECT * FROM (VALUES ' + _values(("urn:p/c_acctbal", 1, 1), ("urn:p/c_mktsegment", 0, 1)) + ') AS t(p, min, max)')
def infer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that some of the nodes lack may be absent."""
    t = Tables(spark, sf_dir)
    graph = t.graph("customer.c_acctbal", t.column("customer", "c_mktsegment").filter(F.col("o")["lex"] == "MACHINERY"))
    return infer.predicates(graph, t.types("customer").select(F.col("s").alias("node")), support=True).select("p", "min", "max")


# conversion


def _converted(name: str, parts, schema: str, focus: str, sql: str) -> None:
    """Foci that violate SHACL shapes converted from ShEx."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        shapes = convert.shex_to_shacl(shex.load(SHEX + schema), shapemap.parse(f"{{FOCUS {focus} _}}@:S", NAMES))
        from .plans import shapes as S

        return shacl.Validator(t.graph(*(parts(t) if callable(parts) else parts)), S.read(shapes)).validate(only=[iri("urn:shape/S")]).flat().select("focus").distinct()

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


_part = f"SELECT {_iri('part', 'p_partkey')} AS focus FROM part WHERE NOT "
_converted("convert_boolean", ["part.p_size", "part.p_type"], ':S { p:p_size MININCLUSIVE 10 } AND { p:p_type [ "ECONOMY" "STANDARD" ] } OR NOT { p:p_size MAXINCLUSIVE 40 }', "p:p_size", _part + "(p_size >= 10 AND p_type IN ('ECONOMY', 'STANDARD') OR p_size > 40)")
_converted("convert_reference", ["customer.c_nationkey", "nation.n_regionkey"], ":S { p:c_nationkey @:N } :N { p:n_regionkey [ <urn:t/region/1> <urn:t/region/2> ] }", "p:c_nationkey", f"SELECT {_iri('customer', 'c_custkey')} AS focus FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey NOT IN (1, 2)")
_converted("convert_extra", lambda t: ["part.p_size", t.column("part", "p_partkey").withColumn("p", F.lit(prop("p_size"))).withColumn("o", node(LITERAL, F.lit("x"), XSD + "string"))], ":S EXTRA p:p_size { p:p_size MININCLUSIVE 25 }", "p:p_size", _part + "p_size >= 25")
_converted("convert_closed", lambda t: ["part.p_size", t.column("part", "p_type").filter(F.col("o")["lex"] == "ECONOMY")], ":S CLOSED { p:p_size . }", "p:p_size", _part + "(p_type <> 'ECONOMY')")


@query(_status("nation", "n_nationkey", "n_nationkey IN (1, 2, 3)", "nation").replace("urn:shape/S", "urn:c/S"))
def convert_node_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node shape's own components as ShEx."""
    body, found = convert.shacl_to_shex(shacl.shapes_of(PREFIXES + "c:S a sh:NodeShape ; sh:targetSubjectsOf p:n_name ; sh:nodeKind sh:IRI ; sh:in (<urn:t/nation/1> <urn:t/nation/2> <urn:t/nation/3>) ."))
    graph = Tables(spark, sf_dir).graph("nation.n_name")
    return shapemap.results(shex.Validator(graph, shex.Schema(body)).validate(shapemap.fix(graph, found).select("node", "shape"))).select("node", "shape", "status")


# results, export and streams


@query("SELECT '{\"focus\":\"<urn:t/part/' || p_partkey || '>\",\"value\":\"\\\"' || p_size || '\\\"^^<http://www.w3.org/2001/XMLSchema#integer>\"}' AS line FROM part WHERE p_size > 40")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's rows as JSON lines, cut to two fields."""
    result = api.schema(PREFIXES + "c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path p:p_size ; sh:maxInclusive 40 ] .", "Turtle", "SHACL").validate(Tables(spark, sf_dir).graph(*SIZES))
    rows = result.to_json().select(F.from_json("value", "focus string, value string").alias("r"))
    return rows.select(F.to_json("r").alias("line"))


_G = "g AS (SELECT '<urn:t/nation/' || n_nationkey || '>' AS s, 'urn:p/n_regionkey' AS p, '<urn:t/region/' || n_regionkey || '>' AS o FROM nation), t AS (SELECT s AS x FROM g UNION SELECT o FROM g), k AS (SELECT substr(x, 2, length(x) - 2) AS x, 'N' || (row_number() OVER (ORDER BY x) - 1) AS id FROM t), e AS (SELECT a.id AS source, b.id AS target, p FROM g JOIN k a ON '<' || a.x || '>' = s JOIN k b ON '<' || b.x || '>' = o)"


@query(f"""WITH {_G} SELECT 'digraph {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT id || ' [label="' || x || '", shape=ellipse, color="blue"]' FROM k UNION ALL SELECT source || ' -> ' || target || ' [label="' || p || '", href="' || p || '"]' FROM e""")
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.dot(Tables(spark, sf_dir).graph("nation.n_regionkey")).select(F.col("value").alias("line"))


@query(f"""WITH {_G} SELECT '{{"data":{{"id":"' || id || '","label":"' || x || '","type":"iri"}}}}' AS line FROM k UNION ALL SELECT '{{"data":{{"source":"' || source || '","target":"' || target || '","label":"' || p || '","href":"' || p || '"}}}}' FROM e""")
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.to_json(Tables(spark, sf_dir).graph("nation.n_regionkey")).select(F.col("value").alias("line"))


def _streamed(spark: SparkSession, sf_dir: str, make, mode: str) -> DataFrame:
    """All that a stream over the events' file gives, by one run to its end; its result in the shared folder or in memory."""
    import uuid

    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    arcs = events.select(row("events", F.col("user_id")).alias("s"), F.lit(prop("value")).alias("p"), node(LITERAL, F.col("value").cast("string"), XSD + "double").alias("o"), F.col("ts").cast("timestamp").alias("ts"))
    name = f"shapeloom_{uuid.uuid4().hex[:12]}"
    run = make(arcs).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query(f"SELECT {_iri('events', 'user_id')} AS focus, count(*) AS n FROM events WHERE NOT value <= 150 GROUP BY 1")
def stream_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a value's shape in a stream, as they come."""
    shape = shacl.shapes_of(PREFIXES + "c:S a sh:NodeShape ; sh:maxInclusive 150 .")[iri("urn:c/S")]
    return _streamed(spark, sf_dir, lambda arcs: streaming.leaves(arcs, prop("value"), shape), "append").groupBy("focus").agg(F.count("*").alias("n"))


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, {_iri('events', 'user_id')} AS focus, count(DISTINCT value) AS n FROM events GROUP BY 1, 2 HAVING count(DISTINCT value) > 3")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foci with too many values in a day of a stream."""
    return _streamed(spark, sf_dir, lambda arcs: streaming.cardinality(arcs, prop("value"), "ts", "1 day", "1 day", high=3), "update")


__all__: list[str] = []
