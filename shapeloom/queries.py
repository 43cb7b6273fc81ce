"""The registered queries over the driver's tables, with their DuckDB SQL.

Tables are mapped to triples predicate by predicate (sources.tables); every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .operators import asp, convert, infer, shacl, shapemap, shex, viz
from .operators import sparql as sq
from .plans import paths as P
from .plans import shapes as S
from .plans import slang
from .sources import rdf
from .sources.tables import Tables, prop, row
from .sources.terms import LANGSTRING, LITERAL, RDFS, SH, SUBCLASS, TYPE, XSD, constant, iri, node, text

PREFIXES = f"@prefix c: <urn:c/> . @prefix p: <urn:p/> . @prefix t: <urn:t/> . @prefix sh: <{SH}> . @prefix xsd: <{XSD}> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <{RDFS}> .\n"
SHEX = f"PREFIX c: <urn:c/> PREFIX p: <urn:p/> PREFIX xsd: <{XSD}> PREFIX : <urn:shape/>\n"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _violations(name: str, parts, shapes: str, sql: str, value: bool = False) -> None:
    """Register a query of a shape's violations (focus, component and maybe value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        graph = t.graph(*(parts(t) if callable(parts) else parts))
        out = shacl.validate(graph, PREFIXES + shapes).flat()
        name_ = F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component")
        return out.select("focus", name_, *["value"] * value)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


def links(t: Tables) -> DataFrame:
    """Arcs from orders to the parts they hold."""
    return t.links("lineitem", "l_orderkey", "l_partkey", prop("holds"))


def _flags(t: Tables) -> DataFrame:
    """Arcs from orders to the flags of their lines."""
    return t.arcs("lineitem", "l_orderkey", {c: (F.col(c), lambda x: node(LITERAL, x, XSD + "string")) for c in ("l_returnflag", "l_linestatus")})


def _line_dates(t: Tables) -> DataFrame:
    return t.arcs("lineitem", "l_orderkey", {"l_shipdate": (F.date_trunc("second", "l_shipdate"), lambda x: node(LITERAL, F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime"))})


def _line_keys(t: Tables) -> DataFrame:
    """Arcs from orders to part and supplier numbers, as literals of one type."""
    return t.arcs("lineitem", "l_orderkey", {c: (F.col(c), lambda x: node(LITERAL, x.cast("string"), XSD + "integer")) for c in ("l_partkey", "l_suppkey")})


def _titles(t: Tables) -> DataFrame:
    """Arcs from a source to a title in each document's language."""
    rows = t.table("documents")
    lang = node(LITERAL, F.concat(F.lit("doc "), F.col("doc_id").cast("string")), LANGSTRING, F.col("lang"))
    return rows.select(node(0, F.concat(F.lit("urn:s/"), F.col("source"))).alias("s"), F.lit(prop("title")).alias("p"), lang.alias("o")).distinct()


def _turns(t: Tables) -> DataFrame:
    """Arcs from each conversation turn to the next."""
    c = t.table("conversations").select("conv_id", "turn").distinct()
    n = c.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("turn").alias("_n"))
    pairs = c.join(n, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    return pairs.select(row("conversations", F.col("conv_id"), F.col("turn")).alias("s"), F.lit(prop("next")).alias("p"), row("conversations", F.col("conv_id"), F.col("_n")).alias("o"))


def _ontology(t: Tables) -> DataFrame:
    """Regions as classes, nations as their subclasses, customers as instances of nations."""
    n = t.table("nation").select(row("nation", F.col("n_nationkey")).alias("s"), F.lit(SUBCLASS).alias("p"), row("region", F.col("n_regionkey")).alias("o"))
    c = t.table("customer").select(row("customer", F.col("c_custkey")).alias("s"), F.lit(TYPE).alias("p"), row("nation", F.col("c_nationkey")).alias("o"))
    return n.unionByName(c)


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.select(text(F.col("focus")).alias("focus"), text(F.col("value")).alias("value"))


def _iri(table: str, *keys: str) -> str:
    return f"'<urn:t/{table}/' || " + " || '/' || ".join(keys) + " || '>'"


# targets


def _target(name: str, parts, turtle: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        v = shacl.Validator(t.graph(*(parts(t) if callable(parts) else parts)), shacl.shapes_of(PREFIXES + turtle))
        s = next(s for s in v.shapes.values() if s.targets)
        return v.targets(s).select(text(F.col("focus")).alias("focus"))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


_target("target_class", ["customer"], "c:S sh:targetClass c:customer .", f"SELECT {_iri('customer', 'c_custkey')} AS focus FROM customer")
_target("target_class_implicit", lambda t: [_ontology(t)], "<urn:t/region/1> a rdfs:Class, sh:NodeShape .", f"SELECT {_iri('customer', 'c_custkey')} AS focus FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
_target("target_subjects_of", ["orders.o_custkey"], "c:S sh:targetSubjectsOf p:o_custkey .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus FROM orders")
_target("target_objects_of", ["orders.o_custkey"], "c:S sh:targetObjectsOf p:o_custkey .", f"SELECT DISTINCT {_iri('customer', 'o_custkey')} AS focus FROM orders")
_target("target_node", ["nation"], 'c:S sh:targetNode <urn:t/nation/1>, "absent", <urn:t/none> .', "SELECT unnest(['<urn:t/nation/1>', '\"absent\"', '<urn:t/none>']) AS focus")
_target("target_multiple", ["orders.o_custkey", "customer"], "c:S sh:targetObjectsOf p:o_custkey ; sh:targetClass c:customer ; sh:targetSubjectsOf p:o_custkey .", f"SELECT {_iri('customer', 'c_custkey')} AS focus FROM customer UNION SELECT {_iri('customer', 'o_custkey')} FROM orders UNION SELECT {_iri('orders', 'o_orderkey')} FROM orders")

# node constraints

_violations("node_kind", ["customer.c_nationkey"], "c:S sh:targetObjectsOf p:c_nationkey ; sh:nodeKind sh:Literal .", f"SELECT DISTINCT {_iri('nation', 'c_nationkey')} AS focus, 'NodeKind' AS component FROM customer")
_violations("datatype", ["part.p_size", "part.p_retailprice"], "c:S sh:targetSubjectsOf p:p_size ; sh:property [ sh:path [ sh:alternativePath (p:p_size p:p_retailprice) ] ; sh:datatype xsd:integer ] .", f"SELECT {_iri('part', 'p_partkey')} AS focus, 'Datatype' AS component FROM part")
_violations("datatype_range", lambda t: [t.column("orders", "o_orderkey").withColumn("o", F.col("o").withField("dt", F.lit(XSD + "byte")))], "c:S sh:targetSubjectsOf p:o_orderkey ; sh:property [ sh:path p:o_orderkey ; sh:datatype xsd:byte ] .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'Datatype' AS component FROM orders WHERE o_orderkey NOT BETWEEN -128 AND 127")
_violations("in_list", ["orders.o_orderstatus"], 'c:S sh:targetSubjectsOf p:o_orderstatus ; sh:property [ sh:path p:o_orderstatus ; sh:in ("F" "O") ] .', f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'In' AS component, '\"' || o_orderstatus || '\"' AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", True)
_violations("pattern", ["part.p_brand"], 'c:S sh:targetSubjectsOf p:p_brand ; sh:property [ sh:path p:p_brand ; sh:pattern "^brand#1[0-9]*$" ; sh:flags "i" ] .', f"SELECT {_iri('part', 'p_partkey')} AS focus, 'Pattern' AS component, '\"' || p_brand || '\"' AS value FROM part WHERE NOT regexp_matches(p_brand, '^brand#1[0-9]*$', 'i')", True)
_violations("min_length", ["part.p_brand"], "c:S sh:targetSubjectsOf p:p_brand ; sh:property [ sh:path p:p_brand ; sh:minLength 8 ] .", f"SELECT {_iri('part', 'p_partkey')} AS focus, 'MinLength' AS component FROM part WHERE length(p_brand) < 8")
_violations("max_length", ["part.p_name"], "c:S sh:targetSubjectsOf p:p_name ; sh:property [ sh:path p:p_name ; sh:maxLength 10 ] .", f"SELECT {_iri('part', 'p_partkey')} AS focus, 'MaxLength' AS component FROM part WHERE length(p_name) > 10")
_violations("language_in", lambda t: [_titles(t)], 'c:S sh:targetSubjectsOf p:title ; sh:property [ sh:path p:title ; sh:languageIn ("EN" "fr") ] .', "SELECT '<urn:s/' || source || '>' AS focus, 'LanguageIn' AS component, '\"doc ' || doc_id || '\"@' || lang AS value FROM documents WHERE lang NOT IN ('en', 'fr')", True)
for _name, _op, _limit in (("minInclusive", "<", "0.0"), ("minExclusive", "<=", "100.5"), ("maxInclusive", ">", "9000.0"), ("maxExclusive", ">=", "5000.0")):
    _snake = _name.replace("In", "_in").replace("Ex", "_ex")
    _violations(_snake, ["customer.c_acctbal"], f"c:S sh:targetSubjectsOf p:c_acctbal ; sh:property [ sh:path p:c_acctbal ; sh:{_name} {_limit} ] .", f"SELECT {_iri('customer', 'c_custkey')} AS focus, '{_name[0].upper() + _name[1:]}' AS component FROM customer WHERE c_acctbal {_op} {_limit}")
_violations("date_range", ["orders.o_orderdate"], 'c:S sh:targetSubjectsOf p:o_orderdate ; sh:property [ sh:path p:o_orderdate ; sh:minInclusive "1998-01-01T00:00:00"^^xsd:dateTime ] .', f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'MinInclusive' AS component FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
_violations("incomparable", ["orders.o_orderdate"], 'c:S sh:targetSubjectsOf p:o_orderdate ; sh:property [ sh:path p:o_orderdate ; sh:minInclusive "1990-01-01T00:00:00Z"^^xsd:dateTime ] .', f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'MinInclusive' AS component FROM orders")

# counts

_violations("min_count_orders_lines", lambda t: ["orders", links(t)], "c:S sh:targetClass c:orders ; sh:property [ sh:path p:holds ; sh:minCount 1 ] .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'MinCount' AS component FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_violations("max_count_lines", lambda t: [links(t)], "c:S sh:targetSubjectsOf p:holds ; sh:property [ sh:path p:holds ; sh:maxCount 5 ] .", f"SELECT {_iri('orders', 'l_orderkey')} AS focus, 'MaxCount' AS component FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 5")
_violations("qualified_count", lambda t: ["orders", links(t), "part.p_size"], "c:S sh:targetClass c:orders ; sh:property [ sh:path p:holds ; sh:qualifiedValueShape [ sh:property [ sh:path p:p_size ; sh:minInclusive 26 ] ] ; sh:qualifiedMinCount 2 ; sh:qualifiedMaxCount 3 ] .", f"""WITH k AS (SELECT o_orderkey, count(DISTINCT p_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size >= 26 GROUP BY 1)
SELECT {_iri('orders', 'o_orderkey')} AS focus, CASE WHEN n < 2 THEN 'QualifiedMinCount' ELSE 'QualifiedMaxCount' END AS component FROM k WHERE n NOT BETWEEN 2 AND 3""")
_violations("qualified_disjoint", lambda t: ["orders", links(t), "part.p_size"], """c:S sh:targetClass c:orders ; sh:property c:A, c:B .
c:A sh:path p:holds ; sh:qualifiedValueShape c:Large ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 .
c:B sh:path p:holds ; sh:qualifiedValueShape c:Middle ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMaxCount 1 .
c:Large sh:property [ sh:path p:p_size ; sh:minInclusive 30 ] . c:Middle sh:property [ sh:path p:p_size ; sh:minInclusive 20 ; sh:maxInclusive 40 ] .""", f"""WITH k AS (SELECT o_orderkey, count(DISTINCT p_partkey) FILTER (p_size > 40) AS a, count(DISTINCT p_partkey) FILTER (p_size BETWEEN 20 AND 29) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT {_iri('orders', 'o_orderkey')} AS focus, 'QualifiedMinCount' AS component FROM k WHERE a < 1 UNION ALL SELECT {_iri('orders', 'o_orderkey')}, 'QualifiedMaxCount' FROM k WHERE b > 1""")
_violations("unique_lang", lambda t: [_titles(t)], "c:S sh:targetSubjectsOf p:title ; sh:property [ sh:path p:title ; sh:uniqueLang true ] .", "SELECT '<urn:s/' || source || '>' AS focus, 'UniqueLang' AS component FROM documents GROUP BY source, lang HAVING count(DISTINCT doc_id) > 1")
_violations("has_value", lambda t: [_flags(t)], 'c:S sh:targetSubjectsOf p:l_returnflag ; sh:property [ sh:path p:l_returnflag ; sh:hasValue "A" ] .', f"SELECT {_iri('orders', 'l_orderkey')} AS focus, 'HasValue' AS component FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag = 'A')")

# pairs of properties

_violations("equals", lambda t: [_flags(t)], "c:S sh:targetSubjectsOf p:l_returnflag ; sh:property [ sh:path p:l_returnflag ; sh:equals p:l_linestatus ] .", f"""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS v FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS v FROM lineitem),
d AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT {_iri('orders', 'k')} AS focus, 'Equals' AS component, '"' || v || '"' AS value FROM d""", True)
_violations("disjoint", lambda t: [_line_keys(t)], "c:S sh:targetSubjectsOf p:l_partkey ; sh:property [ sh:path p:l_partkey ; sh:disjoint p:l_suppkey ] .", f"SELECT DISTINCT {_iri('orders', 'a.l_orderkey')} AS focus, 'Disjoint' AS component, '\"' || a.l_partkey || '\"^^<{XSD}integer>' AS value FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_suppkey", True)
_violations("less_than", lambda t: ["orders.o_orderdate", _line_dates(t)], "c:S sh:targetSubjectsOf p:o_orderdate ; sh:property [ sh:path p:o_orderdate ; sh:lessThan p:l_shipdate ] .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'LessThan' AS component FROM (SELECT DISTINCT o_orderkey, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE NOT o_orderdate < l_shipdate")
_violations("less_than_or_equals", lambda t: ["orders.o_orderdate", _line_dates(t)], "c:S sh:targetSubjectsOf p:o_orderdate ; sh:property [ sh:path p:o_orderdate ; sh:lessThanOrEquals p:l_shipdate ] .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'LessThanOrEquals' AS component FROM (SELECT DISTINCT o_orderkey, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE NOT o_orderdate <= l_shipdate")

# paths


def _path(name: str, parts, path, focus: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        start = t.types(focus).select(F.col("s").alias("focus"))
        return _shown(P.pairs(t.graph(*(parts(t) if callable(parts) else parts)), path, start))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


_c, _r, _s = P.Pred(prop("c_nationkey")), P.Pred(prop("n_regionkey")), P.Pred(prop("s_nationkey"))
_path("path_predicate", ["customer.c_nationkey"], _c, "customer", f"SELECT {_iri('customer', 'c_custkey')} AS focus, {_iri('nation', 'c_nationkey')} AS value FROM customer")
_path("path_sequence", ["customer.c_nationkey", "nation.n_regionkey"], P.Seq((_c, _r)), "customer", f"SELECT {_iri('customer', 'c_custkey')} AS focus, {_iri('region', 'n_regionkey')} AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
_path("path_inverse", ["customer.c_nationkey"], P.Inv(_c), "nation", f"SELECT {_iri('nation', 'c_nationkey')} AS focus, {_iri('customer', 'c_custkey')} AS value FROM customer")
_path("path_alternative", ["customer.c_nationkey", "supplier.s_nationkey"], P.Alt((P.Inv(_c), P.Inv(_s))), "nation", f"SELECT {_iri('nation', 'c_nationkey')} AS focus, {_iri('customer', 'c_custkey')} AS value FROM customer UNION SELECT {_iri('nation', 's_nationkey')}, {_iri('supplier', 's_suppkey')} FROM supplier")
_path("path_zero_or_one", ["nation.n_regionkey"], P.Opt(_r), "nation", f"SELECT {_iri('nation', 'n_nationkey')} AS focus, {_iri('nation', 'n_nationkey')} AS value FROM nation UNION SELECT {_iri('nation', 'n_nationkey')}, {_iri('region', 'n_regionkey')} FROM nation")
_path("path_negated", ["nation.n_regionkey", "nation.n_name", "nation"], P.NoPreds((prop("n_name"), TYPE)), "nation", f"SELECT {_iri('nation', 'n_nationkey')} AS focus, {_iri('region', 'n_regionkey')} AS value FROM nation")
_CHAIN = "WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn AS t, b.turn AS n FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (%s UNION SELECT r.conv_id, r.a, e.n FROM r JOIN e ON e.conv_id = r.conv_id AND e.t = r.b) "
_pair = f"SELECT {_iri('conversations', 'conv_id', 'a')} AS focus, {_iri('conversations', 'conv_id', 'b')} AS value FROM r"
_path("path_zero_or_more", lambda t: [_turns(t)], P.Star(P.Pred(prop("next"))), "conversations", _CHAIN % "SELECT conv_id, turn AS a, turn AS b FROM c" + _pair)
_path("path_one_or_more", lambda t: [_turns(t)], P.Plus(P.Pred(prop("next"))), "conversations", _CHAIN % "SELECT conv_id, t AS a, n AS b FROM e" + _pair)
_violations("class_with_subclasses", lambda t: [_ontology(t), "orders.o_custkey"], "c:S sh:targetSubjectsOf p:o_custkey ; sh:property [ sh:path p:o_custkey ; sh:class <urn:t/region/1> ] .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'Class' AS component, {_iri('customer', 'o_custkey')} AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1", True)

# shapes over shapes

_LOGIC = ["part", "part.p_size", "part.p_retailprice", "part.p_type"]
_A, _B = "[ sh:property [ sh:path p:p_size ; sh:minInclusive 10 ] ]", '[ sh:property [ sh:path p:p_type ; sh:in ("ECONOMY" "STANDARD") ] ]'
for _k, _test in (("and", "NOT (p_size >= 10 AND e)"), ("or", "NOT (p_size >= 10 OR e)"), ("xone", "(p_size >= 10) = e")):
    _violations(f"logic_{_k}", _LOGIC, f"c:S sh:targetClass c:part ; sh:{_k} ({_A} {_B}) .", f"SELECT {_iri('part', 'p_partkey')} AS focus, '{_k.capitalize()}' AS component FROM (SELECT *, p_type IN ('ECONOMY', 'STANDARD') AS e FROM part) WHERE {_test}")
_violations("logic_not", _LOGIC, f"c:S sh:targetClass c:part ; sh:not {_A} .", f"SELECT {_iri('part', 'p_partkey')} AS focus, 'Not' AS component FROM part WHERE p_size >= 10")
_violations("node_shape", ["orders.o_custkey", "customer.c_acctbal"], "c:S sh:targetSubjectsOf p:o_custkey ; sh:property [ sh:path p:o_custkey ; sh:node [ sh:property [ sh:path p:c_acctbal ; sh:minInclusive 0 ] ] ] .", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'Node' AS component, {_iri('customer', 'o_custkey')} AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0", True)
_violations("property_nested", ["orders.o_custkey", "customer.c_acctbal"], "c:S sh:targetSubjectsOf p:o_custkey ; sh:property [ sh:path p:o_custkey ; sh:property [ sh:path p:c_acctbal ; sh:minInclusive 0 ] ] .", f"SELECT {_iri('customer', 'o_custkey')} AS focus, 'MinInclusive' AS component FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
_violations("closed_shape", ["nation", "nation.n_name", "nation.n_regionkey"], "c:S sh:targetClass c:nation ; sh:closed true ; sh:ignoredProperties (rdf:type) ; sh:property [ sh:path p:n_name ] .", f"SELECT {_iri('nation', 'n_nationkey')} AS focus, 'Closed' AS component, {_iri('region', 'n_regionkey')} AS value FROM nation", True)
_violations("sparql_constraint", ["orders.o_custkey", "customer.c_nationkey", "nation.n_regionkey"], """c:S sh:targetSubjectsOf p:o_custkey ; sh:sparql [ sh:select "SELECT $this ?value WHERE { $this <urn:p/o_custkey>/<urn:p/c_nationkey> ?value . FILTER NOT EXISTS { ?value <urn:p/n_regionkey> <urn:t/region/0> } }" ] .""", f"SELECT {_iri('orders', 'o_orderkey')} AS focus, 'SPARQL' AS component, {_iri('nation', 'c_nationkey')} AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0", True)

FLAGSHIP = """c:Order a sh:NodeShape ; sh:targetClass c:orders ;
  sh:property [ sh:path p:holds ; sh:minCount 1 ; sh:severity sh:Warning ] ;
  sh:property [ sh:path p:o_orderstatus ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:in ("F" "O") ] ;
  sh:property [ sh:path p:o_orderdate ; sh:lessThan p:l_shipdate ; sh:severity sh:Info ] ;
  sh:property [ sh:path p:o_custkey ; sh:minCount 1 ; sh:property [ sh:path p:c_acctbal ; sh:minInclusive 0 ] ] ."""


def _order_graph(t: Tables) -> DataFrame:
    return t.graph("orders", "orders.o_orderstatus", "orders.o_orderdate", "orders.o_custkey", "customer.c_acctbal", links(t), _line_dates(t))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of a node shape of orders."""
    return shacl.validate(_order_graph(Tables(spark, sf_dir)), PREFIXES + FLAGSHIP).flat()


@query(f"""WITH v AS (
SELECT '{SH}Warning' AS severity, 'MinCount' AS component FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT '{SH}Violation', 'In' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT '{SH}Info', 'LessThan' FROM (SELECT DISTINCT o_orderkey, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE NOT o_orderdate < l_shipdate
UNION ALL SELECT '{SH}Violation', 'MinInclusive' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)
SELECT severity, component, count(*) AS n FROM v GROUP BY ALL""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shacl.validate(_order_graph(Tables(spark, sf_dir)), PREFIXES + FLAGSHIP).by_severity()
    return out.select("severity", F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component"), "n")


@query(f"""WITH v AS (SELECT count(*) AS k FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
SELECT * FROM (SELECT '<{SH}conforms>' AS predicate, 1::BIGINT AS n UNION ALL SELECT '<{SH}result>', k FROM v UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', k + 1 FROM v
UNION ALL SELECT unnest(['<{SH}focusNode>', '<{SH}value>', '<{SH}resultSeverity>', '<{SH}sourceConstraintComponent>', '<{SH}sourceShape>', '<{SH}resultPath>']), k FROM v)""")
def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation report as triples, counted by predicate."""
    shape = 'c:S sh:targetSubjectsOf p:o_orderstatus ; sh:property [ sh:path p:o_orderstatus ; sh:in ("F" "O") ] .'
    report = shacl.validate(Tables(spark, sf_dir).graph("orders.o_orderstatus"), PREFIXES + shape).report()
    return report.groupBy(F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("predicate")).agg(F.count("*").alias("n"))


# ShEx


def _shex(name: str, parts, schema: str, targets: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        graph = t.graph(*(parts(t) if callable(parts) else parts))
        prefixes = {"c": "urn:c/", "p": "urn:p/", "t": "urn:t/", "": "urn:shape/"}
        fixed = shapemap.fix(graph, shapemap.parse(targets, prefixes))
        out = shapemap.results(shex.Validator(graph, shex.load(SHEX + schema)).validate(fixed.select("node", "shape")))
        return out.select("node", "shape", "status")

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _status(table: str, key: str, test: str, rows: str) -> str:
    return f"SELECT {_iri(table, key)} AS node, 'urn:shape/S' AS shape, CASE WHEN {test} THEN 'conformant' ELSE 'nonconformant' END AS status FROM {rows}"


_shex("shex_flat_shape", ["customer.c_acctbal", "customer.c_mktsegment", "customer.c_nationkey"], ':S { p:c_acctbal xsd:double MININCLUSIVE 0 ; p:c_mktsegment ["MACHINERY" "AUTO"~ "H"~ - "HX"~] ; p:c_nationkey IRI }', "{FOCUS p:c_acctbal _}@:S", _status("customer", "c_custkey", "c_acctbal >= 0 AND (c_mktsegment = 'MACHINERY' OR c_mktsegment LIKE 'AUTO%' OR c_mktsegment LIKE 'H%' AND c_mktsegment NOT LIKE 'HX%')", "customer"))
_shex("shex_cardinality", lambda t: [links(t), "orders.o_custkey"], ":S { p:holds IRI{2,5} ; p:o_custkey . }", "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "n BETWEEN 2 AND 5", "(SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"))
_shex("shex_closed", lambda t: [_flags(t), "orders.o_custkey"], ":S CLOSED { p:l_returnflag .+ ; p:o_custkey . }", "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "FALSE", "orders"))
_shex("shex_extra", lambda t: [_flags(t), "orders.o_custkey"], ':S EXTRA p:l_returnflag { p:l_returnflag ["A"] ; p:l_linestatus ["F"]* }', "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "a AND NOT o", "(SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'A'), FALSE) AS a, coalesce(bool_or(l_linestatus <> 'F'), FALSE) AS o FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"))
_FLAGSETS = "(SELECT o_orderkey, count(DISTINCT l_returnflag) AS r, count(DISTINCT l_linestatus) AS l FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"
_shex("shex_oneof", lambda t: [_flags(t), "orders.o_custkey"], ":S { p:o_custkey . ; (p:l_returnflag .{3} | p:l_linestatus .{1} ; p:l_returnflag .{1,2}) }", "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "r = 3 AND l = 0 OR l = 1 AND r BETWEEN 1 AND 2", _FLAGSETS))
_shex("shex_group_repeat", lambda t: [_flags(t), "orders.o_custkey"], ":S { (p:l_returnflag . ; p:l_linestatus .){1,2} ; p:l_returnflag .? }", "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "l BETWEEN 1 AND 2 AND r - l BETWEEN 0 AND 1", _FLAGSETS))
_shex("shex_repeated_predicate", lambda t: [_flags(t), "orders.o_custkey"], ':S { p:l_returnflag ["A" "R"] ; p:l_returnflag ["R" "N"] ; p:l_returnflag ["N"]? ; p:l_linestatus .* }', "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "f IN ('A,R', 'A,N', 'N,R', 'A,N,R')", "(SELECT o_orderkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS f FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"))
_shex("shex_negation", ["customer.c_acctbal", "orders.o_custkey"], ":S { p:o_custkey NOT @:Poor } :Poor { p:c_acctbal MAXEXCLUSIVE 0 }", "{FOCUS p:o_custkey _}@:S", _status("orders", "o_orderkey", "c_acctbal >= 0", "orders JOIN customer ON c_custkey = o_custkey"))
_shex("shex_inverse", ["orders.o_custkey"], ":S { ^p:o_custkey IRI{8,12} }", "{_ p:o_custkey FOCUS}@:S", _status("customer", "k", "n BETWEEN 8 AND 12", "(SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)"))
_shex("shex_boolean", ["part.p_size", "part.p_type"], ':S { p:p_size MININCLUSIVE 10 } AND { p:p_type ["ECONOMY" "STANDARD"] } OR NOT { p:p_size MAXINCLUSIVE 40 }', "{FOCUS p:p_size _}@:S", _status("part", "p_partkey", "p_size >= 10 AND p_type IN ('ECONOMY', 'STANDARD') OR p_size > 40", "part"))
_shex("shex_recursive", lambda t: [_turns(t), t.column("conversations", "role"), _long(t)], ':S { p:role ["user" "assistant" "system"] ; p:long ["false"] ; p:next @:S? }', "{FOCUS p:role _}@:S", _CHAIN % "SELECT conv_id, turn AS a, turn AS b FROM c" + f"SELECT {_iri('conversations', 'conv_id', 'a')} AS node, 'urn:shape/S' AS shape, CASE WHEN bool_or(length(text) > 1500) THEN 'nonconformant' ELSE 'conformant' END AS status FROM r JOIN conversations t ON t.conv_id = r.conv_id AND t.turn = r.b GROUP BY r.conv_id, a".replace("'<urn:t/conversations/' || conv_id", "'<urn:t/conversations/' || r.conv_id"))


def _long(t: Tables) -> DataFrame:
    """An arc from each turn that tells whether its text has over 1,500 characters."""
    c = t.table("conversations")
    return c.select(row("conversations", F.col("conv_id"), F.col("turn")).alias("s"), F.lit(prop("long")).alias("p"), node(LITERAL, (F.char_length("text") > 1500).cast("string"), XSD + "string").alias("o")).distinct()


@query(f"SELECT {_iri('customer', 'c_custkey')} AS node, 'urn:shape/A' AS shape FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {_iri('nation', 'n_nationkey')}, 'urn:shape/B' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT DISTINCT {_iri('customer', 'c_custkey')}, 'urn:shape/C' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def shape_map_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple patterns and a path selector of a shape map."""
    graph = Tables(spark, sf_dir).graph("customer.c_nationkey", "nation.n_regionkey")
    found = shapemap.parse("{FOCUS p:c_nationkey <urn:t/nation/3>}@:A, {_ p:c_nationkey FOCUS}@:B, {FOCUS p:c_nationkey/p:n_regionkey <urn:t/region/2>}@:C", {"p": "urn:p/", "": "urn:shape/"})
    return shapemap.fix(graph, found).select(text(F.col("node")).alias("node"), "shape")


@query(f"SELECT DISTINCT {_iri('customer', 'c_custkey')} AS x, {_iri('region', 'n_regionkey')} AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000")
def sparql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Tables(spark, sf_dir).graph("customer.c_nationkey", "customer.c_acctbal", "nation.n_regionkey")
    out = sq.select(graph, "SELECT ?x ?r WHERE { ?x <urn:p/c_acctbal> ?b ; <urn:p/c_nationkey> ?n . ?n <urn:p/n_regionkey> ?r . FILTER (?b > 9000) }")
    return out.select(text(F.col("x")).alias("x"), text(F.col("r")).alias("r")).distinct()


# the minimal language, inference, conversion, export


@query(_status("orders", "o_orderkey", "n >= 2 AND NOT bad", "(SELECT o_orderkey, count(DISTINCT l_partkey) FILTER (p_size >= 0) AS n, coalesce(bool_or(l_partkey % 7 = 0), FALSE) AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)").replace("'conformant'", "'+'").replace("'nonconformant'", "'-'"))
def slang_qualified_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two qualified arcs and a negation: parts held with a typed size, and none whose mark is an IRI."""
    t = Tables(spark, sf_dir)
    mark = t.table("part").filter("p_partkey % 7 = 0").select(row("part", F.col("p_partkey")).alias("s"), F.lit(prop("mark")).alias("p"), constant(iri("urn:x")).alias("o"))
    graph = t.graph("orders", links(t), "part.p_size", mark)
    holds = P.Pred(prop("holds"))
    shapes: dict = {
        "urn:shape/Sized": slang.QualifiedArc(P.Pred(prop("p_size")), slang.Datatype(XSD + "integer"), 1, 1),
        "urn:shape/S": slang.And(slang.QualifiedArc(holds, slang.Ref("urn:shape/Sized"), 2, -1), slang.Not(slang.QualifiedArc(holds, slang.QualifiedArc(P.Pred(prop("mark")), slang.IRIKind(), 1, -1), 1, -1))),
    }
    targets = t.types("orders").select(F.col("s").alias("node"), F.lit("urn:shape/S").alias("shape"))
    return slang.show(slang.Validator(graph, shapes).validate(targets))


@query(f"""SELECT '<urn:p/holds>' AS p, 'iri' AS "constraint", '' AS datatype, 0::BIGINT AS min, -1::BIGINT AS max, (SELECT max(n) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey)) AS max_number
UNION ALL SELECT '<urn:p/o_custkey>', 'iri', '', 1, 1, 1 UNION ALL SELECT '<urn:p/o_orderdate>', 'datatype', '{XSD}dateTime', 1, 1, 1 UNION ALL SELECT '<urn:p/o_orderstatus>', 'datatype', '{XSD}string', 1, 1, 1 UNION ALL SELECT '<urn:p/o_totalprice>', 'datatype', '{XSD}double', 1, 1, 1""")
def infer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    graph = t.graph(links(t), "orders.o_custkey", "orders.o_orderdate", "orders.o_orderstatus", "orders.o_totalprice")
    out = infer.predicates(graph, t.types("orders").select(F.col("s").alias("node")))
    return out.select(F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), "constraint", "datatype", "min", "max", "max_number")


@query(f"SELECT {_iri('customer', 'c_custkey')} AS focus, 'MinInclusive' AS component FROM customer WHERE c_acctbal < 0 UNION ALL SELECT {_iri('customer', 'c_custkey')}, 'In' FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')")
def convert_shex_to_shacl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ShEx schema converted to SHACL, and the violations of that."""
    schema = shex.load(SHEX + ':S { p:c_acctbal MININCLUSIVE 0 ; p:c_mktsegment ["MACHINERY" "HOUSEHOLD"] }')
    found = shapemap.parse("{FOCUS p:c_acctbal _}@:S", {"p": "urn:p/", "": "urn:shape/"})
    shapes = S.read(convert.shex_to_shacl(schema, found))
    graph = Tables(spark, sf_dir).graph("customer.c_acctbal", "customer.c_mktsegment")
    out = shacl.Validator(graph, shapes).validate().flat()
    return out.select("focus", F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component"))


@query(_status("customer", "c_custkey", "c_acctbal >= 0 AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')", "customer").replace("urn:shape/S", "urn:c/S"))
def convert_shacl_to_shex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHACL shapes converted to ShEx with their shape map, and its result."""
    data = 'c:S a sh:NodeShape ; sh:targetSubjectsOf p:c_acctbal ; sh:property [ sh:path p:c_acctbal ; sh:minInclusive 0 ; sh:maxCount 1 ], [ sh:path p:c_mktsegment ; sh:in ("MACHINERY" "HOUSEHOLD") ] .'
    body, found = convert.shacl_to_shex(shacl.shapes_of(PREFIXES + data))
    graph = Tables(spark, sf_dir).graph("customer.c_acctbal", "customer.c_mktsegment")
    checked = shex.Validator(graph, shex.Schema(body)).validate(shapemap.fix(graph, found).select("node", "shape"))
    return shapemap.results(checked).select("node", "shape", "status")


@query("""SELECT 'arc("urn:t/nation/' || n_nationkey || '", "urn:p/n_name", l("' || n_name || '", "http://www.w3.org/2001/XMLSchema#string")).' AS fact FROM nation
UNION ALL SELECT 'iri("urn:t/nation/' || n_nationkey || '").' FROM nation UNION ALL SELECT DISTINCT 'literal(l("' || n_name || '", "http://www.w3.org/2001/XMLSchema#string"), "http://www.w3.org/2001/XMLSchema#string").' FROM nation""")
def asp_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asp.facts(Tables(spark, sf_dir).graph("nation.n_name")).select(F.col("value").alias("fact"))


@query("SELECT 'urn:p/holds' AS p, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def count_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(Tables(spark, sf_dir)).groupBy("p").agg(F.count_distinct("s", "o").alias("n"))


_GRAPH = "g AS (SELECT '<urn:t/customer/' || c_custkey || '>' AS s, 'urn:p/c_nationkey' AS p, '<urn:t/nation/' || c_nationkey || '>' AS o FROM customer UNION ALL SELECT '<urn:t/nation/' || n_nationkey || '>', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '<urn:t/region/' || n_regionkey || '>' FROM nation), t AS (SELECT s AS x FROM g UNION SELECT o FROM g), k AS (SELECT x, 'N' || (row_number() OVER (ORDER BY x) - 1) AS id FROM t)"


def _viz_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.graph("customer.c_nationkey", t.column("nation", "n_regionkey").withColumn("p", F.lit(TYPE)))


@query(f"WITH {_GRAPH} SELECT id, substr(x, 2, length(x) - 2) AS label, 'iri' AS type FROM k")
def sgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.nodes(_viz_graph(spark, sf_dir)).select("id", "label", "type")


@query(f"WITH {_GRAPH} SELECT a.id AS source, b.id AS target, CASE WHEN p LIKE '%#type' THEN 'a' ELSE p END AS label, p AS href FROM g JOIN k a ON a.x = s JOIN k b ON b.x = o")
def sgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _viz_graph(spark, sf_dir)
    return viz.edges(g, viz.nodes(g))


@query(f"WITH {_GRAPH} SELECT x AS node, (SELECT count(*) FROM g WHERE s = x) AS n_out, (SELECT count(*) FROM g WHERE o = x) AS n_in FROM t")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.degrees(_viz_graph(spark, sf_dir)).select(text(F.col("node")).alias("node"), "n_out", "n_in")


# sources and sinks


@query(f"SELECT '<urn:t/orders/' || o_orderkey || '> <urn:p/o_orderpriority> \"' || o_orderpriority || '\" .' AS line FROM orders UNION ALL SELECT '<urn:t/part/' || p_partkey || '> <urn:p/p_size> \"' || p_size || '\"^^<{XSD}integer> .' FROM part")
def ntriples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as N-Triples in the shared folder, and read back."""
    path = shared.path(spark, "ntriples")
    rdf.write(Tables(spark, sf_dir).graph("orders.o_orderpriority", "part.p_size"), path)
    return rdf.lines(rdf.read(spark, path)).select(F.col("value").alias("line"))


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS n")
def merge_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    a, b = t.graph("customer.c_nationkey"), t.graph("customer.c_nationkey", "nation.n_regionkey")
    return rdf.merge(a, b).agg(F.count("*").alias("n"))


@query(f"""SELECT {_iri('customer', 'c_custkey')} AS node, {_iri('nation', 'c_nationkey')} AS class FROM customer UNION ALL SELECT {_iri('customer', 'c_custkey')}, {_iri('region', 'n_regionkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT {_iri('orders', 'o_orderkey')}, '<urn:c/order>' FROM orders UNION ALL SELECT DISTINCT {_iri('customer', 'o_custkey')}, '<urn:c/buyer>' FROM orders""")
def rdfs_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that subclasses, a domain and a range entail."""
    t = Tables(spark, sf_dir)
    rules = rdf.frame(spark, [(iri(prop("o_custkey")), RDFS + "domain", iri("urn:c/order")), (iri(prop("o_custkey")), RDFS + "range", iri("urn:c/buyer"))])
    out = rdf.infer(t.graph(_ontology(t), "orders.o_custkey", rules), "RDFS").filter(F.col("p") == TYPE)
    return out.select(text(F.col("s")).alias("node"), text(F.col("o")).alias("class"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more_queries  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more_queries  # noqa: F401

    return dict(SQL)


