"""Schema inference: a shape of the predicates that a set of nodes has.

For each predicate the constraint is the least upper bound of its objects' types, the cardinality {1,1}
if no node has it twice and {0,*} otherwise. Aggregation has no order, so the bound is the symmetric one;
with `support=True` a predicate that some nodes lack gets the minimum 0 as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.terms import LANGSTRING, LITERAL, RDFS, SX, XSD

# fixed values: prefixes that are added to an inferred schema if it uses them
KNOWN = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": RDFS, "xsd": XSD, "sx": SX, "foaf": "http://xmlns.com/foaf/0.1/", "schema": "http://schema.org/", "skos": "http://www.w3.org/2004/02/skos/core#", "dct": "http://purl.org/dc/terms/", "wd": "http://www.wikidata.org/entity/", "wdt": "http://www.wikidata.org/prop/direct/"}


@dataclass
class Options:
    plain_node: bool = True  # type nodes at all
    label: bool = False  # annotate predicates with rdfs:label
    label_lang: str = "en"
    max_follow: int = 1  # depth at which follow-on rules stop
    follow: dict[str, str] = field(default_factory=dict)  # predicate -> label of the shape to infer for its objects
    support: bool = False
    sort: object = None  # key function over predicate IRIs
    prefixes: dict[str, str] = field(default_factory=dict)


def predicates(graph: DataFrame, nodes: DataFrame, plain_node: bool = True, support: bool = False) -> DataFrame:
    """(p, constraint, datatype, lang, min, max, max_number, nodes) for the distinct nodes (column node).

    constraint is one of iri, bnode, literal, datatype, lang, langstring, any; max is -1 for unbounded.
    """
    arcs = nodes.join(graph, F.col("node") == F.col("s")).select("node", "p", "o")
    o = F.col("o")
    per = arcs.groupBy("node", "p").agg(F.count("*").alias("k"), F.min(o["kind"]).alias("k0"), F.max(o["kind"]).alias("k1"), F.min(o["dt"]).alias("d0"), F.max(o["dt"]).alias("d1"), F.min(o["lang"]).alias("l0"), F.max(o["lang"]).alias("l1"))
    out = per.groupBy("p").agg(F.max("k").cast("long").alias("max_number"), F.count("*").alias("nodes"), F.min("k0").alias("k0"), F.max("k1").alias("k1"), F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("l0").alias("l0"), F.max("l1").alias("l1"))
    one_dt = (F.col("k0") == LITERAL) & (F.col("d0") == F.col("d1"))
    kind = (
        F.when(F.lit(not plain_node), "any").when(F.col("k0") != F.col("k1"), "any").when(F.col("k0") == 0, "iri").when(F.col("k0") == 1, "bnode")
        .when(one_dt & (F.col("d0") == LANGSTRING) & (F.col("l0") == F.col("l1")), "lang").when(one_dt & (F.col("d0") == LANGSTRING), "langstring").when(one_dt, "datatype").otherwise("literal")
    )
    out = out.withColumn("constraint", kind)
    low = F.when(F.col("max_number") > 1, 0).otherwise(1)
    if support:
        low = F.when(F.col("nodes") < F.lit(nodes.count()), 0).otherwise(low)
    return out.select(
        "p", "constraint", F.when(F.col("constraint") == "datatype", F.col("d0")).otherwise("").alias("datatype"), F.when(F.col("constraint") == "lang", F.col("l0")).otherwise("").alias("lang"),
        low.cast("long").alias("min"), F.when(F.col("max_number") == 1, 1).otherwise(-1).cast("long").alias("max"), "max_number", "nodes",
    )


def _value(r):
    c = r["constraint"]
    if c in ("iri", "bnode", "literal"):
        return {"type": "NodeConstraint", "nodeKind": c}
    if c == "datatype":
        return {"type": "NodeConstraint", "datatype": r["datatype"]}
    if c == "lang":
        return {"type": "NodeConstraint", "values": [{"type": "Language", "languageTag": r["lang"]}]}
    return {"type": "NodeConstraint", "datatype": LANGSTRING} if c == "langstring" else None


def infer(graph: DataFrame, nodes: DataFrame, label: str, options: Options | None = None) -> tuple[dict, list[tuple[str, str]]]:
    """A ShExJ schema for the nodes and the follow-on shapes; and (predicate, label) pairs that were followed.

    Only the list of predicates reaches the driver, one row for each.
    """
    o = options or Options()
    shapes, followed, todo, done = [], [], [(label, nodes.select("node").distinct(), 1)], set()
    while todo:
        name, mine, level = todo.pop(0)
        if name in done:
            continue
        done.add(name)
        rows = predicates(graph, mine, o.plain_node, o.support).collect()
        names = _labels(graph, [r["p"] for r in rows], o.label_lang) if o.label else {}
        parts = []
        for r in sorted(rows, key=(lambda r: o.sort(r["p"])) if o.sort else lambda r: _qualified(r["p"], o.prefixes)):
            e: dict = {"type": "TripleConstraint", "predicate": r["p"]}
            if (v := _value(r)) is not None:
                e["valueExpr"] = v
            if r["p"] in o.follow and level < o.max_follow:
                e["valueExpr"] = o.follow[r["p"]]
                followed.append((r["p"], o.follow[r["p"]]))
                inner = mine.join(graph.filter(F.col("p") == r["p"]), F.col("node") == F.col("s")).filter(F.col("o")["kind"] != LITERAL).select(F.col("o").alias("node")).distinct()
                todo.append((o.follow[r["p"]], inner, level + 1))
            if (r["min"], r["max"]) != (1, 1):
                e |= {"min": r["min"], "max": r["max"]}
            notes = [{"type": "Annotation", "predicate": RDFS + "label", "object": {"value": names[r["p"]], "language": o.label_lang}}] if r["p"] in names else []
            if r["max_number"] > 1:
                notes.append({"type": "Annotation", "predicate": SX + "maxNumber", "object": {"value": str(r["max_number"]), "type": XSD + "integer"}})
            parts.append(e | ({"annotations": notes} if notes else {}))
        body: dict = {"type": "Shape", "id": name}
        if parts:
            body["expression"] = parts[0] if len(parts) == 1 else {"type": "EachOf", "expressions": parts}
        shapes.append(body)
    schema = {"type": "Schema", "shapes": shapes}
    used = str(schema)
    return schema | {"prefixes": o.prefixes | {k: v for k, v in KNOWN.items() if v in used}}, followed


def _qualified(p: str, prefixes: dict[str, str]) -> str:
    for k, v in {**KNOWN, **prefixes}.items():
        if p.startswith(v):
            return f"{k}:{p[len(v) :]}"
    return p


def _labels(graph: DataFrame, preds: list[str], lang: str) -> dict[str, str]:
    rows = graph.filter((F.col("p") == RDFS + "label") & F.col("s")["lex"].isin(*preds) & (F.col("o")["lang"] == lang)) if preds else graph.limit(0)
    return {r[0]: r[1] for r in rows.groupBy(F.col("s")["lex"]).agg(F.min(F.col("o")["lex"])).collect()}


__all__ = ["KNOWN", "Options", "infer", "predicates"]
