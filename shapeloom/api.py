"""The facade: schemas of either language by engine name, and their validation, conversion and inspection."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import asp, convert, shacl, shapemap, shex, shexr
from .plans import shapes as S
from .plans import shexc, slang
from .sources import rdf
from .sources.terms import SH, Node, iri, text

ENGINES = ("ShEx", "SHACL")
TRIGGERS = ("TargetDecls", "ShapeMap", "NodeShape", "NodeStart")


@dataclass
class Result:
    """valid, a message, the result map (node, shape, status, reason), the report's violations and errors."""

    result_map: DataFrame | None = None
    violations: shacl.Result | None = None
    errors: list[str] = field(default_factory=list)
    trigger: str = ""

    @property
    def valid(self) -> bool:
        if self.errors:
            return False
        if self.violations is not None:
            return self.violations.conforms()
        return self.result_map.filter(F.col("status") != F.col("expected") if "expected" in self.result_map.columns else F.col("status") != "conformant").isEmpty()

    @property
    def message(self) -> str:
        if self.errors:
            return self.errors[0]
        return "Valid" if self.valid else f"Number of violations: {self.violations.count()}" if self.violations is not None else "Not valid"

    def report(self) -> DataFrame | None:
        return self.violations.report() if self.violations is not None else None

    def to_json(self) -> DataFrame:
        """The result map or violations as JSON lines (column value); a distributed table."""
        rows = self.result_map if self.result_map is not None else self.violations.flat()
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    def show(self, kind: str = "COMPACT", n: int = 20) -> str:
        """A short text in COMPACT, DETAILS or JSON form, with at most n lines."""
        rows = (self.result_map if self.result_map is not None else self.violations.flat()).limit(n).collect() if not self.errors else []
        if kind.upper() == "JSON":
            return json.dumps({"valid": self.valid, "type": "Result", "message": self.message, "trigger": self.trigger, "errors": self.errors, "shapeMap": [r.asDict() for r in rows]})
        if kind.upper() == "DETAILS":
            return "\n".join([self.message, *(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)])
        return self.message


class Schema:
    """A parsed schema with its engine: name, formats, validate, serialize, convert, shapes, info, to_asp."""

    formats: tuple[str, ...] = ()

    def __init__(self, name: str):
        self.name = name


class ShExSchema(Schema):
    formats = ("ShExC", "ShExJ", *rdf.FORMATS)

    def __init__(self, inner: shex.Schema, name: str = "ShEx"):
        super().__init__(name)
        self.inner = inner
        self.prefixes = inner.body.get("prefixes", {})

    @property
    def shapes(self) -> list[str]:
        return list(self.inner.shapes)

    def info(self) -> dict:
        errors = self.inner.check()
        return {"name": self.name, "engine": self.name, "wellFormed": not errors, "errors": errors}

    def validate(self, graph: DataFrame, trigger: str = "ShapeMap", shape_map: str = "", node: str = "", shape: str = "", prefixes: dict[str, str] | None = None) -> Result:
        try:
            found = associations(graph, trigger, shape_map, node, shape, prefixes or {}, self.prefixes)
            targets = shapemap.fix(graph, found) if isinstance(found, list) else found
            if targets is None:
                return Result(errors=["the shape map is empty"], trigger=trigger)
            checked = shex.Validator(graph, self.inner).validate(targets.select("node", "shape"))
            rows = shapemap.results(checked)
            want = targets.select(text(F.col("node")).alias("_n"), F.col("shape").alias("_s"), "expected")
            return Result(rows.join(want, (F.col("node") == F.col("_n")) & (F.col("shape") == F.col("_s"))).drop("_n", "_s"), trigger=trigger)
        except (ValueError, SyntaxError) as e:
            return Result(errors=[str(e)], trigger=trigger)

    def serialize(self, format: str = "ShExC") -> str:
        body = {k: v for k, v in self.inner.body.items() if k != "prefixes"}
        kind = format.lower()
        if kind == "shexc":
            return shexc.show(self.inner.body)
        if kind == "shexj":
            return json.dumps({"@context": "http://www.w3.org/ns/shex.jsonld", **body}, indent=2)
        if kind in ("turtle", "n-triples", "trig", "n-quads"):
            return convert.shacl_text(shexr.write(body))
        raise ValueError(f"ShEx schemas aren't written as {format}")

    def convert(self, engine: str, format: str = "Turtle", shape_map: str = "") -> str:
        if lookup(engine) == "ShEx":
            return self.serialize(format)
        found = shapemap.parse(shape_map, self.prefixes) if shape_map else []
        return convert.shacl_text(convert.shex_to_shacl(self.inner, found))

    def to_asp(self, graph: DataFrame, asked: list[tuple[Node, str]]) -> tuple[DataFrame, str]:
        return asp.program(graph, slang.lower(self.inner), asked)


class ShaclSchema(Schema):
    formats = (*rdf.FORMATS, "TREE")

    def __init__(self, triples, name: str = "SHACL"):
        super().__init__(name)
        self.triples = list(triples)
        self.inner = S.read(self.triples)

    @property
    def shapes(self) -> list[str]:
        return [x.nt() for x in self.inner]

    def info(self) -> dict:
        return {"name": self.name, "engine": self.name, "wellFormed": True, "errors": []}

    def validate(self, graph: DataFrame, trigger: str = "TargetDecls", **_) -> Result:
        if trigger.lower() != "targetdecls":
            return Result(errors=[f"{self.name} validates target declarations only, not {trigger}"], trigger=trigger)
        try:
            return Result(violations=shacl.Validator(graph, self.inner).validate(), trigger=trigger)
        except ValueError as e:
            return Result(errors=[str(e)], trigger=trigger)

    def serialize(self, format: str = "Turtle") -> str:
        if format.lower() == "tree":
            return "\n".join(f"{x.nt()}: {s}" for x, s in self.inner.items())
        if format.lower() not in ("turtle", "n-triples", "trig", "n-quads"):
            raise ValueError(f"SHACL schemas aren't written as {format}")
        return convert.shacl_text(self.triples)

    def convert(self, engine: str, format: str = "ShExC") -> str:
        if lookup(engine) != "ShEx":
            return self.serialize(format)
        body, _ = convert.shacl_to_shex(self.inner)
        return ShExSchema(shex.Schema(body)).serialize(format)

    def target_map(self) -> list[str]:
        return [shapemap.show(a) for a in convert.target_map(self.inner)]


def lookup(engine: str = "ShEx") -> str:
    """The engine that a name stands for, in any case: both languages have one, whatever else a name adds."""
    for e in ENGINES:
        if e.lower() in engine.lower():
            return e
    raise ValueError(f"unknown engine {engine}; known are {', '.join(ENGINES)}")


def schema(data: str, format: str = "ShExC", engine: str = "ShEx", base: str = "", fetch=None) -> ShExSchema | ShaclSchema:
    """A schema from a text."""
    name = lookup(engine)
    if name == "ShEx":
        return ShExSchema(shex.load(data, "turtle" if format.lower() in rdf.FORMATS else format, base, fetch), name)
    return ShaclSchema(rdf.parse(data, format, base), name)


def schema_from_graph(graph: DataFrame, engine: str = "SHACL") -> ShExSchema | ShaclSchema:
    """The schema that a data graph itself holds; only triples of the shapes' vocabularies and lists are collected."""
    name = lookup(engine)
    words = graph.filter(F.col("p").startswith(SH) | F.col("p").startswith("http://www.w3.org/ns/shex#") | F.col("p").startswith("http://www.w3.org/1999/02/22-rdf-syntax-ns#") & (~F.col("p").endswith("#type") | F.col("o")["lex"].startswith(SH) | F.col("o")["lex"].startswith("http://www.w3.org/ns/shex#") | F.col("o")["lex"].endswith("#Class")))
    triples = [(Node(*r["s"]), r["p"], Node(*r["o"])) for r in words.collect()]
    if name == "ShEx":
        return ShExSchema(shex.Schema(shexr.read(convert.shacl_text(triples))), name)
    return ShaclSchema(triples, name)


def resolve(x: str, prefixes: dict[str, str], base: str = "") -> str:
    """<x>, p:x or x as an IRI."""
    if x.startswith("<") and x.endswith(">"):
        from urllib.parse import urljoin

        return urljoin(base, x[1:-1]) if base else x[1:-1]
    p, colon, rest = x.partition(":")
    return prefixes[p] + rest if colon and p in prefixes and not rest.startswith("//") else x


def associations(graph: DataFrame, trigger: str, shape_map: str, node: str, shape: str, prefixes: dict[str, str], shape_prefixes: dict[str, str]):
    """What a trigger asks for: associations, or (node, shape, expected) of the data's sh:targetNode triples."""
    t = trigger.lower()
    if t == "targetdecls":
        rows = graph.filter((F.col("p") == SH + "targetNode")).select(F.col("o").alias("node"), F.col("s")["lex"].alias("shape"), F.lit("conformant").alias("expected"))
        return None if rows.isEmpty() else rows.distinct()
    if t == "shapemap":
        return shapemap.parse(shape_map, prefixes, shape_prefixes | prefixes)
    if t in ("nodeshape", "nodestart"):
        if not node or t == "nodeshape" and not shape:
            raise ValueError(f"{trigger} needs a node" + " and a shape" * (t == "nodeshape"))
        return [shapemap.Association(iri(resolve(node, prefixes)), "START" if t == "nodestart" else resolve(shape, shape_prefixes | prefixes))]
    raise ValueError(f"unknown trigger {trigger}; known are {', '.join(TRIGGERS)}")


def validate(spark: SparkSession, data: str, schema_text: str, data_format: str = "turtle", schema_format: str = "ShExC", engine: str = "ShEx", inference: str = "NONE", **kw) -> Result:
    """Texts in, a result out."""
    graph = rdf.infer(rdf.from_string(spark, data, data_format), inference)
    return schema(schema_text, schema_format, engine).validate(graph, **kw)


__all__ = ["ENGINES", "TRIGGERS", "Result", "Schema", "ShExSchema", "ShaclSchema", "lookup", "resolve", "schema", "schema_from_graph", "validate"]
