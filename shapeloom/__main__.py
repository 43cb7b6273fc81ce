"""Command line: python -m shapeloom --schema S --data D [--shapeMap M] ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from . import api
from .operators import infer, shapemap, viz
from .sources import rdf


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shapeloom", description="Validate graphs against ShEx and SHACL shapes on Spark.")
    a = p.add_argument
    a("--data", help="data file or folder that Spark can read")
    a("--dataFormat", default="turtle", help=", ".join(rdf.FORMATS))
    a("--schema", help="schema file; without it the data graph holds the schema")
    a("--schemaFormat", default=None)
    a("--engine", default="ShEx", help=", ".join(api.ENGINES))
    a("--trigger", default=None, help=", ".join(api.TRIGGERS))
    a("--shapeMap", help="shape map file")
    a("--node")
    a("--shape")
    a("--inference", default="NONE")
    a("--validate", action=argparse.BooleanOptionalAction, default=True)
    a("--showSchema", action="store_true")
    a("--outSchemaFormat", default=None)
    a("--outSchemaFile")
    a("--convert", metavar="ENGINE", help="show the schema in another language")
    a("--showResult", default="COMPACT", help="COMPACT, DETAILS or JSON")
    a("--outResult", help="folder for the result as JSON lines")
    a("--outReport", help="folder for the validation report as N-Triples")
    a("--showClingo", action="store_true")
    a("--clingoFile", help="folder for the program's facts and rules")
    a("--infer", metavar="SHAPE", help="infer a shape of this label for --node or all nodes of --shapeMap")
    a("--dot", help="folder for the data graph as DOT")
    a("--shell", action="store_true", help="an interactive shell: :help, :load FILE, :quit")
    a("--time", action="store_true")
    return p


def text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def shell(read=input, write=print) -> None:
    while (line := read("> ").strip()) not in (":quit", ":q"):
        if line == ":help":
            write(":help  this text\n:load FILE  name a file\n:quit  leave")
        elif line.startswith(":load"):
            write(f"load {line.removeprefix(':load').strip()}")
        elif line:
            write(f"unknown command {line}; try :help")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = options().parse_args(argv)
    if o.shell:
        shell()
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    began = time.time()
    graph = rdf.infer(rdf.from_path(spark, o.data, o.dataFormat), o.inference)
    is_shex = api.lookup(o.engine) == "ShEx"
    if o.dot:
        viz.dot(graph).orderBy("part", "value").select("value").write.text(o.dot)
    mapped = text(spark, o.shapeMap) if o.shapeMap else ""
    if o.infer:
        from pyspark.sql import functions as F

        nodes = shapemap.fix(graph, shapemap.parse(mapped)) if mapped else None
        if nodes is None:
            from .sources.terms import constant, iri

            nodes = spark.range(1).select(constant(iri(api.resolve(o.node, {}))).alias("node"))
        body, _ = infer.infer(graph, nodes.select(F.col("node")).distinct(), o.infer)
        print(api.ShExSchema(api.shex.Schema(body)).serialize(o.outSchemaFormat or "ShExC"))
        return 0
    if o.schema:
        schema = api.schema(text(spark, o.schema), o.schemaFormat or ("ShExC" if is_shex else "turtle"), o.engine)
    else:
        schema = api.schema_from_graph(graph, o.engine)
    if o.showSchema or o.outSchemaFile or o.convert:
        out = schema.convert(o.convert, *([o.outSchemaFormat] if o.outSchemaFormat else [])) if o.convert else schema.serialize(*([o.outSchemaFormat] if o.outSchemaFormat else []))
        if o.outSchemaFile:
            with open(o.outSchemaFile, "w", encoding="utf-8") as f:
                f.write(out)
        else:
            print(out)
    if (o.showClingo or o.clingoFile) and is_shex:
        asked = [(a.selector, a.shape) for a in shapemap.parse(mapped) if not isinstance(a.selector, (str, tuple)) or hasattr(a.selector, "nt")]
        facts, rules = schema.to_asp(graph, asked)
        if o.clingoFile:
            facts.unionByName(spark.createDataFrame([(x,) for x in rules.splitlines()], "value string")).write.text(o.clingoFile)
        else:
            print(rules)
    if not o.validate:
        return 0
    trigger = o.trigger or ("ShapeMap" if mapped else "NodeShape" if o.node and o.shape else "NodeStart" if o.node else "TargetDecls")
    result = schema.validate(graph, trigger=trigger, shape_map=mapped, node=o.node or "", shape=o.shape or "")
    print(result.show(o.showResult))
    if o.outResult:
        result.to_json().write.text(o.outResult)
    if o.outReport and result.violations is not None:
        rdf.write(result.report(), o.outReport)
    if o.time:
        print(f"Elapsed: {1000 * (time.time() - began):.0f} ms")
    return 0 if result.valid else 1


if __name__ == "__main__":
    raise SystemExit(main())

