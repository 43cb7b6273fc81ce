"""Graph export: numbered nodes and edges, as DOT or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.paths import _cut as cut
from ..sources.terms import BNODE, IRI, TYPE, text


def _short(c, prefixes: dict[str, str]):
    out = c
    for k, v in sorted(prefixes.items(), key=lambda kv: -len(kv[1])):
        out = F.when(c.startswith(v), F.concat(F.lit(f"{k}:"), F.substring(c, len(v) + 1, 1_000_000))).otherwise(out) if out is c else F.when(c.startswith(v) & (out == c), F.concat(F.lit(f"{k}:"), F.substring(c, len(v) + 1, 1_000_000))).otherwise(out)
    return out


def nodes(graph: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(id, label, type, node): ids N0, N1, ... in the order of the terms' text.

    Ranges of the text are sorted and numbered each alone, after the counts of those before them. The ranges are written
    before they are counted: read twice, Spark may merge them differently each time, and numbers would come twice or be left out.
    """
    every = graph.select(F.col("s").alias("node")).unionByName(graph.select(F.col("o").alias("node"))).distinct().withColumn("t", text(F.col("node")))
    place = F.monotonically_increasing_id()  # the range in the upper 31 bits, the row's place in the lower 33
    part = cut(every.repartitionByRange("t").sortWithinPartitions("t").withColumn("m", place))
    part = part.select("node", "t", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    counts = part.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = part.join(F.broadcast(base), F.col("part") == F.col("_p"))
    n = F.col("node")
    kind = F.when(n["kind"] == IRI, "iri").when(n["kind"] == BNODE, "bnode").otherwise("literal")
    label = F.when(n["kind"] == IRI, _short(n["lex"], prefixes or {})).when(n["kind"] == BNODE, F.concat(F.lit("_:"), n["lex"])).otherwise(F.col("t"))
    return out.select(F.concat(F.lit("N"), (F.col("base") + F.col("k")).cast("string")).alias("id"), label.alias("label"), kind.alias("type"), "node")


def edges(graph: DataFrame, numbered: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(source, target, label, href); rdf:type is labelled a."""
    a, b = numbered.select(F.col("node").alias("_a"), F.col("id").alias("source")), numbered.select(F.col("node").alias("_b"), F.col("id").alias("target"))
    label = F.when(F.col("p") == TYPE, "a").otherwise(_short(F.col("p"), prefixes or {}))
    return graph.join(a, F.col("s") == F.col("_a")).join(b, F.col("o") == F.col("_b")).select("source", "target", label.alias("label"), F.col("p").alias("href"))


STYLE = {"iri": 'shape=ellipse, color="blue"', "bnode": 'shape=circle, color="gray"', "literal": 'shape=box, color="green"'}


def dot(graph: DataFrame, prefixes: dict[str, str] | None = None, style: dict[str, str] | None = None) -> DataFrame:
    """Lines (column value) of a DOT digraph, with a column `part` to order them by: 0 head, 1 nodes, 2 edges, 3 end."""
    numbered = nodes(graph, prefixes)
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    looks = F.lit("")
    for k, v in (STYLE | (style or {})).items():
        looks = F.when(F.col("type") == k, F.lit(v)).otherwise(looks)
    spark = graph.sparkSession
    ns = numbered.select(F.lit(1).alias("part"), F.concat(F.col("id"), F.lit(" [label="), quote(F.col("label")), F.lit(", "), looks, F.lit("]")).alias("value"))
    es = edges(graph, numbered, prefixes).select(F.lit(2).alias("part"), F.concat(F.col("source"), F.lit(" -> "), F.col("target"), F.lit(" [label="), quote(F.col("label")), F.lit(", href="), quote(F.col("href")), F.lit("]")).alias("value"))
    ends = spark.createDataFrame([(0, "digraph {"), (3, "}")], "part int, value string")
    return ends.unionByName(ns).unionByName(es)


def to_json(graph: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A JSON element a row (column value): {"data": {...}} of nodes, then of edges."""
    numbered = nodes(graph, prefixes)
    ns = numbered.select(F.to_json(F.struct(F.struct("id", "label", "type").alias("data"))).alias("value"))
    es = edges(graph, numbered, prefixes).select(F.to_json(F.struct(F.struct("source", "target", "label", "href").alias("data"))).alias("value"))
    return ns.unionByName(es)


def degrees(graph: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of every node."""
    out = graph.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.select(F.col("o").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
