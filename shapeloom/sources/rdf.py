"""Reading and writing graphs as tables of triples.

A graph is a set: `distinct` is applied once, where data come in. N-Triples and N-Quads are parsed on the
executors from lines of text; files of Turtle, TriG, RDF/JSON, RDF/XML and a JSON-LD subset are parsed on the
executors too, each in one task. Turtle and TriG pass through it statement by statement; the task holds files of the other
formats whole. Texts are parsed on the driver, for schemas and
small data. Any path that Spark can read is accepted. Named graphs are merged into one set of triples.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from urllib.parse import quote, urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import turtle
from .terms import BNODE, IRI, LANGSTRING, LITERAL, RDF, RDFS, STRING, SUBCLASS, TRIPLE, TYPE, XSD, Node, iri, literal, node, text

FORMATS = ("turtle", "n-triples", "trig", "n-quads", "rdf/json", "rdf/xml", "json-ld")
_IRI, _BN = r"<([^<>\"{}|^`\x00-\x20]*)>", r"_:([^\s<>\"]+)"
_TERMS = rf"^\s*(?:{_IRI}|{_BN})\s*{_IRI}\s*(?:{_IRI}|{_BN}|\"((?:[^\"\\]|\\.)*)\"(?:@([A-Za-z0-9-]+)|\^\^{_IRI})?)"
_LINE, _QUAD = (rf"{_TERMS}{graph}\s*\.\s*(?:#.*)?$" for graph in ("", rf"(?:\s*(?:{_IRI}|{_BN}))?"))


def _unescape(c: Column) -> Column:
    """String escapes of N-Triples; numeric ones go through a JSON string, which shares them."""
    plain = ~c.contains("\\")
    wide = F.regexp_replace(c, r"\\'", "'")
    return F.when(plain, c).otherwise(F.coalesce(F.get_json_object(F.concat(F.lit('{"x":"'), wide, F.lit('"}')), "$.x"), c))


def read(spark: SparkSession, path: str, strict: bool = True, quads: bool = False) -> DataFrame:
    """N-Triples (or N-Quads) files as triples; lines that are neither these, comments nor blank raise an error.

    strict=False drops such lines instead. A blank node's label means the same node in all files of the path.
    """
    form = _QUAD if quads else _LINE
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    g = lambda i: F.regexp_extract("value", form, i)
    ok = F.col("value").rlike(form)
    lines = lines.filter(ok) if not strict else lines.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))))
    subject_iri = F.col("value").rlike(r"^\s*<")
    s = F.struct(F.when(subject_iri, IRI).otherwise(BNODE).cast("byte").alias("kind"), F.when(subject_iri, g(1)).otherwise(g(2)).alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"))
    rest = F.regexp_replace("value", rf"^\s*(?:{_IRI}|{_BN})\s*{_IRI}\s*", "")
    kind = F.when(rest.startswith("<"), IRI).when(rest.startswith("_:"), BNODE).otherwise(LITERAL).cast("byte")
    lang = F.lower(g(7))
    lex = F.when(kind == IRI, g(4)).when(kind == BNODE, g(5)).otherwise(_unescape(g(6)))
    dt = F.when(kind != LITERAL, "").when(lang != "", LANGSTRING).when(g(8) != "", g(8)).otherwise(STRING)
    o = F.struct(kind.alias("kind"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang"))
    return lines.select(s.alias("s"), g(3).alias("p"), o.alias("o")).distinct()


def frame(spark: SparkSession, triples) -> DataFrame:
    """Driver-side triples (Node, predicate, Node) as a table."""
    rows = [((int(s.kind), *s[1:]), p, (int(o.kind), *o[1:])) for s, p, o in dict.fromkeys(triples)]
    return spark.createDataFrame(rows, TRIPLE)


def parse(data: str, format: str = "turtle", base: str = "", scope: str = "") -> list[tuple[Node, str, Node]]:
    """Triples of a text in one of FORMATS (any case)."""
    kind = format.lower()
    if kind in ("turtle", "n-triples", "trig", "n-quads", "ttl", "nt"):
        return turtle.parse(data, base, scope)
    if kind == "rdf/json":
        return _rdf_json(data, scope)
    if kind == "rdf/xml":
        return _rdf_xml(data, base, scope)
    if kind == "json-ld":
        return _json_ld(data, base, scope)
    raise ValueError(f"unknown format {format}; known are {', '.join(FORMATS)}")


def from_string(spark: SparkSession, data: str, format: str = "turtle", base: str = "", scope: str = "") -> DataFrame:
    return frame(spark, parse(data, format, base, scope))


def from_path(spark: SparkSession, path: str, format: str = "turtle", base: str = "", scope: str = "") -> DataFrame:
    """A file or folder: lines of N-Triples or N-Quads, or a task for each file of another format.

    Blank nodes of different files stay apart, but in N-Triples and N-Quads.
    """
    kind = format.lower()
    if kind in ("n-triples", "nt", "n-quads"):
        return read(spark, path, quads=kind == "n-quads")
    if kind not in (*FORMATS, "ttl"):
        raise ValueError(f"unknown format {format}; known are {', '.join(FORMATS)}")
    file = F.hex(F.xxhash64(F.input_file_name())).alias("file")
    if kind in ("turtle", "ttl", "trig"):
        return _statements(spark.read.text(path, lineSep="\n"), file, base, scope)
    texts = spark.read.text(path, wholetext=True).select("value", file)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(TRIPLE)
        for rb in batches:
            for data, file in zip(rb.column("value").to_pylist(), rb.column("file").to_pylist(), strict=True):
                triples = parse(data, kind, base, f"{scope}f{file}_")
                for at in range(0, len(triples), 8192):
                    yield pa.RecordBatch.from_pylist(_cells(triples[at : at + 8192]), schema=shape)

    return texts.mapInArrow(run, TRIPLE).distinct()


def _cells(triples) -> list[dict]:
    cell = lambda n: {"kind": int(n.kind), "lex": n.lex, "dt": n.dt, "lang": n.lang}
    return [{"s": cell(s), "p": p, "o": cell(o)} for s, p, o in triples]


def _statements(lines: DataFrame, file: Column, base: str, scope: str) -> DataFrame:
    """Triples of Turtle's lines (column value). A file may be read in pieces; its lines are put in order again for the task that parses it."""
    placed = lines.select("value", file, F.input_file_block_start().alias("piece"), F.monotonically_increasing_id().alias("line"))
    placed = placed.repartition(max(1, len(lines.inputFiles())), "file").sortWithinPartitions("file", "piece", "line").select("value", "file")

    def run(batches):
        from itertools import groupby

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(TRIPLE)
        rows = (x for rb in batches for x in zip(rb.column("file").to_pylist(), rb.column("value").to_pylist(), strict=True))
        for name, own in groupby(rows, lambda x: x[0]):
            for triples in turtle.stream((x[1] for x in own), base, f"{scope}f{name}_"):
                for at in range(0, len(triples), 8192):
                    yield pa.RecordBatch.from_pylist(_cells(triples[at : at + 8192]), schema=shape)

    return placed.mapInArrow(run, TRIPLE).distinct()


def from_url(spark: SparkSession, url: str, fetch, format: str = "turtle") -> DataFrame:
    """The graph that a URL names; `fetch` (URL to text) is the caller's, as for imports."""
    return from_string(spark, fetch(url), format, url)


def from_endpoint(spark: SparkSession, url: str, fetch, query: str = "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", format: str = "n-triples") -> DataFrame:
    """What a SPARQL endpoint answers to a query that constructs a graph, by the protocol's GET request."""
    return from_string(spark, fetch(f"{url}{'&' if '?' in url else '?'}query={quote(query, safe='')}"), format)


def merge(*graphs: DataFrame) -> DataFrame:
    """The union of graphs, as a set; blank nodes of different graphs stay apart."""
    out = None
    for i, g in enumerate(graphs):
        scope = lambda c, i=i: F.when(c["kind"] == BNODE, c.withField("lex", F.concat(F.lit(f"m{i}_"), c["lex"]))).otherwise(c)
        g = g.select(scope(F.col("s")).alias("s"), "p", scope(F.col("o")).alias("o"))
        out = g if out is None else out.unionByName(g)
    return out.distinct()


def lines(graph: DataFrame) -> DataFrame:
    """The graph's N-Triples lines (column value)."""
    return graph.select(F.concat(text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), text(F.col("o")), F.lit(" .")).alias("value"))


def write(graph: DataFrame, path: str, format: str = "n-triples", name: str = "") -> None:
    """Files of N-Triples, which are Turtle and TriG as well, or of N-Quads in the graph `name`."""
    if format.lower() not in ("n-triples", "nt", "turtle", "ttl", "trig", "n-quads"):
        raise ValueError(f"graphs aren't written as {format}")
    rows = lines(graph)
    if name and format.lower() == "n-quads":
        rows = rows.select(F.concat(F.substring("value", F.lit(1), F.length("value") - 1), F.lit(f"<{name}> .")).alias("value"))
    rows.write.text(path)


def infer(graph: DataFrame, name: str = "NONE", most: int = 64) -> DataFrame:
    """The inference pre-pass: NONE, or RDFS (subclass, subproperty, domain and range rules to a fixpoint).

    Rules about predicates are sent to all tasks, as there are no more of them than predicates need; dealt out by predicate,
    all arcs of one would land in one task.
    """
    from ..plans.paths import closure

    if name.upper() == "NONE":
        return graph
    if name.upper() != "RDFS":
        raise ValueError(f"unknown inference {name}; known are NONE and RDFS")
    e = graph.select(F.col("s").alias("a"), "p", F.col("o").alias("b"))
    sub = closure(e.filter(F.col("p") == RDFS + "subPropertyOf").select("a", "b"), most)
    sub = sub.select(F.col("a")["lex"].alias("_sp"), F.col("b")["lex"].alias("_p"))
    more = graph.join(F.broadcast(sub), F.col("p") == F.col("_sp")).select("s", F.col("_p").alias("p"), "o")
    full = graph.unionByName(more).distinct()
    kind = lambda side, rule: full.join(F.broadcast(graph.filter(F.col("p") == RDFS + rule).select(F.col("s")["lex"].alias("_p"), F.col("o").alias("_c"))), F.col("p") == F.col("_p")).filter(F.col(side)["kind"] != LITERAL).select(F.col(side).alias("s"), F.lit(TYPE).alias("p"), F.col("_c").alias("o"))
    full = full.unionByName(kind("s", "domain")).unionByName(kind("o", "range"))
    classes = closure(e.filter(F.col("p") == SUBCLASS).select("a", "b"), most).withColumnsRenamed({"a": "_a", "b": "_b"})
    up = full.filter(F.col("p") == TYPE).join(classes, F.col("o") == F.col("_a")).select("s", "p", F.col("_b").alias("o"))
    tree = classes.select(F.col("_a").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("_b").alias("o"))
    return full.unionByName(up).unionByName(tree).distinct()


class Loader:
    """Follows import links between texts, each once; `fetch` gives a text for an IRI."""

    def __init__(self, fetch):
        self.fetch, self.seen = fetch, set()

    def load(self, start: str, links) -> list:
        out, todo = [], [start]
        while todo:
            x = todo.pop(0)
            if x not in self.seen:
                self.seen.add(x)
                got = self.fetch(x)
                out.append(got)
                todo += links(got)
        return out


def _rdf_json(data: str, scope: str) -> list:
    name = lambda x: Node(BNODE, scope + x[2:]) if x.startswith("_:") else iri(x)
    out = []
    for s, ps in json.loads(data).items():
        for p, os in ps.items():
            for o in os:
                out.append((name(s), p, literal(o["value"], o.get("datatype", STRING), o.get("lang", "")) if o["type"] == "literal" else name(o["value"])))
    return out


def _rdf_xml(data: str, base: str, scope: str) -> list:
    out, fresh = [], [0]
    r = "{" + RDF + "}"
    lang_, base_ = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
    full = lambda tag: tag[1:].replace("}", "", 1)

    def new() -> Node:
        fresh[0] += 1
        return Node(BNODE, f"{scope}x{fresh[0]}")

    def subject(e: ET.Element, at: str, lang: str) -> Node:
        at, lang = e.get(base_, at), e.get(lang_, lang)
        if e.get(r + "about") is not None:
            s = iri(urljoin(at, e.get(r + "about")))
        elif e.get(r + "ID") is not None:
            s = iri(urljoin(at, "#" + e.get(r + "ID")))
        else:
            s = Node(BNODE, scope + e.get(r + "nodeID")) if e.get(r + "nodeID") else new()
        if e.tag != r + "Description":
            out.append((s, TYPE, iri(full(e.tag))))
        attributes(s, e, lang)
        count = 0
        for c in e:
            if c.tag == r + "li":
                count += 1
            prop(s, c, RDF + f"_{count}" if c.tag == r + "li" else full(c.tag), at, lang)
        return s

    def attributes(s: Node, e: ET.Element, lang: str) -> None:
        for k, v in e.attrib.items():
            if not k.startswith((r, "{http://www.w3.org/XML/1998/namespace}")) and k.startswith("{"):
                out.append((s, full(k), literal(v, lang=lang)))

    def prop(s: Node, c: ET.Element, p: str, at: str, lang: str) -> None:
        lang, kind = c.get(lang_, lang), c.get(r + "parseType")
        if kind == "Resource":
            o = new()
            for x in c:
                prop(o, x, full(x.tag), at, lang)
        elif kind == "Collection":
            o = iri(RDF + "nil")
            for x in reversed([subject(x, at, lang) for x in c]):
                b = new()
                out.extend([(b, RDF + "first", x), (b, RDF + "rest", o)])
                o = b
        elif c.get(r + "resource") is not None:
            o = iri(urljoin(at, c.get(r + "resource")))
        elif c.get(r + "nodeID"):
            o = Node(BNODE, scope + c.get(r + "nodeID"))
        elif len(c):
            o = subject(c[0], at, lang)
        elif any(k.startswith("{") and not k.startswith((r, "{http://www.w3.org/XML")) for k in c.attrib):
            o = new()
            attributes(o, c, lang)
        else:
            dt = c.get(r + "datatype")
            o = literal(c.text or "", dt) if dt else literal(c.text or "", lang=lang)
        out.append((s, p, o))

    root = ET.fromstring(data)
    base, lang = root.get(base_, base), root.get(lang_, "")
    for e in root if root.tag == r + "RDF" else [root]:
        subject(e, base, lang)
    return out


def _json_ld(data: str, base: str, scope: str) -> list:
    """Documents with inline contexts of prefixes, terms, @vocab, @base, @type coercions, @list and @graph."""
    out, fresh = [], [0]

    def expand(x: str, ctx: dict, vocab: bool) -> str:
        if x in ctx["terms"] and vocab:
            return ctx["terms"][x][0]
        p, colon, rest = x.partition(":")
        if colon and p in ctx["terms"] and not rest.startswith("//"):
            return ctx["terms"][p][0] + rest
        if colon or x.startswith("@"):
            return x
        return ctx["vocab"] + x if vocab and ctx["vocab"] else urljoin(ctx["base"], x)

    def context(ctx: dict, c) -> dict:
        ctx = {"terms": dict(ctx["terms"]), "vocab": ctx["vocab"], "base": ctx["base"], "lang": ctx["lang"]}
        for part in c if isinstance(c, list) else [c or {}]:
            if isinstance(part, str):
                raise ValueError("remote JSON-LD contexts aren't fetched")
            ctx["vocab"], ctx["base"], ctx["lang"] = part.get("@vocab", ctx["vocab"]), part.get("@base", ctx["base"]), part.get("@language", ctx["lang"])
            for k, v in part.items():
                if isinstance(v, str) and not k.startswith("@"):
                    ctx["terms"][k] = (v, None, None)
            for k, v in part.items():
                if not k.startswith("@"):
                    d = {"@id": v} if isinstance(v, str) else v
                    dt = d.get("@type")
                    ctx["terms"][k] = (expand(d.get("@id", k), ctx, d.get("@id", k) != k or ":" in k or bool(ctx["vocab"])), dt if dt in (None, "@id", "@vocab") else expand(dt, ctx, True), d.get("@container"))
        return ctx

    def name(x: str, ctx: dict) -> Node:
        return Node(BNODE, scope + x[2:]) if x.startswith("_:") else iri(expand(x, ctx, False))

    def new() -> Node:
        fresh[0] += 1
        return Node(BNODE, f"{scope}j{fresh[0]}")

    def chain(xs: list) -> Node:
        rest = iri(RDF + "nil")
        for x in reversed(xs):
            b = new()
            out.extend([(b, RDF + "first", x), (b, RDF + "rest", rest)])
            rest = b
        return rest

    def value(v, ctx: dict, dt: str | None) -> Node:
        if isinstance(v, dict):
            if "@value" in v:
                x = v["@value"]
                lex, own = (str(x).lower(), XSD + "boolean") if isinstance(x, bool) else (str(x), XSD + ("integer" if isinstance(x, int) else "double" if isinstance(x, float) else "string"))
                return literal(lex, expand(v["@type"], ctx, True) if "@type" in v else own, v.get("@language", "") if "@type" not in v else "")
            if "@list" in v:
                return chain([value(x, ctx, dt) for x in v["@list"]])
            return thing(v, ctx)
        if isinstance(v, str) and dt in ("@id", "@vocab"):
            return name(v, ctx) if dt == "@id" else iri(expand(v, ctx, True))
        if isinstance(v, bool):
            return literal(str(v).lower(), dt or XSD + "boolean")
        if isinstance(v, (int, float)):
            return literal(str(v), dt or XSD + ("integer" if isinstance(v, int) else "double"))
        return literal(v, dt) if dt else literal(v, lang=ctx["lang"])

    def thing(d: dict, ctx: dict) -> Node:
        ctx = context(ctx, d.get("@context")) if "@context" in d else ctx
        alias = {k: v[0] for k, v in ctx["terms"].items() if v[0].startswith("@")}
        d = {alias.get(k, k): v for k, v in d.items()}
        s = name(d["@id"], ctx) if "@id" in d else new()
        for k, v in d.items():
            vs = v if isinstance(v, list) else [v]
            if k == "@type":
                out.extend((s, TYPE, iri(expand(x, ctx, True))) for x in vs)
            elif k in ("@graph", "@included"):
                for x in vs:
                    thing(x, ctx)
            elif not k.startswith("@") and v is not None:
                p, (_, dt, box) = expand(k, ctx, True), ctx["terms"].get(k, (None, None, None))
                if ":" not in p:
                    continue
                nodes = [value(x, ctx, dt) for x in vs if x is not None]
                out.extend((s, p, o) for o in ([chain(nodes)] if box == "@list" else nodes))
        return s

    top = {"terms": {}, "vocab": "", "base": base, "lang": ""}
    doc = json.loads(data)
    for d in doc if isinstance(doc, list) else [doc]:
        if "@graph" in d and set(d) <= {"@graph", "@context"}:
            ctx = context(top, d.get("@context"))
            for x in d["@graph"] if isinstance(d["@graph"], list) else [d["@graph"]]:
                thing(x, ctx)
        else:
            thing(d, top)
    return out


__all__ = ["FORMATS", "Loader", "frame", "from_endpoint", "from_path", "from_string", "from_url", "infer", "lines", "merge", "node", "parse", "read", "write"]
