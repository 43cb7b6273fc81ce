"""Shape maps: which nodes are checked against which shapes, and the results.

Compact syntax: associations separated by commas, each a node selector, @, an optional ! or ?, and a
shape label or START. A selector is a node, a triple pattern {FOCUS path o} or {s path FOCUS} with _ as
a wildcard, where path is a predicate or a SPARQL path, or SPARQL "SELECT ...".
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import paths as P
from ..sources import turtle
from ..sources.terms import RDF, XSD, Node, constant, iri, literal, text

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[a-z]{2,}(?:-[A-Za-z0-9]+)*(?=\s*@))|(?P<dtype>\^\^)|(?P<bnode>_:[\w.-]+)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[\w-]*:[\w%.-]*)|(?P<word>[A-Za-z_]+)|(?P<mark>[{}@,!?/|*+()^$-])""", re.X)


@dataclass(frozen=True)
class Association:
    """selector is a Node, (subject or None, path, object or None, focus is the subject) or a query text."""

    selector: object
    shape: str
    status: str = "conformant"


class Parser:
    def __init__(self, data: str, node_prefixes: dict[str, str] | None = None, shape_prefixes: dict[str, str] | None = None, base: str = ""):
        self.tok, self.at = [], 0
        self.nodes, self.shapes, self.base = node_prefixes or {}, shape_prefixes or node_prefixes or {}, base
        at = 0
        while at < len(data):
            m = _TOKEN.match(data, at)
            if not m:
                raise SyntaxError(f"unexpected {data[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tok.append((m.lastgroup, m[0]))
            at = m.end()

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tok) or want and self.tok[self.at][1] != want:
            raise SyntaxError(f"expected {want or 'more'} at token {self.at}")
        self.at += 1
        return self.tok[self.at - 1]

    def maybe(self, want: str) -> bool:
        if self.at < len(self.tok) and self.tok[self.at][1] == want:
            self.at += 1
            return True
        return False

    def iri(self, prefixes: dict[str, str]) -> str:
        kind, x = self.take()
        if kind == "iri":
            return turtle.urljoin(self.base, x[1:-1]) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", x[1:-1]) else x[1:-1]
        if kind == "name":
            p, _, local = x.partition(":")
            if p not in prefixes:
                raise SyntaxError(f"prefix {p}: is not known")
            return prefixes[p] + local
        if x == "a":
            return RDF + "type"
        raise SyntaxError(f"expected an IRI, found {x!r}")

    def node(self) -> Node:
        kind, x = self.tok[self.at] if self.at < len(self.tok) else ("", "")
        if kind == "bnode":
            self.at += 1
            return Node(1, x[2:])
        if kind == "str":
            self.at += 1
            lex = turtle.unescape(x[1:-1])
            if self.at < len(self.tok) and self.tok[self.at][0] == "lang":
                return literal(lex, lang=self.take()[1][1:])
            return literal(lex, self.iri(self.nodes)) if self.maybe("^^") else literal(lex)
        if kind == "num":
            self.at += 1
            return literal(x, XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))
        if x in ("true", "false"):
            self.at += 1
            return literal(x, XSD + "boolean")
        return iri(self.iri(self.nodes))

    def path(self):
        parts = [self.sequence()]
        while self.maybe("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else P.Alt(tuple(parts))

    def sequence(self):
        parts = [self.step()]
        while self.maybe("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else P.Seq(tuple(parts))

    def step(self):
        if self.maybe("^"):
            return P.Inv(self.step())
        if self.maybe("("):
            p = self.path()
            self.take(")")
        else:
            p = P.Pred(self.iri(self.nodes))
        for mark, make in (("*", P.Star), ("+", P.Plus), ("?", P.Opt)):
            if self.maybe(mark):
                p = make(p)
        return p

    def end(self):
        """FOCUS, None for _, or a node."""
        if self.maybe("FOCUS"):
            return "FOCUS"
        return None if self.maybe("_") else self.node()

    def associations(self) -> list[Association]:
        out = []
        while self.at < len(self.tok):
            if self.maybe("{"):
                s = self.end()
                p = self.path()
                o = self.end()
                self.take("}")
                if (s == "FOCUS") == (o == "FOCUS"):
                    raise SyntaxError("a pattern has FOCUS once")
                selector: object = (None if s == "FOCUS" else s, p, None if o == "FOCUS" else o, s == "FOCUS")
            elif self.at < len(self.tok) and self.tok[self.at][1].upper() == "SPARQL":
                self.at += 1
                selector = turtle.unescape(self.take()[1][1:-1])
            else:
                selector = self.node()
            self.take("@")
            status = "nonconformant" if self.maybe("!") else "unknown" if self.maybe("?") else "conformant"
            shape = "START" if self.maybe("START") else f"_:{self.take()[1][2:]}" if self.tok[self.at][0] == "bnode" else self.iri(self.shapes)
            out.append(Association(selector, shape, status))
            if self.at < len(self.tok):
                self.take(",")
        return out


def parse(data: str, node_prefixes: dict[str, str] | None = None, shape_prefixes: dict[str, str] | None = None, base: str = "") -> list[Association]:
    """Associations of a shape map in compact or JSON syntax."""
    if data.lstrip().startswith("["):
        return [Association(Parser(d["node"], node_prefixes, shape_prefixes, base).node(), d["shape"].strip("<>"), d.get("status", "conformant")) for d in json.loads(data)]
    return Parser(data, node_prefixes, shape_prefixes, base).associations()


def fix(graph: DataFrame, found: list[Association]) -> DataFrame:
    """The fixed map (node, shape, expected): selectors are evaluated over the graph."""
    out = None
    for a in found:
        if isinstance(a.selector, Node):
            rows = graph.sparkSession.range(1).select(constant(a.selector).alias("node"))
        elif isinstance(a.selector, str):
            from .sparql import select

            rows = select(graph, a.selector)
            rows = rows.select(F.col(rows.columns[0]).alias("node"))
        else:
            s, path, o, front = a.selector
            path = path if front else P.Inv(path)
            fixed = o if front else s
            if fixed is not None:  # from the known end backwards
                one = graph.sparkSession.range(1).select(constant(fixed).alias("focus"))
                rows = P.pairs(graph, P.Inv(path), one).select(F.col("value").alias("node"))
            else:
                rows = P.edges(graph, path).select(F.col("a").alias("node"))
        rows = rows.distinct().select("node", F.lit(a.shape).alias("shape"), F.lit(a.status).alias("expected"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct() if out is not None else None


def show(a: Association) -> str:
    """An association in the compact syntax."""
    sign = {"conformant": "", "nonconformant": "!", "unknown": "?"}[a.status]
    shape = "START" if a.shape == "START" else a.shape if a.shape.startswith("_:") else f"<{a.shape}>"
    if isinstance(a.selector, Node):
        where = a.selector.nt()
    elif isinstance(a.selector, str):
        where = "SPARQL " + json.dumps(a.selector)
    else:
        s, p, o, front = a.selector
        ends = ["FOCUS" if front else "_" if s is None else s.nt(), "FOCUS" if not front else "_" if o is None else o.nt()]
        where = f"{{{ends[0]} {P.text(p)} {ends[1]}}}"
    return f"{where}@{sign}{shape}"


def results(checked: DataFrame) -> DataFrame:
    """(node, shape, status, reason) of a validator's (node, shape, conforms), as text."""
    status = F.when(F.col("conforms"), "conformant").otherwise("nonconformant")
    return checked.select(text(F.col("node")).alias("node"), "shape", status.alias("status"), F.when(F.col("conforms"), "").otherwise(F.concat(F.lit("does not match "), F.col("shape"))).alias("reason"))


def write_json(result: DataFrame, path: str) -> None:
    """The result map as JSON lines."""
    result.write.json(path)


