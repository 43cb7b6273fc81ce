"""Answer-set programs of a validation: facts of the reachable graph, and rules that a schema compiles to.

A program derives failures. Every different subexpression of the schema has a number, and fails(I, X) holds
if node X does not conform to subexpression I. Failures grow from the graph's facts by least fixpoints,
so what nothing refutes conforms, which is how recursive references are meant. A rule is written out
for each subexpression, with the numbers of its parts; programs whose negation is stratified, which are those that the
plan-based validator takes, have one answer set. Counts are of values that fail, wherever a minimum is asked
for: its failure is monotone. "All values conform" has a rule of its own, so that it can recurse.

Data facts are arc/3, iri/1, bNode/1 and literal/2: rows of a table, as many as the graph has. The schema's rules, the
facts root/2 (label, number) and asked/2 (node, label), and the results yes/2 and no/2 are text on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import paths as P
from ..plans import slang as L
from ..sources.terms import BNODE, IRI, Node

NODES = ["node(X) :- arc(X, _, _).", "node(X) :- arc(_, _, X).", "node(X) :- asked(X, _)."]
ANSWERS = ["yes(X, L) :- asked(X, L), root(L, I), not fails(I, X).", "no(X, L) :- asked(X, L), root(L, I), fails(I, X).", "#show yes/2.", "#show no/2."]


def quoted(x: str) -> str:
    return json.dumps(x, ensure_ascii=False)


def _quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def term(n: Column) -> Column:
    """A node as a term: an IRI's text, b("label") for blank nodes, l("lexical", "datatype or language")."""
    tag = F.when(n["lang"] != "", F.concat(F.lit("@"), n["lang"])).otherwise(n["dt"])
    return F.when(n["kind"] == IRI, _quoted(n["lex"])).when(n["kind"] == BNODE, F.concat(F.lit("b("), _quoted(n["lex"]), F.lit(")"))).otherwise(F.concat(F.lit("l("), _quoted(n["lex"]), F.lit(", "), _quoted(tag), F.lit(")")))


def facts(graph: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Facts (column value) of the graph, or of what is reachable from the nodes in `start` (column node)."""
    if start is not None:
        seen = P.reach(P.edges(graph, P.NoPreds(())), start.select(F.col("node").alias("focus")), True).select(F.col("value").alias("_n")).distinct()
        graph = graph.join(seen, F.col("s") == F.col("_n"), "left_semi")
        alone = start.select("node")
    else:
        alone = graph.select(F.col("s").alias("node")).limit(0)
    arcs = graph.select(F.concat(F.lit("arc("), term(F.col("s")), F.lit(", "), _quoted(F.col("p")), F.lit(", "), term(F.col("o")), F.lit(").")).alias("value"))
    nodes = graph.select(F.col("s").alias("node")).unionByName(graph.select(F.col("o").alias("node"))).unionByName(alone).distinct()
    n = F.col("node")
    kinds = F.when(n["kind"] == IRI, F.concat(F.lit("iri("), term(n), F.lit(")."))).when(n["kind"] == BNODE, F.concat(F.lit("bNode("), term(n), F.lit(").")))
    kinds = kinds.otherwise(F.concat(F.lit("literal("), term(n), F.lit(", "), _quoted(n["dt"]), F.lit(").")))
    return arcs.unionByName(nodes.select(kinds.alias("value")))


class Program:
    """The schema's part of a program."""

    def __init__(self, shapes: dict[str, L.SLang]):
        self.shapes, self.numbers, self.steps, self.rules = shapes, {}, {}, []
        self.roots = {x: self.number(s) for x, s in shapes.items()}

    def step(self, path) -> int:
        """The number of a path, whose pairs are step(number, X, V); its rules are written when it is met first."""
        if path in self.steps:
            return self.steps[path]
        i = self.steps[path] = len(self.steps)
        match path:
            case P.Pred(x):
                self.rules.append(f"step({i}, X, V) :- arc(X, {quoted(x)}, V).")
            case P.Inv(P.Pred(x)):
                self.rules.append(f"step({i}, X, V) :- arc(V, {quoted(x)}, X).")
            case P.NoPreds(xs):
                self.rules.append(f"step({i}, X, V) :- arc(X, P, V)" + "".join(f", P != {quoted(x)}" for x in xs) + ".")
            case _:
                raise L.NotSupported(f"no rule for path {P.text(path)}")
        return i

    def number(self, s: L.SLang) -> int:
        """The number of a subexpression; the rules of its failures are written when it is met first."""
        if s in self.numbers:
            return self.numbers[s]
        i = self.numbers[s] = len(self.numbers)
        fails = f"fails({i}, X) :- "
        match s:
            case L.STrue():
                bodies = []
            case L.IRIKind():
                bodies = ["node(X), not iri(X)"]
            case L.BNodeKind():
                bodies = ["node(X), not bNode(X)"]
            case L.Datatype(x):
                bodies = [f"node(X), not literal(X, {quoted(x)})"]
            case L.Ref(x):
                if x not in self.shapes:
                    raise KeyError(f"no shape {x}")
                bodies = [f"root({quoted(x)}, I), fails(I, X)"]
            case L.And(a, b):
                bodies = [f"fails({self.number(part)}, X)" for part in (a, b)]
            case L.Not(L.QualifiedArc(path, L.Not(x), 1, -1)):  # all values conform to x
                bodies = [f"step({self.step(path)}, X, V), fails({self.number(x)}, V)"]
            case L.Not(x):
                bodies = [f"node(X), not fails({self.number(x)}, X)"]
            case L.QualifiedArc(path, x, low, high):
                step, of = self.step(path), self.number(x)
                bodies = []
                if low > 0:
                    bodies.append(f"node(X), N = #count {{ V : step({step}, X, V) }}, #count {{ V : step({step}, X, V), fails({of}, V) }} > N - {low}")
                if high >= 0:
                    bodies.append(f"node(X), #count {{ V : step({step}, X, V), not fails({of}, V) }} > {high}")
            case _:
                raise TypeError(f"not a shape: {s!r}")
        self.rules += [f"{fails}{b}." for b in bodies]
        return i

    def text(self, asked: list[tuple[Node, str]] = ()) -> str:
        """Facts of the schema's labels and of the (node, label) pairs asked for, and all rules."""
        lines = [f"root({quoted(x)}, {i})." for x, i in self.roots.items()]
        for n, x in asked:
            t = quoted(n.lex) if n.kind == IRI else f"b({quoted(n.lex)})" if n.kind == BNODE else f"l({quoted(n.lex)}, {quoted('@' + n.lang if n.lang else n.dt)})"
            lines.append(f"asked({t}, {quoted(x)}).")
        return "\n".join([*lines, *NODES, *self.rules, *ANSWERS]) + "\n"


def program(graph: DataFrame, shapes: dict[str, L.SLang], asked: list[tuple[Node, str]]) -> tuple[DataFrame, str]:
    """Data facts (a table of lines) of what the asked nodes reach, and the schema's text."""
    from ..sources.terms import constant

    spark = graph.sparkSession
    start = None
    for n, _ in asked:
        one = spark.range(1).select(constant(n).alias("node"))
        start = one if start is None else start.unionByName(one)
    return facts(graph, start), Program(shapes).text(asked)
