"""The minimal shape language: true, references, conjunction, datatype, node kinds, negation, qualified arcs.

Everything in ShEx's flat shapes lowers to it. Its validator is a plan over sets of nodes. A status is a
pair of bits, evidence that a node conforms and evidence that it does not: Belnap's four truth values.
Evidence adds up where typings merge; a conjunction has evidence for it where both its parts do, and
against it where one of them does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..sources.terms import BNODE, IRI, text
from . import paths as P

FOR, AGAINST = 1, 2
UNKNOWN, CONFORMS, NOT_CONFORMS, INCONSISTENT = 0, FOR, AGAINST, FOR | AGAINST
# fixed values: how statuses are printed
SIGNS = {UNKNOWN: "?", CONFORMS: "+", NOT_CONFORMS: "-", INCONSISTENT: "!!"}


def merge(a: int, b: int) -> int:
    """All evidence of both."""
    return a | b


def both(a: int, b: int) -> int:
    """Conjunction."""
    return (a & b & FOR) | ((a | b) & AGAINST)


def contrary(a: int) -> int:
    """Negation: evidence for and against change places."""
    return (a & FOR) * AGAINST | (a & AGAINST) // AGAINST


def merge_typings(*typings: DataFrame) -> DataFrame:
    """(node, shape, status) tables merged by evidence."""
    every = reduce(lambda a, b: a.unionByName(b), typings)
    return every.groupBy("node", "shape").agg(F.bit_or("status").alias("status"))


class SLang:
    def __and__(self, other):
        return And(self, other)

    def __or__(self, other):
        return Not(And(Not(self), Not(other)))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class STrue(SLang):
    pass


@dataclass(frozen=True)
class Ref(SLang):
    label: str


@dataclass(frozen=True)
class And(SLang):
    left: SLang
    right: SLang


@dataclass(frozen=True)
class Datatype(SLang):
    iri: str


@dataclass(frozen=True)
class IRIKind(SLang):
    pass


@dataclass(frozen=True)
class BNodeKind(SLang):
    pass


@dataclass(frozen=True)
class Not(SLang):
    shape: SLang


@dataclass(frozen=True)
class QualifiedArc(SLang):
    path: object
    shape: SLang
    min: int = 1
    max: int = -1


class NotSupported(ValueError):
    pass


def lower(schema) -> dict[str, SLang]:
    """The minimal forms of a ShEx schema's shapes.

    A triple constraint is two counts: conforming arcs in its interval and, without EXTRA, no arc that
    does not conform. CLOSED adds that there is no arc of another predicate.
    """

    def shape(e) -> SLang:
        if e is None:
            return STrue()
        if isinstance(e, str):
            return Ref(e)
        t = e["type"]
        if t == "ShapeAnd":
            return reduce(And, map(shape, e["shapeExprs"]))
        if t == "ShapeOr":
            return reduce(lambda a, b: a | b, map(shape, e["shapeExprs"]))
        if t == "ShapeNot":
            return Not(shape(e["shapeExpr"]))
        if t == "NodeConstraint":
            rest = set(e) - {"type", "id", "nodeKind", "datatype"}
            if rest:
                raise NotSupported(f"the minimal language has no {sorted(rest)[0]}")
            parts: list[SLang] = []
            if "nodeKind" in e:
                kinds = {"iri": IRIKind(), "bnode": BNodeKind(), "nonliteral": IRIKind() | BNodeKind(), "literal": And(Not(IRIKind()), Not(BNodeKind()))}
                parts.append(kinds[e["nodeKind"]])
            if "datatype" in e:
                parts.append(Datatype(e["datatype"]))
            return reduce(And, parts) if parts else STrue()
        if t == "Shape":
            tcs = members(e["expression"]) if "expression" in e else []
            names = [(c["predicate"], c.get("inverse", False)) for c in tcs]
            if len(set(names)) < len(names):
                raise NotSupported("the minimal language can't share a predicate's arcs between constraints")
            parts = []
            for c in tcs:
                path = P.Inv(P.Pred(c["predicate"])) if c.get("inverse") else P.Pred(c["predicate"])
                s = shape(c.get("valueExpr"))
                parts.append(QualifiedArc(path, s, c.get("min", 1), c.get("max", 1)))
                if c["predicate"] not in e.get("extra", []) and s != STrue():
                    parts.append(Not(QualifiedArc(path, Not(s), 1, -1)))
            if e.get("closed"):
                own = tuple(sorted({p for p, back in names if not back} | set(e.get("extra", []))))
                parts.append(Not(QualifiedArc(P.NoPreds(own), STrue(), 1, -1)))
            return reduce(And, parts) if parts else STrue()
        raise NotSupported(f"the minimal language has no {t}")

    def members(e) -> list[dict]:
        e = schema.triple(e)
        if e["type"] == "TripleConstraint":
            return [e]
        if e["type"] == "EachOf" and e.get("min", 1) == e.get("max", 1) == 1:
            return [c for x in e["expressions"] for c in members(x)]
        raise NotSupported("the minimal language has no choices or repeated groups")

    return {x: shape(s) for x, s in schema.shapes.items()}


class Validator:
    """Conforming subsets of sets of nodes; references are solved as a greatest fixpoint, so an open question counts as yes.

    Negated cycles have no such fixpoint and raise RecursionError.
    """

    def __init__(self, graph: DataFrame, shapes: dict[str, SLang]):
        self.graph, self.shapes = graph, shapes
        self.cyclic = {x for x in shapes if self._reaches(x, x)}
        for x in self.cyclic:
            if any(self._reaches(y, x) for y, neg in self._refs(shapes[x]) if neg and y in shapes):
                raise RecursionError(f"negation in the cycle of {x}")
        self.typing: dict[str, DataFrame] = {}

    def _refs(self, s: SLang, neg: bool = False):
        match s:
            case Ref(x):
                yield x, neg
            case And(a, b):
                yield from self._refs(a, neg)
                yield from self._refs(b, neg)
            case Not(QualifiedArc(_, Not(x), 1, -1)):
                yield from self._refs(x, neg)
            case Not(x):
                yield from self._refs(x, not neg)
            case QualifiedArc(_, x, lo, hi):
                yield from self._refs(x, neg)

    def _reaches(self, x: str, goal: str) -> bool:
        seen, todo = set(), [y for y, _ in self._refs(self.shapes[x])]
        while todo:
            y = todo.pop()
            if y == goal:
                return True
            if y not in seen and y in self.shapes:
                seen.add(y)
                todo += [z for z, _ in self._refs(self.shapes[y])]
        return False

    def column(self, s: SLang, v):
        match s:
            case STrue():
                return F.lit(True)
            case IRIKind():
                return v["kind"] == IRI
            case BNodeKind():
                return v["kind"] == BNODE
            case Datatype(x):
                return N.datatype(v, x, lexical=False)
            case Not(x):
                c = self.column(x, v)
                return None if c is None else ~c
            case And(a, b):
                ca, cb = self.column(a, v), self.column(b, v)
                return None if ca is None or cb is None else ca & cb
        return None

    def conforming(self, s: SLang, nodes: DataFrame) -> DataFrame:
        """Those of the distinct nodes (column node) that conform."""
        c = self.column(s, F.col("node"))
        if c is not None:
            return nodes.filter(c)
        match s:
            case And(a, b):
                left = self.conforming(a, nodes)
                # what follows reads its nodes more than once; without a cut a plan would double with every part
                return self.conforming(b, left if self.column(a, F.col("node")) is not None else P._cut(left))
            case Not(x):
                ok = self.conforming(x, nodes).select(F.col("node").alias("_n"))
                return nodes.join(ok, F.col("node") == F.col("_n"), "left_anti")
            case Ref(x):
                if x not in self.shapes:
                    raise KeyError(f"no shape {x}")
                if x in self.typing:
                    ok = self.typing[x].select(F.col("node").alias("_n"))
                    return nodes.join(ok, F.col("node") == F.col("_n"), "left_semi")
                return self.conforming(self.shapes[x], nodes)
            case QualifiedArc(path, x, lo, hi):
                pairs = P.pairs(self.graph, path, nodes.select(F.col("node").alias("focus")))
                good = self.conforming(x, pairs.select(F.col("value").alias("node")).distinct()).select(F.col("node").alias("_n"))
                hits = pairs.join(good, F.col("value") == F.col("_n"), "left_semi").groupBy("focus").agg(F.count("*").alias("k"))
                per = nodes.join(hits, F.col("node") == F.col("focus"), "left").withColumn("k", F.coalesce("k", F.lit(0)))
                ok = F.col("k") >= lo
                return per.filter(ok & (F.col("k") <= hi) if hi != -1 else ok).select("node")
        raise TypeError(f"not a shape: {s!r}")

    def validate(self, targets: DataFrame) -> DataFrame:
        """`targets` (node, shape) with status, CONFORMS or NOT_CONFORMS."""
        if self.cyclic:
            every = self.graph.select(F.col("s").alias("node")).unionByName(self.graph.select(F.col("o").alias("node"))).unionByName(targets.select("node")).distinct()
            every = P._cut(every)
            self.typing = {x: every for x in self.cyclic}
            sizes = None
            while True:
                now = {x: P._cut(self.conforming(self.shapes[x], self.typing[x])) for x in sorted(self.cyclic)}
                new = {x: d.count() for x, d in now.items()}
                self.typing = now
                if new == sizes:
                    break
                sizes = new
        out = None
        for (x,) in targets.select("shape").distinct().collect():
            mine = targets.filter(F.col("shape") == x).select("node").distinct()
            ok = self.conforming(Ref(x), mine).select(F.col("node").alias("_n"), F.lit(CONFORMS).alias("_s"))
            d = mine.join(ok, F.col("node") == F.col("_n"), "left").select("node", F.lit(x).alias("shape"), F.coalesce("_s", F.lit(NOT_CONFORMS)).alias("status"))
            out = d if out is None else out.unionByName(d)
        return out


def show(typing: DataFrame) -> DataFrame:
    """A typing as text: node, shape and one of + - ? !!."""
    sign = F.lit("")
    for k, v in SIGNS.items():
        sign = F.when(F.col("status") == k, v).otherwise(sign)
    return typing.select(text(F.col("node")).alias("node"), "shape", sign.alias("status"))


