"""ShEx validation as DataFrame plans.

A schema is a value in ShExJ's form. References between shapes make a signed graph: cycles through
NOT or EXTRA are rejected; strongly connected shapes are taken in order, so that every shape outside a
cycle is evaluated once. In a cycle all pairs (node, shape) that are asked for start as conforming, and
rounds take away those that fail under the current typing until none does: the greatest fixpoint. What is
asked for follows the references from the shape map before anything is evaluated.

A shape whose predicates occur once each (per direction), without choices or repeated groups, is one
aggregate: for every constraint the number of conforming arcs lies in its interval, and no other arc of
its predicate is there unless EXTRA allows. Other expressions collect each node's arcs as counts by signature
(bounded by the expression, not by the node's degree), and a batched matcher solves each signature bag once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..plans import bags, shexc
from ..plans.paths import _cut as cut
from ..sources.terms import BNODE, IRI, LITERAL, STRING, XSD, Node, constant, iri, literal, same

OPS = {"mininclusive": ">=", "minexclusive": ">", "maxinclusive": "<=", "maxexclusive": "<"}
START = "START"


class SchemaError(ValueError):
    """A schema that breaks a rule: a missing reference, a negated cycle, an unknown action."""


@dataclass
class Schema:
    """A ShEx schema with its lookups; `actions` decide semantic actions, `external` shapes by label."""

    body: dict
    actions: dict = field(default_factory=dict)  # name -> function(code) -> bool
    external: dict = field(default_factory=dict)  # label -> shape expression

    def __post_init__(self):
        self.shapes = {s["id"]: s["shapeExpr"] if s["type"] == "ShapeDecl" else s for s in self.body.get("shapes", [])}
        self.triples: dict[str, dict] = {}
        for s in [*self.shapes.values(), self.body.get("start")]:
            self._labels(s)
        for x, s in list(self.shapes.items()):
            if s["type"] == "ShapeExternal":
                if x in self.external:
                    self.shapes[x] = self.external[x]

    def _labels(self, e) -> None:
        if isinstance(e, dict):
            if e.get("type") in ("TripleConstraint", "EachOf", "OneOf") and "id" in e:
                if e["id"] in self.triples:
                    raise SchemaError(f"{e['id']} labels two triple expressions")
                self.triples[e["id"]] = e
            for v in e.values():
                self._labels(v)
        elif isinstance(e, list):
            for v in e:
                self._labels(v)

    def shape(self, label: str):
        if label == START:
            if "start" not in self.body:
                raise SchemaError("the schema has no start shape")
            return self.body["start"]
        if label not in self.shapes:
            raise SchemaError(f"no shape {label}")
        return self.shapes[label]

    def triple(self, e) -> dict:
        if isinstance(e, str):
            if e not in self.triples:
                raise SchemaError(f"no triple expression {e}")
            return self.triples[e]
        return e

    def constraints(self, e) -> list[dict]:
        """The triple constraints of an expression, inclusions resolved."""
        seen: list[str] = []

        def walk(x) -> list[dict]:
            if isinstance(x, str):
                if x in seen:
                    raise SchemaError(f"{x} includes itself")
                seen.append(x)
                out = walk(self.triple(x))
                seen.pop()
                return out
            return [x] if x["type"] == "TripleConstraint" else [t for y in x["expressions"] for t in walk(y)]

        return walk(e)

    # references and strata

    def references(self, e, negated: bool = False):
        """(label, negated) of what a shape expression refers to."""
        if isinstance(e, str):
            yield e, negated
        elif isinstance(e, dict):
            t = e["type"]
            if t in ("ShapeAnd", "ShapeOr"):
                for x in e["shapeExprs"]:
                    yield from self.references(x, negated)
            elif t == "ShapeNot":
                yield from self.references(e["shapeExpr"], not negated)
            elif t == "ShapeDecl":
                yield from self.references(e["shapeExpr"], negated)
            elif t == "Shape":
                for x in e.get("extends", []):
                    yield x, negated
                for c in self.constraints(e["expression"]) if "expression" in e else []:
                    if "valueExpr" in c:
                        # an arc that EXTRA tolerates counts for failing its shape too
                        yield from self.references(c["valueExpr"], negated)
                        if c["predicate"] in e.get("extra", []):
                            yield from self.references(c["valueExpr"], not negated)

    def strata(self) -> list[list[str]]:
        """Strongly connected shapes, referred ones first; raises on missing references and negated cycles."""
        labels = [*self.shapes, *[START] * ("start" in self.body)]
        edges = {x: list(self.references(self.shape(x))) for x in labels}
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        stack: list[str] = []
        out: list[list[str]] = []

        def visit(x: str) -> None:
            index[x] = low[x] = len(index)
            stack.append(x)
            for y, _ in edges[x]:
                self.shape(y)
                if y not in index:
                    visit(y)
                    low[x] = min(low[x], low[y])
                elif y in stack:
                    low[x] = min(low[x], index[y])
            if low[x] == index[x]:
                part = []
                while True:
                    part.append(stack.pop())
                    if part[-1] == x:
                        break
                if any(y in part and neg for z in part for y, neg in edges[z]):
                    raise SchemaError(f"negation in the cycle of {', '.join(sorted(part))}")
                out.append(part)

        for x in labels:
            if x not in index:
                visit(x)
        return out

    def check(self) -> list[str]:
        """What is wrong with the schema; empty if it is well formed."""
        try:
            for s in [*self.shapes.values(), *([self.body["start"]] if "start" in self.body else [])]:
                for e in _shapes_in(s):
                    if "expression" in e:
                        self.constraints(e["expression"])
            self.strata()
        except (SchemaError, RecursionError) as e:
            return [str(e)]
        return []


def _shapes_in(e):
    if isinstance(e, dict):
        if e.get("type") == "Shape":
            yield e
        for v in e.values():
            yield from _shapes_in(v)
    elif isinstance(e, list):
        for v in e:
            yield from _shapes_in(v)


def load(text: str, format: str = "ShExC", base: str = "", fetch=None, **kw) -> Schema:
    """A schema from ShExC, ShExJ or (as Turtle) ShExR; `fetch` (IRI to text) follows IMPORTs, each once."""
    from . import shexr

    kind = format.lower()
    if kind not in ("shexc", "shexj", "shexr", "turtle"):
        raise ValueError(f"unknown schema format {format}; known are ShExC, ShExJ and ShExR")
    read = {"shexc": lambda t, b: shexc.parse(t, b), "shexj": lambda t, b: json.loads(t)}.get(kind, lambda t, b: shexr.read(t, b))
    body = read(text, base)
    todo, seen = list(body.get("imports", [])), set()
    while todo and fetch:
        x = todo.pop(0)
        if x not in seen:
            seen.add(x)
            other = read(fetch(x), x)
            have = {s["id"] for s in body.get("shapes", [])}
            body.setdefault("shapes", []).extend(s for s in other.get("shapes", []) if s["id"] not in have)
            if "start" in other and "start" not in body:
                body["start"] = other["start"]
            todo += other.get("imports", [])
    schema = Schema(body, **kw)
    if errors := schema.check():
        raise SchemaError(errors[0])
    return schema


def term(v) -> Node:
    """A ShExJ object value as a node."""
    if isinstance(v, str):
        return Node(BNODE, v[2:]) if v.startswith("_:") else iri(v)
    return literal(v["value"], v.get("type", STRING), v.get("language", ""))


class Validator:
    def __init__(self, graph: DataFrame, schema: Schema):
        self.graph, self.schema = graph, schema
        self.typing: dict[str, DataFrame] = {}  # label -> conforming nodes (column node) among those asked

    # node constraints

    def value(self, v: Column, x) -> Column:
        if isinstance(x, dict) and x.get("type") in ("IriStem", "IriStemRange", "LiteralStem", "LiteralStemRange", "LanguageStem", "LanguageStemRange", "Language"):
            t = x["type"]
            if t == "Language":
                return (v["kind"] == LITERAL) & (v["lang"] == x["languageTag"].lower()) & (v["lang"] != "")
            kind = t.removesuffix("Range").removesuffix("Stem")
            ok = self._stem(v, kind, x["stem"])
            for e in x.get("exclusions", []):
                if isinstance(e, dict) and "stem" in e:
                    ok &= ~self._stem(v, kind, e["stem"])
                elif kind == "Iri":
                    ok &= v["lex"] != e
                elif kind == "Language":
                    ok &= v["lang"] != (e if isinstance(e, str) else e["languageTag"]).lower()
                else:
                    ok &= v["lex"] != (e if isinstance(e, str) else e["value"])
            return ok
        return same(v, term(x))

    @staticmethod
    def _stem(v: Column, kind: str, stem) -> Column:
        if kind == "Language":
            return (v["kind"] == LITERAL) & (v["lang"] != "") & (F.lit(True) if isinstance(stem, dict) else N.language_matches(v["lang"], stem))
        own = v["kind"] == (IRI if kind == "Iri" else LITERAL)
        return own if isinstance(stem, dict) else own & v["lex"].startswith(stem)

    def constraint(self, v: Column, e: dict) -> Column:
        out = F.lit(True)
        if "nodeKind" in e:
            out &= N.kind_in(v, e["nodeKind"])
        if "datatype" in e:
            out &= N.datatype(v, e["datatype"])
        if "values" in e:
            out &= reduce(lambda a, b: a | b, (self.value(v, x) for x in e["values"]), F.lit(False))
        for k, op in (("length", "="), ("minlength", ">="), ("maxlength", "<=")):
            if k in e:
                out &= N.length(v, op, e[k], bnodes=True)
        if "pattern" in e:
            out &= N.pattern(v, e["pattern"], e.get("flags", ""), bnodes=True)
        for k, op in OPS.items():
            if k in e:
                x = e[k]
                out &= N.compare(v, constant(literal(repr(x) if isinstance(x, float) else str(x), XSD + ("double" if isinstance(x, float) else "integer"))), op)
        for k in ("totaldigits", "fractiondigits"):
            if k in e:
                out &= N.digits(v, e[k], k == "fractiondigits")
        return out

    def local(self, e, v: Column) -> Column | None:
        """A shape expression over the node alone as a Column, else None."""
        if e is None:
            return F.lit(True)
        if isinstance(e, str):
            return None
        t = e["type"]
        if t == "NodeConstraint":
            return self.constraint(v, e)
        if t in ("ShapeAnd", "ShapeOr"):
            parts = [self.local(x, v) for x in e["shapeExprs"]]
            return None if any(p is None for p in parts) else reduce((lambda a, b: a & b) if t == "ShapeAnd" else (lambda a, b: a | b), parts)
        if t == "ShapeNot":
            c = self.local(e["shapeExpr"], v)
            return None if c is None else ~c
        return F.lit(True) if t == "Shape" and "expression" not in e and not e.get("closed") and not e.get("extends") and not e.get("semActs") else None

    # shape expressions over sets of nodes

    def conforming(self, e, nodes: DataFrame) -> DataFrame:
        """Those of the distinct nodes (column node) that conform, under the current typing."""
        c = self.local(e, F.col("node"))
        if c is not None:
            return nodes.filter(c)
        if isinstance(e, str):
            ok = self.typing[e].select(F.col("node").alias("_t"))
            return nodes.join(ok, F.col("node") == F.col("_t"), "left_semi")
        t = e["type"]
        if t == "ShapeAnd":
            for x in e["shapeExprs"]:
                nodes = self.conforming(x, nodes)
            return nodes
        if t == "ShapeOr":
            return reduce(lambda a, b: a.unionByName(b), (self.conforming(x, nodes) for x in e["shapeExprs"])).distinct()
        if t == "ShapeNot":
            ok = self.conforming(e["shapeExpr"], nodes).select(F.col("node").alias("_t"))
            return nodes.join(ok, F.col("node") == F.col("_t"), "left_anti")
        if t == "ShapeExternal":
            raise SchemaError("an external shape was not given")
        if t == "ShapeDecl":
            return self.conforming(e["shapeExpr"], nodes)
        for x in e.get("extends", []):
            nodes = self.conforming(x, nodes)
        return self.shape(e, nodes)

    def acts(self, e: dict) -> bool:
        for a in e.get("semActs", []):
            f = self.schema.actions.get(a["name"])
            if f is not None and not f(a.get("code")):
                return False
        return True

    def shape(self, e: dict, nodes: DataFrame) -> DataFrame:
        if not self.acts(e):
            return nodes.limit(0)
        tcs = self.schema.constraints(e["expression"]) if "expression" in e else []
        narrow = len(tcs) <= 62  # the constraints that an arc fits are bits of a long, else an array
        extra = set(e.get("extra", []))
        parts = []
        for back in (False, True):
            mine = [(i, c) for i, c in enumerate(tcs) if bool(c.get("inverse")) == back]
            preds = sorted({c["predicate"] for _, c in mine})
            if not preds and not (e.get("closed") and not back):
                continue
            g = self.graph if e.get("closed") and not back else self.graph.filter(F.col("p").isin(*preds))
            me, other = ("o", "s") if back else ("s", "o")
            arcs = nodes.join(g.select(F.col(me).alias("_m"), "p", F.col(other).alias("_v")), F.col("node") == F.col("_m")).select("node", "p", "_v")
            fits = []
            for i, c in mine:
                on = F.col("p") == c["predicate"]
                ok = self.local(c.get("valueExpr"), F.col("_v"))
                if not self.acts(c):
                    ok = F.lit(False)
                if ok is None:
                    asked = arcs.filter(on).select(F.col("_v").alias("node")).distinct()
                    good = self.conforming(c["valueExpr"], asked).select(F.col("node").alias(f"_g{i}"), F.lit(True).alias(f"_f{i}"))
                    arcs = arcs.join(good, F.col("_v") == F.col(f"_g{i}"), "left").drop(f"_g{i}")
                    ok = F.coalesce(F.col(f"_f{i}"), F.lit(False))
                fits.append((i, on & ok))
            if narrow:
                mask = reduce(lambda a, b: a + b, (F.when(f, F.lit(1 << i)).otherwise(0).cast("long") for i, f in fits), F.lit(0).cast("long"))
            else:
                mask = F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(f, F.lit(i)) for i, f in fits)))
            spare = F.col("p").isin(*extra) if extra and not back else F.lit(False)
            parts.append(arcs.select("node", mask.alias("mask"), spare.alias("spare")))
        if not parts:
            return nodes if self._empty_ok(e) else nodes.limit(0)
        arcs = reduce(lambda a, b: a.unionByName(b), parts)
        sep = {}
        for c in tcs:
            sep.setdefault((c["predicate"], bool(c.get("inverse"))), []).append(c)
        none = F.col("mask") == 0 if narrow else F.size("mask") == 0
        fit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 if narrow else F.array_contains("mask", i)
        lost = F.coalesce(F.count_if(none & ~F.col("spare")), F.lit(0)).alias("lost")
        flat = self._flat(e.get("expression"), tcs) if all(len(x) == 1 for x in sep.values()) else None
        bare = nodes.select(F.col("node").alias("_n"))
        if flat is not None:
            hits = [F.count_if(fit(i)).alias(f"c{i}") for i in range(len(tcs))]
            per = bare.join(arcs.groupBy("node").agg(lost, *hits), F.col("_n") == F.col("node"), "left")
            ok = F.coalesce("lost", F.lit(0)) == 0
            for i, (lo, hi) in enumerate(flat):
                n = F.coalesce(f"c{i}", F.lit(0))
                ok &= n >= lo
                if hi != -1:
                    ok &= n <= hi
            return per.filter(ok).select(F.col("_n").alias("node"))
        # collect counts by signature, then match each bag of signatures once
        seen = arcs.groupBy("node", "mask", "spare").agg(F.count("*").alias("k"))
        lists = seen.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("mask", "spare", "k"))).alias("bag"))
        per = bare.join(lists, F.col("_n") == F.col("node"), "left").select(F.col("_n").alias("node"), "bag")
        form = self._form(e["expression"])

        def run(batches):
            solve = lru_cache(65536)(lambda bag: _match(form, bag))
            for rb in batches:
                ok = [solve(tuple((b["mask"] if narrow else sum(1 << i for i in b["mask"]), b["spare"], b["k"]) for b in (bag or ()))) for bag in rb.column("bag").to_pylist()]
                yield rb.select(["node"]).filter(pa.array(ok, pa.bool_()))

        return per.mapInArrow(run, nodes.select("node").schema)

    def _empty_ok(self, e: dict) -> bool:
        return "expression" not in e or bags.matches(self._form(e["expression"]), ())

    def _flat(self, e, tcs: list[dict]):
        """(min, max) of each constraint if the expression is a plain conjunction."""
        if e is None:
            return []
        e = self.schema.triple(e)
        if e["type"] == "TripleConstraint":
            return [(e.get("min", 1), e.get("max", 1))]
        if e["type"] == "EachOf" and e.get("min", 1) == 1 and e.get("max", 1) == 1:
            parts = [self._flat(x, tcs) for x in e["expressions"]]
            return None if any(p is None for p in parts) or not self.acts(e) else [y for p in parts for y in p]
        return None

    def _form(self, e) -> tuple:
        count = [0]

        def walk(x) -> tuple:
            x = self.schema.triple(x)
            lo, hi = x.get("min", 1), x.get("max", 1)
            if x["type"] == "TripleConstraint":
                count[0] += 1
                return ("t", count[0] - 1, lo, hi)
            out = ("each" if x["type"] == "EachOf" else "one", tuple(walk(y) for y in x["expressions"]), lo, hi)
            return out if self.acts(x) else ("one", (), max(lo, 1), hi)

        return walk(e)

    # typing

    def demand(self, asked: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All nodes that each shape has to be evaluated on, following references from what is asked."""
        want = {x: cut(d.distinct()) for x, d in asked.items()}
        new = dict(want)
        while new:
            step: dict[str, list[DataFrame]] = {}
            for x, nodes in new.items():
                for y, d in self._asks(self.schema.shape(x), nodes):
                    step.setdefault(y, []).append(d)
            new = {}
            for y, ds in step.items():
                d = reduce(lambda a, b: a.unionByName(b), ds).distinct()
                if y in want:
                    d = d.join(want[y].select(F.col("node").alias("_w")), F.col("node") == F.col("_w"), "left_anti")
                d = cut(d)
                if not d.isEmpty():
                    new[y] = d
                    want[y] = cut(want[y].unionByName(d)) if y in want else d
                elif y not in want:
                    want[y] = d
        return want

    def _asks(self, e, nodes: DataFrame):
        if isinstance(e, str):
            yield e, nodes
        elif isinstance(e, dict):
            t = e["type"]
            if t in ("ShapeAnd", "ShapeOr"):
                for x in e["shapeExprs"]:
                    yield from self._asks(x, nodes)
            elif t in ("ShapeNot", "ShapeDecl"):
                yield from self._asks(e["shapeExpr"], nodes)
            elif t == "Shape":
                for x in e.get("extends", []):
                    yield x, nodes
                for c in self.schema.constraints(e["expression"]) if "expression" in e else []:
                    if c.get("valueExpr") is not None and self.local(c["valueExpr"], F.col("node")) is None:
                        me, other = ("o", "s") if c.get("inverse") else ("s", "o")
                        g = self.graph.filter(F.col("p") == c["predicate"]).select(F.col(me).alias("_m"), F.col(other).alias("_v"))
                        yield from self._asks(c["valueExpr"], nodes.join(g, F.col("node") == F.col("_m")).select(F.col("_v").alias("node")).distinct())

    def run(self, asked: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Conforming nodes of every shape among those asked for (label -> column node)."""
        want = self.demand(asked)
        if not self.acts({"semActs": self.schema.body.get("startActs", [])}):
            return {x: d.limit(0) for x, d in want.items()}
        for part in self.schema.strata():
            part = [x for x in part if x in want]
            cyclic = len(part) > 1 or any(y == x for x in part for y, _ in self.schema.references(self.schema.shape(x)))
            if not cyclic:
                for x in part:
                    self.typing[x] = cut(self.conforming(self.schema.shape(x), want[x]))
                continue
            for x in part:
                self.typing[x] = want[x]
            now = {x: cut(self.conforming(self.schema.shape(x), want[x])) for x in part}
            while True:  # only nodes near one that has lost a shape can lose theirs
                lost = cut(reduce(lambda a, b: a.unionByName(b), (self._less(self.typing[x], now[x]) for x in part)).distinct())
                self.typing |= now
                if lost.isEmpty():
                    break
                near = lost
                for _ in range(max(self._arcs(self.schema.shape(x)) for x in part)):
                    here = near.select(F.col("node").alias("_l"))
                    beside = [self.graph.join(here, F.col(at) == F.col("_l"), "left_semi").select(F.col(other).alias("node")) for at, other in (("o", "s"), ("s", "o"))]
                    near = cut(reduce(lambda a, b: a.unionByName(b), beside, near).distinct())
                now = {x: self._recheck(x, near) for x in part}
        return self.typing

    def _arcs(self, e) -> int:
        """Over how many arcs a shape looks before it asks for another one's typing; anonymous shapes nest."""
        if not isinstance(e, dict):
            return 0
        inner = [*e.get("shapeExprs", []), *([e["shapeExpr"]] if "shapeExpr" in e else [])]
        own = [1 + self._arcs(c.get("valueExpr")) for c in self.schema.constraints(e["expression"])] if e["type"] == "Shape" and "expression" in e else []
        return max([0, *map(self._arcs, inner), *own])

    @staticmethod
    def _less(nodes: DataFrame, other: DataFrame, how: str = "left_anti") -> DataFrame:
        return nodes.join(other.select(F.col("node").alias("_o")), F.col("node") == F.col("_o"), how)

    def _recheck(self, x: str, near: DataFrame) -> DataFrame:
        """A shape's nodes, those in `near` evaluated again."""
        mine = cut(self._less(self.typing[x], near, "left_semi"))
        return cut(self._less(self.typing[x], near).unionByName(self.conforming(self.schema.shape(x), mine)))

    def validate(self, targets: DataFrame) -> DataFrame:
        """`targets` (node, shape) with conforms; shape is a label or START."""
        labels = [r[0] for r in targets.select("shape").distinct().collect()]
        asked = {x: targets.filter(F.col("shape") == x).select("node").distinct() for x in labels}
        typing = self.run(asked)
        out = None
        for x in labels:
            ok = typing[x].select(F.col("node").alias("_t"), F.lit(True).alias("_c"))
            d = asked[x].join(ok, F.col("node") == F.col("_t"), "left").select("node", F.lit(x).alias("shape"), F.coalesce("_c", F.lit(False)).alias("conforms"))
            out = d if out is None else out.unionByName(d)
        return out


def _match(form: tuple, bag: tuple) -> bool:
    """bag of (mask, spare, count): arcs that fit nothing must be spare; others are matched."""
    if any(m == 0 and not s for m, s, _ in bag):
        return False
    return bags.matches(form, tuple(x for x in bag if x[0]))
