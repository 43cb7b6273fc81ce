"""Conversions between ShEx and SHACL schemas, both ways, and shape maps from SHACL targets.

Nothing is dropped in silence: what the other language can't say raises NotSupported. CLOSED becomes
sh:closed, facets become their SHACL twins, EXTRA a qualified value shape; a missing sh:minCount is 0 and a
missing sh:maxCount unbounded in ShEx.
"""

from __future__ import annotations

from ..plans import paths as P
from ..plans import shapes as S
from ..sources import rdf
from ..sources.terms import LITERAL, RDF, SH, SUBCLASS, TYPE, XSD, Node, iri, literal
from . import shapemap
from .shex import Schema, term


class NotSupported(ValueError):
    """Something that the target language can't express."""


_FACETS = {"minlength": "minLength", "maxlength": "maxLength", "mininclusive": "minInclusive", "minexclusive": "minExclusive", "maxinclusive": "maxInclusive", "maxexclusive": "maxExclusive"}
_KINDS = {"iri": "IRI", "bnode": "BlankNode", "literal": "Literal", "nonliteral": "BlankNodeOrIRI"}


class ToShacl:
    """Builds a shapes graph; equal anonymous expressions share one blank node."""

    def __init__(self, schema: Schema):
        self.schema, self.out, self.memo, self.n = schema, {}, {}, 0

    def add(self, s: Node, p: str, o: Node) -> None:
        self.out[s, p if ":" in p else SH + p, o] = None

    def fresh(self) -> Node:
        self.n += 1
        return Node(1, f"B{self.n - 1}")

    def chain(self, xs: list[Node]) -> Node:
        rest = iri(RDF + "nil")
        for x in reversed(xs):
            b = self.fresh()
            self.add(b, RDF + "first", x)
            self.add(b, RDF + "rest", rest)
            rest = b
        return rest

    def ref(self, e) -> Node:
        if isinstance(e, str):
            if e == "START":
                return self.ref(self.schema.shape(e))
            self.schema.shape(e)
            return term(e)
        key = repr(e)
        if key not in self.memo:
            self.memo[key] = b = self.fresh()
            self.shape(e, b)
        return self.memo[key]

    def shape(self, e, s: Node) -> None:
        if isinstance(e, str):
            self.add(s, "node", self.ref(e))
            return
        t = e["type"]
        if t == "Shape":
            if e.get("extends"):
                raise NotSupported("SHACL has no inheritance between shapes")
            self.add(s, TYPE, iri(SH + "NodeShape"))
            if e.get("closed"):
                self.add(s, "closed", literal("true", XSD + "boolean"))
            if e.get("semActs"):
                raise NotSupported("SHACL has no semantic actions")
            if "expression" in e:
                self.expression(e, e["expression"], s)
        elif t == "NodeConstraint":
            self.add(s, TYPE, iri(SH + "NodeShape"))
            self.constraint(e, s)
        elif t in ("ShapeAnd", "ShapeOr"):
            self.add(s, TYPE, iri(SH + "NodeShape"))
            self.add(s, "and" if t == "ShapeAnd" else "or", self.chain([self.ref(x) for x in e["shapeExprs"]]))
        elif t == "ShapeNot":
            self.add(s, TYPE, iri(SH + "NodeShape"))
            self.add(s, "not", self.ref(e["shapeExpr"]))
        else:
            raise NotSupported(f"SHACL has nothing like {t}")

    def expression(self, shape: dict, e, s: Node) -> None:
        if isinstance(e, str):
            raise NotSupported("SHACL has no inclusions")
        if e["type"] == "OneOf":
            raise NotSupported("SHACL can't choose between bags of arcs")
        if e["type"] == "EachOf":
            if e.get("min", 1) != 1 or e.get("max", 1) != 1:
                raise NotSupported("SHACL can't repeat groups")
            if e.get("semActs"):
                raise NotSupported("SHACL has no semantic actions")
            parts = e["expressions"]
            if any(isinstance(x, str) or x["type"] != "TripleConstraint" for x in parts):
                raise NotSupported("SHACL has no nested groups")
        else:
            parts = [e]
        names = [(x["predicate"], bool(x.get("inverse"))) for x in parts]
        if len(set(names)) < len(names):
            raise NotSupported("SHACL can't share one predicate's arcs between constraints")
        for c in parts:
            self.triple(c, s, c["predicate"] in shape.get("extra", []))
        for x in shape.get("extra", []):
            if x not in [c["predicate"] for c in parts] and shape.get("closed"):
                self.add(s, "ignoredProperties", self.chain([iri(x)]))

    def triple(self, c: dict, s: Node, extra: bool) -> None:
        if c.get("semActs"):
            raise NotSupported("SHACL has no semantic actions")
        p = self.fresh()
        self.add(s, "property", p)
        if c.get("inverse"):
            b = self.fresh()
            self.add(b, "inversePath", iri(c["predicate"]))
            self.add(p, "path", b)
        else:
            self.add(p, "path", iri(c["predicate"]))
        lo, hi, v = c.get("min", 1), c.get("max", 1), c.get("valueExpr")
        names = ("minCount", "maxCount")
        if extra and v is not None:
            self.add(p, "qualifiedValueShape", self.ref(v))
            names = ("qualifiedMinCount", "qualifiedMaxCount")
        elif v is not None:
            if isinstance(v, dict) and v["type"] == "NodeConstraint":
                self.constraint(v, p)
            else:
                self.add(p, "node", self.ref(v))
        if lo:
            self.add(p, names[0], literal(str(lo), XSD + "integer"))
        if hi != -1:
            self.add(p, names[1], literal(str(hi), XSD + "integer"))

    def constraint(self, e: dict, s: Node) -> None:
        if "nodeKind" in e:
            self.add(s, "nodeKind", iri(SH + _KINDS[e["nodeKind"]]))
        if "datatype" in e:
            self.add(s, "datatype", iri(e["datatype"]))
        for k, name in _FACETS.items():
            if k in e:
                x = e[k]
                self.add(s, name, literal(str(x), XSD + ("integer" if isinstance(x, int) else "decimal")))
        if "length" in e:
            self.add(s, "minLength", literal(str(e["length"]), XSD + "integer"))
            self.add(s, "maxLength", literal(str(e["length"]), XSD + "integer"))
        if "pattern" in e:
            self.add(s, "pattern", literal(e["pattern"]))
            if "flags" in e:
                self.add(s, "flags", literal(e["flags"]))
        for k in ("totaldigits", "fractiondigits"):
            if k in e:
                raise NotSupported(f"SHACL has no {k}")
        if "values" in e:
            self.values(e["values"], s)

    def values(self, vs: list, s: Node) -> None:
        plain = [v for v in vs if not (isinstance(v, dict) and ("stem" in v or "languageTag" in v))]
        if len(plain) == len(vs):
            self.add(s, "in", self.chain([term(v) for v in vs]))
            return
        parts = [{"type": "NodeConstraint", "values": plain}] if plain else []
        options = [self.ref(x) for x in parts]
        for v in vs:
            if v in plain:
                continue
            if "exclusions" in v or not isinstance(v.get("stem", ""), str):
                raise NotSupported("SHACL can't exclude values from a stem")
            b = self.fresh()
            self.add(b, TYPE, iri(SH + "NodeShape"))
            if "languageTag" in v:
                raise NotSupported("sh:languageIn also takes longer tags, so it can't stand for one tag")
            if v["type"] == "LanguageStem":
                self.add(b, "languageIn", self.chain([literal(v["stem"])]))
            else:
                self.add(b, "nodeKind", iri(SH + ("IRI" if v["type"] == "IriStem" else "Literal")))
                self.add(b, "pattern", literal("^" + _quote(v["stem"])))
            options.append(b)
        if len(options) == 1:
            self.add(s, "node", options[0])
        else:
            self.add(s, "or", self.chain(options))


def _quote(x: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in x)


def shex_to_shacl(schema: Schema, found: list[shapemap.Association] = ()) -> list[tuple[Node, str, Node]]:
    """The shapes graph of a ShEx schema; a shape map's associations become targets."""
    to = ToShacl(schema)
    for x, e in schema.shapes.items():
        to.shape(e, term(x))
    for a in found:
        s = to.ref(a.shape)
        if isinstance(a.selector, Node):
            to.add(s, "targetNode", a.selector)
        elif isinstance(a.selector, tuple) and isinstance(a.selector[1], P.Pred) and a.selector[0] is None and (a.selector[2] is None or a.selector[1].iri == TYPE):
            _, p, o, front = a.selector
            to.add(s, "targetClass" if o is not None else "targetSubjectsOf" if front else "targetObjectsOf", o if o is not None else iri(p.iri))
        else:
            raise NotSupported(f"SHACL has no target like {shapemap.show(a)}")
    return list(to.out)


def target_map(shapes: dict[Node, S.Shape]) -> list[shapemap.Association]:
    """The shape map that selects what SHACL's targets select."""
    out = []
    for x, s in shapes.items():
        label = x.lex if x.kind == 0 else f"_:{x.lex}"
        for kind, n in s.targets:
            if kind == "targetNode":
                sel: object = n
            elif kind == "targetClass":
                sel = (None, P.Seq((P.Pred(TYPE), P.Star(P.Pred(SUBCLASS)))), n, True)
            else:
                sel = (None, P.Pred(n.lex), None, kind == "targetSubjectsOf")
            out.append(shapemap.Association(sel, label))
    return out


def shacl_to_shex(shapes: dict[Node, S.Shape]) -> tuple[dict, list[shapemap.Association]]:
    """A ShExJ schema and the shape map of the targets."""
    name = lambda n: n.lex if n.kind == 0 else f"_:{n.lex}"
    value = lambda n: {"value": n.lex} | ({"language": n.lang} if n.lang else {} if n.dt == XSD + "string" else {"type": n.dt}) if n.kind == LITERAL else name(n)

    def leaf(k: str, v) -> dict | None:
        if k == "nodeKind":
            kind = v.lex.removeprefix(SH)
            one = {v: k for k, v in _KINDS.items()}
            if kind in one:
                return {"nodeKind": one[kind]}
            parts = {"BlankNodeOrLiteral": ("bnode", "literal"), "IRIOrLiteral": ("iri", "literal")}[kind]
            return {"or": [{"type": "NodeConstraint", "nodeKind": x} for x in parts]}
        if k == "datatype":
            return {"datatype": v.lex}
        if k == "in":
            return {"values": [value(x) for x in v]}
        if k == "languageIn":
            return {"values": [{"type": "LanguageStem", "stem": x.lex.lower()} for x in v]}
        if k in ("minLength", "maxLength"):
            return {k.lower(): v}
        if k == "pattern":
            return {"pattern": v[0]} | ({"flags": v[1]} if v[1] else {})
        if k in _FACETS.values():
            if not v.dt.startswith(XSD) or not v.lex.replace(".", "", 1).lstrip("+-").isdigit():
                raise NotSupported(f"ShEx compares numbers alone, not {v.nt()}")
            return {k.lower(): int(v.lex) if v.dt == XSD + "integer" else float(v.lex)}
        return None

    def exprs(s: S.Shape, skip: tuple = ()) -> list:
        """Conjuncts over a value."""
        out, flat = [], {}
        for k, v in s.constraints:
            if k in skip:
                continue
            if (c := leaf(k, v)) is not None:
                if "or" in c:
                    out.append({"type": "ShapeOr", "shapeExprs": c["or"]})
                elif set(c) & set(flat):
                    out.append({"type": "NodeConstraint", **c})
                else:
                    flat |= c
            elif k == "node":
                out.append(ref(v))
            elif k in ("and", "or"):
                xs = [ref(x) for x in v]
                out.append(xs[0] if len(xs) == 1 else {"type": "ShapeAnd" if k == "and" else "ShapeOr", "shapeExprs": xs})
            elif k == "not":
                out.append({"type": "ShapeNot", "shapeExpr": ref(v)})
            elif k == "xone":
                xs = [ref(x) for x in v]
                nots = [{"type": "ShapeNot", "shapeExpr": x} for x in xs]
                each = [{"type": "ShapeAnd", "shapeExprs": [xs[i], *(nots[j] for j in range(len(xs)) if j != i)]} if len(xs) > 1 else xs[i] for i in range(len(xs))]
                out.append(each[0] if len(each) == 1 else {"type": "ShapeOr", "shapeExprs": each})
            elif k == "hasValue" and s.path is None:
                out.append({"type": "NodeConstraint", "values": [value(v)]})
            elif k == "class":
                raise NotSupported(f"ShEx can't follow rdfs:subClassOf* to {v.nt()}")
            else:
                raise NotSupported(f"ShEx has nothing like sh:{k}")
        return ([{"type": "NodeConstraint", **flat}] if flat else []) + out

    def ref(x: Node):
        return name(x) if x in shapes else {"type": "Shape"}

    def conj(xs: list):
        return None if not xs else xs[0] if len(xs) == 1 else {"type": "ShapeAnd", "shapeExprs": xs}

    def triples(p: S.Shape) -> tuple[list, list]:
        """The triple constraint of a property shape and its constraints that need EXTRA."""
        if isinstance(p.path, P.Pred):
            base: dict = {"type": "TripleConstraint", "predicate": p.path.iri}
        elif isinstance(p.path, P.Inv) and isinstance(p.path.path, P.Pred):
            base = {"type": "TripleConstraint", "inverse": True, "predicate": p.path.path.iri}
        else:
            raise NotSupported(f"ShEx has no path {P.text(p.path)}")
        own = dict((k, v) for k, v in p.constraints if k in ("minCount", "maxCount"))
        parts = exprs(p, ("minCount", "maxCount", "hasValue", "qualified")) + [ref_of_properties(p)] * bool(p.properties)
        v = conj(parts)
        lo, hi = own.get("minCount", 0), own.get("maxCount", -1)
        out = [base | ({"valueExpr": v} if v is not None else {}) | ({"min": lo, "max": hi} if (lo, hi) != (1, 1) else {})]
        return out, [(k, x) for k, x in p.constraints if k in ("hasValue", "qualified")]

    def ref_of_properties(p: S.Shape):
        return body(S.Shape(p.id, None, properties=p.properties))

    def body(s: S.Shape):
        """The expression of a node shape."""
        if s.deactivated:
            return {"type": "Shape"}
        parts = exprs(s)
        groups: list[dict] = []
        for x in s.properties:
            p = shapes[x]
            if p.deactivated:
                continue
            tcs, more = triples(p)
            # each property shape has a Shape of its own, as they may share a predicate
            groups.append({"type": "Shape", "expression": tcs[0]})
            inv = {"inverse": True} if isinstance(p.path, P.Inv) else {}
            pred = tcs[0]["predicate"]
            for k, q in more:
                if k == "hasValue":
                    v, lo, hi = {"type": "NodeConstraint", "values": [value(q)]}, 1, -1
                else:
                    if q[3]:
                        raise NotSupported("ShEx has no disjoint qualified shapes")
                    v, lo, hi = ref(q[0]), q[1] or 0, -1 if q[2] is None else q[2]
                if inv:
                    raise NotSupported("EXTRA doesn't reach inverse arcs")
                groups.append({"type": "Shape", "extra": [pred], "expression": {"type": "TripleConstraint", "predicate": pred, "valueExpr": v, "min": lo, "max": hi}})
        preds = [(g["expression"]["predicate"], g["expression"].get("inverse", False)) for g in groups]
        if groups and len(set(preds)) == len(preds) and not any("extra" in g for g in groups):
            tcs = [g["expression"] for g in groups]
            groups = [{"type": "Shape", "expression": tcs[0] if len(tcs) == 1 else {"type": "EachOf", "expressions": tcs}}]
            if s.closed is not None:
                extra = [x for x in s.closed if x not in [p for p, _ in preds]]
                groups[0] = {"type": "Shape", "closed": True} | ({"extra": extra} if extra else {}) | {k: v for k, v in groups[0].items() if k != "type"}
        elif s.closed is not None:
            groups.append({"type": "Shape", "closed": True} | ({"extra": list(s.closed)} if s.closed else {}))
        return conj(parts + groups) or {"type": "Shape"}

    out = []
    for x, s in shapes.items():
        if s.path is None:
            e = body(s)
            out.append({"id": name(x), **e} if isinstance(e, dict) else {"type": "ShapeAnd", "id": name(x), "shapeExprs": [e]})
    return {"type": "Schema", "shapes": out}, target_map({x: s for x, s in shapes.items() if s.path is None})


def shacl_text(triples) -> str:
    return "\n".join(f"{s.nt()} <{p}> {o.nt()} ." for s, p, o in triples) + "\n"


def read_shacl(text: str, format: str = "turtle") -> dict[Node, S.Shape]:
    return S.read(rdf.parse(text, format))
