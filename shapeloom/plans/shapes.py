"""SHACL shapes as driver-side values, read from a shapes graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..sources.terms import BNODE, LITERAL, OWL, RDF, RDFS, SH, TYPE, XSD, Node, iri
from . import paths as P

NIL = iri(RDF + "nil")


class ShapeError(ValueError):
    """An ill-formed or unsupported shapes graph."""


@dataclass
class Shape:
    id: Node
    path: object = None
    targets: list = field(default_factory=list)  # (kind, Node)
    constraints: list = field(default_factory=list)  # (kind, value)
    properties: list = field(default_factory=list)
    closed: list | None = None  # predicates that are allowed
    severity: str = SH + "Violation"
    message: str = ""
    deactivated: bool = False


class Index:
    """Driver-side lookups over a shapes graph."""

    def __init__(self, triples):
        self.out: dict[Node, dict[str, list[Node]]] = {}
        self.triples = list(triples)
        for s, p, o in self.triples:
            self.out.setdefault(s, {}).setdefault(p, []).append(o)

    def all(self, s: Node, p: str) -> list[Node]:
        return self.out.get(s, {}).get(p, [])

    def one(self, s: Node, p: str) -> Node | None:
        return next(iter(self.all(s, p)), None)

    def list(self, head: Node) -> list[Node]:
        out, seen = [], set()
        while head != NIL:
            if head in seen or not self.all(head, RDF + "first"):
                raise ShapeError(f"ill-formed list at {head.nt()}")
            seen.add(head)
            out.append(self.all(head, RDF + "first")[0])
            head = self.one(head, RDF + "rest") or NIL
        return out

    def is_list(self, x: Node) -> bool:
        return x == NIL or bool(self.all(x, RDF + "first"))


PARAMETERS = (
    "class datatype nodeKind minCount maxCount minExclusive minInclusive maxExclusive maxInclusive minLength maxLength pattern languageIn "
    "uniqueLang equals disjoint lessThan lessThanOrEquals not and or xone node property qualifiedValueShape closed hasValue in sparql"
).split()
TARGETS = ("targetNode", "targetClass", "targetSubjectsOf", "targetObjectsOf")


def path(ix: Index, x: Node):
    """A SHACL path node; a list wins over other readings."""
    if x.kind == 0:
        return P.Pred(x.lex)
    if x.kind == LITERAL:
        raise ShapeError("a literal isn't a path")
    if ix.is_list(x):
        parts = tuple(path(ix, y) for y in ix.list(x))
        if len(parts) < 2:
            raise ShapeError("a sequence path has two parts at least")
        return P.Seq(parts)
    for name, make in (("inversePath", P.Inv), ("zeroOrMorePath", P.Star), ("oneOrMorePath", P.Plus), ("zeroOrOnePath", P.Opt)):
        if (y := ix.one(x, SH + name)) is not None:
            return make(path(ix, y))
    if (y := ix.one(x, SH + "alternativePath")) is not None:
        return P.Alt(tuple(path(ix, z) for z in ix.list(y)))
    raise ShapeError(f"ill-formed path {x.nt()}")


def _int(n: Node) -> int:
    if n.dt != XSD + "integer" and not n.dt.startswith(XSD):
        raise ShapeError(f"{n.nt()} isn't an integer")
    return int(n.lex)


def read(triples) -> dict[Node, Shape]:
    """All shapes of a shapes graph by id; shapes that only others refer to are among them."""
    ix = Index(triples)
    roots: dict[Node, None] = {}
    refs = {SH + p for p in ("property", "node", "not", "qualifiedValueShape")}
    lists = {SH + p for p in ("and", "or", "xone")}
    for s, p, o in ix.triples:
        if p == TYPE and o.lex in (SH + "NodeShape", SH + "PropertyShape") or p in {SH + t for t in TARGETS} or p.removeprefix(SH) in PARAMETERS and p.startswith(SH) and p not in (SH + "not",) and s.kind != LITERAL:
            roots[s] = None
        if p in refs:
            roots[s] = roots[o] = None
        if p in lists:
            roots[s] = None
            roots.update(dict.fromkeys(ix.list(o)))
    out: dict[Node, Shape] = {}
    for x in roots:
        if x.kind != LITERAL and not (x not in ix.out and x.kind == BNODE):
            out[x] = _shape(ix, x)
    return out


def _shape(ix: Index, x: Node) -> Shape:
    s = Shape(x)
    if (p := ix.one(x, SH + "path")) is not None:
        if len(ix.all(x, SH + "path")) > 1:
            raise ShapeError("a shape has one path at most")
        s.path = path(ix, p)
    get, one = (lambda n: ix.all(x, SH + n)), (lambda n: ix.one(x, SH + n))
    s.targets = [(t, o) for t in TARGETS for o in get(t)]
    if any(o.lex in (RDFS + "Class", OWL + "Class") for o in ix.all(x, TYPE)):
        s.targets.append(("targetClass", x))
    s.deactivated = any(o.lex in ("true", "1") for o in get("deactivated"))
    if (v := one("severity")) is not None:
        s.severity = v.lex
    if (v := one("message")) is not None:
        s.message = v.lex
    s.properties = get("property")
    c = s.constraints
    for name in ("class", "datatype", "nodeKind", "minExclusive", "minInclusive", "maxExclusive", "maxInclusive", "equals", "disjoint", "lessThan", "lessThanOrEquals", "not", "node", "hasValue"):
        c += [(name, o) for o in get(name)]
    for name in ("minCount", "maxCount", "minLength", "maxLength"):
        c += [(name, _int(o)) for o in get(name)]
    for o in get("pattern"):
        c.append(("pattern", (o.lex, one("flags").lex if one("flags") else "")))
    for name in ("and", "or", "xone", "in", "languageIn"):
        c += [(name, tuple(ix.list(o))) for o in get(name)]
    if any(o.lex == "true" and o.dt == XSD + "boolean" for o in get("uniqueLang")):
        c.append(("uniqueLang", True))
    if (q := get("qualifiedValueShape")):
        siblings = set()
        if any(o.lex == "true" for o in get("qualifiedValueShapesDisjoint")):
            for parent, ps in ix.out.items():
                if x in ps.get(SH + "property", []):
                    siblings |= {y for other in ix.all(parent, SH + "property") for y in ix.all(other, SH + "qualifiedValueShape")}
        low, high = one("qualifiedMinCount"), one("qualifiedMaxCount")
        for o in q:
            c.append(("qualified", (o, _int(low) if low else None, _int(high) if high else None, tuple(sorted(siblings - {o})))))
    if any(o.lex in ("true", "1") for o in get("closed")):
        own = [p.lex for y in s.properties if (p := ix.one(y, SH + "path")) is not None and p.kind == 0]
        s.closed = sorted({*own, *(p.lex for o in get("ignoredProperties") for p in ix.list(o))})
    for o in get("sparql"):
        c.append(("sparql", _sparql(ix, o)))
    for k in [k for k, p, o in ix.triples if p == TYPE and o.lex == SH + "ConstraintComponent"]:
        c += _custom(ix, k, x, s.path is not None)
    if s.path is None and any(k in ("minCount", "maxCount", "uniqueLang", "lessThan", "lessThanOrEquals", "qualified") for k, _ in c):
        raise ShapeError(f"{x.nt()} has constraints that need a path")
    return s


def _sparql(ix: Index, x: Node) -> tuple[str, dict[str, str], str, bool]:
    """(query, prefixes, message, deactivated) of a sh:sparql constraint."""
    names = _prefixes(ix, x)
    m, q = ix.one(x, SH + "message"), ix.one(x, SH + "select")
    if q is None:
        raise ShapeError("a SPARQL constraint needs sh:select")
    return q.lex, names, m.lex if m else "", any(o.lex in ("true", "1") for o in ix.all(x, SH + "deactivated"))


def _prefixes(ix: Index, x: Node) -> dict[str, str]:
    out, todo, seen = {}, ix.all(x, SH + "prefixes"), set()
    while todo:
        o = todo[0]
        todo = todo[1:]
        if o not in seen:
            seen.add(o)
            for y in ix.all(o, SH + "declare"):
                out[ix.one(y, SH + "prefix").lex] = ix.one(y, SH + "namespace").lex
            todo = [*todo, *ix.all(o, OWL + "imports")]
    return out


def _custom(ix: Index, component: Node, x: Node, on_path: bool):
    """("custom", (component, is an ASK query, query, prefixes, message, parameters)) where the shape has its parameters."""
    values: dict[str, Node] = {}
    for p in ix.all(component, SH + "parameter"):
        path_ = ix.one(p, SH + "path")
        v = ix.one(x, path_.lex)
        optional = any(o.lex in ("true", "1") for o in ix.all(p, SH + "optional"))
        if v is None and not optional:
            return
        if v is not None:
            values[path_.lex.rpartition("/")[2].rpartition("#")[2]] = v
    v = ix.one(component, SH + ("propertyValidator" if on_path else "nodeValidator")) or ix.one(component, SH + "validator")
    if v is None or not values:
        return
    ask, select, m = ix.one(v, SH + "ask"), ix.one(v, SH + "select"), ix.one(v, SH + "message")
    if ask is None and select is None:
        raise ShapeError(f"the validator of {component.nt()} has no query")
    yield "custom", (component.lex, ask is not None, (ask or select).lex, _prefixes(ix, v), m.lex if m else "", values)
