"""ShExR: ShEx schemas as graphs, read into and written from ShExJ's form."""

from __future__ import annotations

from ..plans.shapes import Index
from ..sources import rdf
from ..sources.terms import LANGSTRING, LITERAL, RDF, STRING, SX, TYPE, XSD, Node, iri, literal

NUMBERS = ("length", "minlength", "maxlength", "totaldigits", "fractiondigits", "mininclusive", "minexclusive", "maxinclusive", "maxexclusive")
STEMS = ("IriStem", "LiteralStem", "LanguageStem")


def _name(n: Node) -> str:
    return n.lex if n.kind == 0 else f"_:{n.lex}"


def _number(n: Node):
    return int(n.lex) if n.dt == XSD + "integer" else float(n.lex)


def _object(n: Node):
    if n.kind != LITERAL:
        return _name(n)
    return {"value": n.lex} | ({"language": n.lang} if n.dt == LANGSTRING else {} if n.dt == STRING else {"type": n.dt})


def read(text: str, base: str = "") -> dict:
    ix = Index(rdf.parse(text, "turtle", base))
    kind = lambda x: next((t.lex.removeprefix(SX) for t in ix.all(x, TYPE) if t.lex.startswith(SX)), "")
    get = lambda x, p: ix.one(x, SX + p)

    def items(x: Node, p: str) -> list[Node]:
        head = get(x, p)
        return ix.list(head) if head is not None else []

    def acts(x: Node, p: str = "semActs") -> list:
        return [{"type": "SemAct", "name": _name(get(a, "name"))} | ({"code": get(a, "code").lex} if get(a, "code") else {}) for a in items(x, p)]

    def extras(x: Node, out: dict) -> dict:
        notes = [{"type": "Annotation", "predicate": get(a, "predicate").lex, "object": _object(get(a, "object"))} for a in items(x, "annotation")]
        return out | ({"annotations": notes} if notes else {}) | ({"semActs": a} if (a := acts(x)) else {})

    def value(x: Node):
        t = kind(x)
        if x.kind == LITERAL or not t:
            return _object(x)
        if t == "Language":
            return {"type": t, "languageTag": get(x, "languageTag").lex.lower()}
        stem = get(x, "stem")
        own: dict = {"type": t, "stem": stem.lex if kind(stem) != "Wildcard" else {"type": "Wildcard"}}
        if t.endswith("Range"):
            own["exclusions"] = [value(e) if e.kind != LITERAL else e.lex if t.startswith("Language") else _object(e) for e in items(x, "exclusion")]
        return own

    def shape(x: Node, top: bool = False):
        t = kind(x)
        if not t or x.kind == 0 and not top:
            return _name(x)
        out: dict = {"type": t}
        if t in ("ShapeAnd", "ShapeOr"):
            out["shapeExprs"] = [shape(y) for y in items(x, "shapeExprs")]
        elif t == "ShapeNot":
            out["shapeExpr"] = shape(get(x, "shapeExpr"))
        elif t == "NodeConstraint":
            if (n := get(x, "nodeKind")) is not None:
                out["nodeKind"] = n.lex.removeprefix(SX)
            if (n := get(x, "datatype")) is not None:
                out["datatype"] = n.lex
            out |= {k: _number(n) for k in NUMBERS if (n := get(x, k)) is not None}
            out |= {k: n.lex for k in ("pattern", "flags") if (n := get(x, k)) is not None}
            if (v := get(x, "values")) is not None:
                out["values"] = [value(y) for y in ix.list(v)]
        elif t == "Shape":
            if (n := get(x, "closed")) is not None and n.lex == "true":
                out["closed"] = True
            if e := ix.all(x, SX + "extra"):
                out["extra"] = [y.lex for y in e]
            if (e := get(x, "expression")) is not None:
                out["expression"] = triple(e)
            out = extras(x, out)
        return out

    seen: set[Node] = set()

    def triple(x: Node):
        t = kind(x)
        if not t or x in seen:
            return _name(x)
        seen.add(x)
        out: dict = ({"id": _name(x)} if x.kind == 0 else {}) | {"type": t}
        if t == "TripleConstraint":
            if (n := get(x, "inverse")) is not None and n.lex == "true":
                out["inverse"] = True
            out["predicate"] = get(x, "predicate").lex
            if (v := get(x, "valueExpr")) is not None:
                out["valueExpr"] = shape(v)
        else:
            out["expressions"] = [triple(y) for y in items(x, "expressions")]
        out |= {k: int(n.lex) for k in ("min", "max") if (n := get(x, k)) is not None}
        return extras(x, out)

    root = next(s for s, p, o in ix.triples if p == TYPE and o.lex == SX + "Schema")
    out: dict = {"type": "Schema"}
    if i := items(root, "imports"):
        out["imports"] = [x.lex for x in i]
    if a := acts(root, "startActs"):
        out["startActs"] = a
    if (s := get(root, "start")) is not None:
        out["start"] = shape(s)
    head = ix.all(root, SX + "shapes")
    labels = [y for h in head for y in (ix.list(h) if ix.is_list(h) else [h])]
    if labels:
        out["shapes"] = [{"id": _name(x), **shape(x, top=True)} for x in labels]
    return out


def write(schema: dict) -> list[tuple[Node, str, Node]]:
    """The schema's triples."""
    out: list[tuple[Node, str, Node]] = []
    count = [0]

    def new() -> Node:
        count[0] += 1
        return Node(1, f"s{count[0]}")

    name = lambda x: Node(1, x[2:]) if x.startswith("_:") else iri(x)
    add = lambda s, p, o: out.append((s, SX + p, o))
    number = lambda n: literal(str(n), XSD + ("integer" if isinstance(n, int) else "decimal"))

    def chain(xs: list[Node]) -> Node:
        rest = iri(RDF + "nil")
        for x in reversed(xs):
            b = new()
            out.extend([(b, RDF + "first", x), (b, RDF + "rest", rest)])
            rest = b
        return rest

    def obj(v) -> Node:
        return name(v) if isinstance(v, str) else literal(v["value"], v.get("type", STRING), v.get("language", ""))

    def acts(s: Node, xs: list, p: str = "semActs") -> None:
        nodes = []
        for a in xs:
            b = new()
            out.append((b, TYPE, iri(SX + "SemAct")))
            add(b, "name", iri(a["name"]))
            if "code" in a:
                add(b, "code", literal(a["code"]))
            nodes.append(b)
        if nodes:
            add(s, p, chain(nodes))

    def extras(s: Node, e: dict) -> None:
        acts(s, e.get("semActs", []))
        notes = []
        for a in e.get("annotations", []):
            b = new()
            out.append((b, TYPE, iri(SX + "Annotation")))
            add(b, "predicate", iri(a["predicate"]))
            add(b, "object", obj(a["object"]))
            notes.append(b)
        if notes:
            add(s, "annotation", chain(notes))

    def value(v) -> Node:
        if not isinstance(v, dict) or v.get("type") not in (*STEMS, *(s + "Range" for s in STEMS), "Language"):
            return obj(v)
        b, t = new(), v["type"]
        out.append((b, TYPE, iri(SX + t)))
        if t == "Language":
            add(b, "languageTag", literal(v["languageTag"]))
            return b
        stem = v["stem"]
        if isinstance(stem, dict):
            w = new()
            out.append((w, TYPE, iri(SX + "Wildcard")))
            add(b, "stem", w)
        else:
            add(b, "stem", literal(stem, XSD + "anyURI") if t.startswith("Iri") else literal(stem))
        if "exclusions" in v:
            add(b, "exclusion", chain([literal(x) if t.startswith("Language") and isinstance(x, str) else value(x) for x in v["exclusions"]]))
        return b

    def shape(e, s: Node | None = None) -> Node:
        if isinstance(e, str):
            return name(e)
        s = s or new()
        t = e["type"]
        out.append((s, TYPE, iri(SX + t)))
        if t in ("ShapeAnd", "ShapeOr"):
            add(s, "shapeExprs", chain([shape(x) for x in e["shapeExprs"]]))
        elif t in ("ShapeNot", "ShapeDecl"):
            add(s, "shapeExpr", shape(e["shapeExpr"]))
        elif t == "NodeConstraint":
            if "nodeKind" in e:
                add(s, "nodeKind", iri(SX + e["nodeKind"]))
            if "datatype" in e:
                add(s, "datatype", iri(e["datatype"]))
            for k in NUMBERS:
                if k in e:
                    add(s, k, number(e[k]))
            for k in ("pattern", "flags"):
                if k in e:
                    add(s, k, literal(e[k]))
            if "values" in e:
                add(s, "values", chain([value(v) for v in e["values"]]))
        elif t == "Shape":
            if e.get("closed"):
                add(s, "closed", literal("true", XSD + "boolean"))
            for x in e.get("extra", []):
                add(s, "extra", iri(x))
            if "expression" in e:
                add(s, "expression", triple(e["expression"]))
            extras(s, e)
        return s

    def triple(e) -> Node:
        if isinstance(e, str):
            return name(e)
        s = name(e["id"]) if "id" in e else new()
        out.append((s, TYPE, iri(SX + e["type"])))
        if e["type"] == "TripleConstraint":
            if e.get("inverse"):
                add(s, "inverse", literal("true", XSD + "boolean"))
            add(s, "predicate", iri(e["predicate"]))
            if e.get("valueExpr") is not None:
                add(s, "valueExpr", shape(e["valueExpr"]))
        else:
            add(s, "expressions", chain([triple(x) for x in e["expressions"]]))
        for k in ("min", "max"):
            if k in e:
                add(s, k, number(e[k]))
        extras(s, e)
        return s

    root = new()
    out.append((root, TYPE, iri(SX + "Schema")))
    if schema.get("imports"):
        add(root, "imports", chain([iri(x) for x in schema["imports"]]))
    acts(root, schema.get("startActs", []), "startActs")
    if "start" in schema:
        add(root, "start", shape(schema["start"]))
    if schema.get("shapes"):
        add(root, "shapes", chain([shape(s, name(s["id"])) for s in schema["shapes"]]))
    return list(dict.fromkeys(out))
