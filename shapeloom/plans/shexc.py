"""A parser and printer of the ShEx compact syntax; schemas are values in the JSON syntax's form (ShExJ)."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

from ..sources.terms import RDF, XSD
from ..sources.turtle import unescape

_NAME = r"(?:[^\W\d_](?:[\w·.-]*[\w·-])?)?:(?:(?:[\w:·]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w:·.-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?"
_TOKEN = re.compile(
    rf"""\s+|\#[^\n\r]*|/\*.*?\*/
    |(?P<code>\{{[^%\\}}]*(?:(?:\\[%\\uU]|\}}(?!%)|\\)[^%\\}}]*)*%\}})
    |(?P<repeat>\{{\s*\d+\s*(?:,\s*(?:\d+|\*)?\s*)?\}})
    |(?P<note>//)
    |(?P<regex>/(?:[^/\\\n\r]|\\.)+/[smixq]*)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<str>\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><[^\x00-\x20<>\"{{}}|^`\\]*(?:\\[uU][0-9A-Fa-f]+[^\x00-\x20<>\"{{}}|^`\\]*)*>)
    |(?P<at>@(?=(?:\s|\#[^\n\r]*[\n\r])*(?:<|_:|{_NAME}|START\b)))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|@(?=~))
    |(?P<dtype>\^\^)
    |(?P<bnode>_:[\w·](?:[\w·.-]*[\w·-])?)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>{_NAME})
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;|,\[\](){{}}=$&^!?*+~%-])""",
    re.X | re.S,
)
STRING_FACETS = {"LENGTH": "length", "MINLENGTH": "minlength", "MAXLENGTH": "maxlength"}
NUMBER_FACETS = {"MININCLUSIVE": "mininclusive", "MINEXCLUSIVE": "minexclusive", "MAXINCLUSIVE": "maxinclusive", "MAXEXCLUSIVE": "maxexclusive", "TOTALDIGITS": "totaldigits", "FRACTIONDIGITS": "fractiondigits"}
KINDS = {"IRI": "iri", "BNODE": "bnode", "NONLITERAL": "nonliteral", "LITERAL": "literal"}


class Parser:
    def __init__(self, text: str, base: str = ""):
        self.tok, self.at, self.base, self.prefixes = [], 0, base, {}
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tok.append((m.lastgroup, m[0]))
            at = m.end()

    def peek(self, *want: str) -> bool:
        if self.at >= len(self.tok):
            return False
        kind, x = self.tok[self.at]
        return (x.upper() if kind == "word" else x) in want

    def kind(self, *want: str) -> bool:
        return self.at < len(self.tok) and self.tok[self.at][0] in want

    def take(self, *want: str) -> tuple[str, str]:
        if self.at >= len(self.tok):
            raise SyntaxError("unexpected end")
        if want and not self.peek(*want):
            raise SyntaxError(f"expected {' or '.join(want)}, found {self.tok[self.at][1]!r}")
        self.at += 1
        return self.tok[self.at - 1]

    def maybe(self, *want: str) -> bool:
        if self.peek(*want):
            self.at += 1
            return True
        return False

    def iri(self) -> str:
        kind, x = self.take()
        if kind == "iri":
            x = unescape(x[1:-1])
            return urljoin(self.base, x) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", x) else x
        if kind == "name":
            p, _, local = x.partition(":")
            if p not in self.prefixes:
                raise SyntaxError(f"prefix {p}: is not declared")
            return self.prefixes[p] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxError(f"expected an IRI, found {x!r}")

    def label(self) -> str:
        return self.take()[1] if self.kind("bnode") else self.iri()

    def schema(self) -> dict:
        out: dict = {"type": "Schema"}
        imports, shapes, acts = [], [], []
        while self.at < len(self.tok):
            if self.maybe("BASE"):
                self.base = self.iri()
            elif self.maybe("PREFIX"):
                name = self.take()[1]
                self.prefixes[name.removesuffix(":")] = self.iri()
            elif self.maybe("IMPORT"):
                imports.append(self.iri())
            elif self.peek("%") and not shapes and "start" not in out:
                acts += self.acts()
            elif self.peek("START"):
                self.at += 1
                self.take("=")
                out["start"] = self.expression()
            else:
                abstract = self.maybe("ABSTRACT")
                name = self.label()
                e = {"type": "ShapeExternal"} if self.maybe("EXTERNAL") else self.expression()
                e = {"type": "ShapeDecl", "id": name, "abstract": True, "shapeExpr": e} if abstract else {"id": name, **e} if isinstance(e, dict) else {"type": "ShapeAnd", "id": name, "shapeExprs": [e]}
                if any(s["id"] == name for s in shapes):
                    raise SyntaxError(f"{name} is declared twice")
                shapes.append(e)
        for k, v in (("imports", imports), ("startActs", acts), ("shapes", shapes)):
            if v:
                out[k] = v
        return out

    def expression(self, inline: bool = False):
        parts = [self.conjunction(inline)]
        while self.maybe("OR"):
            parts.append(self.conjunction(inline))
        return parts[0] if len(parts) == 1 else {"type": "ShapeOr", "shapeExprs": parts}

    def conjunction(self, inline: bool):
        parts = [self.negation(inline)]
        while self.maybe("AND"):
            parts.append(self.negation(inline))
        return parts[0] if len(parts) == 1 else {"type": "ShapeAnd", "shapeExprs": parts}

    def negation(self, inline: bool):
        return {"type": "ShapeNot", "shapeExpr": self.atom(inline)} if self.maybe("NOT") else self.atom(inline)

    def atom(self, inline: bool):
        if self.maybe("("):
            e = self.expression(inline)
            self.take(")")
            return e
        if self.maybe("."):
            return {"type": "Shape"} if not inline else None
        if self.starts_shape():
            first = self.shape_or_ref()
            second = self.constraint() if self.starts_constraint() and self.peek("IRI", "BNODE", "NONLITERAL", *STRING_FACETS) or self.kind("regex") else None
        else:
            first = self.constraint()
            literal = first.get("nodeKind") == "literal" or "datatype" in first or "values" in first
            second = self.shape_or_ref() if self.starts_shape() and not literal else None
        return first if second is None else {"type": "ShapeAnd", "shapeExprs": [first, second]}

    def starts_shape(self) -> bool:
        return self.kind("at") or self.peek("EXTRA", "CLOSED", "{", "EXTENDS", "&") and not self.kind("repeat")

    def starts_constraint(self) -> bool:
        return self.peek(*KINDS, *STRING_FACETS, *NUMBER_FACETS, "[") or self.kind("iri", "name", "regex")

    def shape_or_ref(self):
        if self.kind("at"):
            self.at += 1
            return "START" if self.maybe("START") else self.label()
        out: dict = {"type": "Shape"}
        while True:
            if self.maybe("CLOSED"):
                out["closed"] = True
            elif self.maybe("EXTRA"):
                out.setdefault("extra", []).append(self.predicate())
                while self.kind("iri", "name") or self.at < len(self.tok) and self.tok[self.at] == ("word", "a"):
                    out["extra"].append(self.predicate())
            elif self.maybe("EXTENDS", "&"):
                self.take("@") if self.peek("@") else None
                out.setdefault("extends", []).append(self.label())
            else:
                break
        self.take("{")
        if not self.peek("}"):
            out["expression"] = self.one_of()
        self.take("}")
        self.extras(out)
        return out

    def predicate(self) -> str:
        if self.at < len(self.tok) and self.tok[self.at] == ("word", "a"):
            self.at += 1
            return RDF + "type"
        return self.iri()

    def extras(self, out: dict) -> None:
        notes = []
        while self.kind("note"):
            self.at += 1
            p = self.predicate()
            notes.append({"type": "Annotation", "predicate": p, "object": self.value()})
        if notes:
            out["annotations"] = notes
        if acts := self.acts():
            out["semActs"] = acts

    def acts(self) -> list:
        out = []
        while self.maybe("%"):
            act = {"type": "SemAct", "name": self.iri()}
            if self.kind("code"):
                act["code"] = re.sub(r"\\([%\\])", r"\1", self.take()[1][1:-2])
            else:
                self.take("%")
            out.append(act)
        return out

    def one_of(self):
        parts = [self.each_of()]
        while self.maybe("|"):
            parts.append(self.each_of())
        return parts[0] if len(parts) == 1 else {"type": "OneOf", "expressions": parts}

    def each_of(self):
        parts = [self.unary()]
        while self.maybe(";", ","):
            if self.peek("}", ")", "|"):
                break
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else {"type": "EachOf", "expressions": parts}

    def unary(self):
        if self.maybe("&"):
            return self.label()
        name = self.label() if self.maybe("$") else None
        if self.maybe("("):
            e = self.one_of()
            self.take(")")
            low, high = self.cardinality()
            if isinstance(e, str) or low is not None and "min" in e or self.kind("note") and e["type"] == "TripleConstraint" or name and "id" in e:
                e = {"type": "EachOf", "expressions": [e]}
            if low is not None:
                e |= {"min": low, "max": high}
            self.extras(e)
        else:
            e = {"type": "TripleConstraint"}
            while self.peek("^", "!"):
                if self.take()[1] == "^":
                    e["inverse"] = True
                else:
                    raise SyntaxError("negated triple constraints aren't in the language any more")
            e["predicate"] = self.predicate()
            v = self.expression(inline=True)
            if v is not None:
                e["valueExpr"] = v
            low, high = self.cardinality()
            if low is not None:
                e |= {"min": low, "max": high}
            self.extras(e)
        return {"id": name, **e} if name else e

    def cardinality(self) -> tuple[int | None, int | None]:
        if self.kind("repeat"):
            low, comma, high = re.sub(r"[{}\s]", "", self.take()[1]).partition(",")
            top = -1 if comma and high in ("", "*") else int(high) if comma else int(low)
            if top != -1 and top < int(low):
                raise SyntaxError("a maximum under its minimum")
            return int(low), top
        for m, r in (("?", (0, 1)), ("*", (0, -1)), ("+", (1, -1))):
            if self.maybe(m):
                return r
        return None, None

    def constraint(self) -> dict:
        out: dict = {"type": "NodeConstraint"}
        if self.peek(*KINDS):
            out["nodeKind"] = KINDS[self.take()[1].upper()]
        elif self.peek("["):
            out["values"] = self.values()
        elif self.kind("iri", "name"):
            out["datatype"] = self.iri()
        elif not self.starts_constraint():
            raise SyntaxError(f"unexpected {self.tok[self.at][1] if self.at < len(self.tok) else 'end'!r}")
        while True:
            if self.kind("regex"):
                x = self.take()[1]
                body, _, flags = x[1:].rpartition("/")
                key, v = "pattern", re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), body.replace("\\/", "/"))
                if flags:
                    out["flags"] = flags
            elif self.peek(*STRING_FACETS):
                key = STRING_FACETS[self.take()[1].upper()]
                v = int(self.take()[1])
            elif self.peek(*NUMBER_FACETS):
                key = NUMBER_FACETS[self.take()[1].upper()]
                v = self.number(key)
            else:
                return out
            if key in out:
                raise SyntaxError(f"{key} is given twice")
            if key in NUMBER_FACETS.values() and out.get("nodeKind") in ("iri", "bnode", "nonliteral"):
                raise SyntaxError("numeric facets need literals")
            out[key] = v

    def number(self, key: str):
        kind, x = self.take()
        if kind in ("str", "long"):
            self.take("^^")
            self.iri()
            x = x[1:-1]
        elif kind != "num":
            raise SyntaxError(f"expected a number, found {x!r}")
        if key in ("totaldigits", "fractiondigits"):
            return int(x)
        return int(x) if re.fullmatch(r"[+-]?\d+", x) else float(x)

    def value(self):
        kind, x = self.take()
        if kind in ("str", "long"):
            lex = unescape(x[3:-3] if kind == "long" else x[1:-1])
            if self.kind("lang"):
                return {"value": lex, "language": self.take()[1][1:].lower()}
            if self.maybe("^^"):
                dt = self.iri()
                return {"value": lex} if dt == XSD + "string" else {"value": lex, "type": dt}
            return {"value": lex}
        if kind == "num":
            return {"value": x, "type": XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer")}
        if x in ("true", "false"):
            return {"value": x, "type": XSD + "boolean"}
        self.at -= 1
        return self.iri()

    def values(self) -> list:
        self.take("[")
        out = []
        while not self.maybe("]"):
            if self.maybe("."):
                out.append(self.exclusions(None, "."))
            elif self.kind("lang"):
                tag = self.take()[1][1:].lower()
                out.append(self.exclusions("Language", tag) if self.maybe("~") else {"type": "Language", "languageTag": tag})
            else:
                v = self.value()
                if self.maybe("~"):
                    out.append(self.exclusions("Literal" if isinstance(v, dict) else "Iri", v["value"] if isinstance(v, dict) else v))
                else:
                    out.append(v)
        return out

    def exclusions(self, kind: str | None, stem: str) -> dict:
        found = []
        while self.maybe("-"):
            if self.kind("lang"):
                own, v = "Language", self.take()[1][1:].lower()
            else:
                v = self.value()
                own, v = ("Literal", v["value"]) if isinstance(v, dict) else ("Iri", v)
            if kind not in (None, own):
                raise SyntaxError("an exclusion of another kind")
            kind = own
            found.append({"type": own + "Stem", "stem": v} if self.maybe("~") else v)
        if stem == ".":
            if not found:
                raise SyntaxError("a wildcard in a value set needs exclusions")
            return {"type": kind + "StemRange", "stem": {"type": "Wildcard"}, "exclusions": found}
        return {"type": kind + "StemRange", "stem": stem, "exclusions": found} if found else {"type": kind + "Stem", "stem": stem}


def parse(text: str, base: str = "") -> dict:
    """A schema in ShExJ's form from the compact syntax; its prefixes are kept under "prefixes"."""
    p = Parser(text, base)
    return p.schema() | ({"prefixes": p.prefixes} if p.prefixes else {})


# printing


def _term(x) -> str:
    if isinstance(x, str):
        return x if x.startswith("_:") else f"<{x}>"
    lex = json.dumps(x["value"], ensure_ascii=False)
    return f"{lex}@{x['language']}" if x.get("language") else f"{lex}^^<{x['type']}>" if x.get("type") else lex


def _stem(kind: str, x) -> str:
    return f"@{x}" if kind == "Language" else json.dumps(x, ensure_ascii=False) if kind == "Literal" else f"<{x}>"


def _value(v) -> str:
    t = v.get("type", "") if isinstance(v, dict) else ""
    if t == "Language":
        return "@" + v["languageTag"]
    for kind in ("Iri", "Literal", "Language"):
        if t == kind + "Stem":
            return _stem(kind, v["stem"]) + "~"
        if t == kind + "StemRange":
            head = "." if isinstance(v["stem"], dict) else _stem(kind, v["stem"]) + "~"
            return head + "".join(" - " + (_stem(kind, x["stem"]) + "~" if isinstance(x, dict) and "stem" in x else _stem(kind, x["value"] if isinstance(x, dict) else x)) for x in v["exclusions"])
    return _term(v)


def _extras(e: dict) -> str:
    notes = "".join(f" // {_term(a['predicate'])} {_term(a['object'])}" for a in e.get("annotations", []))
    return notes + "".join(f" %{_term(a['name'])}" + ("{" + re.sub(r"([%\\])", r"\\\1", a["code"]) + "%}" if "code" in a else "%") for a in e.get("semActs", []))


def _card(e: dict) -> str:
    if "min" not in e:
        return ""
    return {(0, 1): "?", (0, -1): "*", (1, -1): "+"}.get((e["min"], e["max"]), f"{{{e['min']},{'*' if e['max'] == -1 else e['max']}}}")


def expression(e, level: int = 0) -> str:
    """A shape expression in compact syntax; level 1 inside AND, 2 inside NOT."""
    if e is None:
        return "."
    if isinstance(e, str):
        return "@" + (e if e == "START" else _term(e))
    t = e["type"]
    if t == "ShapeOr" or t == "ShapeAnd":
        own = 0 if t == "ShapeOr" else 1
        s = (" OR " if t == "ShapeOr" else " AND ").join(expression(x, own + 1) if isinstance(x, (str, type(None))) or x["type"] not in ("ShapeAnd", "ShapeOr") else f"({expression(x)})" for x in e["shapeExprs"])
        return f"({s})" if level > own else s
    if t == "ShapeNot":
        inner = e["shapeExpr"]
        s = expression(inner, 2)
        return f"NOT {s}" if isinstance(inner, str) or inner["type"] != "ShapeNot" else f"NOT ({s})"
    if t == "ShapeExternal":
        return "EXTERNAL"
    if t == "ShapeDecl":
        return expression(e["shapeExpr"], level)
    if t == "NodeConstraint":
        parts = [e["nodeKind"].upper()] if "nodeKind" in e else [_term(e["datatype"])] if "datatype" in e else ["[" + " ".join(map(_value, e["values"])) + "]"] if "values" in e else []
        for names in (STRING_FACETS, NUMBER_FACETS):
            parts += [f"{k} {e[v]}" for k, v in names.items() if v in e]
        if "pattern" in e:
            parts.append("/" + e["pattern"].replace("/", "\\/") + "/" + e.get("flags", ""))
        return " ".join(parts) or "."
    head = "CLOSED " * bool(e.get("closed")) + (f"EXTRA {' '.join(map(_term, e['extra']))} " if e.get("extra") else "")
    return head + "{ " + (triples(e["expression"]) + " " if "expression" in e else "") + "}" + _extras(e)


def triples(e) -> str:
    if isinstance(e, str):
        return "&" + _term(e)
    name = f"${_term(e['id'])} " if "id" in e else ""
    if e["type"] == "TripleConstraint":
        v = e.get("valueExpr")
        s = expression(v, 2) if isinstance(v, (str, type(None))) or v["type"] != "ShapeNot" else expression(v)
        return name + "^" * bool(e.get("inverse")) + f"{_term(e['predicate'])} {s}{_card(e)}" + _extras(e)
    s = (" | " if e["type"] == "OneOf" else " ; ").join(f"({triples(x)})" if isinstance(x, dict) and x["type"] in ("OneOf", "EachOf") and "min" not in x and "id" not in x else triples(x) for x in e["expressions"])
    return f"{name}({s}){_card(e)}" + _extras(e) if "min" in e or name or "annotations" in e or "semActs" in e else s


def show(schema: dict) -> str:
    """A schema in the compact syntax."""
    out = [f"PREFIX {k}: <{v}>" for k, v in schema.get("prefixes", {}).items()] + [f"IMPORT <{x}>" for x in schema.get("imports", [])]
    out += [_extras({"semActs": schema["startActs"]}).strip()] if schema.get("startActs") else []
    out += [f"start = {expression(schema['start'])}"] if "start" in schema else []
    out += [f"{'ABSTRACT ' * (s['type'] == 'ShapeDecl')}{_term(s['id'])} {expression(s)}" for s in schema.get("shapes", [])]
    return "\n".join(out) + "\n"
