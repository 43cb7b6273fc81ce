"""A parser of Turtle, N-Triples, TriG and N-Quads: of texts as a whole, for schemas and small graphs, or of lines as they come.

Named graphs are merged into one set of triples. Large data come as N-Triples through `rdf.read`, or as files whose
lines `stream` takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

from .terms import RDF, XSD, Node, iri, literal

_TOKEN = re.compile(
    r"""\s+|\#[^\n\r]*
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<str>\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><[^\x00-\x20<>\"{}|^`\\]*(?:\\[uU][0-9A-Fa-f]+[^\x00-\x20<>\"{}|^`\\]*)*>)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dtype>\^\^)
    |(?P<bnode>_:[\w·](?:[\w·.-]*[\w·-])?)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w·.-]*[\w·-])?)?:(?:(?:[\w:·]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w:·.-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\](){}])""",
    re.X | re.S,
)
_ESCAPE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _ESCAPE:
            raise SyntaxError(f"bad escape \\{m[3]}")
        return _ESCAPE[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, s, flags=re.S) if "\\" in s else s


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Parser:
    """Parses one text; `triples` are the distinct triples in order, `prefixes` the declared names."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.base, self.scope = base, scope
        self.prefixes: dict[str, str] = {}
        self.triples: dict[tuple[Node, str, Node], None] = {}
        self.fresh = 0
        self.feed(text)

    def feed(self, text: str) -> None:
        """Parses whole statements that follow those before."""
        self.tok, self.at = tokens(text), 0
        while self.at < len(self.tok):
            self._statement()

    def _peek(self, *want: str) -> bool:
        return self.at < len(self.tok) and self.tok[self.at][1] in want

    def _take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tok):
            raise SyntaxError("unexpected end")
        t = self.tok[self.at]
        if want and t[1] != want:
            raise SyntaxError(f"expected {want}, found {t[1]!r}")
        self.at += 1
        return t

    def _iri(self, t: tuple[str, str]) -> str:
        if t[0] == "iri":
            x = unescape(t[1][1:-1])
            return urljoin(self.base, x) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", x) else x
        if t[0] == "name":
            p, _, local = t[1].partition(":")
            if p not in self.prefixes:
                raise SyntaxError(f"prefix {p}: is not declared")
            return self.prefixes[p] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxError(f"expected an IRI, found {t[1]!r}")

    def _bnode(self) -> Node:
        self.fresh += 1
        return Node(1, f"{self.scope}g{self.fresh}")

    def _statement(self) -> None:
        kind, word = self.tok[self.at]
        low = word.lower()
        if low in ("@prefix", "prefix") and kind in ("lang", "word"):
            self.at += 1
            name = self._take()[1]
            self.prefixes[name.removesuffix(":")] = self._iri(self._take())
        elif low in ("@base", "base") and kind in ("lang", "word"):
            self.at += 1
            self.base = self._iri(self._take())
        elif word == "{" or low == "graph" and kind == "word":
            if low == "graph":
                self.at += 1
                self._take()
            self._block()
            return
        else:
            mark = self.at
            subject = self._term(subject=True)
            if self._peek("{"):
                self._block()
                return
            if not (self._peek(".") and self.tok[mark][1] == "["):
                self._predicates(subject)
            if self.at < len(self.tok) and self.tok[self.at][0] in ("iri", "bnode"):  # an N-Quads graph label
                self.at += 1
            self._take(".")
            return
        if word.startswith("@"):
            self._take(".")

    def _block(self) -> None:
        self._take("{")
        while not self._peek("}"):
            mark = self.at
            subject = self._term(subject=True)
            if not (self._peek(".", "}") and self.tok[mark][1] == "["):
                self._predicates(subject)
            if not self._peek("}"):
                self._take(".")
        self.at += 1

    def _predicates(self, subject: Node) -> None:
        while True:
            t = self._take()
            p = RDF + "type" if t == ("word", "a") else self._iri(t)
            while True:
                self.triples[subject, p, self._term()] = None
                if not self._peek(","):
                    break
                self.at += 1
            if not self._peek(";"):
                return
            while self._peek(";"):
                self.at += 1
            if self._peek(".", "]", "}"):
                return

    def _term(self, subject: bool = False) -> Node:
        t = self._take()
        kind, word = t
        if kind in ("iri", "name"):
            return iri(self._iri(t))
        if kind == "bnode":
            return Node(1, f"{self.scope}{word[2:]}")
        if word == "[":
            b = self._bnode()
            if not self._peek("]"):
                self._predicates(b)
            self._take("]")
            return b
        if word == "(":
            items = []
            while not self._peek(")"):
                items.append(self._term())
            self.at += 1
            rest = iri(RDF + "nil")
            for x in reversed(items):
                b = self._bnode()
                self.triples[b, RDF + "first", x] = None
                self.triples[b, RDF + "rest", rest] = None
                rest = b
            return rest
        if subject:
            raise SyntaxError(f"{word!r} can't be a subject")
        if kind in ("str", "long"):
            lex = unescape(word[3:-3] if kind == "long" else word[1:-1])
            if self.at < len(self.tok) and self.tok[self.at][0] == "lang":
                return literal(lex, lang=self._take()[1][1:])
            if self._peek("^^"):
                self.at += 1
                return literal(lex, self._iri(self._take()))
            return literal(lex)
        if kind == "num":
            return literal(word, XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"))
        if word in ("true", "false"):
            return literal(word, XSD + "boolean")
        raise SyntaxError(f"unexpected {word!r}")


def parse(text: str, base: str = "", scope: str = "") -> list[tuple[Node, str, Node]]:
    """The distinct triples of a text; `scope` keeps its blank nodes apart from other texts'."""
    return list(Parser(text, base, scope).triples)


_OPEN = re.compile(r"""\#[^\n\r]*|\"\"\"|'''|\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*'|<[^\x00-\x20<>\"{}|^`]*>|\\.|[\[({\])}.]|[^\s.#\"'<\\\[({\])}]+|.""", re.S)

_PLAIN = re.compile(r"""(?:<[^\s<>\"{}|^`]*>|_:\w+)\s+<[^\s<>\"{}|^`]*>\s+(?:<[^\s<>\"{}|^`]*>|_:\w+)\s*\.\s*$""")
_INSIDE = {q * 3: re.compile(rf"(?:[^\\{q}]|\\.|{q}(?!{q}{q})|\\$)*", re.S) for q in ('"', "'")}


class _Ends:
    """Where statements may end: after a line whose last mark is a full stop or a brace, outside of texts and brackets."""

    def __init__(self):
        self.quote, self.depth = "", 0

    def after(self, line: str) -> bool:
        if not self.quote and _PLAIN.match(line):
            return not self.depth
        at, last = 0, ""
        while at < len(line):
            if self.quote:
                at = _INSIDE[self.quote].match(line, at).end()
                if at < len(line):
                    at, self.quote, last = at + 3, "", "text"
                continue
            m = _OPEN.match(line, at)
            at, x = m.end(), m[0]
            if x[0] in "#" or x.isspace():
                continue
            if x in ('"""', "'''"):
                self.quote = x
            elif x in "[({":
                self.depth += 1
            elif x in "])}":
                self.depth -= 1
            last = x
        return not self.quote and not self.depth and last in (".", "}")


def stream(lines: Iterable[str], base: str = "", scope: str = "", least: int = 1 << 16) -> Iterator[list[tuple[Node, str, Node]]]:
    """The triples of a text that comes by lines, in parts; no more than a part, of `least` characters or one statement, is held.

    Triples are distinct within a part only.
    """
    parser, ends = Parser("", base, scope), _Ends()
    held: list[str] = []
    size = 0
    for line in lines:
        held.append(line)
        size += len(line)
        if ends.after(line) and size >= least:
            parser.feed("\n".join(held))
            held, size = [], 0
            yield list(parser.triples)
            parser.triples.clear()
    parser.feed("\n".join(held))
    yield list(parser.triples)
