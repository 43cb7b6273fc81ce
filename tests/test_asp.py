"""Programs of the minimal language, solved by brute force over all candidate answer sets."""

import itertools
import re

import pytest

from shapeloom.operators import asp
from shapeloom.plans import paths as P
from shapeloom.plans import slang as L
from shapeloom.sources import rdf
from shapeloom.sources.terms import XSD, constant, iri, literal

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|:-|!=|#\w+|[A-Za-z_]\w*|\d+|[(){}.,:=<>/-]')


class Program:
    """Rules of atoms, negated atoms, inequalities and counts, read from their text."""

    def __init__(self, text):
        self.t, self.i, self.rules = TOKEN.findall(text), 0, []
        while self.i < len(self.t):
            if self.t[self.i] == "#show":
                self.i = self.t.index(".", self.i) + 1
                continue
            head, body = self.atom(), []
            if self.next() == ":-":
                body = [self.literal()]
                while self.next() == ",":
                    body.append(self.literal())
            self.rules.append((head, body))

    def next(self):
        self.i += 1
        return self.t[self.i - 1]

    def atom(self):
        name, args = self.next(), []
        if self.i < len(self.t) and self.t[self.i] == "(":
            while self.next() in "(,":
                args.append(self.atom())
        return int(name) if name.isdigit() else name if name[0] in '"_' or name[0].isupper() else (name, *args)

    def literal(self):
        if self.t[self.i] == "not":
            self.i += 1
            return ("not", self.atom())
        if self.t[self.i] == "#count":
            return self.count(None)
        a = self.atom()
        if self.t[self.i] == "!=":
            self.i += 1
            return ("differs", a, self.atom())
        if self.t[self.i] == "=":
            self.i += 1
            return self.count(a)
        return ("is", a)

    def count(self, into):
        assert self.next() == "#count" and self.next() == "{"
        what, sep, body = self.atom(), self.next(), [self.literal()]
        while self.next() == ",":
            body.append(self.literal())
        assert sep == ":"
        if into is not None:
            return ("count", what, body, into)
        assert self.next() == ">"
        limit, less = self.atom(), 0
        if self.t[self.i] == "-":
            self.i += 1
            less = self.atom()
        return ("over", what, body, limit, less)


def bind(pattern, value, sub):
    if isinstance(pattern, str) and pattern[0] != '"':
        if pattern == "_":
            return sub
        return sub if sub.get(pattern, value) == value and sub.setdefault(pattern, value) == value else None
    if isinstance(pattern, tuple):
        if not isinstance(value, tuple) or len(pattern) != len(value) or pattern[0] != value[0]:
            return None
        for p, v in zip(pattern[1:], value[1:], strict=True):
            if (sub := bind(p, v, sub)) is None:
                return None
        return sub
    return sub if pattern == value else None


def ground(x, sub):
    return tuple([x[0], *(ground(y, sub) for y in x[1:])]) if isinstance(x, tuple) else sub.get(x, x) if isinstance(x, str) else x


def solutions(body, facts, sub):
    if not body:
        yield sub
        return
    kind, *x = body[0]
    if kind == "is":
        for f in facts:
            if f[0] == x[0][0] and (s := bind(x[0], f, dict(sub))) is not None:
                yield from solutions(body[1:], facts, s)
    elif kind == "not":
        if ground(x[0], sub) not in facts:
            yield from solutions(body[1:], facts, sub)
    elif kind == "differs":
        if ground(x[0], sub) != ground(x[1], sub):
            yield from solutions(body[1:], facts, sub)
    else:
        n = len({ground(x[0], s) for s in solutions(x[1], facts, dict(sub))})
        if kind == "count":
            yield from solutions(body[1:], facts, sub | {x[2]: n})
        elif n > ground(x[2], sub) - x[3]:
            yield from solutions(body[1:], facts, sub)


def answer_sets(text):
    """Sets of fails atoms that are minimal models of the rules whose bodies hold in them."""
    rules = Program(text).rules
    low = [r for r in rules if r[0][0] not in ("fails", "yes", "no")]
    base: set = set()
    while True:
        new = {ground(h, s) for h, b in low for s in solutions(b, base, {})}
        if new <= base:
            break
        base |= new
    mine = [r for r in rules if r[0][0] == "fails"]
    nodes = [f[1] for f in base if f[0] == "node"]
    every = [("fails", i, x) for i in sorted({h[1] for h, _ in mine}) for x in nodes]
    for k in range(len(every) + 1):
        for pick in itertools.combinations(every, k):
            s = set(pick)
            live = [(ground(h, sub), b, sub) for h, b in mine for sub in solutions(b, base | s, {})]
            if not all(h in s for h, _, _ in live):
                continue
            closed = lambda t: all(h in t or next(solutions(b, base | t, dict(sub)), None) is None for h, b, sub in live)  # noqa: B023,E731
            if not any(closed(set(t)) for n in range(k) for t in itertools.combinations(pick, n)):
                top = base | s
                yield {ground(h, sub) for h, b in rules if h[0] in ("yes", "no") for sub in solutions(b, top, {})}


E = "http://e/"
P_, Q_ = P.Pred(E + "p"), P.Pred(E + "q")
CASES = {
    "recursion": ({"S": L.Not(L.QualifiedArc(P_, L.Not(L.Ref("S")), 1, -1)), "T": L.And(L.Ref("S"), L.QualifiedArc(Q_, L.STrue(), 1, 1))}, [("a", "p", "b"), ("b", "p", "a"), ("b", "q", "c")]),
    "counts": ({"S": L.QualifiedArc(P_, L.QualifiedArc(Q_, L.Datatype(XSD + "string"), 1, 2), 2, 3)}, [("a", "p", "b"), ("a", "p", "c"), ("b", "q", "'x"), ("c", "q", "'x")]),
    "minimum in a cycle": ({"S": L.QualifiedArc(P_, L.Ref("S"), 1, -1)}, [("a", "p", "b"), ("b", "p", "a"), ("c", "p", "d")]),
    "inverse, other": ({"S": L.And(L.QualifiedArc(P.Inv(P_), L.STrue(), 0, 1), L.Not(L.QualifiedArc(P.NoPreds((E + "p",)), L.STrue(), 1, -1)))}, [("a", "p", "b"), ("c", "p", "b"), ("a", "q", "c")]),
    "kinds": ({"S": L.Not(L.Datatype(XSD + "string")), "T": L.QualifiedArc(P_, L.IRIKind(), 1, 1)}, [("a", "p", "b"), ("b", "p", "'x"), ("c", "p", "'x")]),
}


@pytest.mark.parametrize("case", CASES)
def test_program_has_one_answer_set_the_plans_result(spark, case):
    shapes, arcs = CASES[case]
    shapes = {E + k: _named(s) for k, s in shapes.items()}
    graph = rdf.frame(spark, [(iri(E + s), E + p, node_of(o)) for s, p, o in arcs])
    asked = [(iri(E + x), k) for x in "abc" for k in shapes]
    text = asp.Program(shapes).text(asked) + "\n".join(r["value"] for r in asp.facts(graph).collect())
    found = list(answer_sets(text))
    targets = None
    for n, k in asked:
        one = spark.range(1).select(constant(n).alias("node")).selectExpr("node", f"'{k}' as shape")
        targets = one if targets is None else targets.unionByName(one)
    want = {("yes" if r["status"] == L.CONFORMS else "no", f'"{r["node"]["lex"]}"', f'"{r["shape"]}"') for r in L.Validator(graph, shapes).validate(targets).collect()}
    assert found == [want]


def _named(s):
    match s:
        case L.Ref(x):
            return L.Ref(E + x)
        case L.Not(x):
            return L.Not(_named(x))
        case L.And(a, b):
            return L.And(_named(a), _named(b))
        case L.QualifiedArc(p, x, lo, hi):
            return L.QualifiedArc(p, _named(x), lo, hi)
    return s


def node_of(x):
    return literal(x[1:]) if x[0] == "'" else iri(E + x)


def test_truth_values():
    """Conjunction and negation are those of pairs of evidence, for and against."""
    pairs = {v: (bool(v & L.FOR), bool(v & L.AGAINST)) for v in range(4)}
    for (a, (af, ag)), (b, (bf, bg)) in itertools.product(pairs.items(), repeat=2):
        assert pairs[L.both(a, b)] == (af and bf, ag or bg) and pairs[L.merge(a, b)] == (af or bf, ag or bg)
        assert L.contrary(L.both(a, b)) == L.contrary(L.both(b, a)) and L.contrary(L.contrary(a)) == a
