"""The SPARQL subset that shape constraints and selectors use, compiled to joins.

SELECT [DISTINCT] variables or *, and ASK; basic graph patterns with paths, FILTER, FILTER [NOT] EXISTS,
OPTIONAL, UNION, MINUS-free, BIND; expressions with = != < <= > >= && || ! + - * /, IN, and the functions
of FUNCTIONS. Anything else raises NotSupported when the query is compiled, as do rebinding of $this and
SERVICE, VALUES and MINUS, whose use a constraint must report as a failure.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nodes as N
from ..plans import paths as P
from ..sources import turtle
from ..sources.terms import BNODE, IRI, LITERAL, NODE, RDF, STRING, XSD, Node, constant, iri, literal, node

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>\"\"\".*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dtype>\^\^)|(?P<op>&&|\|\||!=|<=|>=)|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<bnode>_:\w+)|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:)|(?P<word>[A-Za-z_]+)|(?P<mark>[{}()\[\].;,=<>!*/+|^?-])""", re.X | re.S)
FUNCTIONS = ("isIRI", "isURI", "isBlank", "isLiteral", "isNumeric", "str", "lang", "datatype", "langMatches", "bound", "sameTerm", "CONCAT", "COALESCE", "IF", "STRLEN", "UCASE", "LCASE", "STRSTARTS", "STRENDS", "CONTAINS", "REGEX")
TRUE, FALSE = literal("true", XSD + "boolean"), literal("false", XSD + "boolean")


class NotSupported(ValueError):
    """A query outside the subset, or one that shape constraints forbid."""


class Query:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, bound: tuple[str, ...] = (), constants: dict[str, Node] | None = None):
        self.constants = constants or {}
        self.tok, self.at, self.prefixes, self.bound = [], 0, dict(prefixes or {}), bound
        self.prefixes.setdefault("rdf", RDF)
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise NotSupported(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tok.append((m.lastgroup, m[0]))
            at = m.end()
        while self.word("PREFIX"):
            name = self.take()[1]
            self.prefixes[name.rstrip(":")] = self.take()[1][1:-1]
        self.ask = self.word("ASK")
        if self.ask:
            self.names, self.aliases, self.by = [], {}, None
            self.word("WHERE")
            self.body = self.group()
        else:
            if not self.word("SELECT"):
                raise NotSupported("only SELECT and ASK are supported")
            self.names, self.aliases, self.body, self.by, self.distinct = self.selection()
        if self.at < len(self.tok):
            raise NotSupported(f"{self.tok[self.at][1]} after the pattern")

    def selection(self) -> tuple[list[str] | None, dict[str, object], list, list[str] | None, bool]:
        """What follows SELECT: names (None for all), expressions, pattern, variables to group by (None: no groups), DISTINCT."""
        distinct, names, aliases = self.word("DISTINCT"), [], {}
        if self.mark("*"):
            names = None
        while names is not None and not self.peek("{", "WHERE"):
            if self.mark("("):
                e = self.expression()
                self.need("AS")
                v = self.var()
                self.need(")")
                aliases[v] = e
                names.append(v)
            else:
                names.append(self.var())
        self.word("WHERE")
        body, by = self.group(), None
        if self.word("GROUP"):
            self.need("BY")
            by = []
            while self.at < len(self.tok) and self.tok[self.at][0] == "var":
                by.append(self.var())
        if by is None and any(e[0] == "count" for e in aliases.values() if isinstance(e, tuple)):
            by = []
        if by is not None and (names is None or any(v not in by and v not in aliases for v in names)):
            raise NotSupported("a grouped query returns its groups' variables and counts")
        return names, aliases, body, by, distinct

    def peek(self, *want: str) -> bool:
        return self.at < len(self.tok) and (self.tok[self.at][1] in want or self.tok[self.at][0] == "word" and self.tok[self.at][1].upper() in want)

    def word(self, want: str) -> bool:
        if self.peek(want):
            self.at += 1
            return True
        return False

    mark = word

    def need(self, want: str) -> None:
        if not self.word(want):
            raise NotSupported(f"expected {want}")

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tok):
            raise NotSupported("unexpected end")
        self.at += 1
        return self.tok[self.at - 1]

    def var(self) -> str:
        kind, x = self.take()
        if kind != "var":
            raise NotSupported(f"expected a variable, found {x}")
        return x[1:]

    # patterns

    def group(self) -> list:
        self.need("{")
        out = []
        while not self.mark("}"):
            if self.word("FILTER"):
                neg = self.word("NOT")
                if self.word("EXISTS"):
                    out.append(("exists", not neg, self.group()))
                else:
                    out.append(("filter", self.primary()))
            elif self.word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                v = self.var()
                self.need(")")
                if v in self.bound:
                    raise NotSupported(f"?{v} is bound beforehand")
                out.append(("bind", v, e))
            elif self.peek("SERVICE", "GRAPH") or self.bound and self.peek("VALUES", "MINUS"):
                raise NotSupported(f"{self.take()[1]} isn't supported")
            elif self.word("MINUS"):
                out.append(("minus", self.group()))
            elif self.word("VALUES"):
                out.append(self.values())
            elif self.peek("{") and self.at + 1 < len(self.tok) and self.tok[self.at + 1][1].upper() == "SELECT":
                if self.bound:
                    raise NotSupported("sub-SELECT isn't supported where variables are bound beforehand")
                self.at += 2
                out.append(("select", *self.selection()))
                self.need("}")
            elif self.peek("{"):
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                out += self.triples()
            self.mark(".")
        return out

    def values(self) -> tuple:
        """VALUES ?x { ... } or VALUES (?x ?y) { (...) ... }; UNDEF isn't supported."""
        many = self.mark("(")
        names = [self.var()]
        while many and not self.mark(")"):
            names.append(self.var())
        self.need("{")
        rows = []
        while not self.mark("}"):
            if many:
                self.need("(")
            rows.append([self.term() for _ in names])
            if many:
                self.need(")")
        if any(not isinstance(x, Node) for r in rows for x in r):
            raise NotSupported("VALUES takes terms alone")
        return ("values", names, rows)

    def triples(self) -> list:
        s, out = self.term(), []
        while True:
            p = ("var", self.var()) if self.at < len(self.tok) and self.tok[self.at][0] == "var" and self.tok[self.at][1] != "$PATH" else self.path()
            while True:
                out.append(("triple", s, p, self.term()))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return out
            if self.peek(".", "}"):
                return out

    def iri(self, t: tuple[str, str]) -> str:
        if t[0] == "iri":
            return t[1][1:-1]
        if t[0] == "name":
            p, _, local = t[1].partition(":")
            if p not in self.prefixes:
                raise NotSupported(f"prefix {p}: is not declared")
            return self.prefixes[p] + local
        raise NotSupported(f"expected an IRI, found {t[1]}")

    def term(self):
        t = self.take()
        kind, x = t
        if kind == "var":
            return self.constants.get(x[1:], ("var", x[1:]))
        if kind == "bnode":
            return ("var", "_b" + x[2:])
        if kind == "str":
            lex = turtle.unescape(x[3:-3] if x.startswith('"""') else x[1:-1])
            if self.at < len(self.tok) and self.tok[self.at][0] == "lang":
                return literal(lex, lang=self.take()[1][1:])
            return literal(lex, self.iri(self.take())) if self.mark("^^") else literal(lex)
        if kind == "num":
            return literal(x, XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))
        if x in ("true", "false"):
            return literal(x, XSD + "boolean")
        return iri(self.iri(t))

    def path(self):
        parts = [self.path_sequence()]
        while self.mark("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else P.Alt(tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.mark("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else P.Seq(tuple(parts))

    def path_step(self):
        if self.mark("^"):
            return P.Inv(self.path_step())
        if self.mark("("):
            p = self.path()
            self.need(")")
        elif self.peek("$PATH"):
            self.at += 1
            p = "PATH"
        else:
            t = self.take()
            p = P.Pred(RDF + "type" if t == ("word", "a") else self.iri(t))
        for m, make in (("*", P.Star), ("+", P.Plus), ("?", P.Opt)):
            if self.mark(m):
                p = make(p)
        return p

    # expressions as nested tuples

    def expression(self):
        e = self.conjunction()
        while self.mark("||"):
            e = ("||", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.mark("&&"):
            e = ("&&", e, self.relation())
        return e

    def relation(self):
        e = self.primary()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.mark(op):
                return (op, e, self.primary())
        neg = self.word("NOT")
        if self.word("IN"):
            self.need("(")
            xs = [self.expression()]
            while self.mark(","):
                xs.append(self.expression())
            self.need(")")
            e = ("in", e, xs)
            return ("!", e) if neg else e
        return e

    def primary(self):
        if self.mark("!"):
            return ("!", self.primary())
        if self.mark("("):
            e = self.expression()
            self.need(")")
            return e
        if self.at < len(self.tok) and self.tok[self.at][0] == "word" and self.tok[self.at][1] not in ("true", "false"):
            name = self.take()[1]
            if name.upper() == "COUNT":
                self.need("(")
                distinct = self.word("DISTINCT")
                e = None if self.mark("*") else self.expression()
                self.need(")")
                return ("count", distinct, e)
            known = {f.upper(): f for f in FUNCTIONS}.get(name.upper())
            if known is None:
                raise NotSupported(f"function {name} isn't supported")
            self.need("(")
            args = []
            while not self.mark(")"):
                args.append(self.expression())
                self.mark(",")
            return ("call", known, args)
        return self.term()


def _bool(c: Column) -> Column:
    return node(LITERAL, F.when(c, "true").otherwise("false"), XSD + "boolean")


def _text(c: Column, lang: Column | str = "") -> Column:
    return node(LITERAL, c, STRING, lang)


def value(e, cols: dict[str, str]) -> Column:
    """An expression as a node column; null stands for unbound and errors."""
    if isinstance(e, Node):
        return constant(e)
    if e[0] == "var":
        c = cols.get(e[1])
        return F.lit(None).cast(NODE) if c is None else F.col(c) if isinstance(c, str) else c
    if e[0] == "call":
        name, a = e[1], e[2]
        x = value(a[0], cols) if a and name != "bound" else None
        if name in ("str", "UCASE", "LCASE"):
            f = {"str": lambda c: c, "UCASE": F.upper, "LCASE": F.lower}[name]
            return F.when(x.isNotNull(), _text(f(x["lex"])))
        if name == "lang":
            return F.when(x["kind"] == LITERAL, _text(x["lang"]))
        if name == "datatype":
            return F.when(x["kind"] == LITERAL, node(IRI, x["dt"]))
        if name == "STRLEN":
            return F.when(x.isNotNull(), node(LITERAL, F.char_length(x["lex"]).cast("string"), XSD + "integer"))
        if name == "CONCAT":
            xs = [value(y, cols) for y in a]
            ok = reduce(lambda p, q: p & q, (y.isNotNull() for y in xs))
            return F.when(ok, _text(F.concat(*(y["lex"] for y in xs))))
        if name == "COALESCE":
            return F.coalesce(*(value(y, cols) for y in a))
        if name == "IF":
            return F.when(truth(a[0], cols), value(a[1], cols)).otherwise(value(a[2], cols))
    return _bool_or_null(truth(e, cols))


def _bool_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), _bool(c))


def truth(e, cols: dict[str, str]) -> Column:
    """An expression's effective boolean value; null for errors."""
    if not isinstance(e, Node) and e[0] in ("&&", "||"):
        a, b = truth(e[1], cols), truth(e[2], cols)
        return a & b if e[0] == "&&" else a | b
    if not isinstance(e, Node) and e[0] == "!":
        return ~truth(e[1], cols)
    if not isinstance(e, Node) and e[0] == "in":
        return reduce(lambda a, b: a | b, (truth(("=", e[1], x), cols) for x in e[2]))
    if not isinstance(e, Node) and e[0] in ("=", "!=", "<", "<=", ">", ">="):
        a, b = value(e[1], cols), value(e[2], cols)
        if e[0] in ("=", "!="):
            both = N.number(a)[1].isNotNull() & N.number(b)[1].isNotNull()
            same = F.when(both, N.compare(a, b, "<=") & N.compare(a, b, ">=")).otherwise(a == b)
            return same if e[0] == "=" else ~same
        return F.when(a.isNotNull() & b.isNotNull(), N.compare(a, b, e[0]))
    if not isinstance(e, Node) and e[0] == "call":
        name, a = e[1], e[2]
        if name == "bound":
            return value(a[0], cols).isNotNull()
        x = value(a[0], cols)
        kinds = {"isIRI": IRI, "isURI": IRI, "isBlank": BNODE, "isLiteral": LITERAL}
        if name in kinds:
            return x["kind"] == kinds[name]
        if name == "isNumeric":
            return F.when(x.isNotNull(), N.number(x)[1].isNotNull())
        if name == "sameTerm":
            return x == value(a[1], cols)
        if name == "langMatches":
            y = value(a[1], cols)
            tag = F.lower(y["lex"])
            return F.when(tag == "*", x["lex"] != "").otherwise((F.lower(x["lex"]) == tag) | F.lower(x["lex"]).startswith(F.concat(tag, F.lit("-"))))
        if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
            y = value(a[1], cols)["lex"]
            return {"STRSTARTS": x["lex"].startswith, "STRENDS": x["lex"].endswith, "CONTAINS": x["lex"].contains}[name](y)
        if name == "REGEX":
            if not isinstance(a[1], Node) or len(a) > 2 and not isinstance(a[2], Node):
                raise NotSupported("REGEX needs a constant pattern")
            return x["lex"].rlike(N.java_regex(a[1].lex, a[2].lex if len(a) > 2 else ""))
    v = value(e, cols)
    num = N.number(v)[1]
    return F.when(v["dt"] == XSD + "boolean", v["lex"].isin("true", "1")).when(num.isNotNull(), num != 0).when(v["dt"] == STRING, v["lex"] != "")


class Compiler:
    """Turns patterns into joins; a solution table has a node column v_name for each variable bound."""

    def __init__(self, graph: DataFrame, path=None):
        self.graph, self.own = graph, path

    def resolve(self, p):
        if p == "PATH":
            if self.own is None:
                raise NotSupported("$PATH needs a property shape")
            return self.own
        if isinstance(p, (P.Seq, P.Alt)):
            return type(p)(tuple(map(self.resolve, p.parts)))
        return type(p)(self.resolve(p.path)) if isinstance(p, (P.Inv, P.Star, P.Plus, P.Opt)) else p

    def triple(self, s, p, o) -> tuple[DataFrame, set[str]]:
        if isinstance(p, tuple) and p[0] == "var":
            rows = self.graph.select(F.col("s").alias("a"), node(IRI, F.col("p")).alias("m"), F.col("o").alias("b"))
        else:
            rows = P.edges(self.graph, self.resolve(p)).select("a", "b")
        cols: dict[str, str] = {}
        for at, t in (("a", s), ("m", p), ("b", o)):
            if at not in rows.columns:
                continue
            if isinstance(t, Node):
                from ..sources.terms import same

                rows = rows.filter(same(F.col(at), t))
            elif t[1] in cols:
                rows = rows.filter(F.col(cols[t[1]]) == F.col(at))
            else:
                cols[t[1]] = at
        return rows.select(*(F.col(c).alias(f"v_{v}") for v, c in cols.items()), *([F.lit(1).alias("_one")] if not cols else [])), set(cols)

    @staticmethod
    def join(left: DataFrame, lv: set[str], right: DataFrame, rv: set[str], how: str = "inner") -> DataFrame:
        both = sorted(lv & rv)
        right = right.select(*(F.col(f"v_{v}").alias(f"r_{v}" if v in both else f"v_{v}") for v in sorted(rv)))
        if not both:
            if how in ("left_semi", "left_anti"):
                return Compiler.whether(left, right, how)
            raise NotSupported("patterns without a common variable would need a cross join")
        on = reduce(lambda a, b: a & b, (F.col(f"v_{v}").eqNullSafe(F.col(f"r_{v}")) if how != "inner" else F.col(f"v_{v}") == F.col(f"r_{v}") for v in both))
        return left.join(right, on, how).drop(*(f"r_{v}" for v in both))

    @staticmethod
    def whether(left: DataFrame, right: DataFrame, how: str = "left_semi") -> DataFrame:
        """`left` if `right` has a row (or has none, for left_anti), found when the plan runs: a join with one row."""
        one = right.limit(1).select(F.lit(1).alias("_some"))
        return left.withColumn("_one", F.lit(1)).join(F.broadcast(one), F.col("_one") == F.col("_some"), how).drop("_one")

    def solve(self, body: list, rows: DataFrame | None = None, have: set[str] | None = None) -> tuple[DataFrame, set[str]]:
        have = set(have or ())
        todo = list(body)
        late = [x for x in todo if x[0] in ("filter", "exists")]
        todo = [x for x in todo if x[0] not in ("filter", "exists")]
        while todo:
            i = next((i for i, x in enumerate(todo) if x[0] != "triple" or rows is None or {t[1] for t in x[1:] if isinstance(t, tuple) and t[0] == "var"} & have), 0)
            x = todo.pop(i if todo[0][0] == "triple" else 0)
            if x[0] == "triple":
                right, rv = self.triple(*x[1:])
                rows = right if rows is None else self.join(rows, have, right, rv) if rv else self.whether(rows, right)
                have |= rv
            elif x[0] == "union":
                parts = [self.solve(b, rows, have) for b in x[1]]
                every = set().union(*(v for _, v in parts))
                rows = reduce(lambda a, b: a.unionByName(b), (d.select(*((F.col(f"v_{v}") if v in vs else F.lit(None).cast(NODE)).alias(f"v_{v}") for v in sorted(every))) for d, vs in parts))
                have = every
            elif x[0] == "optional":
                right, rv = self.solve(x[1], rows, have) if any(y[0] == "filter" for y in x[1]) else self.solve(x[1])
                key = have if any(y[0] == "filter" for y in x[1]) else have & rv
                fresh = rv - have
                r = right.select(*(F.col(f"v_{v}").alias(f"r_{v}") for v in sorted(key)), *(f"v_{v}" for v in sorted(fresh))).distinct()
                on = reduce(lambda a, b: a & b, (F.col(f"v_{v}").eqNullSafe(F.col(f"r_{v}")) for v in sorted(key)))
                rows = rows.join(r, on, "left").drop(*(f"r_{v}" for v in key))
                have |= rv
            elif x[0] == "minus":
                right, rv = self.solve(x[1])
                if have & rv:
                    rows = self.join(rows, have, right.select(*(f"v_{v}" for v in sorted(have & rv))).distinct(), have & rv, "left_anti")
            elif x[0] in ("values", "select"):
                if x[0] == "values":
                    right = self.graph.sparkSession.createDataFrame([[tuple([int(n.kind), *n[1:]]) for n in r] for r in x[2]], T.StructType([T.StructField(f"v_{v}", NODE) for v in x[1]]))
                    rv = set(x[1])
                else:
                    right, names = selected(self, *x[1:])
                    right, rv = right.select(*(F.col(v).alias(f"v_{v}") for v in names)), set(names)
                rows = right if rows is None else self.join(rows, have, right, rv)
                have |= rv
            elif x[0] == "bind":
                rows = rows.withColumn(f"v_{x[1]}", value(x[2], {v: f"v_{v}" for v in have}))
                have.add(x[1])
        for x in late:
            cols = {v: f"v_{v}" for v in have}
            if x[0] == "filter":
                rows = rows.filter(F.coalesce(truth(x[1], cols), F.lit(False)))
            else:
                inner, iv = self.solve(x[2], rows.select(*cols.values()).distinct() if rows is not None else None, have)
                rows = self.join(rows, have, inner, have if rows is not None else iv, "left_semi" if x[1] else "left_anti")
        return rows, have


def select(graph: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Solutions of a SELECT query, a node column for each variable."""
    q = Query(text, prefixes)
    if q.ask:
        raise NotSupported("only SELECT queries have solutions")
    return selected(Compiler(graph), q.names, q.aliases, q.body, q.by, q.distinct)[0]


def selected(compiler: Compiler, names: list[str] | None, aliases: dict, body: list, by: list[str] | None, distinct: bool) -> tuple[DataFrame, list[str]]:
    """The solutions of a selection, a node column for each variable, and the variables."""
    rows, have = compiler.solve(body)
    if by is not None:
        if missing := [v for v in by if v not in have]:
            raise NotSupported(f"?{missing[0]} is not bound")
        cols, counts = {x: f"v_{x}" for x in have}, {}
        for v, e in aliases.items():
            if e[0] != "count":
                raise NotSupported("a grouped query returns its groups' variables and counts")
            of = F.lit(1) if e[2] is None else value(e[2], cols)
            counts[v] = (F.count_distinct(of) if e[1] else F.count(of)).cast("string")
        rows = rows.groupBy(*(f"v_{v}" for v in by)).agg(*(c.alias(f"_c_{v}") for v, c in counts.items()))
        rows = rows.select(*(f"v_{v}" for v in by), *(node(LITERAL, F.col(f"_c_{v}"), XSD + "integer").alias(f"v_{v}") for v in counts))
        have = {*by, *counts}
    else:
        for v, e in aliases.items():
            rows = rows.withColumn(f"v_{v}", value(e, {x: f"v_{x}" for x in have}))
            have.add(v)
    names = names if names is not None else sorted(v for v in have if not v.startswith("_b"))
    if missing := [v for v in names if v not in have]:
        raise NotSupported(f"?{missing[0]} is not bound")
    rows = rows.select(*(F.col(f"v_{v}").alias(v) for v in names))
    return rows.distinct() if distinct else rows, names


def rejected(graph: DataFrame, text: str, prefixes: dict[str, str], values: DataFrame, constants: dict[str, Node], path=None) -> DataFrame:
    """Those of the rows (focus, n, value) for which a validator's ASK query with $this and $value bound is false."""
    q = Query(text, prefixes, ("this", "value", *constants), constants)
    if not q.ask:
        raise NotSupported("sh:ask needs an ASK query")
    start = values.select(F.col("focus").alias("v_this"), F.col("value").alias("v_value")).distinct()
    good, _ = Compiler(graph, path).solve(q.body, start, {"this", "value"})
    good = good.select(F.col("v_this").alias("_t"), F.col("v_value").alias("_v")).distinct()
    return values.join(good, (F.col("focus") == F.col("_t")) & (F.col("value") == F.col("_v")), "left_anti")


def violations(graph: DataFrame, text: str, prefixes: dict[str, str], focus: DataFrame, path=None, constants: dict[str, Node] | None = None) -> DataFrame:
    """(focus, n, value, path) for every solution of a constraint's SELECT with $this bound to each focus."""
    q = Query(text, prefixes, ("this", *(constants or ())), constants)
    if q.ask:
        raise NotSupported("sh:select needs a SELECT query")
    if q.by is not None:
        raise NotSupported("a constraint's query has no groups")
    if q.names is not None and "this" not in q.names:
        raise NotSupported("a constraint's query has to return $this")
    start = focus.select(F.col("focus").alias("v_this")).distinct()
    rows, have = Compiler(graph, path).solve(q.body, start, {"this"})
    for v, e in q.aliases.items():
        rows = rows.withColumn(f"v_{v}", value(e, {x: f"v_{x}" for x in have}))
        have.add(v)
    val = F.col("v_value") if "value" in have else F.lit(None).cast(NODE)
    where = F.concat(F.lit("<"), F.col("v_path")["lex"], F.lit(">")) if "path" in have else F.lit(None).cast("string")
    rows = rows.select(F.col("v_this").alias("_t"), val.alias("value"), where.alias("path"))
    return focus.join(rows, F.col("focus") == F.col("_t")).select("focus", "n", "value", "path")


def ask_column(text: str, prefixes: dict[str, str] | None = None):
    """A validator for a value from an ASK query that filters alone: value column (and parameters) to Column."""
    q = Query(text, prefixes)
    if not q.ask or any(x[0] != "filter" for x in q.body):
        raise NotSupported("only ASK queries of filters are columns")

    def build(**cols: Column) -> Column:
        out = F.lit(True)
        for x in q.body:
            out &= F.coalesce(truth(x[1], cols), F.lit(False))
        return out

    return build
