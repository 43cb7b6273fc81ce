"""SHACL validation as DataFrame plans.

Violations are a bag: a shape reached by two routes reports twice, so foci carry their multiplicity n
until the end. Values of a path are a set. All leaf constraints of a shape are tested in one pass over
its values, all counts in one aggregate over (focus, value); inner shapes of and, or, not, xone, node
and qualified constraints are boolean columns where they look at the node alone, and otherwise the set of
failing nodes, found once for the distinct values and joined as flags.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..plans import paths as P
from ..plans import shapes as S
from ..sources import rdf
from ..sources.terms import LITERAL, NODE, RDF, SH, TYPE, Node, constant, iri, node, same, text

VIOLATIONS = "focus struct<kind:tinyint,lex:string,dt:string,lang:string>, path string, value struct<kind:tinyint,lex:string,dt:string,lang:string>, severity string, component string, shape string, message string, n long"
COMPARED = {"minExclusive": ">", "minInclusive": ">=", "maxExclusive": "<", "maxInclusive": "<="}


def component(kind: str) -> str:
    fixed = {"qualifiedMin": "QualifiedMinCount", "qualifiedMax": "QualifiedMaxCount", "sparql": "SPARQL"}
    return f"{SH}{fixed.get(kind, kind[0].upper() + kind[1:])}ConstraintComponent"


@dataclass
class Result:
    """A validation's lazy violations (focus, path, value, severity, component, shape, message)."""

    violations: DataFrame
    paths: dict[str, object] = field(default_factory=dict)  # by their text: the shapes' paths that are no plain predicates

    def conforms(self) -> bool:
        return self.violations.isEmpty()

    def count(self) -> int:
        return self.violations.count()

    def by_severity(self) -> DataFrame:
        return self.violations.groupBy("severity", "component").agg(F.count("*").alias("n"))

    def flat(self) -> DataFrame:
        """Nodes as N-Triples text; an absent value as the empty string."""
        return self.violations.select(text(F.col("focus")).alias("focus"), "path", F.coalesce(text(F.col("value")), F.lit("")).alias("value"), "severity", "component", "shape", "message")

    def report(self) -> DataFrame:
        """The validation report as triples; results get blank nodes by their order."""
        from pyspark.sql import Window

        every = self.violations.select("*", text(F.col("focus")).alias("_f"), F.coalesce(text(F.col("value")), F.lit("")).alias("_t"))
        keyed = every.withColumn("_h", F.sha2(F.concat_ws("\u0001", "_f", "path", "_t", "severity", "component", "shape", "message").cast("binary"), 256))
        keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy("_f")))
        r = node(1, F.concat(F.lit("r"), F.substring("_h", 1, 32), F.lit("_"), F.col("_k").cast("string")))
        cell = lambda s, p, o, ok=True: F.when(F.lit(True) if ok is True else ok, F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")))
        top = node(1, F.lit("report"))
        as_iri = lambda c: node(0, c)
        shape = F.when(F.col("shape").startswith("_:"), node(1, F.substring("shape", 3, 100000))).otherwise(node(0, F.regexp_extract("shape", "^<(.*)>$", 1)))
        cells = [
            cell(top, SH + "result", r), cell(r, TYPE, constant(iri(SH + "ValidationResult"))), cell(r, SH + "focusNode", F.col("focus")),
            cell(r, SH + "value", F.col("value"), F.col("value").isNotNull()), cell(r, SH + "resultSeverity", as_iri(F.col("severity"))),
            cell(r, SH + "sourceConstraintComponent", as_iri(F.col("component"))), cell(r, SH + "sourceShape", shape),
            cell(r, SH + "resultPath", as_iri(F.regexp_extract("path", "^<([^<>]*)>$", 1)), F.col("path").rlike("^<[^<>]*>$")),
            cell(r, SH + "resultMessage", node(2, F.col("message"), "http://www.w3.org/2001/XMLSchema#string"), F.col("message") != ""),
        ]
        for name, path in self.paths.items():  # each result has blank nodes of its own for its path
            head, parts = described(path)
            at = lambda x: node(1, F.concat(r["lex"], F.lit(f"p{x}"))) if isinstance(x, int) else constant(x)
            cells += [cell(r, SH + "resultPath", at(head), F.col("path") == name), *(cell(at(a), p, at(b), F.col("path") == name) for a, p, b in parts)]
        rows = keyed.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("t")).select("t.*")
        spark = self.violations.sparkSession
        ok = "true" if self.conforms() else "false"
        head = rdf.frame(spark, [(Node(1, "report"), TYPE, iri(SH + "ValidationReport")), (Node(1, "report"), SH + "conforms", Node(LITERAL, ok, "http://www.w3.org/2001/XMLSchema#boolean"))])
        return head.unionByName(rows)


def described(path) -> tuple[int | Node, list[tuple[int, str, int | Node]]]:
    """A path as RDF: its node, and triples whose blank nodes are numbers."""
    triples: list = []
    fresh = iter(range(1_000_000))

    def listed(parts) -> int | Node:
        head: int | Node = iri(RDF + "nil")
        for x in reversed(parts):
            here = next(fresh)
            triples.extend([(here, RDF + "first", walk(x)), (here, RDF + "rest", head)])
            head = here
        return head

    def walk(x) -> int | Node:
        match x:
            case P.Pred(p):
                return iri(p)
            case P.Seq(parts):
                return listed(parts)
            case P.Alt(parts):
                name, of = "alternativePath", listed(parts)
            case P.Inv(y):
                name, of = "inversePath", walk(y)
            case P.Star(y):
                name, of = "zeroOrMorePath", walk(y)
            case P.Plus(y):
                name, of = "oneOrMorePath", walk(y)
            case P.Opt(y):
                name, of = "zeroOrOnePath", walk(y)
            case _:
                raise TypeError(f"not a path of shapes: {x!r}")
        here = next(fresh)
        triples.append((here, SH + name, of))
        return here

    return walk(path), triples


class Validator:
    """Compiles shapes over a graph of triples (s, p, o)."""

    def __init__(self, graph: DataFrame, shapes: dict[Node, S.Shape]):
        self.graph, self.shapes = graph, shapes
        self._acyclic()

    def _refs(self, s: S.Shape):
        for k, v in s.constraints:
            if k in ("not", "node"):
                yield v
            elif k in ("and", "or", "xone"):
                yield from v
            elif k == "qualified":
                yield v[0]
                yield from v[3]
        yield from s.properties

    def _acyclic(self) -> None:
        state: dict[Node, int] = {}

        def visit(x: Node) -> None:
            if state.get(x) == 1:
                raise S.ShapeError(f"recursive shape {x.nt()}: SHACL leaves its meaning undefined")
            if x not in state and x in self.shapes:
                state[x] = 1
                for y in self._refs(self.shapes[x]):
                    visit(y)
                state[x] = 2

        for x in self.shapes:
            visit(x)

    def shape(self, x: Node) -> S.Shape:
        return self.shapes.get(x) or S.Shape(x)

    # targets

    def targets(self, s: S.Shape) -> DataFrame | None:
        """The distinct foci of a shape, or None if it has no target."""
        out = None
        for kind, x in s.targets:
            if kind == "targetNode":
                rows = self.graph.sparkSession.range(1).select(constant(x).alias("focus"))
            elif kind == "targetClass":
                rows = P.instances(self.graph, x)
            else:
                side = "s" if kind == "targetSubjectsOf" else "o"
                rows = self.graph.filter(F.col("p") == x.lex).select(F.col(side).alias("focus"))
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.distinct()

    # node-local shapes as columns

    def column(self, s: S.Shape, v: Column) -> Column | None:
        """Whether a node conforms, as a Column, for shapes that look at the node alone; else None."""
        if s.deactivated:
            return F.lit(True)
        if s.path is not None or s.closed is not None or s.properties:
            return None
        out = F.lit(True)
        for k, x in s.constraints:
            c = self.leaf(k, x, v)
            if c is None:
                if k not in ("and", "or", "not", "xone", "node"):
                    return None
                inner = [self.column(self.shape(y), v) for y in (x if isinstance(x, tuple) and not isinstance(x, Node) else (x,))]
                if any(i is None for i in inner):
                    return None
                c = self.combine(k, inner)
            out &= c
        return out

    @staticmethod
    def combine(kind: str, flags: list[Column]) -> Column:
        n = reduce(lambda a, b: a + b, (f.cast("int") for f in flags), F.lit(0))
        return {"and": n == len(flags), "node": n == len(flags), "or": n >= 1, "not": n == 0, "xone": n == 1}[kind]

    def leaf(self, k: str, x, v: Column) -> Column | None:
        if k == "datatype":
            return N.datatype(v, x.lex)
        if k == "nodeKind":
            return N.kind_in(v, x.lex.removeprefix(SH))
        if k in COMPARED:
            return N.compare(v, constant(x), COMPARED[k])
        if k in ("minLength", "maxLength"):
            return N.length(v, ">=" if k == "minLength" else "<=", x)
        if k == "pattern":
            return N.pattern(v, *x)
        if k == "languageIn":
            return N.language_in(v, [t.lex for t in x])
        if k == "in":
            return N.in_list(v, list(x))
        return None

    # relational part

    def failing(self, s: S.Shape, focus: DataFrame) -> DataFrame:
        """The distinct foci that violate the shape."""
        return self.violations(s, focus.select("focus").distinct()).select("focus").distinct()

    def flagged(self, values: DataFrame, shapes: list[Node]) -> tuple[DataFrame, list[Column]]:
        """`values` (distinct, column value) with a flag for each shape: whether the value conforms."""
        flags = []
        for i, x in enumerate(shapes):
            s = self.shape(x)
            c = self.column(s, F.col("value"))
            if c is None:
                bad = self.failing(s, values.select(F.col("value").alias("focus"))).select(F.col("focus").alias(f"_b{i}"), F.lit(True).alias(f"_f{i}"))
                values = values.join(bad, F.col("value") == F.col(f"_b{i}"), "left").drop(f"_b{i}")
                c = F.col(f"_f{i}").isNull()
            values = values.withColumn(f"_f{i}", c)
            flags.append(F.col(f"_f{i}"))
        return values, flags

    def _row(self, df: DataFrame, s: S.Shape, kind: str, value: Column | None = None, path: Column | None = None, message: str = "") -> DataFrame:
        null = F.lit(None).cast(NODE)
        own = F.lit(P.text(s.path) if s.path is not None else "")
        name = component(kind)
        return df.select("focus", (own if path is None else path).alias("path"), (null if value is None else value).alias("value"), F.lit(s.severity).alias("severity"), F.lit(name).alias("component"), F.lit(s.id.nt()).alias("shape"), F.lit(message or s.message).alias("message"), F.col("n").cast("long").alias("n"))

    def violations(self, s: S.Shape, focus: DataFrame) -> DataFrame:
        """Violations of distinct foci, each with its multiplicity n; without a column n that is 1."""
        spark = self.graph.sparkSession
        out: list[DataFrame] = []
        if s.deactivated:
            return spark.createDataFrame([], VIOLATIONS)
        plain, once = focus, F.lit(1).cast("long")
        if "n" not in focus.columns:
            focus = focus.withColumn("n", once)
        values = focus.withColumn("value", F.col("focus")) if s.path is None else self._values(s.path, plain)
        v = F.col("value")
        tests = [(k, self.leaf(k, x, v)) for k, x in s.constraints]
        tests = [(k, c) for k, c in tests if c is not None]
        if tests:  # one pass for all leaves
            bad = F.array(*(F.when(~c, F.lit(component(k))) for k, c in tests))
            rows = values.withColumn("_c", F.explode(F.filter(bad, lambda x: x.isNotNull())))
            out.append(rows.select("focus", F.lit(P.text(s.path) if s.path is not None else "").alias("path"), v.alias("value"), F.lit(s.severity).alias("severity"), F.col("_c").alias("component"), F.lit(s.id.nt()).alias("shape"), F.lit(s.message).alias("message"), F.col("n").cast("long").alias("n")))
        counts = [(k, x) for k, x in s.constraints if k in ("minCount", "maxCount", "hasValue")]
        if counts and s.path is None:
            for k, x in counts:
                out.append(self._row(values.filter(~same(v, x)), s, k))
        elif counts:  # one aggregate for all counts
            aggs = [F.count("value").alias("_n"), *(F.coalesce(F.max(same(v, x)), F.lit(False)).alias(f"_h{i}") for i, (k, x) in enumerate(counts) if k == "hasValue")]
            need = any(k == "hasValue" or k == "minCount" and x > 0 for k, x in counts)
            if need:  # foci without a value count as well
                per = focus.join(values.groupBy(F.col("focus").alias("_f")).agg(*aggs), F.col("focus") == F.col("_f"), "left")
                per = per.withColumns({c: F.coalesce(c, F.lit(0) if c == "_n" else F.lit(False)) for c in per.columns if c == "_n" or c.startswith("_h")})
            else:
                per = values.groupBy("focus", "n").agg(*aggs)
            tests = [F.when((F.col("_n") < x) if k == "minCount" else (F.col("_n") > x) if k == "maxCount" else ~F.col(f"_h{i}"), F.lit(component(k))) for i, (k, x) in enumerate(counts)]
            rows = per.withColumn("_c", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
            out.append(rows.select("focus", F.lit(P.text(s.path)).alias("path"), F.lit(None).cast(NODE).alias("value"), F.lit(s.severity).alias("severity"), F.col("_c").alias("component"), F.lit(s.id.nt()).alias("shape"), F.lit(s.message).alias("message"), "n"))
        for k, x in s.constraints:
            if k == "class":
                good = P.instances(self.graph, x).withColumnRenamed("focus", "_i")
                out.append(self._row(values.join(good, v == F.col("_i"), "left_anti"), s, k, v))
            elif k in ("and", "or", "not", "xone", "node"):
                inner = list(x) if k in ("and", "or", "xone") else [x]
                local = [self.column(self.shape(y), v) for y in inner]
                if all(c is not None for c in local):
                    out.append(self._row(values.filter(~self.combine(k, local)), s, k, v))
                else:
                    flagged, flags = self.flagged(values.select("value").distinct(), inner)
                    bad = flagged.filter(~self.combine(k, flags)).select(F.col("value").alias("_v"))
                    out.append(self._row(values.join(bad, v == F.col("_v"), "left_semi"), s, k, v))
            elif k == "qualified":
                shape, low, high, siblings = x
                flagged, flags = self.flagged(values.select("value").distinct(), [shape, *siblings])
                ok = reduce(lambda a, b: a & ~b, flags[1:], flags[0])
                good = flagged.filter(ok).select(F.col("value").alias("_v"))
                hits = values.join(good, v == F.col("_v"), "left_semi").groupBy(F.col("focus").alias("_f")).agg(F.count("*").alias("_n"))
                per = focus.join(hits, F.col("focus") == F.col("_f"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
                if low is not None:
                    out.append(self._row(per.filter(F.col("_n") < low), s, "qualifiedMin"))
                if high is not None:
                    out.append(self._row(per.filter(F.col("_n") > high), s, "qualifiedMax"))
            elif k == "uniqueLang":
                tags = values.filter(v["lang"] != "").groupBy("focus", "n", v["lang"].alias("_l")).agg(F.count("*").alias("_n"))
                out.append(self._row(tags.filter("_n > 1"), s, k))
            elif k in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
                out += self._pair(s, k, x, plain, values)
            elif k == "sparql":
                from .sparql import violations as sparql

                query, prefixes, message, off = x
                if not off:
                    rows = sparql(self.graph, query, prefixes, focus, s.path)
                    path = F.coalesce("path", F.lit(P.text(s.path) if s.path is not None else ""))
                    out.append(self._row(rows, s, k, F.when(F.col("value").isNotNull(), F.col("value")).otherwise(F.col("focus")) if s.path is None else F.col("value"), path, message))
            elif k == "custom":
                from .sparql import rejected
                from .sparql import violations as sparql

                name, ask, query, prefixes, message, params = x
                if ask:
                    rows = self._row(rejected(self.graph, query, prefixes, values, params, s.path), s, k, v, message=message)
                else:
                    found = sparql(self.graph, query, prefixes, focus, s.path, params)
                    path = F.coalesce("path", F.lit(P.text(s.path) if s.path is not None else ""))
                    rows = self._row(found, s, k, F.coalesce("value", F.col("focus")) if s.path is None else F.col("value"), path, message)
                out.append(rows.withColumn("component", F.lit(name)))
        if s.closed is not None:
            arcs = self.graph.select(F.col("s").alias("_s"), "p", "o")
            arcs = arcs.filter(~F.col("p").isin(*s.closed)) if s.closed else arcs
            nodes = values.groupBy(v.alias("_v")).agg(F.sum("n").alias("n")) if s.path is not None else values.select(v.alias("_v"), "n")
            rows = nodes.join(arcs, F.col("_v") == F.col("_s")).withColumn("focus", F.col("_v"))
            out.append(self._row(rows, s, "closed", F.col("o"), F.concat(F.lit("<"), F.col("p"), F.lit(">"))))
        if s.properties:
            inner = values.groupBy("value").agg(F.sum("n").alias("n")).withColumnRenamed("value", "focus") if s.path is not None else plain
            out += [self.violations(self.shape(p), inner) for p in s.properties]
        if not out:
            return spark.createDataFrame([], VIOLATIONS)
        names = ["focus", "path", "value", "severity", "component", "shape", "message", "n"]
        return reduce(lambda a, b: a.unionByName(b), (d.select(*names) for d in out))

    def _values(self, path, focus: DataFrame) -> DataFrame:
        """(focus, value, n) of a path from distinct foci, that may have a multiplicity n."""
        pairs = P.pairs(self.graph, path, focus.select("focus"))
        if "n" not in focus.columns:
            return pairs.withColumn("n", F.lit(1).cast("long"))
        return pairs.join(focus.withColumnRenamed("focus", "_focus"), F.col("focus") == F.col("_focus")).drop("_focus")

    def _pair(self, s: S.Shape, k: str, x: Node, focus: DataFrame, values: DataFrame) -> list[DataFrame]:
        others = self._values(P.Pred(x.lex), focus)
        right = others.select(F.col("focus").alias("_f"), F.col("value").alias("_o"))
        both = (F.col("focus") == F.col("_f")) & (F.col("value") == F.col("_o"))
        if k == "equals":
            left = values.select(F.col("focus").alias("_f"), F.col("value").alias("_o"))
            return [self._row(values.join(right, both, "left_anti"), s, k, F.col("value")), self._row(others.join(left, both, "left_anti"), s, k, F.col("value"))]
        if k == "disjoint":
            return [self._row(values.join(right, both, "left_semi"), s, k, F.col("value"))]
        # terms are parsed before the join, once each
        left, right = values.withColumn("_a", N.ordered(F.col("value"))), right.select("_f", N.ordered(F.col("_o")).alias("_b"))
        rows = left.join(right, (F.col("focus") == F.col("_f")) & ~N.in_order(F.col("_a"), F.col("_b"), "<" if k == "lessThan" else "<="))
        return [self._row(rows, s, k, F.col("value"))]

    def validate(self, only: list[Node] | None = None) -> Result:
        """All violations of all shapes with targets (or of `only` those)."""
        parts = []
        for x, s in self.shapes.items():
            if only is None or x in only:
                focus = self.targets(s)
                if focus is not None and not s.deactivated:
                    parts.append(self.violations(s, P._cut(focus) if len(s.constraints) + len(s.properties) > 1 else focus))
        spark = self.graph.sparkSession
        rows = reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], VIOLATIONS)
        paths = {P.text(s.path): s.path for s in self.shapes.values() if s.path is not None and not isinstance(s.path, P.Pred)}
        return Result(rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("_i", "n"), paths)


def shapes_of(data: str, format: str = "turtle", base: str = "", fetch=None) -> dict[Node, S.Shape]:
    """Shapes of a text; with `fetch` (IRI to text) its owl:imports are followed, each once."""
    triples = rdf.parse(data, format, base)
    if fetch:
        links = lambda ts: [o.lex for _, p, o in ts if p == "http://www.w3.org/2002/07/owl#imports" and o.kind == 0]
        seen: set[str] = set()
        todo = links(triples)
        while todo:
            x = todo.pop(0)
            if x not in seen:
                seen.add(x)
                more = rdf.parse(fetch(x), format, x, f"i{len(seen)}_")
                triples += more
                todo += links(more)
    return S.read(triples)


def validate(graph: DataFrame, shapes: dict[Node, S.Shape] | str, **kw) -> Result:
    """Validate a graph against shapes, or against shapes in Turtle."""
    return Validator(graph, shapes_of(shapes, **kw) if isinstance(shapes, str) else shapes).validate()
