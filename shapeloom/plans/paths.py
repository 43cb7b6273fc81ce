"""Property paths as joins: every path compiles to a set of (focus, value) pairs for a set of foci."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..sources.terms import LITERAL


@dataclass(frozen=True)
class Pred:
    iri: str


@dataclass(frozen=True)
class Inv:
    path: object


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Star:
    path: object


@dataclass(frozen=True)
class Plus:
    path: object


@dataclass(frozen=True)
class Opt:
    path: object


@dataclass(frozen=True)
class NoPreds:
    iris: tuple


def text(path) -> str:
    """A path in SPARQL's notation."""
    match path:
        case Pred(x):
            return f"<{x}>"
        case Inv(p):
            return f"^{_wrap(p)}"
        case Seq(ps):
            return "/".join(map(_wrap, ps))
        case Alt(ps):
            return "|".join(map(_wrap, ps))
        case Star(p):
            return _wrap(p) + "*"
        case Plus(p):
            return _wrap(p) + "+"
        case Opt(p):
            return _wrap(p) + "?"
        case NoPreds(xs):
            return "!(" + "|".join(f"<{x}>" for x in xs) + ")"
    return ""


def _wrap(p) -> str:
    return text(p) if isinstance(p, (Pred, NoPreds)) else f"({text(p)})"


def edges(graph: DataFrame, path) -> DataFrame:
    """All (a, b) pairs of a path without closures over the whole graph, or of its closure's step."""
    match path:
        case Pred(x):
            return graph.filter(F.col("p") == x).select(F.col("s").alias("a"), F.col("o").alias("b"))
        case NoPreds(xs):
            rows = graph.filter(~F.col("p").isin(*xs)) if xs else graph
            return rows.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
        case Inv(p):
            return edges(graph, p).select(F.col("b").alias("a"), F.col("a").alias("b"))
        case Alt(ps) if all(isinstance(p, Pred) for p in ps):
            rows = graph.filter(F.col("p").isin(*(p.iri for p in ps)))
            return rows.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
        case Alt(ps):
            out = edges(graph, ps[0])
            for p in ps[1:]:
                out = out.unionByName(edges(graph, p))
            return out.distinct()
        case Seq(ps):
            out = edges(graph, ps[0])
            for p in ps[1:]:
                step = edges(graph, p).select(F.col("a").alias("m"), F.col("b").alias("z"))
                out = out.join(step, F.col("b") == F.col("m")).select("a", F.col("z").alias("b")).distinct()
            return out
        case Plus(p):
            return closure(edges(graph, p))
        case Star(p) | Opt(p):
            nodes = graph.select(F.col("s").alias("a")).unionByName(graph.select(F.col("o").alias("a"))).distinct()
            some = closure(edges(graph, p)) if isinstance(path, Star) else edges(graph, p)
            return nodes.select("a", F.col("a").alias("b")).unionByName(some).distinct()
    raise TypeError(f"not a path: {path!r}")


def pairs(graph: DataFrame, path, focus: DataFrame) -> DataFrame:
    """The distinct (focus, value) pairs of a path from a set of foci."""
    match path:
        case Seq(ps):
            out = pairs(graph, ps[0], focus)
            for p in ps[1:]:
                mid = out.select(F.col("value").alias("focus")).distinct()
                step = pairs(graph, p, mid).select(F.col("focus").alias("m"), F.col("value").alias("z"))
                out = out.join(step, F.col("value") == F.col("m")).select("focus", F.col("z").alias("value")).distinct()
            return out
        case Alt(ps) if not all(isinstance(p, Pred) for p in ps):
            out = pairs(graph, ps[0], focus)
            for p in ps[1:]:
                out = out.unionByName(pairs(graph, p, focus))
            return out.distinct()
        case Opt(p):
            return focus.select("focus", F.col("focus").alias("value")).unionByName(pairs(graph, p, focus)).distinct()
        case Star(p) | Plus(p):
            return reach(edges(graph, p), focus, isinstance(path, Star))
        case _:
            e = edges(graph, path)
            return focus.select("focus").join(e, F.col("focus") == F.col("a")).select("focus", F.col("b").alias("value"))


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared.root(df.sparkSession))
    return df.checkpoint()


def reach(step: DataFrame, focus: DataFrame, zero: bool, most: int = 10_000) -> DataFrame:
    """(focus, value) reached over edges (a, b) by any number of steps, by none too if `zero`.

    Semi-naive: only the pairs found last are extended, and only new ones kept; cycles end by themselves.
    A round writes what it found, not all again: pairs are kept in runs, and a run is merged with the one
    before it only where that is not twice as long.
    """
    step = _cut(step.select(F.col("a").alias("ea"), F.col("b").alias("eb")))
    first = focus.select("focus").distinct()
    if zero:
        new = first.select("focus", F.col("focus").alias("value"))
    else:
        new = first.join(step, F.col("focus") == F.col("ea")).select("focus", F.col("eb").alias("value")).distinct()
    runs = [_cut(new)]  # what was found, in runs of which none is shorter than the next two together
    sizes = [runs[0].count()]
    new = runs[0]
    for _ in range(most):
        found = new.select(F.col("focus").alias("f"), F.col("value").alias("v")).join(step, F.col("v") == F.col("ea")).select("f", F.col("eb").alias("v")).distinct()
        for run in runs:
            old = run.select(F.col("focus").alias("of"), F.col("value").alias("ov"))
            found = found.join(old, (F.col("f") == F.col("of")) & (F.col("v") == F.col("ov")), "left_anti")
        new = _cut(found.select(F.col("f").alias("focus"), F.col("v").alias("value")))
        size = new.count()
        if not size:
            return reduce(lambda a, b: a.unionByName(b), runs)
        runs, sizes = [*runs, new], [*sizes, size]
        while len(runs) > 4 and sizes[-2] < 2 * sizes[-1]:
            runs, sizes = [*runs[:-2], _cut(runs[-2].unionByName(runs[-1]))], [*sizes[:-2], sum(sizes[-2:])]
    raise RuntimeError(f"a path is longer than {most} steps")


def closure(step: DataFrame, most: int = 10_000) -> DataFrame:
    """The transitive closure of edges (a, b)."""
    got = reach(step, step.select(F.col("a").alias("focus")).distinct(), False, most)
    return got.select(F.col("focus").alias("a"), F.col("value").alias("b"))


def instances(graph: DataFrame, cls) -> DataFrame:
    """Nodes whose type is the class or one of its subclasses, found from the class downwards."""
    from ..sources.terms import SUBCLASS, TYPE, constant

    top = graph.sparkSession.range(1).select(constant(cls).alias("focus"))
    below = reach(edges(graph, Inv(Pred(SUBCLASS))), top, True).select(F.col("value").alias("c"))
    typed = graph.filter(F.col("p") == TYPE).select(F.col("s").alias("focus"), F.col("o").alias("t"))
    return typed.join(below, F.col("t") == F.col("c"), "left_semi").select("focus").filter(F.col("focus")["kind"] != LITERAL).distinct()
