"""Validation of node-local shapes and of cardinalities over streams of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shacl import Validator
from ..plans.shapes import Shape, ShapeError
from ..sources.terms import text


def leaves(stream: DataFrame, path: str, shape: Shape) -> DataFrame:
    """Violations (focus, value, shape) of a node-local shape by the objects of one predicate: a stateless filter."""
    v = Validator(stream, {})
    ok = v.column(shape, F.col("o"))
    if ok is None:
        raise ShapeError("only shapes that look at the value alone are stateless")
    return stream.filter((F.col("p") == path) & ~ok).select(text(F.col("s")).alias("focus"), text(F.col("o")).alias("value"), F.lit(shape.id.nt()).alias("shape"))


def cardinality(stream: DataFrame, path: str, time: str, window: str, late: str, low: int = 0, high: int | None = None) -> DataFrame:
    """(start, focus, n) of foci whose number of distinct values of a predicate in a window is out of range.

    Foci with no arc at all in a window are not known to a stream. State ends `late` after a window.
    """
    arcs = stream.filter(F.col("p") == path).withWatermark(time, late)
    per = arcs.groupBy(F.window(time, window).alias("w"), text(F.col("s")).alias("focus")).agg(F.size(F.collect_set(text(F.col("o")))).cast("long").alias("n"))
    bad = F.col("n") < low
    if high is not None:
        bad |= F.col("n") > high
    return per.filter(bad).select(F.col("w.start").alias("start"), "focus", "n")
