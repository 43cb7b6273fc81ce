"""Mixing sources to target weights by entropy balancing.

Among all document rates r with 0 <= r <= cap and sum(size * r) = target in every source, take the one
that minimises

    sum(size * (r log r - r + 1)) + W / (2 * RIDGE) * (mean of f)**2,

the relative entropy to the unmixed corpus measured in tokens, and a second token constraint, a soft one,
as it can contradict the first: f is a document's log size, standardised over the corpus's tokens, and W the sum of the targets, so that
the mix stays near the corpus's mean log size although sources of long and short documents change places. The
convex dual has a multiplier l for each source and one, m, for the mean; at the optimum a document's rate
is the tilt min(cap, exp(l + m * f)), by its source and by its own length. The cap is a part of the problem,
not applied to its solution. Newton's method solves the dual: an iteration is one distributed pass over
all documents that sums, for each source, the tokens taken, their f, and the curvature of those below
the cap; the sources' multipliers are eliminated from the step, so that one row of sums reaches the
driver. Steps are bounded, and halved until the dual falls.

The rates are then rounded into whole copies: inside blocks of bounded size, largest documents first,
each document takes the number of copies that brings the block's running total closest to what its
rates ask for so far. Blocks are dealt by a hash of key and text; rows that repeat more often than a
block is long are dealt by their place too. Multipliers are cut to nine digits, below which sums
depend on the order of adding, so reruns agree; they agree for another layout of the table as well,
unless rows repeat that often.

Cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; rows
that repeat and rows with null keys are separate documents; an empty table gives an empty result; other
columns are carried through, but those named size, source_size, target, copies and taken, which are
replaced, and those whose names begin with _mix, which are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hash, _text
from ._store import query, read, table

CAP = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
RIDGE = 1.0
BLOCK_DOCS = 4096
MOST_BROADCAST = 100_000  # sources whose multipliers go to all tasks; more are joined by an exchange
NULL = "\U0010ffff\U0010ffff"  # sorts after every source name by code point
OURS = ("size", "source_size", "target", "copies", "taken")


def sizes(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with its number of words as `size`, without its text."""
    keep = [c for c in docs.columns if c not in (text, "size")]
    schema = docs.select(*keep).withColumn("size", F.lit(0).cast("long")).schema

    def count(batches):
        _hash.only("mixing")
        for rb in _text.slices(batches, text, 1 << 22):
            n = pa.array(_text.counts(rb.column(text)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), n], names=[*keep, "size"])

    return docs.select(*keep, text).mapInArrow(count, schema)


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with its place in the order of _mix_source, from 0: sorted by ranges, one count a range."""
    order = table(sources.repartitionByRange("_mix_source").sortWithinPartitions("_mix_source").withColumn("_id", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_id", 33)
    offsets, before = [], 0
    for p, n in order.groupBy(part).count().orderBy(part).collect():  # a row for each range
        offsets.append((p, before))
        before += n
    start = order.sparkSession.createDataFrame(offsets, "_p long, _before long")
    return order.join(F.broadcast(start), part == F.col("_p")).withColumn("place", F.col("_before") + F.col("_id") - F.shiftleft("_p", 33)).drop("_id", "_p", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets of (_mix_source, source_size): the total shared by weight, none above cap times its size.

    target = min(cap * size, level * weight) for the one level at which the targets add up to the total.
    A round stops the sources above the level so far and shares what is left; it ends when none is added.
    """
    at = (F.pmod("place", F.lit(len(weights))) + 1).cast("int")
    s = table(ranked(sources).withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), at)), "weights")
    most = cap * F.col("source_size")
    total, level, stopped = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("_w") * level >= most
        n, full, free = s.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("_w")))).first()
        if n == stopped or not free:
            break
        level, stopped = (total - (full or 0.0)) / free, n
    return s.select("_mix_source", "source_size", F.least(most, level * F.col("_w")).cast("double").alias("target"))


def _tilt(l: Column, m: float, cap: float) -> tuple[Column, Column]:
    """Rate of a document and whether it is below the cap."""
    x = l + m * F.col("_mix_f")
    top = float(np.log(cap))
    return F.when(F.col("size") == 0, 0.0).otherwise(F.exp(F.least(x, F.lit(top)))), x < top


def solve(sized: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-8, most: int = 100) -> tuple[DataFrame, float]:
    """Newton's method on the dual: (_mix_source, source_size, target, l) of every source, and m.

    `sized` has _mix_source, size and _mix_f of every document. A source whose target is cap times its
    size takes every document at the cap, one without target or size none; the others have multipliers.
    A step that does not lower the dual is halved.
    """
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    live = (F.col("source_size") > 0) & (F.col("target") > 0) & ~full
    start = F.when(live, F.log(F.col("target") / F.col("source_size"))).when(full & (F.col("target") > 0), F.lit(1e6)).otherwise(F.lit(-1e6))
    duals = table(goals.select("_mix_source", "source_size", "target", start.alias("l")), "duals")
    few, weight = duals.agg(F.count("*") <= MOST_BROADCAST, F.coalesce(F.sum("target"), F.lit(0.0))).first()
    f, top = F.col("_mix_f"), float(np.log(cap))

    def sums(duals: DataFrame, m: float):
        """A pass over all documents: the sources' sums with the step that they ask for, and the sums over sources."""
        rate, free = _tilt(F.col("l"), m, cap)
        mass, x = F.col("size") * rate, F.col("l") + m * f
        some = lambda y: F.coalesce(F.sum(F.when(free, y)), F.lit(0.0))
        value = F.sum(F.col("size") * F.when(free, rate - 1).otherwise(cap * (x - top) + cap - 1))
        per = sized.join(F.broadcast(duals) if few else duals, "_mix_source").groupBy("_mix_source").agg(
            *(F.first(c).alias(c) for c in ("source_size", "target", "l")), F.sum(mass).alias("a"), some(mass).alias("b"), some(mass * f).alias("c"), some(mass * f * f).alias("d"), F.sum(mass * f).alias("e"), value.alias("v")
        )
        per = per.withColumn("gap", F.when(live, F.col("a") - F.col("target")).otherwise(0.0)).withColumn("b", F.greatest("b", 1e-6 * F.col("target")))
        per = table(per, "pass")
        on = lambda y: F.coalesce(F.sum(F.when(live, y)), F.lit(0.0))
        return per, per.agg(
            F.max(F.when(live, F.abs("gap") / F.col("target"))).alias("worst"), F.coalesce(F.sum("e"), F.lit(0.0)).alias("e"), on(F.col("c") * F.col("gap") / F.col("b")).alias("cg"),
            on(F.col("d") - F.col("c") * F.col("c") / F.col("b")).alias("curve"), on(F.col("v") - F.col("l") * F.col("target")).alias("v"),
            F.coalesce(F.sum(F.when(~live, F.col("e"))), F.lit(0.0)).alias("fixed"),
        ).first()

    def dual(row, m: float) -> float:
        return row["v"] + m * row["fixed"] + RIDGE * weight * m * m / 2

    m = 0.0
    per, now = sums(duals, m)
    for _ in range(most):
        if now["worst"] is None:
            return duals, m
        slope, value = now["e"] + RIDGE * weight * m, dual(now, m)
        if now["worst"] <= tolerance and abs(slope) <= tolerance * weight:
            return duals.withColumn("l", F.round("l", 9)), round(m, 9)
        dm = -(slope - now["cg"]) / (max(now["curve"], 0.0) + RIDGE * weight)
        steps = table(per.select("_mix_source", "source_size", "target", "l", F.when(live, -(F.col("gap") + F.col("c") * dm) / F.col("b")).otherwise(0.0).alias("dl")), "steps")
        part = 1 / max(1.0, abs(dm), steps.agg(F.max(F.abs("dl"))).first()[0])
        while True:
            tried = table(steps.select("_mix_source", "source_size", "target", (F.col("l") + part * F.col("dl")).alias("l")), "duals")
            new, then = sums(tried, m + part * dm)
            if part < 1e-4 or dual(then, m + part * dm) <= value + 1e-9 * (abs(value) + weight):
                break
            part /= 2
        per, now, duals, m = new, then, tried, m + part * dm
    raise RuntimeError(f"Newton's method did not settle in {most} iterations")


def _copies(cap: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_mix_tie", "_mix_row"], ascending=[False, True, True], kind="stable")
        size, rate = pdf["size"].to_numpy(float), pdf["_mix_rate"].to_numpy(float)
        want = np.cumsum(size * rate)
        out, have = np.zeros(len(pdf), np.int64), 0.0
        for i, n in enumerate(size):
            if n:
                k = min(cap, max(0, int(np.floor((want[i] - have) / n + 0.5))))
                out[i], have = k, have + k * n
        return pdf[["_mix_row", "source_size", "target"]].rename(columns={"_mix_row": "_mix_at"}).assign(copies=out)

    return block


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, with_text: bool = False) -> DataFrame:
    """Every document with size, source_size, target (its source's), copies and taken (copies * size).

    A source of any size is cut into blocks of about BLOCK_DOCS documents, so that none, a hot one
    included, is rounded in one task.
    """
    extra = [c for c in docs.columns if c not in (*OURS, text) and not c.startswith("_mix")]
    counted = docs.select(*extra, *[F.col(text).alias("_mix_kept")] * with_text, F.xxhash64(F.lit("mix"), key, text).alias("_mix_tie"), text)
    extra += ["_mix_kept"] * with_text
    named = sizes(counted, text).withColumn("_mix_source", F.coalesce(F.col(source).cast("string"), F.lit(NULL)))
    sized = table(named.withColumn("_mix_row", F.monotonically_increasing_id()).withColumn("_mix_log", F.log(F.greatest("size", F.lit(1)))), "sized")
    n, log = F.col("size"), F.col("_mix_log")
    total, mean, square = sized.agg(F.sum("size"), F.sum(n * log) / F.sum("size"), F.sum(n * log * log) / F.sum("size")).first() if sized.take(1) else (0, 0.0, 0.0)
    mean = round(mean, 6) if total else 0.0
    spread = max(round((square - mean * mean) ** 0.5, 6), 1e-6) if total and square > mean * mean else 1.0
    light = sized.select("_mix_source", "_mix_row", "_mix_tie", "size", ((log - mean) / spread).alias("_mix_f"))  # all but the last join is on numbers
    stats = table(light.groupBy("_mix_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_mix_docs")), "sources")
    duals, m = solve(light, targets(stats.select("_mix_source", "source_size"), weights, cap), cap)
    per = table(duals.join(stats.select("_mix_source", "_mix_docs"), "_mix_source"), "rates")
    if per.count() <= MOST_BROADCAST:
        per = F.broadcast(per)
    often = light.groupBy("_mix_tie").agg(F.count("*").alias("_mix_n")).filter(F.col("_mix_n") > BLOCK_DOCS).select(F.col("_mix_tie").alias("_mix_often"))
    deal = F.when(F.col("_mix_often").isNull(), F.col("_mix_tie")).otherwise(F.xxhash64("_mix_tie", "_mix_row"))
    rated = light.join(per, "_mix_source").join(often, F.col("_mix_tie") == F.col("_mix_often"), "left").withColumn("_mix_block", F.pmod(deal, F.ceil(F.col("_mix_docs") / BLOCK_DOCS)))
    part = rated.select("_mix_block", "_mix_row", "_mix_tie", "size", _tilt(F.col("l"), m, cap)[0].alias("_mix_rate"), "_mix_source", "source_size", "target")
    schema = part.select(F.col("_mix_row").alias("_mix_at"), "source_size", "target").withColumn("copies", F.lit(0).cast("long")).schema
    taken = part.groupBy("_mix_source", "_mix_block").applyInPandas(_copies(int(cap)), schema)
    out = sized.join(taken, F.col("_mix_row") == F.col("_mix_at"))
    if with_text:
        out = out.withColumnRenamed("_mix_kept", text)
        extra = [text if c == "_mix_kept" else c for c in extra]
    return out.select(*extra, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
