"""Connected components over edge tables that may have hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import table


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the smallest id reachable.

    Alternates the published large-star and small-star steps until the edges are stars, which have every
    node either as the smaller end only or once as the larger. A step
    takes each node's smallest neighbour with partial minima and joins it back to the edges, a join that
    Spark can split where a node has very many edges; the number of edges never grows beyond twice.
    """
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    pairs = table(pairs, "edges")
    for _ in range(most):
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.least("m", "u").alias("lo"), F.col("v").alias("hi"))
        large = large.distinct()
        least = large.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
        small = large.join(least, F.col("hi") == F.col("k"))
        small = small.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo < hi").distinct()
        pairs = table(small, "edges")
        ends = pairs.select(F.col("lo").alias("id"), F.lit(0).alias("under")).unionByName(pairs.select(F.col("hi").alias("id"), F.lit(1).alias("under")))
        if not ends.groupBy("id").agg(F.sum("under").alias("n"), F.min("under").alias("least")).filter("n > least").count():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = pairs.select(F.col("lo").alias("id")).distinct()
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots.withColumn("component", F.col("id")))
