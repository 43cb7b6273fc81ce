"""Embedding near-duplicates by lattice hashing.

A table projects unit vectors at random to 8 * blocks dimensions and decodes every 8 of them to the
nearest point of the E8 lattice; the points together are a vector's home cell. It also probes the
neighbouring cells that lie nearest. Two vectors meet in a cell if one of them is at home there. Where
they meet first, in the order of tables and cells, their cosine is taken in double precision.

Equal vectors form one class first and only its smallest id goes on, with the class's size. A crowded
cell is cut into blocks by hash, and pairs of blocks are dealt out as tasks' rows; what a task returns
is a number of links for each vector and edges to one root for each connected part, never pairs. The
links of a dense cluster of unequal vectors have to be counted, so its work, not its rows, grows with
the square.

`plan` sets blocks and tables by the number of vectors: finer cells for more vectors, and as many
tables as a chance of at least 0.995 to meet at the limit's cosine asks for. Every vector is indexed.

Cases: null, empty, zero and non-finite vectors, and those with null components, link with nothing;
vectors of different lengths never link; rows that share an id are one node, whose different vectors
are each compared and counted apart; a null id links with nothing and is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._graph import components
from ._store import query, read, table

LIMIT = 0.9
PROBES = 3
BLOCK = 512
SCALE = {1: 0.6, 2: 0.5, 3: 0.5}
# measured chance that two vectors at cosine 0.9 meet in a table, and most vectors for the cells' size
MEET = {1: 0.43, 2: 0.19, 3: 0.06}
MOST = {1: 100_000, 2: 5_000_000, 3: 2**62}
_MINIMAL = np.array([v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2] + [tuple(x / 2 for x in v) for v in itertools.product((-1, 1), repeat=8) if math.prod(v) > 0], float)


def plan(n: int) -> tuple[int, int]:
    blocks = next(b for b, most in MOST.items() if n <= most)
    return blocks, math.ceil(math.log(0.005) / math.log(1 - MEET[blocks]))


def _d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    e = (x - r)[odd]
    worst = np.abs(e).argmax(1)
    r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 and D8 + 1/2 to each row of 8 coordinates."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, blocks: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """Keys of (row, table, home cell and then probes)."""
    n, d = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    weight = _text.mix(np.arange(1, 8 * blocks + 1, dtype=np.uint64)) | np.uint64(1)
    for t in range(tables):
        x = unit @ (np.random.Generator(np.random.PCG64([d, t])).normal(size=(d, 8 * blocks)) * SCALE[blocks])
        home = np.concatenate([e8(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], 1)
        r = x - home
        near = np.concatenate([r[:, 8 * b : 8 * b + 8] @ _MINIMAL.T for b in range(blocks)], 1)
        best = np.argsort(-near, 1, kind="stable")[:, :probes]
        for p in range(1 + probes):
            c = home.copy()
            if p:
                b, v = np.divmod(best[:, p - 1], len(_MINIMAL))
                for k in range(blocks):
                    c[:, 8 * k : 8 * k + 8] += np.where((b == k)[:, None], _MINIMAL[v], 0)
            out[:, t, p] = _text.mix(((2 * c).astype(np.int64).view(np.uint64) * weight).sum(1, dtype=np.uint64) + np.uint64(t))
    return out


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(rb: pa.RecordBatch):
    lengths = rb.column("v").value_lengths().to_numpy()
    for d in np.unique(lengths):
        yield int(d), rb.filter(pa.array(lengths == d)) if (lengths != d).any() else rb


def _keyed(vectors: DataFrame, blocks: int, tables: int) -> DataFrame:
    """(id, k, cell, home): the cells of each vector."""

    def run(batches):
        for rb in (b for x in batches for b in (x.slice(at, 1024) for at in range(0, x.num_rows, 1024))):
            for d, part in _by_length(rb):
                keys = cells(_matrix(part.column("v"), d), blocks, tables)
                n, width = len(keys), keys.shape[1] * keys.shape[2]
                home = np.zeros(keys.shape[1:], bool)
                home[:, 0] = True
                ids, ks = (pa.array(np.repeat(part.column(c).to_numpy(), width)) for c in ("id", "k"))
                yield pa.RecordBatch.from_arrays([ids, ks, pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(home.reshape(-1), n))], names=["id", "k", "cell", "home"])

    return vectors.select("id", "k", "v").mapInArrow(run, "id long, k long, cell long, home boolean")


def _first(ka: np.ndarray, kb: np.ndarray, table_: int, cell: np.uint64) -> np.ndarray:
    """Of pairs with all their cells: whether this cell of this table is where they meet first."""
    first = np.ones(len(ka), bool)
    for t in range(table_ + 1):
        for i, j in itertools.product(range(ka.shape[2]), repeat=2):
            if i and j:
                continue  # neither is at home
            same = ka[:, t, i] == kb[:, t, j]
            first &= ~(same & (ka[:, t, i] < cell)) if t == table_ else ~same
    return first


def _links(rows: DataFrame, limit: float, blocks: int, tables: int) -> DataFrame:
    """(id, k, links, root): links found in one group of rows of a cell, and an edge to the smallest id reached."""

    def group(pdf: dict):
        none = [], [], [], []
        if len(pdf["id"]) < 2 or not pdf["home"].any():
            return none
        order = np.lexsort((pdf["k"], pdf["id"]))
        x, ids, ks, home, size, side = (pdf[c][order] for c in ("x", "id", "k", "home", "size", "side"))
        ai, bi = [], []
        for at in range(0, len(ids), BLOCK):
            near = x[at : at + BLOCK] @ x.T >= limit
            near &= home[at : at + BLOCK, None] | home[None, :]
            if pdf["cross"]:
                near &= side[at : at + BLOCK, None] != side[None, :]
            near &= np.arange(len(ids))[None, :] > np.arange(at, at + near.shape[0])[:, None]
            p, q = np.nonzero(near)
            ai.append(p + at)
            bi.append(q)
        a, b = np.concatenate(ai), np.concatenate(bi)
        if not len(a):
            return none
        used = np.unique(np.concatenate([a, b]))
        keys = np.zeros((len(ids), tables, 1 + PROBES), np.uint64)
        keys[used] = cells(x[used], blocks, tables)
        cell = np.int64(pdf["cell"]).view(np.uint64)
        table_ = int((keys[used[0]] == cell).any(1).argmax())
        ok = np.concatenate([_first(keys[a[i : i + 65536]], keys[b[i : i + 65536]], table_, cell) for i in range(0, len(a), 65536)])
        links = np.bincount(a[ok], size[b[ok]], len(ids)) + np.bincount(b[ok], size[a[ok]], len(ids))
        root = np.arange(len(ids))
        while True:  # smallest position over links, whichever cell counts them
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return ids[used].tolist(), ks[used].tolist(), links[used].astype(np.int64).tolist(), ids[root[used]].tolist()

    def run(batches):
        held: list = []
        key = None

        def flush():
            cols = {c: np.concatenate([h[c] for h in held]) for c in ("id", "k", "home", "size", "side", "x")}
            return group(cols | {"cell": key[0], "cross": key[2] != key[3]})

        for rb in (b for y in batches for b in (y.slice(at, 4096) for at in range(0, y.num_rows, 4096))):
            names = ["cell", "d", "i", "j"]
            keys = np.stack([rb.column(c).to_numpy() for c in names], 1)
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            done = [[], [], [], []]
            for s, e in itertools.pairwise(cut.tolist()):
                now = tuple(keys[s].tolist())
                if now != key:
                    if held:
                        for x, y in zip(done, flush(), strict=True):
                            x += y
                    held, key = [], now
                part = rb.slice(s, e - s)
                held.append({c: part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "k", "home", "size", "side")} | {"x": _matrix(part.column("v"), now[1])})
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=["id", "k", "links", "root"])
        if held and (last := flush())[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in last], names=["id", "k", "links", "root"])

    keys = ["cell", "d", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, k long, links long, root long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col(vector)
    fine = v.isNotNull() & F.col(key).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x + F.lit(0.0).cast("float"))  # -0 and 0 are one number
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(fine, plain).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v")))
    live = rows.filter("v is not null")
    same = table(live.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")), "classes")
    # an id that stands for several classes, which takes repeated ids, tells them apart by k
    several = same.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("id").alias("_i"))
    same = table(same.join(several, F.col("id") == F.col("_i"), "left").withColumn("k", F.when(F.col("_i").isNull(), F.lit(0)).otherwise(F.col("h1")).cast("long")).drop("_i"), "named")
    reps = live.join(same, (F.col("vec_id") == F.col("id")) & (live.h1 == same.h1) & (live.h2 == same.h2)).select("id", "k", "v", "size").dropDuplicates(["id", "k"])
    reps = table(reps.withColumn("d", F.size("v").cast("long")), "vectors")
    blocks, tables = plan(reps.count())
    keyed = table(_keyed(reps, blocks, tables), "cells")
    crowd = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 and any")
    crowd = crowd.select("cell", F.ceil(F.col("n") / block).alias("nb"))
    met = keyed.join(crowd, "cell").withColumn("side", F.pmod(F.xxhash64("id", "k", F.lit("side")), F.col("nb")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    met = met.select("id", "k", "cell", "home", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    found = table(_links(met.join(reps, ["id", "k"]), limit, blocks, tables), "found")
    links = found.groupBy("id", "k").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "_c")
    known = same.join(links, ["id", "k"], "left").join(comp, F.col("id") == F.col("_c"), "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query
def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.9 * x.n * y.n),
r(id, c) AS (SELECT a, a FROM l UNION SELECT b, c FROM r JOIN l ON l.a = r.id WHERE c < b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(m.c, vec_id) AS component_id, coalesce(m.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN m ON m.id = vec_id
"""
