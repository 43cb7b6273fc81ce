"""MinHash near-duplicates with odd sketches.

1. Every text's set of word shingles gives a digest of the whole set, ROWS * BANDS MinHash samples, a
   band key for every ROWS samples, and an odd sketch: each sample (index, value) flips one of SKETCH
   bits, so that the number of ones in the XOR of two sketches estimates how many samples differ.
2. Texts with equal sets form one class, found by grouping the digests; its smallest key stands for it.
3. In each bucket of a band the smallest member is paired with the others. Pairs whose sizes or XOR
   counts cannot belong to similar sets go; the rest are verified on the full sets and linked. Only the
   texts in such pairs, told by a filter of bounded size, leave the scan.
4. Buckets that still hold several components are searched through: every member outside the largest
   component meets all members of other components, with the same two tests inside the join, on sketches
   of WIDE samples made for these members. So no link between two components is left out, and
   members of one component never meet.
5. Linked components take the smallest key.

ROWS = 5 and BANDS = 32 miss a pair of similarity 0.8 with probability 3e-6; the limits of both
sketches lie over four standard errors below the same similarity. Emitted rows follow the number of texts, buckets and
links, not the square of a group; a very common passage makes buckets of texts that are not similar,
whose pairs step 4 compares inside the join without emitting them.

Cases: null and empty texts have an empty set, link with nothing and are their own component; texts of
fewer words than a shingle have one shingle, the whole sequence; rows that share a key are one node, which
is linked with whatever one of their texts is similar to; a row with a null key links with nothing, has no component and is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hash, _text
from ._graph import components
from ._store import query, read, table

ROWS, BANDS, SKETCH = 5, 32, 512
WIDE, WIDE_SKETCH = 1024, 4096
PERCENT = 80
MARGIN, WIDE_MARGIN = 0.18, 0.065
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_C = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_WA = _RNG.integers(0, 2**32, WIDE, dtype=np.uint32) | np.uint32(1)
_WB = _RNG.integers(0, 2**32, WIDE, dtype=np.uint32)
_WC = _RNG.integers(0, 2**63, WIDE, dtype=np.uint64)
_D = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_E = _RNG.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
PIECE = 2048


def most_ones(percent: int, samples: int, bits: int, margin: float) -> int:
    """Ones in the XOR of two sketches beyond which a pair is taken as not similar."""
    differ = 2 * samples * (1 - (percent / 100 - margin))
    return math.ceil(bits / 2 * (1 - math.exp(-2 * differ / bits)))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, from its words' hashes."""
    if not len(h):
        return h
    if len(h) < size:
        out = np.zeros(1, np.uint64)
        for i in range(len(h)):
            out += h[i : i + 1] * _E[i : i + 1]
        return _text.mix(out + np.uint64(len(h)))
    n = len(h) - size + 1
    out = h[:n] * _E[0]
    for i in range(1, size):
        out += h[i : i + n] * _E[i]
    return np.unique(_text.mix(out))


def _samples(s: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """MinHash samples of a set: its least value under each of the permutations a * x + b."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(low), PIECE):
        np.minimum(best, (a[:, None] * low[None, at : at + PIECE] + b[:, None]).min(1), out=best)
    return best


def _sketches(best: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketches of rows of samples, as 64-bit integers: a bit is set if an odd number of samples fall on it."""
    m = len(best)
    bit = (_text.mix(best.astype(np.uint64) + c) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((np.arange(m)[:, None] * bits + bit).ravel(), minlength=m * bits).reshape(m, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)


def _lists(x: np.ndarray) -> pa.ListArray:
    m, w = x.shape
    return pa.ListArray.from_arrays(np.arange(0, (m + 1) * w, w, dtype=np.int32), pa.array(x.reshape(-1)))


def describe(docs: DataFrame, size: int, key: str, text: str, carry: str | None = None) -> DataFrame:
    """(doc_id, x, n, d1, d2, bands, sketch) of every row; d1 and d2 are the digest of the set, x what is carried."""
    schema = "doc_id long, x long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"

    def run(batches):
        _hash.only("near-dups")
        for rb in _text.slices(batches, "text"):
            h, offs, *_ = _text.words(rb.column("text"))
            m = rb.num_rows
            n, digest = np.zeros(m, np.int64), np.zeros((m, 2), np.uint64)
            best = np.zeros((m, ROWS * BANDS), np.uint32)
            for i in range(m):
                s = shingles(h[offs[i] : offs[i + 1]], size)
                n[i] = len(s)
                if len(s):
                    best[i] = _samples(s)
                    digest[i] = np.add.reduce(s), np.add.reduce(_text.mix(s * np.uint64(0xA24BAED4963EE407)))
            wide = best.reshape(m, BANDS, ROWS).astype(np.uint64)
            bands = _text.mix((wide * _D).sum(2, dtype=np.uint64) + _C[:BANDS])
            lists = [_lists(bands.view(np.int64)), _lists(_sketches(best, _C, SKETCH))]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("x"), pa.array(n), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), *lists], names=["doc_id", "x", "n", "d1", "d2", "bands", "sketch"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), (F.col(carry) if carry else F.lit(0)).cast("long").alias("x"), F.col(text).alias("text")).mapInArrow(run, schema)


def _plausible(percent: int, samples: int, bits: int, margin: float) -> Column:
    """Of rows with na, nb, sa, sb: sizes and sketches may belong to sets of the similarity.

    The ones are summed in a loop: written out, a term a word, the join's method outgrows the 8,000 bytes that the JVM compiles at most and stays interpreted.
    """
    ones = F.aggregate(F.zip_with("sa", "sb", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (ones <= most_ones(percent, samples, bits, margin))


def _wide(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, wide) of texts: the set's size and an odd sketch of WIDE samples."""

    def run(batches):
        for rb in _text.slices(batches, "text", 1 << 19):
            h, offs, *_ = _text.words(rb.column("text"))
            sets = [shingles(h[offs[i] : offs[i + 1]], size) for i in range(rb.num_rows)]
            best = np.stack([_samples(s, _WA, _WB) for s in sets])
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array([len(s) for s in sets], pa.int64()), _lists(_sketches(best, _WC, WIDE_SKETCH))], names=["id", "n", "wide"])

    return texts.mapInArrow(run, "id long, n long, wide array<long>")


def _texts(docs: DataFrame, ends: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the documents in `ends` (id), and a few others that pass the filter of their keys.

    The filter, of bounded size, goes to the tasks that scan; only what passes is exchanged.
    """
    have = docs.sparkSession.sparkContext.broadcast(_hash.Bloom(ends, "id"))

    def run(batches):
        for rb in batches:
            hit = have.value.has(rb.column("id").to_numpy().view(np.uint64))
            if hit.any():
                yield rb.filter(pa.array(hit))

    found = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return table(found.mapInArrow(run, found.schema).dropDuplicates(["id", "text"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity: 100 * |both| >= percent * |either|."""

    def run(batches):
        held, name = None, None
        for rb in _text.slices(_text.slices(batches, "tb"), "ta"):
            keep = np.zeros(rb.num_rows, bool)
            hb, ob, *_ = _text.words(rb.column("tb"))
            for i, (t, n) in enumerate(zip(rb.column("ta"), rb.column("a").to_pylist(), strict=True)):
                if name != (n, t):
                    name, held = (n, t), shingles(_text.words(pa.array([t.as_py()]))[0], size)
                y = shingles(hb[ob[i] : ob[i + 1]], size)
                if len(held) and len(y):
                    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, held), len(y) - 1)] == held))
                    keep[i] = 100 * both >= percent * (len(held) + len(y) - both)
            yield rb.select(["a", "b"]).filter(pa.array(keep))

    ta, tb = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta")), texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    both = pairs.join(tb, F.col("b") == F.col("ib")).join(ta, F.col("a") == F.col("ia"))
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _mixed(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, id, c, main) of buckets that hold several components c; main is the largest of them."""
    placed = crowded.join(found.withColumnRenamed("id", "_c"), F.col("id") == F.col("_c"), "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("k"), "c"))["c"].alias("main")).filter("n > 1")
    return placed.join(main.select("bucket", "main"), "bucket")


def _cross(mixed: DataFrame, wide: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of all members outside their bucket's main component with all members of other components.

    A pair that meets in several buckets is made in the first of them alone.
    """
    rows = mixed.join(wide.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).join(classes.select(F.col("id").alias("_j"), "bands"), F.col("id") == F.col("_j"))
    x = rows.filter("c <> main").select("bucket", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("wide").alias("sa"), F.col("bands").alias("ba"))
    y = rows.select(F.col("bucket").alias("other"), F.col("id").alias("b"), F.col("c").alias("cb"), "main", F.col("n").alias("nb"), F.col("wide").alias("sb"), F.col("bands").alias("bb"))
    first = F.col("bucket") == F.element_at(F.array_intersect("ba", "bb"), 1)
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))
    near = _plausible(percent, WIDE, WIDE_SKETCH, WIDE_MARGIN)
    pairs = x.join(y, (F.col("bucket") == F.col("other")) & (F.col("ca") != F.col("cb")) & once & near & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(docs: DataFrame, size: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; a long column may be carried along as x."""
    rows = table(describe(docs, size, key, text, carry), "signatures")
    live = rows.filter("n > 0 and doc_id is not null")
    classes = live.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = table(classes, "classes")  # rows of equal sets have equal sketches and bands
    small = classes.select("id", "n", "sketch")
    member = classes.select("id", F.explode("bands").alias("bucket"))

    lead = member.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last").select("bucket", "lead")
    crowded = table(member.join(lead, "bucket"), "crowded")
    stars = crowded.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    one = small.select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = small.select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    likely = stars.join(two, F.col("b") == F.col("ib")).join(one, F.col("a") == F.col("ia"))
    likely = table(likely.filter(_plausible(percent, ROWS * BANDS, SKETCH, MARGIN)).select("a", "b").distinct(), "pairs")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = table(verified(likely, _texts(docs, ends(likely), key, text), size, percent), "links")

    found = table(components(links), "components")
    mixed = table(_mixed(crowded, found), "mixed")
    if not mixed.isEmpty():
        texts = _texts(docs, mixed.select("id").distinct(), key, text)
        wide = table(_wide(texts, size), "wide")
        pairs = _cross(mixed, wide, classes, percent)
        pairs = table(pairs.join(likely.withColumnsRenamed({"a": "_a", "b": "_b"}), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), "pairs")
        more = table(verified(pairs, texts, size, percent), "links")
        if not more.isEmpty():
            found = table(components(more.unionByName(found.select(F.col("component").alias("a"), F.col("id").alias("b")))), "components")

    comp = classes.select("d1", "d2", F.col("n").alias("_n"), "id").join(found.withColumnRenamed("id", "_c"), F.col("id") == F.col("_c"), "left")
    comp = comp.select("d1", "d2", "_n", F.coalesce("component", "id").alias("_component"))
    out = rows.select("doc_id", "x", "n", "d1", "d2").join(comp.withColumnsRenamed({"d1": "_1", "d2": "_2"}), (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & (F.col("n") == F.col("_n")) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", *["x"] * bool(carry), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("_component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query
def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"), size=4)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1 : i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT a, a FROM e UNION SELECT b, c FROM r JOIN e ON e.a = r.id WHERE c < b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
