"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts are lower-cased (A-Z), their words joined by single spaces. The published CGK random walk turns a
window of characters into a longer sequence: at step j it writes the byte it stands on and moves on if a
random bit of (j, byte) says so, so that windows at a small edit distance become sequences at a small
Hamming distance. WALKS walks of SPAN steps start at every word of a document, and at every word of an
item (at about STARTS of them where it has more). A key samples TAKEN of WIDE steps in a row; a walk has
a key from every STRIDE-th step on, as far as the rest of the item reaches, so that an item is covered
by repeated samples over windows of its own size (SPAN steps, some 32 characters, at most; a longer item
by such windows at its words). One walk serves windows of all sizes, whatever sizes the items have.
Items under SHORT bytes have, besides, a key for every PIECE words in a row as they are.

The items' keys fill a Bloom filter of bounded size, those of items over LONG bytes another one. A task
walks its documents; where a key is in a filter it returns the surrounding passage once, and the keys.
Keys then meet the items' keys in a join, which tells the item and where in the passage it would start.
There PROBE bytes of the item around the key must be within NEAR percent of edits, which spares most
chance meetings more, and then the item is aligned with the passage: the edit distance in characters,
ends of the passage free, must be at most PERCENT of the item's characters.

Recall, measured against the edit distance of all pairs, 92 to 100 items cut from benchmark texts for
each case, edits at random places, of the copies that stay within PERCENT: with 10 % of the characters
replaced, deleted or inserted 0.95, 0.91 and 0.93 for items of 8 words and 1.00 for those of 14, 20 and 40;
with 15 % replaced 0.74 (8 words), 0.94 (14), 0.98 (20) and 1.00 (40); with 5 % replaced, 10 % of the words
replaced or inserted or 15 % deleted 1.00 at every size. Exact copies of items of 24 bytes or more are all
found, and of shorter ones. Open: edited copies of items of under 24 bytes without PIECE words in a row as they are.

Cases: null and empty texts match nothing, as do items without words; items of equal words are one, by
the smallest id; rows that share a key are searched each and reported once (or once for each value that
is carried along); null keys are reported as null; an item of one short word marks all documents that
hold its letters where it meets a whole word; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hash, _store, _text

SPAN, STRIDE, WALKS, WIDE, TAKEN = 64, 4, 3, 40, 18
STARTS = 20
SHORT, PIECE, LONG = 64, 3, 1024
PERCENT = 20
PROBE, NEAR = 64, 42
CHUNK = 1 << 13
_RNG = np.random.Generator(np.random.PCG64(4111))
# of a byte at a step: its worth in keys, whose last bit tells whether the walk moves on; it stays on the byte 0 after its text
_WORTH = _RNG.integers(0, 2**63, (WALKS, SPAN, 256), dtype=np.uint64)
_WORTH[:, :, 0] &= ~np.uint64(1)
_FIRST = range(0, SPAN - WIDE + 1, STRIDE)
_PICKS = [[np.sort(a + _RNG.choice(WIDE, TAKEN, replace=False)) for a in _FIRST] for _ in range(WALKS)]
_USES = [[[g for g, p in enumerate(_PICKS[r]) if j in p] for j in range(SPAN)] for r in range(WALKS)]
_TAG = _RNG.integers(0, 2**63, WALKS * len(_FIRST), dtype=np.uint64)
_LAST = np.array([p[-1] for r in range(WALKS) for p in _PICKS[r]])
_HIT = pa.struct([("k", pa.int64()), ("at", pa.int64())])


def plain(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words with a space after each (after a text's last one, the byte 0), their starts, and their row offsets."""
    data, offs = _text.buffers(col)
    starts, ends, rows = _text.spans(data, offs)
    sizes = ends - starts
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(place[-1] + 1, 32, np.uint8)
    out[-1] = 0
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    low = data[at + np.repeat(starts, sizes)]
    low[(low >= 65) & (low <= 90)] += 32
    out[at + np.repeat(place[:-1], sizes)] = low
    out[place[rows[1:][rows[1:] > rows[:-1]]] - 1] = 0
    return out, place[:-1], rows


def keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(keys, positions): keys of the walks over `text` that start at `at`, each the sum of its samples' random worths."""
    out = np.repeat(_TAG[:, None], len(at), 1)
    for r in range(WALKS):
        i, acc = at.copy(), out[r * len(_FIRST) : (r + 1) * len(_FIRST)]
        for j in range(SPAN):
            worth = _WORTH[r, j].take(text.take(i))
            for g in _USES[r][j]:
                acc[g] ^= worth
            worth &= np.uint64(1)
            i += worth.view(np.int64)
    return out


def pieces(text: np.ndarray, starts: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of `size` words in a row as they are, and the words at which they start."""
    row = _text.rows_of(rows)
    at = np.flatnonzero(row[size - 1 :] == row[: max(0, len(row) - size + 1)])
    ends = np.append(starts[1:], len(text) - 1) - 1
    return _text.mix(_text._span_hashes(text, starts[at], ends[at + size - 1]) + np.uint64(1000 + size)), at


def items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words, n, w): the distinct items that have words, by their smallest id, their bytes and words."""

    def run(batches):
        for rb in _text.slices(batches, "t"):
            w = [b" ".join(t.encode().lower().split()).decode() for t in rb.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("item"), pa.array(w, pa.string())], names=["item", "words"])

    read = benchmark.select(F.col(key).cast("long").alias("item"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, "item long, words string")
    found = read.filter("words <> ''").groupBy("words").agg(F.min("item").alias("item"))
    return found.withColumn("n", F.octet_length("words")).withColumn("w", F.size(F.split("words", " ")))


def item_keys(found: DataFrame) -> DataFrame:
    """(k, item, at, long): keys of the items and the byte at which their windows start."""

    def run(batches):
        for rb in _text.slices(batches, "words", 1 << 18):
            text, starts, rows = plain(rb.column("words"))
            for i, item in enumerate(rb.column("item").to_pylist()):
                mine = starts[rows[i] : rows[i + 1]]
                first, n = mine[0], rb.column("n")[i].as_py()
                at = mine[np.unique(np.linspace(0, len(mine) - 1, min(len(mine), STARTS)).round().astype(int))]
                q, where = np.nonzero(_LAST[:, None] <= 1.7 * (n - (at - first))[None, :] + 4)
                k, place = keys(text, at)[q, where], at[where]
                if n < SHORT:
                    part = slice(first, first + n + 2)
                    more, word = pieces(text[part], mine - first, np.array([0, len(mine)]), min(PIECE, len(mine)))
                    k, place = np.concatenate([k, more]), np.concatenate([place, mine[word]])
                m = len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(m, item, np.int64)), pa.array(place - first), pa.array(np.full(m, n > LONG))], names=["k", "item", "at", "long"])

    return _store.table(found.select("item", "words", "n").mapInArrow(run, "k long, item long, at long, long boolean").distinct(), "item-keys")


def passages(docs: DataFrame, sizes: list[int], filters: list[tuple], key: str, text: str, carry: str | None = None) -> DataFrame:
    """(region, doc_id, x, words, hits): passages around windows whose keys are in a filter.

    `filters` are (filter, bytes of its longest item); hits are (k, at), `at` the window's start counted
    from the passage's.
    """
    schema = "region long, doc_id long, x long, words binary, hits array<struct<k:long,at:long>>"

    def run(batches):
        from pyspark import TaskContext

        _hash.only("decontaminate")
        region = TaskContext.get().partitionId() << 33
        for rb in _text.slices(batches, "t"):
            words, starts, rows = plain(rb.column("t"))
            pos, ks, reach = [], [], []

            def look(at, k):
                flat = k.reshape(-1)
                for have, longest in filters:
                    hit = have.value.find(flat)
                    pos.append(at[hit % len(at)])
                    ks.append(flat[hit])
                    reach.append(np.full(len(hit), longest + longest // 4 + 16))

            for lo in range(0, len(starts), CHUNK):
                at = starts[lo : lo + CHUNK]
                look(at, keys(words, at))
            for size in sizes:
                k, at = pieces(words, starts, rows, size)
                if len(at):
                    look(starts[at], k)
            if not any(map(len, pos)):
                continue
            pos, ks, reach = map(np.concatenate, (pos, ks, reach))
            bounds = np.append(starts, len(words) - 1)[rows]  # where each text begins; a text ends a byte before the next
            doc = np.searchsorted(bounds, pos, "right") - 1
            lo, hi = np.maximum(bounds[doc], pos - reach), np.minimum(bounds[doc + 1] - 1, pos + reach)
            order = np.lexsort((pos, lo))
            pos, ks, doc, lo, hi = (x[order] for x in (pos, ks, doc, lo, hi))
            cut = np.flatnonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]]))
            ends = np.maximum.reduceat(hi, cut)
            m, counts = len(cut), np.diff(np.append(cut, len(pos)))
            hits = pa.ListArray.from_arrays(np.append(cut, len(pos)).astype(np.int32), pa.StructArray.from_arrays([pa.array(ks.view(np.int64)), pa.array(pos - np.repeat(lo[cut], counts))], fields=list(_HIT)))
            texts = pa.array([words[a:b].tobytes() for a, b in zip(lo[cut], ends, strict=True)], pa.binary())
            own = pa.array(doc[cut])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(region, region + m)), rb.column("doc_id").take(own), rb.column("x").take(own), texts, hits], names=["region", "doc_id", "x", "words", "hits"])
            region += m

    ready = docs.select(F.col(key).cast("long").alias("doc_id"), (F.col(carry) if carry else F.lit(0)).cast("long").alias("x"), F.coalesce(text, F.lit("")).alias("t"))
    return _store.table(ready.mapInArrow(run, schema), "passages")


def distance(item: str, passage: str, most: int) -> int:
    """The least edit distance between the item and any part of the passage; most+1 if it is larger.

    Myers' bit-vector algorithm: a column of the table of distances is two integers, whose bits tell where
    it rises and falls by one.
    """
    if item in passage:
        return 0
    m = len(item)
    full, top, where = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    rises, falls, now = full, 0, m
    best = now
    for c in passage:
        same = where.get(c, 0)
        level = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (full & ~(across | rises)), rises & across
        now += bool(up & top) - bool(down & top)
        best = min(best, now)
        up, down = up << 1 & full, down << 1 & full
        rises, falls = down | (full & ~(level | up)), up & level
    return min(best, most + 1)


def likely(pieces: list[bytes], passages: list[bytes]) -> np.ndarray:
    """Whether each piece of an item, PROBE bytes at most, is within NEAR percent of edits of a part of its passage.

    The same algorithm as in `distance`, for all pairs at once, a pair's column in two 64-bit words.
    """
    sizes = np.array([len(x) for x in pieces])
    width = max(map(len, passages))
    x = np.frombuffer(b"".join(p.ljust(PROBE, b"\xff") for p in pieces), np.uint8).reshape(-1, PROBE)
    y = np.frombuffer(b"".join(p.ljust(width, b"\xfe") for p in passages), np.uint8).reshape(-1, width)
    one, top = np.uint64(1), np.uint64(1) << (sizes - 1).astype(np.uint64)
    rises, falls = np.full(len(x), 2**64 - 1, np.uint64), np.zeros(len(x), np.uint64)
    now = sizes.copy()
    best = now.copy()
    for t in range(width):
        same = np.packbits(x == y[:, t : t + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        level = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up, down = falls | ~(across | rises), rises & across
        now += (up & top) != 0
        now -= (down & top) != 0
        np.minimum(best, now, out=best)
        up, down = up << one, down << one
        rises, falls = down | ~(level | up), up & level
    return 100 * best <= NEAR * sizes


def matches(found: DataFrame, known: DataFrame, where: DataFrame) -> DataFrame:
    """(doc_id, x, item_id, distance) of the passages that hold an item."""
    hits = where.select("region", F.explode("hits").alias("hit")).select("region", F.col("hit.k").alias("k"), F.col("hit.at").alias("p"))
    starts = hits.join(known.select("k", "item", "at"), "k").select("region", "item", (F.col("p") - F.col("at")).alias("start"), "at").distinct()
    starts = starts.groupBy("region", "item").agg(F.sort_array(F.collect_list(F.struct("start", "at"))).alias("starts"))
    texts = found.select("item", F.col("words").alias("item_words"))
    pairs = starts.join(texts, "item").join(where.select("region", "doc_id", "x", "words"), "region")

    def run(batches):
        for rb in _text.slices(batches, "words", 1 << 21):
            rows = list(zip(*(rb.column(c).to_pylist() for c in ("doc_id", "x", "item", "item_words", "words", "starts")), strict=True))
            tries, pieces_, parts = [], [], []
            for i, (*_, words, passage, begin) in enumerate(rows):
                item = words.encode()
                slack, last = 8 + len(item) // 4, None
                for b in begin:
                    s, at = b["start"], b["at"]
                    if last is not None and s - last <= slack // 2:
                        continue
                    last, lo = s, max(0, min(at - PROBE // 8, len(item) - PROBE))
                    tries.append((i, s, slack))
                    pieces_.append(item[lo : lo + PROBE])
                    parts.append(passage[max(0, s + lo - PROBE // 3) : max(0, s + lo + PROBE + PROBE // 3)] or b" ")
            best: dict[int, int] = {}
            for at in range(0, len(tries), 4096):
                ok = likely(pieces_[at : at + 4096], parts[at : at + 4096])
                for i, s, slack in (tries[at + j] for j in np.flatnonzero(ok)):
                    words, passage = rows[i][3], rows[i][4]
                    most = len(words) * PERCENT // 100
                    if best.get(i, most + 1):
                        d = distance(words, passage[max(0, s - slack) : max(0, s + len(words.encode()) + 2 * slack)].decode("utf-8", "ignore"), most)
                        if d <= most:
                            best[i] = min(d, best.get(i, d))
            if best:
                out = [(*rows[i][:3], d) for i, d in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "x", "item_id", "distance"])

    held = pairs.select("doc_id", "x", "item", "item_words", "words", "starts").mapInArrow(run, "doc_id long, x long, item_id long, distance long")
    return held.groupBy("doc_id", "x", "item_id").agg(F.min("distance").alias("distance"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, item_id, distance) for every document and benchmark item that it holds; a long column may be carried along as x."""
    spark = docs.sparkSession
    found = _store.table(items(benchmark, item_key, item_text), "items")
    known = item_keys(found)
    usual = F.col("n") <= LONG
    sizes, longest, beyond = found.agg(F.collect_set(F.when(F.col("n") < SHORT, F.least("w", F.lit(PIECE)))), F.max(F.when(usual, F.col("n"))), F.max(F.when(~usual, F.col("n")))).first()
    filters = [(spark.sparkContext.broadcast(_hash.Bloom(known.filter(test), "k")), most) for test, most in (("not long", longest), ("long", beyond)) if most]
    out = "doc_id", *["x"] * bool(carry), "item_id", "distance"
    if not filters:
        return spark.createDataFrame([], "doc_id long, x long, item_id long, distance long").select(*out)
    return matches(found, known, passages(docs, sorted(sizes), filters, key, text, carry)).select(*out)


@_store.query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_store.read(spark, sf_dir, "documents"), _store.read(spark, sf_dir, "benchmark"))
