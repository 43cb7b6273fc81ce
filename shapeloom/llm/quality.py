"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Training: documents labelled good and not toxic are split by a hash of their key; two thirds train
the trigram model, with their whole texts, and the last third calibrates it. Counting is distributed:
trigram counts, then for each lower order the number of different words before a gram, Kneser and Ney's
continuation counts (plain counts for pairs at a text's beginning, before which no word can stand); three discounts an order come from its counts of counts, and the mass that they
free at a context is its interpolation weight. Trigrams meet in the shard of their first two words, so that a
context's are together, and pairs in the shard of their own hash; a shard has about SHARD_CHARS characters'
grams whatever the size of the text, and no table is held by a task but its shard's. Shards go in PARTS parts, and each
step removes a part of what it reads before it turns to the next, so that the steps' tables are never all on disk twice.

Scoring: a task asks the shards for the different grams of a batch of documents, packed into one row a shard;
each shard answers with their shares and weights, and the answers meet the batch again, which gives the
documents' perplexities. That goes in ROUNDS rounds of documents, which bounds what is on disk at a time.

Thresholds: every scored document of the calibrating third counts into a histogram (bins of BIN in
log10) for its language. One rule holds for all sizes: a language's threshold is its own median plus
1 + SLACK times a width, which is the distance of its own QUANTILE from the median or, if that is larger,
the mean of this distance (weight: the language's n documents) and of that of all languages'
distances from their own medians (weight: PRIOR documents), times 1 + 1/sqrt(n). So a language of few
documents is judged around its own median and more widely, and one of many by its own quantile. A
document is kept if its log10 perplexity is at most the threshold. All documents are scored.

Cases: documents without words are rejected; null languages are a language of their own; documents of
a language without calibrating documents have a null threshold and are kept if they have words; rows
that repeat are scored alike; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _hash, _store, _text

TRAIN_DOCS, TRAIN_CHARS = 4000, 6_000_000
LEAST_SHARDS, PARTS, SHARD_CHARS, SLICE, ROUNDS = 4, 4, 1 << 22, 1 << 23, 6
BIN, QUANTILE, SLACK, PRIOR = 0.002, 0.99, 0.5, 30
_ROLE = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xD6E8FEB86659FD93)]
_BEGIN, _END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38495AB5A3C1F0E7)
NULL = "\x00null"


def _gram(*h: np.ndarray) -> np.ndarray:
    out = h[0] * _ROLE[0]
    for i in range(1, len(h)):
        out = out + h[i] * _ROLE[i]
    return _text.mix(out + np.uint64(len(h)))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with the first index of each number and every number's place, by one sort of numbers.

    A number's low bits make room for its index, so that nothing is sorted but plain numbers, which is several
    times as fast as sorting indices. Where that takes two numbers for one, np.unique decides.
    """
    low = np.uint64((1 << max(1, len(h).bit_length())) - 1)
    both = h & ~low
    both |= np.arange(len(h), dtype=np.uint64)
    both.sort()
    order = (both & low).view(np.int64)
    both &= ~low
    mine = h.take(order)
    new = np.ones(len(h), bool)
    np.not_equal(mine[1:], mine[:-1], out=new[1:])
    if np.any(new[1:] & (both[1:] == both[:-1])):
        return np.unique(h, return_index=True, return_inverse=True)
    place = np.cumsum(new, dtype=np.int32 if len(h) < 1 << 31 else np.int64)
    place -= 1
    of = np.empty_like(place)
    of[order] = place
    return mine[new], order[new], of


def _sequences(col: pa.Array) -> tuple[np.ndarray, ...]:
    """u, v, w of every token, the end of each text included, and the tokens' row offsets."""
    h, offs, *_ = _text.words(col)
    m = len(offs) - 1
    ends = offs[1:] + np.arange(1, m + 1)
    out = np.full(len(h) + m, _END, np.uint64)
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = h
    starts = np.concatenate([[0], ends[:-1]])
    v, u = np.empty_like(out), np.empty_like(out)
    v[1:], u[2:] = out[:-1], out[:-2]
    v[starts] = u[starts] = _BEGIN
    second = starts[ends - starts > 1] + 1
    u[second] = _BEGIN
    return u, v, out, np.concatenate([starts, [len(out)]])


def _split(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_h", F.xxhash64(F.lit("trusted"), key))


def sample(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """A bounded sample of the training texts, for trials; no query and no stage uses it. Of rows that share a key, the one whose text has the smallest hash."""
    ids = _split(trusted, key).filter("pmod(_h, 3) <> 0").orderBy("_h", key).limit(TRAIN_DOCS)
    found = docs.select(key, F.substring(F.coalesce(text, F.lit("")), 1, TRAIN_CHARS // 100).alias("_t"), F.xxhash64(text).alias("_x")).join(F.broadcast(ids), key)  # TRAIN_DOCS ids at most
    found = _store.table(found.groupBy("_h", key).agg(F.min_by("_t", "_x").alias("_t")), "trusted")
    run = found.select(F.col("_h").alias("_i"), F.col(key).alias("_k"), F.length("_t").cast("long").alias("_n")).withColumn("_sum", F.sum("_n").over(Window.orderBy("_i", "_k")))  # numbers alone
    fits = run.filter(F.col("_sum") <= TRAIN_CHARS).select("_i", "_k")
    return found.join(F.broadcast(fits), (F.col("_h") == F.col("_i")) & (F.col(key) == F.col("_k"))).select("_t")


def trusted_texts(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """The whole texts of all trusted documents that train; of rows that share a key, the one whose text has the smallest hash.

    A filter of bounded size keeps most other texts out of the exchange; the join decides.
    """
    ids = _split(trusted, key).filter("pmod(_h, 3) <> 0").select(F.col(key).cast("long").alias("_k")).filter("_k is not null")
    maybe = _hash.Bloom(ids, "_k")

    def run(batches):
        for rb in batches:
            k = pc.fill_null(rb.column("_k"), 0).to_numpy(zero_copy_only=False).view(np.uint64)
            hit = maybe.find(k)
            if len(hit):
                yield rb.take(pa.array(hit))

    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(text, F.lit("")).alias("_t")).mapInArrow(run, "_k long, _t string")
    return rows.join(ids, "_k").groupBy("_k").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t")).select("_t")


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, which packs better."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack(n: np.ndarray, *words: np.ndarray) -> bytes:
    """Grams with their counts: the different words once, then the words' places among them in ascending order."""
    known, _, of = _distinct(np.concatenate(words))
    of = of.astype("<u4").reshape(len(words), -1)
    bits = len(known).bit_length()
    if bits * len(words) <= 64:  # one number a gram is sorted faster than its words
        one = of[0].astype(np.uint64)
        for x in of[1:]:
            one = one << np.uint64(bits) | x
        order = np.argsort(one, kind="stable")
    else:
        order = np.lexsort(of[::-1])
    of = of[:, order]
    of[0] = np.diff(of[0], prepend=np.uint32(0))
    head = np.asarray([len(known), len(n)], "<u8").tobytes()
    return head + zstandard.compress(b"".join([_planes(np.diff(known, prepend=np.uint64(0)).astype("<u8")), _planes(n[order].astype("<u8")), *map(_planes, of)]), 1)


def _unpack(blobs: pa.ChunkedArray, n: int) -> list[np.ndarray]:
    """The counts and the n words of the grams of all blobs."""
    out: list[list[np.ndarray]] = [[] for _ in range(n + 1)]
    for x in blobs:
        raw = x.as_buffer()
        types, rows = np.frombuffer(raw[:16], "<u8").tolist()
        raw, at = zstandard.decompress(raw[16:]), 8 * (types + rows)
        known = np.cumsum(_numbers(raw[: 8 * types], "<u8"), dtype=np.uint64)
        out[0].append(_numbers(raw[8 * types : at], "<u8"))
        for i in range(n):
            of = _numbers(raw[at + 4 * rows * i : at + 4 * rows * (i + 1)], "<u4")
            out[i + 1].append(known[np.cumsum(of) if i == 0 else of])
    return [np.concatenate(x) for x in out]


def _pieces(of: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that deals elements into shards, and the shards' S+1 offsets in it."""
    order = np.argsort(of.astype(np.uint16) if shards <= 1 << 16 else of, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=shards))])


def _of_counts(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == i)) for i in (1, 2, 3, 4)]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return [max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)


def train(texts: DataFrame, folder: str, spent: str | None = None) -> tuple[str, float]:
    """Write the shards of (k, share, weight); returns their folder and the share of an unknown word. `spent` is removed once the texts are counted."""
    spark = texts.sparkSession
    chars = texts.agg(F.sum(F.length("_t").cast("long"))).first()[0] or 0
    shards = int(max(LEAST_SHARDS, -(-chars // SHARD_CHARS)))
    counted, counts, found, at2, at1, at_ctx = (_store.shared(spark, x) for x in ("counted", "counts", "grams", "pairs", "words", "contexts"))

    def grams(batches):
        _hash.only("quality")
        for rb in _text.slices(batches, "_t", SLICE):
            u, v, w, _ = _sequences(rb.column("_t"))
            _, at, of = _distinct(_gram(u, v, w))
            n = np.bincount(of, minlength=len(at))
            u, v, w = u[at], v[at], w[at]
            order, ends = _pieces(_shard(_gram(u, v), shards), shards)
            for s in np.flatnonzero(np.diff(ends)).tolist():
                i = order[ends[s] : ends[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_pack(n[i], u[i], v[i], w[i])]), pa.array([s % PARTS], pa.int32())], names=["shard", "data", "part"])

    def three(table: pa.Table) -> pa.Table:
        """All trigrams of a shard's contexts: written to a file of the shard, whose pairs go on to their own shards.

        The file has the trigrams with their n and their context's total, then the contexts (n = 0) with their totals and
        the numbers of their trigrams found once, twice and more often; keys of either ascend.
        """
        import pyarrow.parquet as pq

        _hash.only("quality")
        s = table["shard"][0].as_py()
        n, u, v, w = _unpack(table["data"], 3)
        keys, at, of = _distinct(_gram(u, v, w))
        n = np.bincount(of, n.astype(np.float64), len(keys)).astype(np.int64)
        u, v, w = u[at], v[at], w[at]
        fs, root = _store.files(counts)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.parquet"
        ctx, _, of = _distinct(_gram(u, v))
        all_, zero = np.bincount(of, n.astype(np.float64), len(ctx)).astype(np.int64), np.zeros(len(keys), np.int64)
        held = {"k": np.concatenate([keys, ctx]).view(np.int64), "n": np.concatenate([n, np.zeros(len(ctx), np.int64)]), "total": np.concatenate([all_[of], all_])}
        for name, times in (("n1", n == 1), ("n2", n == 2), ("n3", n > 2)):
            held[name] = np.concatenate([zero, np.bincount(of[times], minlength=len(ctx))])
        pq.write_table(pa.table(held), path, filesystem=fs, compression="zstd", use_dictionary=[x for x in held if x != "k"], column_encoding={"k": "DELTA_BINARY_PACKED"})
        rows = [(s, path.encode(), _of_counts(n), 0, s % PARTS)]
        pair, at, of = _distinct(_gram(v, w))
        n2 = np.bincount(of, np.where(v == _BEGIN, n, 1).astype(np.float64), len(pair)).astype(np.int64)
        v, w = v[at], w[at]
        order, ends = _pieces(_shard(pair, shards), shards)
        for t in np.flatnonzero(np.diff(ends)).tolist():
            i = order[ends[t] : ends[t + 1]]
            rows.append((t, _pack(n2[i], v[i], w[i]), None, 1, t % PARTS))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32()), strict=True)], names=["shard", "data", "stats", "kind", "part"])

    def two(table: pa.Table) -> pa.Table:
        _hash.only("quality")
        n, v, w = _unpack(table["data"], 2)
        keys, at, of = _distinct(_gram(v, w))
        n = np.bincount(of, n.astype(np.float64), len(keys)).astype(np.int64)
        c, k1 = _gram(v[at]), _gram(w[at])
        order = np.argsort(c)
        return pa.table({"k": keys[order].view(np.int64), "c": c[order].view(np.int64), "k1": k1[order].view(np.int64), "n": n[order]})

    _write(texts.mapInArrow(grams, "shard int, data binary, part int"), counted, "part")
    _store.remove(spark, [spent] if spent else [])
    for part in range(PARTS):
        mine = spark.read.schema("shard int, data binary, part int").parquet(counted).filter(F.col("part") == part)
        _write(mine.select("shard", "data").groupBy("shard").applyInArrow(three, "shard int, data binary, stats array<long>, kind int, part int"), found, "kind", "part")
        _store.remove(spark, [f"{counted}/part={part}"])
    _store.remove(spark, [counted])
    found_rows = spark.read.schema("shard int, data binary, stats array<long>, kind int, part int").parquet(found)
    files = found_rows.filter("kind = 0").select("shard", "data", "stats").collect()  # a path and four numbers a shard
    paths = {r["shard"]: bytes(r["data"]).decode() for r in files}
    d3 = _discounts(*(sum(r["stats"][i] for r in files) for i in range(4)))
    for part in range(PARTS):
        mine = found_rows.filter((F.col("kind") == 1) & (F.col("part") == part)).select("shard", "data")
        _write(mine.groupBy("shard").applyInArrow(two, "k long, c long, k1 long, n long"), f"{at2}/part={part}")
        _store.remove(spark, [f"{found}/kind=1/part={part}"])
    _store.remove(spark, [found])
    t2 = spark.read.schema("k long, c long, k1 long, n long, part int").parquet(at2)
    many = [F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]
    d2 = _discounts(*(x or 0 for x in t2.agg(*many).first()))
    cut = lambda d: F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    _write(t2.groupBy("k1").agg(F.count("*").alias("n")), at1)
    t1 = spark.read.schema("k1 long, n long").parquet(at1)
    d1 = _discounts(*(x or 0 for x in t1.agg(*many).first()))
    total, lost, types = t1.agg(F.sum("n"), F.sum(cut(d1)), F.count("*")).first()
    unknown = float(lost / total / (types + 1)) if total else 1.0
    _write(t2.groupBy(F.col("c").alias("c_")).agg((F.sum(cut(d2)) / F.sum("n")).alias("weight"), F.sum("n").alias("total")), at_ctx)
    ctx = spark.read.schema("c_ long, weight double, total long").parquet(at_ctx)
    none = F.lit(None).cast("double")
    of = F.pmod(F.shiftrightunsigned("k", 33), F.lit(shards)).cast("int")
    rows = t1.select(F.col("k1").alias("k"), ((F.col("n") - cut(d1)) / F.lit(total or 1) + F.lit(unknown)).alias("share"), none.alias("weight"))
    rows = rows.unionByName(ctx.select(F.col("c_").alias("k"), none.alias("share"), "weight")).withColumn("shard", of)
    rows = rows.unionByName(spark.range(shards).select(F.lit(None).cast("long").alias("k"), none.alias("share"), none.alias("weight"), F.col("id").cast("int").alias("shard")))  # every shard is there

    def shard(table: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        _hash.only("quality")
        s = table["shard"][0].as_py()
        table = table.filter(table["k"].is_valid())
        k, share, weight = [table["k"].to_numpy()], [pc.fill_null(table["share"], 0).to_numpy()], [pc.fill_null(table["weight"], -1).to_numpy()]
        if s in paths:
            t = pq.read_table(paths[s], filesystem=_store.files(counts)[0])
            n, all_ = t["n"].to_numpy(), t["total"].to_numpy()
            less = np.asarray([0, *d3])[np.minimum(n, 3)]
            free = sum(d * t[x].to_numpy() for d, x in zip(d3, ("n1", "n2", "n3"), strict=True))
            k.append(t["k"].to_numpy())
            share.append(((n - less) / all_).astype(np.float32))
            weight.append(np.where(n > 0, -1, free / all_).astype(np.float32))
        keys, of = np.unique(np.concatenate([*k, [s]]), return_inverse=True)  # the shard's own number, which no gram has: no shard is empty
        out = [np.zeros(len(keys), np.float32), np.full(len(keys), -1, np.float32)]
        for o, x in zip(out, (share, weight), strict=True):
            np.maximum.at(o, of[:-1], np.concatenate(x))
        out[1][out[1] < 0] = 1
        return pa.table({"k": keys, "share": out[0], "weight": out[1], "shard": pa.array(np.full(len(keys), s, np.int32))})

    for part in range(PARTS):  # a part's counts and pairs go before the next one's shards are written
        pairs = t2.filter(F.col("part") == part).join(ctx, F.col("c") == F.col("c_")).select("k", ((F.col("n") - cut(d2)) / F.col("total")).alias("share"), none.alias("weight"), of.alias("shard"))
        mine = pairs.unionByName(rows.filter(F.col("shard") % PARTS == part)).select("shard", "k", F.col("share").cast("float"), F.col("weight").cast("float"))
        mine = mine.groupBy("shard").applyInArrow(shard, "k long, share float, weight float, shard int")
        mine.write.mode("append").option("compression", "zstd").option("parquet.writer.version", "v2").partitionBy("shard").parquet(folder)  # v2: ascending keys as differences
        _store.remove(spark, [f"{at2}/part={part}", *(f"{counts}/{paths[s].rpartition('/')[2]}" for s in paths if s % PARTS == part)])
    _store.remove(spark, [counts, at2, at1, at_ctx])
    return folder, unknown


class _Asked:
    """The different grams of a batch of texts, in an order that depends on the texts alone, dealt into shards.

    Words and pairs belong to the shard of their own hash, trigrams to that of their first two words.
    """

    def __init__(self, col: pa.Array, shards: int):
        u, v, w, self.offs = _sequences(col)
        k3, at, self.three = _distinct(_gram(u, v, w))
        u, v, w = u[at], v[at], w[at]
        ctx = _gram(u, v)
        k2, _, of = _distinct(np.concatenate([_gram(v, w), ctx]))
        self.pair, self.pair_ctx = of[: len(at)], of[len(at) :]
        k1, _, of = _distinct(np.concatenate([_gram(w), _gram(v)]))
        self.word, self.word_ctx = of[: len(at)], of[len(at) :]
        self.keys = (k1, k2, k3)
        self.dealt = [_pieces(_shard(h, shards), shards) for h in (k1, k2, ctx)]

    def of(self, s: int) -> list[np.ndarray]:
        return [order[ends[s] : ends[s + 1]] for order, ends in self.dealt]


def perplexities(docs: DataFrame, model: tuple[str, float], key: str, lang: str, text: str, carry: str | None = None) -> DataFrame:
    """(doc_id, lang, n_tokens, log_ppl) of every document; n_tokens counts words and one end. A long column may be carried along as x.

    Documents go in ROUNDS rounds by a hash of their key, so that one round's grams are on disk at a time.
    """
    folder, unknown = model
    spark = docs.sparkSession
    ready = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), (F.col(carry) if carry else F.lit(0)).cast("long").alias("x"), F.coalesce(text, F.lit("")).alias("_t"))
    shards = spark.read.parquet(folder).agg(F.max("shard")).first()[0] + 1
    out = None
    for r in range(ROUNDS):
        mine = _scored(ready.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == r), folder, unknown, shards)
        out = mine if out is None else out.unionByName(mine)
    return out


def _scored(ready: DataFrame, folder: str, unknown: float, shards: int) -> DataFrame:
    spark = ready.sparkSession
    state = _store.shared(spark, "batches")

    def ask(batches):
        from pyspark import TaskContext

        _hash.only("quality")
        fs, root = _store.files(state)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId() << 32  # a task that runs again has the same batches
        for i, rb in enumerate(_text.slices(batches, "_t", SLICE)):
            with fs.open_output_stream(f"{root}/{part + i}.arrow", compression=None) as f, pa.ipc.new_file(f, rb.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as to:
                to.write_batch(rb)
            asked = _Asked(rb.column("_t"), shards)
            for s in range(shards):
                keys = [k[o] for k, o in zip(asked.keys, asked.of(s), strict=True)]
                if sum(map(len, keys)):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part + i]), pa.array([[len(k) for k in keys]], pa.list_(pa.int32())), pa.array([_steps(keys)])], names=["shard", "batch", "n", "data"])

    def answer(table: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        _hash.only("quality")
        s = table["shard"][0].as_py()
        fs, path = _store.files(f"{folder}/shard={s}")
        t = pq.read_table(path, columns=["k", "share", "weight"], filesystem=fs)
        have = t["k"].to_numpy().view(np.uint64)
        order = np.roll(np.arange(len(have)), -int(np.count_nonzero(have >> np.uint64(63))))  # as written, by signed numbers
        if np.any(have[order[1:]] <= have[order[:-1]]):
            order = np.argsort(have)
        have, share, weight = have[order], t["share"].to_numpy()[order], t["weight"].to_numpy()[order]
        out = []
        for n, data in zip(table["n"].to_pylist(), table["data"], strict=True):
            ask = _unsteps(data.as_buffer(), n)
            at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
            hit = have[at] == ask
            m = n[0] + n[1]
            values = np.concatenate([np.where(hit, share[at], 0), np.where(hit[:m], weight[at[:m]], 1)])
            out.append(_values(values))
        return pa.table({"shard": table["shard"], "batch": table["batch"], "data": pa.array(out, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        _hash.only("quality")
        fs, root = _store.files(state)
        with fs.open_input_file(f"{root}/{table['batch'][0].as_py()}.arrow") as f:
            rb = pa.ipc.open_file(f).get_batch(0)
        asked = _Asked(rb.column("_t"), shards)
        share, weight = [np.zeros(len(k), np.float32) for k in asked.keys], [np.ones(len(k), np.float32) for k in asked.keys]
        for s, data in zip(table["shard"].to_pylist(), table["data"], strict=True):
            of = asked.of(s)
            got = np.split(_unvalues(data.as_buffer()), np.cumsum([len(o) for o in (*of, of[0])]))
            for i, o in enumerate(of):
                share[i][o] = got[i]
            weight[0][of[0]], weight[1][of[1]] = got[3], got[4]
        first = share[0][asked.word].astype(np.float64)
        p = np.where(first > 0, first, unknown) * weight[0][asked.word_ctx] + share[1][asked.pair]
        p = p * weight[1][asked.pair_ctx] + share[2]
        logs = np.log10(np.maximum(p, 1e-30))[asked.three]
        n = np.diff(asked.offs)
        sums = np.add.reduceat(logs, asked.offs[:-1])
        return pa.table({"doc_id": rb.column("doc_id"), "lang": rb.column("lang"), "x": rb.column("x"), "n_tokens": pa.array(n), "log_ppl": pa.array(-sums / n)})

    found = ready.mapInArrow(ask, "shard int, batch long, n array<int>, data binary").groupBy("shard").applyInArrow(answer, "shard int, batch long, data binary")
    found = found.groupBy("batch").applyInArrow(total, "doc_id long, lang string, x long, n_tokens long, log_ppl double")
    found = _store.table(found, "scored")
    _store.remove(spark, [state])
    return found


def _steps(keys: list[np.ndarray]) -> bytes:
    """Ascending keys as their differences, byte by byte."""
    diffs = np.concatenate([np.diff(k, prepend=np.uint64(0)) for k in keys]).astype("<u8")
    return zstandard.compress(_planes(diffs), 1)


def _unsteps(data, n: list[int]) -> np.ndarray:
    diffs = _numbers(zstandard.decompress(data), "<u8")
    return np.concatenate([np.cumsum(x, dtype=np.uint64) for x in np.split(diffs, np.cumsum(n)[:-1])])


def _values(x: np.ndarray) -> bytes:
    """The different numbers, the most frequent first, and each number's place among them, byte by byte."""
    both = x.astype("<f4").view("<u4").astype(np.uint64) << np.uint64(32)  # a number's bits, and its index
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    bits = (both >> np.uint64(32)).astype("<u4")
    new = np.ones(len(x), bool)
    np.not_equal(bits[1:], bits[:-1], out=new[1:])
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(x))
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), "<u2" if len(order) <= 1 << 16 else "<u4")
    place[order] = np.arange(len(order))
    places = np.empty(len(x), place.dtype)
    places[(both & np.uint64(0xFFFFFFFF)).view(np.int64)] = np.repeat(place, n)
    return zstandard.compress(len(order).to_bytes(4, "little") + bits[first[order]].tobytes() + _planes(places), 1)


def _unvalues(data) -> np.ndarray:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<f4", n, 4)[_numbers(raw[4 + 4 * n :], "<u2" if n <= 1 << 16 else "<u4")]


def thresholds(scored: DataFrame, trusted: DataFrame) -> DataFrame:
    """(group, threshold): of each language with calibrating documents."""
    held = _split(trusted.withColumnRenamed(trusted.columns[0], "doc_id"), "doc_id").filter("pmod(_h, 3) = 0").select("doc_id")
    bins = scored.join(held, "doc_id", "left_semi").filter("n_tokens > 1").select(F.coalesce("lang", F.lit(NULL)).alias("group"), F.floor(F.col("log_ppl") / BIN).alias("bin"))
    bins = _store.table(bins.groupBy("group", "bin").agg(F.count("*").alias("n")), "bins")
    every = Window.partitionBy("group")
    run = bins.withColumn("cum", F.sum("n").over(every.orderBy("bin"))).withColumn("all", F.sum("n").over(every))
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("all"), (F.col("bin") + 1) * BIN))
    t = run.groupBy("group").agg(F.max("all").alias("n"), at(QUANTILE).alias("high"), at(0.5).alias("mid"))
    off = bins.select("group", "bin", F.col("n").alias("times")).join(t, "group").select(((F.col("bin") + 1) * BIN - F.col("mid")).alias("off"), "times")
    pooled = off.agg(F.percentile("off", F.lit(QUANTILE), F.col("times"))).first()[0] or 0.0
    own = F.col("high") - F.col("mid")
    width = F.greatest(own, (F.col("n") * own + PRIOR * pooled) / (F.col("n") + PRIOR) * (1 + 1 / F.sqrt("n")))
    return t.select("group", (F.col("mid") + (1 + SLACK) * width).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, lang, n_tokens, log_ppl, threshold and kept of every document."""
    spark = docs.sparkSession
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    held = _store.shared(spark, "trusted")
    with _store.swept(spark):
        _write(trusted_texts(docs, trusted, key, text), held)
        model = train(spark.read.schema("_t string").parquet(held), _store.shared(spark, "shards"), held)
        scored = _store.table(perplexities(docs, model, key, lang, text, carry), "scores")
        _store.remove(spark, [model[0]])
        limits = _store.table(thresholds(scored, trusted), "limits")
    out = scored.withColumn("_g", F.coalesce("lang", F.lit(NULL))).join(limits, F.col("_g") == F.col("group"), "left")
    return out.select("doc_id", "lang", *["x"] * bool(carry), "n_tokens", "log_ppl", "threshold", ((F.col("n_tokens") > 1) & F.coalesce(F.col("log_ppl") <= F.col("threshold"), F.lit(True))).alias("kept"))


@_store.query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_store.read(spark, sf_dir, "documents"), _store.read(spark, sf_dir, "labels"))
