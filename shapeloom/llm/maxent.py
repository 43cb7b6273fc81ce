"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Vocabulary: counts of all words of all training documents, grouped after partial sums. The model's
symbols are the CLASSES * MEMBERS - ENDINGS - 1 most frequent words, the end of a text, and ENDINGS
symbols for all other words by a hash of their last three bytes; symbols are dealt into classes by
their rank. Then

    P(word | history) = P(class | history) * P(symbol | class, history) * P(word | symbol),

where the first two are softmaxes over summed weights of hashed features of the history - nothing (a
bias), the last word, the last two, and skips to the second and third last - and the third is 1 for a
symbol of one word and (c+1) / (N_s+V_s+1) for a word counted c times among the N_s of V_s different
words of an ending; a word that was never counted is the one further event of its ending. So the
probabilities of all events sum to 1.

What the model holds follows the vocabulary of V words: the tables of hashed rows have in the order of
sqrt(V) rows (`rows_for`), and as the last word of a history as many of the most frequent words that were
counted SEEN times stand for themselves (all others, and those further back, for their symbol), so that more text
brings more histories and more weights. The symbols, on whose
number the time for a token depends, are of fixed number.

Training starts from the symbols' shares. Documents are dealt into ROUNDS by hash. In a round every task starts from the current
weights, goes through its part of all training text in minibatches with AdaGrad steps, and returns for
each hashed row its change times the number of updates; rows are summed by the exchange, and their
mean change is the update. Partitions of less than TASK tokens share a task, as far as all cores stay busy, since
every task returns most of the rows whatever the size of its part. Only the weights, some hundred bytes a row, reach the driver. A task's pass
depends on what text it holds, so scores are repeatable for one layout of the table and differ slightly for another.

Scoring: tasks score sparse batches in numpy. Counts of words with at least the cut-off count (the most
frequent HEAD at most) are looked up in a table of bounded size; all rarer words leave the task as rows
and meet the whole vocabulary in a join. No count is cut or approximated.

Cases: a null or empty text is one end token; with no training text every token is unknown and the
vocabulary empty; a null key counts as a key whose text is null: it trains and is not held out; rows
that repeat are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _hash, _store, _text

CLASSES, MEMBERS, ENDINGS = 32, 32, 255
LEAST_ROWS, ROWS, SEEN = 4096, 16, 32
ROUNDS, BATCH, RATE, FEW = 2, 8192, 0.1, 7
HEAD, TASK = 1 << 19, 1 << 21
SYMBOLS = CLASSES * MEMBERS
TOP = SYMBOLS - ENDINGS - 1
_K = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def rows_for(types: int) -> int:
    """Rows of the class table for a vocabulary; the members' table has twice as many, histories as many words."""
    return LEAST_ROWS + ROWS * math.isqrt(types)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ending symbol (0 to ENDINGS-1) of each word: a hash of its last three bytes, A-Z lower-cased."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    out = np.zeros(len(starts), np.uint32)
    for back in (1, 2, 3):
        b = np.where(ends - back >= starts, low[np.maximum(ends - back, 0)], 0) if len(low) else np.zeros(0, np.uint8)
        out = out * np.uint32(0x01000193) + b
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((out ^ (out >> np.uint32(13))) % np.uint32(ENDINGS)).astype(np.int32)


class Symbols:
    """From words, the most frequent ones first, to symbols; rank TOP is the end of a text, ranks above it are endings.

    Words beyond the TOP first have an ending's symbol, but stand for themselves in histories.
    """

    def __init__(self, best: list[int]):
        self.table = _hash.HashTable(np.asarray(best, np.int64).view(np.uint64), np.arange(len(best), dtype=np.int32))
        self.member = np.zeros(SYMBOLS, bool)
        self.member[: len(best)] = True
        self.member[TOP:] = True

    def tokens(self, col: pa.Array):
        """h, symbol, whether an ending stands for it, what it is in histories, row offsets; the end of each text included (h = 0)."""
        h, offs, starts, ends, data = _text.words(col)
        slot = self.table.find(h)
        rank, ending = self.table.values[0][slot], TOP + 1 + _endings(data, starts, ends)
        rare = (slot < 0) | (rank >= TOP)
        sym = np.where(rare, ending, rank)
        past = np.where((slot >= 0) & (rank >= TOP), rank + (SYMBOLS - TOP), sym)
        m = len(offs) - 1
        stops = offs[1:] + np.arange(1, m + 1)
        word = np.ones(len(h) + m, bool)
        word[stops - 1] = False
        out = [np.full(len(word), fill, kind) for fill, kind in ((0, np.uint64), (TOP, np.int32), (False, bool), (TOP, np.int32))]
        for o, x in zip(out, (h, sym, rare, past), strict=True):
            o[word] = x
        return *out, np.concatenate([[0], stops])


def features(sym: np.ndarray, past: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Hashed histories of every token, from what stands before it in its text (0: before its start)."""
    n = len(past)
    back = []
    place = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    for k, of in ((1, past), (1, sym), (2, sym), (3, sym)):
        h = (of + 1).astype(np.uint64)
        p = np.zeros(n, np.uint64)
        p[k:] = h[: n - k] if k < n else h[:0]
        p[place < k] = 0
        back.append(p)
    w, a, b, c = back
    return [_text.mix(w * _K[0] + np.uint64(1)), _text.mix(a * _K[0] + b * _K[1] + np.uint64(2)), _text.mix(b * _K[2] + np.uint64(3)), _text.mix(c * _K[3] + np.uint64(4))]


class Model:
    def __init__(self, member: np.ndarray, rows: int, classes: np.ndarray | None = None, words: np.ndarray | None = None):
        self.size = rows
        # symbol s is member s // CLASSES of class s % CLASSES
        self.absent = np.where(member.reshape(MEMBERS, CLASSES).T, 0, -1e9).astype(np.float32)
        self.gone = np.where((self.absent < 0).all(1), -1e9, 0).astype(np.float32)
        self.c = np.zeros((rows, CLASSES), np.float32) if classes is None else classes.copy()
        self.w = np.zeros((2 * rows, MEMBERS), np.float32) if words is None else words.copy()

    def rows(self, feats: list[np.ndarray], cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Hashed rows of the class table, but for its bias in row 0, and of the word table, bias first."""
        rc = [(f >> np.uint64(40)).astype(np.int64) % (self.size - 1) + 1 for f in feats]
        mark = cls.astype(np.uint64) * _K[0]
        rw = [cls.astype(np.int64), *((_text.mix(f + mark) >> np.uint64(40)).astype(np.int64) % (2 * self.size - CLASSES) + CLASSES for f in feats)]
        return rc, rw

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        np.clip(z, -60, 60, out=z)  # in range for float32; biases are logarithms of counts
        np.exp(z, out=z)
        z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
        return z

    def probabilities(self, rc, rw, cls) -> tuple[np.ndarray, np.ndarray]:
        zc = self.c.take(rc[0], 0)
        for r in rc[1:]:
            zc += self.c.take(r, 0)
        zc += self.c[0] + self.gone
        zw = (self.w[:CLASSES] + self.absent).take(cls, 0)
        for r in rw[1:]:
            zw += self.w.take(r, 0)
        return self._softmax(zc), self._softmax(zw)

    def logs(self, feats: list[np.ndarray], sym: np.ndarray) -> np.ndarray:
        """log10 P(symbol | history) of every token."""
        cls, mem = sym % CLASSES, sym // CLASSES
        out = np.empty(len(sym))
        for at in range(0, len(sym), BATCH):
            s = slice(at, at + BATCH)
            rc, rw = self.rows([f[s] for f in feats], cls[s])
            pc, pw = self.probabilities(rc, rw, cls[s])
            i = np.arange(len(cls[s]))
            out[s] = np.log10(np.maximum(pc[i, cls[s]].astype(float), 1e-30)) + np.log10(np.maximum(pw[i, mem[s]].astype(float), 1e-30))
        return out


def _step(table: np.ndarray, sums: np.ndarray, touched: np.ndarray, rows: list[np.ndarray], grad: np.ndarray) -> None:
    """An AdaGrad step, with one sum of squares a row, on the rows of one minibatch, whose tokens share a gradient over their features."""
    flat = np.concatenate(rows)
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # by radix, sixteen bits at a time
    if len(table) > 1 << 16:
        order = order[np.argsort((flat.take(order) >> 16).astype(np.uint16), kind="stable")]
    flat = flat.take(order)
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    order %= len(grad)
    counts, at = np.diff(np.append(first, len(flat))), flat.take(first)
    total = np.zeros((len(at), grad.shape[1]), grad.dtype)
    rest = counts % (FEW + 1)
    for c in range(1, FEW + 1):  # most rows are met a few times in a minibatch
        same = np.flatnonzero(rest == c)
        begin = first.take(same)
        part = grad.take(order.take(begin), 0)
        for k in range(1, c):
            part += grad.take(order.take(begin + k), 0)
        total[same] = part
    many = np.flatnonzero(counts > FEW)
    if len(many):  # blocks of FEW + 1 from behind the rest, then the blocks of a row
        sizes = counts.take(many) // (FEW + 1)
        starts = np.cumsum(sizes) - sizes
        begin = np.repeat(first.take(many) + rest.take(many) - (FEW + 1) * starts, sizes) + (FEW + 1) * np.arange(sizes.sum())
        part = grad.take(order.take(begin), 0)
        for k in range(1, FEW + 1):
            part += grad.take(order.take(begin + k), 0)
        total[many] += np.add.reduceat(part.T.copy(), starts, axis=1).T  # sums along rows are the fast ones
    sums[at] += np.einsum("ij,ij->i", total, total) / grad.shape[1]
    total *= (RATE / np.sqrt(sums.take(at)))[:, None]
    table[at] -= total
    touched[at] += counts


def _bias(table: np.ndarray, sums: np.ndarray, touched: np.ndarray, grad: np.ndarray) -> None:
    total = grad.sum(0)
    sums[0] += np.mean(total * total)
    table[0] -= RATE * total / np.sqrt(sums[0])
    touched[0] += len(grad)


def _class_biases(table: np.ndarray, sums: np.ndarray, touched: np.ndarray, cls: np.ndarray, grad: np.ndarray) -> None:
    """The step of _step on the CLASSES rows of which each token has its class's; all are met so often that one product sums them."""
    one = np.zeros((len(cls), CLASSES), grad.dtype)
    one[np.arange(len(cls)), cls] = 1
    total = one.T @ grad
    sums[:CLASSES] += np.einsum("ij,ij->i", total, total) / grad.shape[1]
    table[:CLASSES] -= RATE * total / np.sqrt(sums[:CLASSES])[:, None]
    touched[:CLASSES] += np.bincount(cls, minlength=CLASSES)


def unigrams(symbols: Symbols, counts: np.ndarray, rows: int) -> Model:
    """The model whose biases alone give each symbol its share of `counts`; training starts from it."""
    m = Model(symbols.member, rows)
    table = np.where(symbols.member, counts + 0.5, 0).reshape(MEMBERS, CLASSES).T
    m.c[0] = np.log(np.maximum(table.sum(1), 1e-9))
    m.w[:CLASSES] = np.log(np.maximum(table, 1e-9))
    return m


def train(docs: DataFrame, symbols: Symbols, model: Model) -> Model:
    """`docs` has _t (text) and _round; the rows of a round are trained on in parallel."""
    for r in range(ROUNDS):
        start = model

        def run(batches, start=start):
            m = Model(symbols.member, start.size, start.c, start.w)
            sums = [np.full(len(x), 1e-3, np.float32) for x in (m.c, m.w)]
            touched = [np.zeros(len(x), np.int64) for x in (m.c, m.w)]
            any_ = False
            for rb in _text.slices(batches, "_t"):
                _, sym, _, past, offs = symbols.tokens(rb.column("_t"))
                feats = features(sym, past, offs)
                for at in range(0, len(sym), BATCH):
                    any_ = True
                    s = slice(at, at + BATCH)
                    cls, mem = sym[s] % CLASSES, sym[s] // CLASSES
                    rc, rw = m.rows([f[s] for f in feats], cls)
                    pc, pw = m.probabilities(rc, rw, cls)
                    i = np.arange(len(cls))
                    pc[i, cls] -= 1
                    pw[i, mem] -= 1
                    _step(m.c, sums[0], touched[0], rc, pc)
                    _bias(m.c, sums[0], touched[0], pc)
                    _step(m.w, sums[1], touched[1], rw[1:], pw)
                    _class_biases(m.w, sums[1], touched[1], cls, pw)
            if any_:
                for t, (new, old, n) in enumerate(((m.c, start.c, touched[0]), (m.w, start.w, touched[1]))):
                    at = np.flatnonzero(n)
                    change = ((new[at] - old[at]) * n[at, None]).astype(np.float32)
                    for lo in range(0, len(at), 2048):
                        part = change[lo : lo + 2048]
                        lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array(at[lo : lo + 2048]), pa.array(n[at[lo : lo + 2048]]), lists], names=["t", "at", "n", "change"])

        deltas = docs.filter(F.col("_round") == r).select("_t").mapInArrow(run, "t int, at long, n long, change array<float>")
        width = max(CLASSES, MEMBERS)
        sums = deltas.groupBy("t", "at").agg(F.sum("n").alias("n"), *(F.sum(F.col("change")[i].cast("double")).alias(f"x{i}") for i in range(width)))
        got = sums.select("t", "at", F.array(*((F.col(f"x{i}") / F.col("n")).cast("float") for i in range(width))).alias("change")).toArrow()
        model = Model(symbols.member, start.size, start.c, start.w)
        t, at = got["t"].to_numpy(), got["at"].to_numpy()
        change = got["change"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        model.c[at[t == 0]] += change[t == 0][:, :CLASSES]
        model.w[at[t == 1]] += change[t == 1][:, :MEMBERS]
    return model


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, ending, c): every word of the training texts with its count."""

    def run(batches):
        for rb in _text.slices(batches, "_t", 1 << 22):
            h, _, starts, ends, data = _text.words(rb.column("_t"))
            keys, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(_endings(data, starts[at], ends[at])), pa.array(n)], names=["h", "ending", "c"])

    counts = docs.select("_t").mapInArrow(run, "h long, ending int, c long")
    return _store.table(counts.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c")), "vocabulary")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    ready = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("_t"), held_out(F.col(key)).alias("held_out"))
    training = ready.filter(~F.col("held_out")).withColumn("_round", F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)))
    vocab = vocabulary(training)
    n_docs = training.count()
    words, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = words + n_docs, types + (n_docs > 0)
    rows = rows_for(types)
    best = vocab.orderBy(F.desc("c"), "h").limit(max(TOP, rows)).select("h", "c").collect()  # in the order of sqrt(types)
    symbols, best = Symbols([r["h"] for i, r in enumerate(best) if i < TOP or r["c"] >= SEEN]), best[:TOP]
    top = [r["h"] for r in best]
    rare = vocab.join(F.broadcast(spark.createDataFrame([(h,) for h in top], "h long")), "h", "left_anti")  # TOP rows at most
    totals = np.zeros((ENDINGS, 2))
    for e, a, b in rare.groupBy("ending").agg(F.sum("c"), F.count("*")).collect():
        totals[e] = a, b
    rest = -np.log10(totals.sum(1) + 1)  # of an ending's word: log10((c+1) * 10**rest)

    bins = vocab.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    cut, room = None, HEAD
    for r in bins:
        room -= r["n"]
        if room < 0:
            break
        cut = r["bin"]
    chosen = vocab.filter(F.floor(F.log2("c") * 8) >= (cut if cut is not None else 2**31))
    folder = _store.shared(spark, "head")
    chosen.select("h", "c").write.parquet(folder)
    counts = np.zeros(SYMBOLS)
    counts[: len(top)], counts[TOP], counts[TOP + 1 :] = [r["c"] for r in best], n_docs, totals[:, 0]
    model = unigrams(symbols, counts, rows)
    if n_docs:
        model = train(training.coalesce(max(spark.sparkContext.defaultParallelism, -(-n // TASK))), symbols, model)
    unit = np.log10(n + v + 1)
    end_count = n_docs

    def run(batches):
        from pyspark import TaskContext

        head, row = _hash.load(folder, folder, "h", "c"), TaskContext.get().partitionId() << 33
        for rb in _text.slices(batches, "_t"):
            h, sym, is_rare, past, offs = symbols.tokens(rb.column("_t"))
            logs = model.logs(features(sym, past, offs), sym)
            logs[is_rare] += rest[sym[is_rare] - TOP - 1]
            slot = head.find(h)
            end = h == 0
            hit = (slot >= 0) | end
            c = np.where(end, end_count, head.values[0][slot])
            own = np.zeros(len(h))
            own[hit] = np.log10(c[hit] + 1.0)
            known = (hit & (c > 0)).astype(np.int64)
            size, m = np.diff(offs), rb.num_rows
            add = lambda x: np.add.reduceat(x, offs[:-1])
            base = add(own) - size * unit
            full = add(logs) + add(np.where(is_rare, own, 0.0))
            left = np.flatnonzero(~hit)
            tails = np.searchsorted(left, offs)
            lists = pa.ListArray.from_arrays(tails.astype(np.int32), pa.array(h[left].view(np.int64)))
            cols = [pa.array(np.arange(row, row + m)), rb.column("doc_id"), rb.column("held_out"), pa.array(size), pa.array(add(known)), pa.array(base), pa.array(full), lists]
            row += m
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "full", "tail"])

    part = _store.table(ready.select("doc_id", "held_out", "_t").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, full double, tail array<long>"), "scores")
    tail = part.select("row", F.explode("tail").alias("h")).join(vocab.select("h", "c"), "h")
    tail = tail.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("s"))
    out = part.drop("tail").join(tail, "row", "left")
    more = F.coalesce("s", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("full") + more).alias("score"),
    )


@_store.query
def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_store.read(spark, sf_dir, "documents"))
