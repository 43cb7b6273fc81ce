"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds, one after another: a frame for each document (for a longer one, a frame for every 2**26
of its ids) of little-endian unsigned 32-bit ids; an index frame of the documents' ids, validity and
numbers of ids; and the seek table of the zstandard seekable format, a skippable frame with each
frame's compressed size, size and checksum (the low 32 bits of XXH64). Any zstandard reader can inflate
the whole file; `open_documents` inflates only the index and the frames asked for, and checks them.

Documents are dealt out by ranges of their key, so file after file holds ascending keys; a manifest
table lists the files that tasks committed (a task that is run again writes a new name, and only the
manifest's files count). Only file sizes, never ids, pass through the driver's plan.

Cases: a null or empty text gives the end id alone; null keys come first; rows that repeat follow each
other; other columns are ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _hash, _store, _text

END_ID = 2
FRAME_IDS = 1 << 26
MEMO_WORDS = 850_000
# fixed values of the zstandard seekable format
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
MANIFEST = "part long, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Encodes whole texts with a tokenizer that drops white space, remembering the words it has met.

    Words between white space are encoded apart, which gives the ids of the whole text as neither the
    normaliser nor the splitter of such a tokenizer sees across white space. Texts with the four
    characters that Python takes for white space and the tokenizer does not are encoded whole. A run of
    closing marks after letters, which the tokenizer splits off, and ASCII capitals, which it lowers,
    are taken off before a word is looked up. New words of letters alone go to the tokenizer as one text,
    which takes half the time, and are told apart by the ids that end a word: every word has one at least, so
    that with as many of them as words each has its own; otherwise the words are encoded in halves, down to
    single ones. The memory is two generations of at most `most` words.
    Any tokenizer whose normaliser or splitter is another one encodes whole texts, without memory.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    MARKS, LONGEST_MARK, MOST_MARKS = string.punctuation, 8, 4096
    # fixed values: the normalisers and the splitting pattern for which all this holds
    NORMALISERS = ["NFC", "Replace", "Lowercase"]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.new, self.old, self.marks = Tokenizer.from_file(path), most, {}, {}, {}
        form = json.loads(self.tokenizer.to_str())
        steps, splits = (form.get("normalizer") or {}).get("normalizers", []), (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = [x["type"] for x in steps] == self.NORMALISERS and bool(splits) and splits[0].get("pattern", {}).get("Regex") == self.PATTERN and splits[0].get("behavior") == "Removed" and splits[0].get("invert", False)
        # added tokens are looked for before all else: they may not reach from letters into marks or across words
        self.by_words &= not (form.get("truncation") or form.get("padding")) and all(t["content"][0] in self.MARKS and len(t["content"].split()) == 1 and not t["single_word"] for t in form.get("added_tokens") or [])
        self.last = self._last(form) if self.by_words else None

    def _last(self, form: dict) -> np.ndarray | None:
        """Whether an id ends a word, by id; None if words of letters may be without such an id."""
        vocab, end = self.tokenizer.get_vocab(), form["model"].get("end_of_word_suffix")
        if not end or sum(len(t) == 1 + len(end) and t.endswith(end) for t in vocab) < 256:
            return None
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for t, i in vocab.items() if t.endswith(end)]] = True
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """_encode for words of letters alone."""
        if self.last is None or len(words) < 2:
            return self._encode(words)
        raw = self._encode([" ".join(words)])[0]
        to = np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1
        if len(to) != len(words):
            half = len(words) // 2
            return self._letters(words[:half]) + self._letters(words[half:])
        ends = (to * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _mark(self, mark: str) -> bytes:
        if (ids := self.marks.get(mark)) is None:
            if len(self.marks) >= self.MOST_MARKS:
                self.marks.clear()
            ids = self.marks[mark] = self._encode([mark])[0]
        return ids

    def _learn(self, words) -> None:
        new, old, asked, later = self.new, self.old, {}, []
        for w in words:
            if (ids := old.get(w)) is not None:
                new[w] = ids
                continue
            core = w.rstrip(self.MARKS)
            if not core.isalpha() or len(w) - len(core) > self.LONGEST_MARK:
                core = w
            mark = w[len(core) :]
            letters = core.isalpha()
            if letters and core.isascii():
                core = core.lower()
            if core not in new:
                if (ids := old.get(core)) is None:
                    asked[core] = letters
                else:
                    new[core] = ids
            if core != w:
                later.append((w, core, mark))
        for encode, kind in ((self._letters, True), (self._encode, False)):
            cores = [c for c, letters in asked.items() if letters is kind]
            for at in range(0, len(cores), 2048):
                part = cores[at : at + 2048]
                new.update(zip(part, encode(part), strict=True))
        for w, core, mark in later:
            new[w] = new[core] + self._mark(mark) if mark else new[core]

    def __call__(self, text: str) -> bytes:
        if not self.by_words or any(c in text for c in self.ODD):
            return self._encode([text])[0]
        words = text.split()
        out = list(map(self.new.get, words))
        if None in out:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            lacking = [i for i, ids in enumerate(out) if ids is None]
            self._learn({words[i] for i in lacking})
            for i in lacking:
                out[i] = self.new[words[i]]
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """This worker process's encoder of a tokenizer file."""

    def make() -> WordEncoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        return WordEncoder(path)

    return _hash.resident("encoder", path, make)


class FrameWriter:
    """Writes one file of the format to a binary stream."""

    def __init__(self, out, level: int = 3):
        self.out, self.zip, self.table, self.size = out, zstandard.ZstdCompressor(level=level, write_checksum=True), [], 0
        self.keys, self.valid, self.lengths = [], [], []

    def _frame(self, raw: bytes) -> None:
        z = self.zip.compress(raw)
        self.out.write(z)
        self.size += len(z)
        self.table.append((len(z), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, key: int | None, ids: bytes) -> None:
        for at in range(0, max(1, len(ids)), FRAME_IDS * 4):
            self._frame(ids[at : at + FRAME_IDS * 4])
        self.keys.append(key or 0)
        self.valid.append(key is not None)
        self.lengths.append(len(ids) // 4)

    def close(self) -> None:
        self._frame(np.asarray(self.keys, "<i8").tobytes() + np.asarray(self.valid, "u1").tobytes() + np.asarray(self.lengths, "<u8").tobytes())
        entries = np.asarray(self.table, "<u4").tobytes()
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot)
        self.size += 8 + len(entries) + len(foot)


def open_documents(f, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(key, ids before it in the file, ids) of the documents of a seekable file; only `wanted` if given.

    Nothing but the seek table, the index and the wanted documents' frames is read; a frame whose
    checksum differs raises ValueError.
    """
    end = f.seek(0, 2)
    f.seek(end - 9)
    n, kind, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or not kind & CHECKSUMS:
        raise ValueError("no seek table with checksums")
    f.seek(end - 9 - 12 * n)
    entries = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
    at = np.concatenate([[0], np.cumsum(entries[:, 0].astype(np.int64))])
    unzip = zstandard.ZstdDecompressor()

    def frame(i: int) -> bytes:
        f.seek(int(at[i]))
        raw = unzip.decompress(f.read(int(entries[i, 0])), max_output_size=max(1, int(entries[i, 1])))
        if len(raw) != entries[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entries[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return raw

    index = frame(n - 1)
    docs = len(index) // 17
    keys, valid, lengths = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs), np.frombuffer(index, "<u8", docs, 9 * docs)
    i = before = 0
    for key, ok, length in zip(keys.tolist(), valid.tolist(), lengths.tolist(), strict=True):
        frames = max(1, -(-length // FRAME_IDS))
        key = key if ok else None
        if wanted is None or key in wanted:
            yield key, before, b"".join(frame(j) for j in range(i, i + frames))
        i, before = i + frames, before + length


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the manifest, one row a file in key order."""
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    stop = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, encode, writer, tokens = TaskContext.get().partitionId(), encoder(tokenizer), None, 0
        fs, root = _store.files(folder)
        path = f"{root}/ids-{part:06d}-{uuid.uuid4().hex[:8]}.zst"
        for rb in _text.slices(batches, "text"):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path, compression=None)
                writer = FrameWriter(out)
            for k, t in zip(rb.column("key").to_pylist(), rb.column("text").to_pylist(), strict=True):
                ids = encode(t) + stop
                writer.add(k, ids)
                tokens += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            row = [[part], [path], [len(writer.keys)], [tokens], [writer.size]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "path", "n_docs", "n_tokens", "n_bytes"])

    return _store.table(ordered.mapInArrow(run, MANIFEST), "ids-manifest")


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document from the files alone: doc_id, start, n_tokens and the CRC-32 of its ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches):
        fs, _ = _store.files(folder)
        for rb in batches:
            for path, base in zip(rb.column("path").to_pylist(), rb.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(path) as f:
                    for key, start, ids in open_documents(f):
                        rows.append((key, base + start, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) == 8192:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return _store.spread(placed.select("path", "base")).mapInArrow(run, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids into a new shared folder and report each document as read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = _store.shared(docs.sparkSession, "ids")
    return read_back(write(docs, folder, tokenizer), folder)


@_store.query
def op3_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_store.read(spark, sf_dir, "documents"))
