"""The word kernel and the word-by-word tokenizer, against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapeloom.llm import _hash, _text
from shapeloom.llm.binary_tokens import WordEncoder

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\x0b\x0c\r\x1c ,.", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    h, offs, starts, ends, data = _text.words(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    got = [data[a:b].tobytes().lower() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for ws in want for w in ws] and np.diff(offs).tolist() == list(map(len, want))
    by = {}
    for w, x in zip(got, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_long_words_and_slices():
    word = "x" * (_text._CHUNK + 5)
    col = pa.array([f"a {word} b", word.upper(), f"{word}y a"])
    h, offs, *_ = _text.words(col)
    assert h[1] == h[3] != h[4] and h[0] == h[5] and offs.tolist() == [0, 3, 4, 6]
    sliced = _text.words(col.slice(1, 2))[0]
    assert sliced.tolist() == h[3:].tolist()
    rb = pa.RecordBatch.from_arrays([pa.array(["ab"] * 10 + [None])], names=["t"])
    parts = list(_text.slices([rb, rb.slice(0, 0)], "t", 5))
    assert sum(p.num_rows for p in parts) == 11 and max(p.num_rows for p in parts) <= 3


def test_hash_table_and_bloom_probes():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    t = _hash.HashTable(keys[::2], np.arange(len(keys[::2])))
    slot = t.find(keys)
    assert (slot[::2] >= 0).all() and (slot[1::2] < 0).all() and (t.values[0][slot[::2]] == np.arange(len(keys[::2]))).all()
    assert (_hash.HashTable(np.zeros(0, np.uint64)).find(keys) == -1).all()


@pytest.fixture(scope="module")
def encoder():
    public = pytest.importorskip("public_tokenizers")
    return WordEncoder(public.path("word_bpe_49k.json"), 40)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abTHE'éÉ́ \t\n\x1c  .,!|<>endoftx0Σßﬁ", max_size=40))
def test_encoder(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(text), "<u4").tolist() == want


def test_encoder_special_strings(encoder):
    for text in ("<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>.", "<|startoftext|> x"):
        assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_new_words_together(encoder):
    """New words of letters go to the tokenizer as one text, without the marks that follow them."""
    asked, real = [], encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **how)

    e = WordEncoder(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    e.tokenizer = Counted()
    text = " ".join(f"{a}{b}é{c}{m}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrst" for m in ("", ".", "***", "?!"))
    assert np.frombuffer(e(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids
    assert len(asked) <= 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abZÉßİıΣςªºµﬁǅéŉ각가々กำ²Ⅷ'!*<|>"), st.characters(categories=["L"]), st.characters(categories=["M"])), min_size=1, max_size=8), max_size=12))
def test_encoder_letters(encoder, words):
    text = " ".join(words)
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("added", ["hello", "b***", "*** x"])
def test_encoder_added_tokens(encoder, tmp_path, added):
    """Added tokens that begin with a letter or hold white space are found where the whole text has them."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_str(encoder.tokenizer.to_str())
    t.add_tokens([AddedToken(added, normalized=False)])
    t.save(str(tmp_path / "t.json"))
    text = "HELLO xhello hello. ab*** b*** x*** x"
    assert np.frombuffer(WordEncoder(str(tmp_path / "t.json"))(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_bloom(spark):
    b = _hash.Bloom(spark.range(0, 3000, 3), "id")
    every = np.arange(3000, dtype=np.uint64)
    hit = b.has(every)
    assert hit[::3].all() and hit[1::3].sum() + hit[2::3].sum() < 5 and not _hash.Bloom(spark.range(0), "id").has(every).any()
