import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinolake.llm import token_output as T


@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0), st.integers(2**60 - 2, 2**60 + 2)), max_size=300))
@settings(max_examples=150, deadline=None)
def test_pack_round_trip(values):
    assert T.unpack(*T.pack(np.array(values, np.uint64))).tolist() == values


def test_words_hold_many_small_ids():
    words, escapes = T.pack(np.ones(600, np.uint64))
    assert len(words) == 8 * 10 and not escapes


def test_encoder_equals_the_tokenizer():
    random.seed(3)
    letters = "abcXYZéÉñßÄ0123'.,;!?<|>-_ΣσςİıǅﬁΥ中文́ \x1c   \t\n#$%’“한🙂"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(4000)]
    texts += ["a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>x", "I'LL we're it's O'Neil can't'", "", "THE END.", "ΟΔΥΣΣΕΥΣ. ς, Σ! é. É,"]
    tokenizer, encode = Tokenizer.from_file(T.vocabulary()), T.Encoder(T.vocabulary())
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == want.ids, text


def test_files_hold_every_document_in_order(documents, spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 16)
    rows = [(i, t) for i, t in enumerate(["the cat", None, "", "Là-bas, déjà vu!", "word " * 5000, "x"])] + [(None, "none"), (3, "again"), (5, "x")]
    got = sorted(T.token_output(documents(rows)).collect(), key=lambda r: r["start"])
    tokenizer, at = Tokenizer.from_file(T.vocabulary()), 0
    left = [(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows]
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 5]
    for r in got:
        match = next((i, ids) for i, ids in left if i == r["doc_id"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"])
        assert (r["start"], r["n_tokens"]) == (at, len(match[1]))
        left.remove(match)
        at += r["n_tokens"]
    assert T.token_output(documents([])).count() == 0


def test_texts_together_equal_texts_alone(monkeypatch):
    """Small slices and a table that starts anew again and again change no id."""
    random.seed(5)
    texts = [" ".join("".join(random.choice("abcdeé.,'(-1\n") for _ in range(random.randint(1, 90))) for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["", "   ", "x" * 5000, "a <|endoftext|> B", "end"]
    tokenizer = Tokenizer.from_file(T.vocabulary())
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(T, "TOGETHER", 700)
    monkeypatch.setattr(T, "CACHE", 200)
    ids, counts = T.Encoder(T.vocabulary()).many([t.encode() for t in texts])
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]
