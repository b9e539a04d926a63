import hashlib
import math
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from registrum.llm import pieces, trie

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = SentencePieceProcessor(model_proto=MODEL)
CODEC = pieces.Codec(MODEL)
TEXTS = ["", " ", "   ", "hello  world ", " a▁b", "▁", "tab\tnew\nline\r\n", "<s> </s> <unk> <0x41>", "naïve 日本語 🎉 ", "x" * 3000, "a " * 500, "\x00 nul \x00"]


def same(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    got = CODEC.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids
    assert CODEC.decode(got) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ▁\nabthe.éß日🎉0"), max_size=40))
def test_equals_the_library_on_any_text(text):
    same(text)


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 2)
    same("one two three four one two")


def test_digests(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "ab  c", 6), (2, "ab  c", 6)], "doc_id long, text string, ids int")
    got = [tuple(r) for r in pieces.digests(docs, MODEL).orderBy("doc_id").collect()]
    none = LIBRARY.encode("", add_bos=True, add_eos=True)
    assert got[0] == (1, 2, hashlib.sha256(struct.pack("<2I", *none)).hexdigest(), hashlib.sha256(b"").hexdigest())
    assert got[1] == got[2] and got[1][3] == hashlib.sha256(b"ab  c").hexdigest()
    assert pieces.digests(docs.limit(0), MODEL).collect() == []


def brute(word, scores, byte):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            s = scores.get(word[j:i])
            k = 1
            if s is None and j == i - 1:
                k = len(word[j].encode())
                s = byte * k
            if s is not None:
                best[i] = max(best[i], (best[j][0] + s, best[j][1] - k))
    return -best[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc ▁é", max_size=12), max_size=8))
def test_counts_equal_brute_force(texts):
    scores = {"a": -3.0, "b": -3.0, "ab": -4.0, "bc": -2.5, "▁": -1.0, "▁a": -2.0, "abc": -6.0, "▁▁": -2.0}
    t = trie.Trie(trie.Unigram(scores, -7.0))
    for text in texts:
        words = trie._WORD.findall(trie.MARK + text.replace(" ", trie.MARK)) if text else []
        assert t.tokens(text) == (len(words), sum(brute(w, scores, -7.0) for w in words))


def test_counted_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "the cat " * 200, 9), (3, "the cat " * 200, 9), (4, "z" * 1000, 9)], "doc_id long, text string, n_tokens int")
    model = trie.Unigram.ranked(MODEL)
    got = trie.counted(docs, model).collect()
    assert [tuple(r) for r in got[:2]] == [(1, 0, 0), (2, 0, 0)] and got[2] == got[3] and got[2].n_pretokens == 401
    assert trie.counted(docs.limit(0), model).collect() == []
    t, again = trie.Trie(model), trie.Trie(model)
    monkeypatch.setattr(trie, "NODES", 1)
    assert [t.tokens("many words here") for _ in range(2)] == [again.tokens("many words here")] * 2
