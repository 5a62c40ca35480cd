import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewloom.llm.catalog import vocabulary
from reviewloom.llm.pieces import Pieces
from reviewloom.llm.words import Words, shingles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" ab\n\té.X\x0b ")), max_size=8))
def test_words_equal_split(texts):
    words = Words(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    assert list(words.count) == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert [words.word(i) for i in range(len(flat))] == flat
    assert len(set(zip(flat, words.hash.tolist()))) == len(set(flat)) == len(set(words.hash.tolist()))


def test_long_words_and_sliced_columns():
    long = "x" * 700_000
    col = pa.array(["skip", f"{long} b", None, "c"]).slice(1)
    words = Words(col)
    assert list(words.count) == [2, 0, 1] and words.word(0) == long.encode()


def test_shingles_are_position_free_and_short_texts_are_one():
    value, many = shingles(Words(pa.array(["a b c d e f", "z a b c d e f", "a b", "", "a b c d e"])), 5)
    assert list(many) == [2, 3, 1, 0, 1]
    a, z, short, full = value[:2], value[2:5], value[5], value[6]
    assert set(a) <= set(z) and full == a[0] and short not in set(a)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(name):
    texts = ["", None, "a  b\n\n c", "it's THE end's'll", " x ", "tab\t\tx", "é ﬁ Σας  y", "<|endoftext|>a <|startoftext|>",
             "a b ", "123 4５", "中文 字", "\x85a b", "a\r\n", "é ́", "w" * 3000]
    own, library = Pieces(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    for _ in range(2):  # the second time from the cache
        flat, at = own.ids(pa.array(texts))
        n = own.counts(pa.array(texts))
        for i, text in enumerate(texts):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert flat[at[i]:at[i + 1]].tolist() == want and n[i] == len(want), text


def test_cache_starts_anew(monkeypatch):
    import reviewloom.llm.pieces as module
    monkeypatch.setattr(module, "MAX_ENTRIES", 3)
    own = Pieces(vocabulary("word_bpe_49k.json"))
    texts = [f"word{i} other{i}" for i in range(20)]
    for t in texts:
        assert own.counts(pa.array([t]))[0] == len(own.tokenizer.encode(t, add_special_tokens=False).ids)
    assert isinstance(own.keys, np.ndarray) and len(own.keys) < 10


def thue_morse(n):
    """Two strings of n bytes (a power of two) on which sums of byte values times powers agree modulo 2^64."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [32, 64, 1024, 2048, 4096, 65536])
def test_self_similar_strings_differ(n):
    a, b = thue_morse(n)
    words = Words(pa.array([a, b, f"x {a} y", f"x {b} y"]))
    assert len(set(words.hash.tolist())) == 4 and len(set(words.digests())) == 4
    own = Pieces(vocabulary("word_bpe_49k.json"))
    flat, at = own.ids(pa.array([a, b]))
    for i, text in enumerate((a, b)):
        assert flat[at[i]:at[i + 1]].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    counted = Pieces(vocabulary("byte_bpe_50k.json"))
    assert [int(x) for x in counted.counts(pa.array([a, b]))] == [len(counted.tokenizer.encode(t, add_special_tokens=False).ids) for t in (a, b)]


def test_digests_see_words_only():
    texts = ["a b", " A\t\tb ", "a  b\n", "ab", "a", "", None, "  ", "a b c", "b a"]
    got = Words(pa.array(texts)).digests()
    assert got[0] == got[1] == got[2] and got[5] == got[6] == got[7] and len(set(got)) == 6
