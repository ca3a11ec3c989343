import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

import numpy as np
import pyarrow as pa
from veedor.llm.arrays import utf8
from veedor.llm.byte_bpe import _encode_long, decode, encode, encode_word, load_ranks, split

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(texts, ranks):
    piece = split(*utf8(pa.array(texts, pa.large_string())))
    words = piece.read(np.arange(len(piece.hashes)))
    return [[i for w in words[a:b] for i in encode_word(w, ranks)] for a, b in zip(piece.first[:-1], piece.first[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aés'tlvredm  \t\n　\x1c\x85२3!!中", max_size=40)), max_size=4))
def test_as_the_library(ranks, library, texts):
    assert own(texts, ranks) == [library.encode_ordinary(t) for t in texts]


def test_long_words(ranks, library):
    for text in ("ab" * 3000, "x" * 2000, "中文" * 900, "!" * 700 + "?" * 900, "thequickbrownfox" * 300):
        assert _encode_long(text.encode(), ranks) == library.encode_ordinary(text) or text.encode() in ranks
        assert own([text], ranks) == [library.encode_ordinary(text)]


def test_table(table, library):
    rows = [(1, "Hello world's  end\n"), (2, None), (3, ""), (3, "x " * 20_000), (None, "Hello"), (None, "Hello"), (4, "naïve 中文 🙂 ️")]
    found = decode(encode(table(rows), VOCABULARY), VOCABULARY).collect()
    got = sorted((str(r.id), r.ids, bytes(r.decoded)) for r in found)
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert encode(table([]), VOCABULARY).count() == 0
