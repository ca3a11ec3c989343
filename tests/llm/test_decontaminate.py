import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm import brute
from veedor.llm import decontaminate as d
from veedor.llm.arrays import ALNUM, hash_texts

LONG = " ".join(f"w{k}" for k in range(40))
ITEMS = [(1, LONG), (2, "short Item here"), (3, None), (4, ""), (1, LONG), (10, " ".join(f"w{k}" for k in range(5, 25)))]
ROWS = [
    (1, "before " + LONG.upper() + " after"), (2, " ".join(LONG.split()[3:16])), (3, " ".join(LONG.split()[3:15])),
    (4, "a short, item: HERE " * 3), (5, None), (6, ""), (6, "clean words only"), (7, LONG + ". " + " ".join(f"z{k}" for k in range(900))),
    (None, LONG), (8, "w0 w0 " * 50 + LONG + " w0" * 30 + " " + LONG), (9, "é" * 5000),
]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_report(table, bench):
    found = d.contamination(table(ROWS), bench).collect()
    want = brute.hits(dict(enumerate(t for _, t in ROWS)), ITEMS)
    assert len(found) == len(ROWS)
    got = sorted((str(r.id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found)
    assert got == sorted((str(ROWS[k][0]), n, h, len(f), h > 0 and 20 * h >= n) for k, (n, h, f) in want.items())


def test_kept_rows(table, bench):
    docs = table(ROWS)
    kept = d.decontaminate(docs, bench)
    assert kept.dtypes == docs.dtypes
    want = brute.hits(dict(enumerate(t for _, t in ROWS)), ITEMS)
    clean = [ROWS[k] for k, (n, h, _) in want.items() if not (h and 20 * h >= n)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))


def test_longest_matches(table, bench):
    found = d.longest_matches(table([(1, "x y " + " ".join(LONG.split()[2:30]) + " q")]), bench).collect()
    assert {(r.item_id, r.doc_word, r.item_word, r.n_words) for r in found} == {("1", 2, 2, 28), ("10", 5, 0, 20)}


def test_empty_tables(table, bench, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(table([]), bench).count() == 0
    assert {r.n_items for r in d.contamination(table(ROWS), nothing).collect()} == {0}
    assert d.decontaminate(table(ROWS), nothing).count() == len(ROWS)


def test_blocks_do_not_matter(table, bench, monkeypatch):
    whole = sorted(map(str, d.contamination(table(ROWS), bench).collect()))
    monkeypatch.setattr(d, "BLOCK_WORDS", 3)
    assert sorted(map(str, d.contamination(table(ROWS), bench).collect())) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 16))
def test_suffix_array(codes, depth):
    codes = np.array([*codes, 0], np.int64)
    array = d.SuffixArray(codes, 3, depth)
    assert sorted(array.order.tolist()) == list(range(len(codes)))
    heads = [tuple(array.codes[k : k + depth]) for k in array.order]
    assert heads == sorted(heads)


def test_equal_words_equal_hashes():
    a, b = hash_texts(["One two, ONE", "zwei one"], ALNUM)
    assert a[0] == a[2] == b[1] and a[0] != a[1]
