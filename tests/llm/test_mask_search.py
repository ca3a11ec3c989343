import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import ALNUM, fold
from veedor.llm import mask_search as ms


def expected(docs, items, most):
    found = [(i, Counter(ALNUM.findall(fold(t)))) for i, t in docs]
    held = [c for _, c in found if c]
    n, length = len(held), sum(c.total() for c in held)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 75 + (25 * c.total() * n) // length if length else 0
            score = 0
            for word in ALNUM.findall(fold(text)):
                df = sum(word in d for d in held)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[word]) // (1000 * c[word] + 12 * m)) if c[word] else 0
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(str(item), r + 1, str(x[3]), -x[0]) for r, x in enumerate(sorted(scored)[:most])]
    return sorted(out)


def run(spark, docs, items, most=3, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id string, text string")
    d, i = (x.select("*", *(F.lit(0).alias(c) for c in ("key", "doc", "score", "rank", "item", "n_docs"))) for x in (d, i))
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in ms.search(d, i, most, **options).collect())


WORDS = [f"w{k}" for k in range(30)] + ["Ñandú", "ÉTÉ", "7up"]


def corpus(n, seed, most):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, len(WORDS) + 1)
    return [(i, " ".join(rng.choice(WORDS, size=int(rng.integers(0, most)), p=odds / odds.sum())) + rng.choice([".", "!", ""])) for i in range(n)]


@pytest.mark.parametrize("pack_bytes", [1 << 20, 60])
def test_against_brute_force(spark, monkeypatch, pack_bytes):
    docs = corpus(300, 1, 40) + [(1000 + i, "w1 w2 w3 W1") for i in range(150)]  # a third are one text
    items = [(f"i{k}", t) for k, t in corpus(12, 2, 12)] + [("long", " ".join(f"x{k}" for k in range(100)) + " w29 w1")]
    monkeypatch.setattr(ms, "BLOCK_DOCS", 40)
    monkeypatch.setattr(ms, "SCORED", 8)
    assert run(spark, docs, items, pack_bytes=pack_bytes) == expected(docs, items, 3)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "a b"), (4, "a b"), (None, "a b"), (5, "a " * 50_000 + "b"), (6, "A-b")]
    items = [("x", "a b a"), ("x", "b"), (None, "a"), ("n", None), ("e", " - "), ("u", "unheard")]
    assert run(spark, docs, items, most=4) == expected(docs, items, 4)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, docs[:3], items) == []


def test_most_masks_are_never_scored():
    """Documents that hold the rare term come first; the groups without it are not scored."""
    docs = ["common " * (k % 7 + 1) for k in range(2000)] + ["common rare rare"] * 30
    body = pa.array(docs, pa.large_string())
    wanted = np.sort(np.concatenate(ms.hash_texts(["common", "rare"], ms.ALNUM)))
    (block,) = ms._indexer(wanted, pa.int64())([pa.record_batch({"id": pa.array(range(len(docs))), "text": body})])
    p = ms.inflate(block.column("postings")[0].as_py())
    share = ms.shares(p, len(docs), int(p.n.sum()))
    best = np.maximum.reduceat(share, p.first[:-1])
    rare = int(np.searchsorted(wanted, ms.hash_texts(["rare"], ms.ALNUM)[0][0]))
    weights = np.array([10, 10])
    weights[rare] = 4000
    places = ms.Places(20)
    scored = ms.search_block(p, share, best, ms.Item(0, None, np.array([0, 1]), np.array([1, 1])), weights, places, block.column("ids")[0].values)
    assert scored == 30 and [i for _, i in places.held] == list(range(2000, 2020))


def test_masks_of_many_terms():
    n, terms = 50, 130
    rng = np.random.default_rng(5)
    held = rng.random((terms, n)) < 0.3
    docs = [np.flatnonzero(row) for row in held]
    p = ms.Postings(np.ones(n), np.arange(terms), np.cumsum([0, *map(len, docs)]), np.concatenate(docs), None)
    best = rng.integers(1, 100, terms)
    distinct, order, first = ms.groups(ms.masks(p, np.arange(terms)))
    want = held.T.astype(int) @ best
    for k, bound in enumerate(ms.bounds(distinct, best)):
        assert (want[order[first[k] : first[k + 1]]] == bound).all()


def test_long_norms_stay_exact():
    n = np.array([3, 10**12])
    n_docs, n_terms = 10**11 + 7, 10**14 + 3
    assert ms.norms(n, n_docs, n_terms).tolist() == [75 + 25 * int(x) * n_docs // n_terms for x in n]
