import random
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from tests.llm import brute
from veedor.llm.links import components
from veedor.llm.ngram_join import components_of, keep_one


def near_copies(n, words=60, seed=1):
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(words)] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


EDGE = [(20, None), (21, ""), (22, " \n"), (23, "one two"), (24, "ONE  two"), (25, "one two three"), (26, "a b c d e"), (27, "A b c d e"),
        (28, "a b c d e f"), (5, "long " * 30_000), (6, "long " * 30_001), (29, "été " * 9)]


def rows():
    texts = near_copies(60)
    shared = " ".join(f"s{k}" for k in range(30))
    mixed = [shared + " " + " ".join(f"m{i}x{k}" for k in range(random.Random(i).randint(5, 40))) for i in range(40)]
    chain = [" ".join(f"c{k}" for k in range(i * 4, i * 4 + 60)) for i in range(12)]
    return [(100 + i, t) for i, t in enumerate([*texts, *mixed, *chain])] + EDGE


def test_components(table):
    data = rows()
    found = components_of(table(data)).collect()
    want = brute.components(dict(data))
    assert {r.id: (r.n, r.component) for r in found} == {i: (len(brute.shingles(t)), want[i]) for i, t in data}
    assert len(set(want.values())) < len(want) - 40


def test_repeated_and_null_ids(table):
    found = components_of(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (2, None), (2, "q")])).collect()
    assert Counter((r.id, r.component) for r in found) == Counter({(1, 1): 2, (None, 1): 1, (None, None): 1, (2, 2): 2})


def test_keep_one(table):
    data = rows() + [(100, near_copies(1)[0]), (23, "one two")]
    docs = table(data)
    kept = keep_one(docs)
    assert kept.dtypes == docs.dtypes
    want = brute.components(dict(data))
    alone = [(i, t) for i, t in data if not brute.shingles(t)]
    firsts = [(i, t) for i, t in dict(data).items() if brute.shingles(t) and want[i] == i]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in [*alone, *firsts])


def test_empty(table):
    assert components_of(table([])).count() == 0 and keep_one(table([])).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_connected(spark, links):
    union = brute.Union(range(26))
    for a, b in links:
        union.tie(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: union.find(n) for a, b in links for n in (a, b) if a != b}
