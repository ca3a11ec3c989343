from collections import Counter

from tests.llm.brute import fold
from veedor.llm.exact_dedup import exact_groups, keep_one

ROWS = [
    (1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (4, ""), (5, "ÀB"), (6, "àB"), (7, "ÀB"), (None, "same text"),
    (8, "x" * 70 + "a"), (9, "x" * 70 + "b"), (10, "Y" * 100_000), (11, "y" * 100_000), (12, " same text"), (2, "same text"),
]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept))
    return Counter(out)


def test_groups(table):
    found = exact_groups(table(ROWS)).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in found) == expected(ROWS)
    assert len({r.digest for r in found}) == len({fold(t) for _, t in ROWS})


def test_only_null_ids(table):
    found = exact_groups(table([(None, "a"), (None, "A"), (None, "b")])).collect()
    assert sorted((r.group_size, r.kept) for r in found) == [(1, True), (2, False), (2, True)]


def test_keep_one(table):
    docs = table(ROWS)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = [(r.doc_id, fold(r.text)) for r in kept.collect()]
    want = {}
    for i, t in ROWS:
        if fold(t) not in want or (i is not None and (want[fold(t)] is None or i > want[fold(t)])):
            want[fold(t)] = i
    assert Counter(rows) == Counter((i, t) for t, i in want.items())


def test_empty(table):
    assert exact_groups(table([])).count() == 0 and keep_one(table([])).count() == 0


def test_a_group_with_most_rows(table):
    rows = [(i, "copy" if i % 2 else f"text {i}") for i in range(400)]
    found = exact_groups(table(rows)).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in found) == expected(rows)


def test_plan_is_native(table):
    plan = exact_groups(table(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
