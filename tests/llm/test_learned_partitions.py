from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veedor.llm import learned_partitions as lp


def exact(rows, most):
    """{query row: [(vec_id, score)]} by comparing all rows, products added up in order."""
    fine = [(i, [float(x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = defaultdict(list)
    for at, (q, a) in enumerate(fine):
        if q is not None and q % 20 == 0:
            near = []
            for k, (i, b) in enumerate(fine):
                if k != at and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    near.append((-s, i is None, i or 0, i))
            out[q].append([(x[3], -x[0]) for x in sorted(near)[:most]])
    return out


def run(spark, rows, most=5, kind="double", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    df = df.select("*", *(F.lit(0).alias(c) for c in ("id", "v", "h", "part", "score", "rank", "near", "own")))
    found = lp.nearest(df, df.where("vec_id % 20 = 0"), most=most, **options).collect()
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return out


def same(found, want):
    assert {q: sorted(x, key=str) for q, x in found.items()} == {
        q: sorted(((r + 1, i, s) for near in lists for r, (i, s) in enumerate(near)), key=str) for q, lists in want.items() if any(lists)}


def test_one_part_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lp, "CELL_ROWS", 60)
    monkeypatch.setattr(lp, "CELL_QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 4) / 2).tolist()) for i in range(300)]  # many ties
    rows += [(1000 + i, [1.0, 0.5, 1.0, -1.0]) for i in range(150)]  # a third are one vector, some of them queries
    same(run(spark, rows), exact(rows, 5))


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 2.0]), (7, [3.0, 3.0]), (20, [1.0, 1.0, 1.0]), (21, [1.0, 0.0, 1.0]), (40, [5.0]), (60, None), (80, [0.0, 0.0])]
    same(run(spark, rows), exact(rows, 5))
    assert run(spark, []) == {} and run(spark, rows[3:5]) == {} and run(spark, [(40, [5.0])]) == {}
    assert run(spark, [(0, [1.0]), (1, [2.0])], kind="float") == {0: [(1, 1, 2.0)]}


def test_parts_meet_the_neighbours(spark):
    """Vectors in groups: few parts are visited, and at least 0.9 of the true neighbours are found."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((24, 16)) * 3
    rows = [(i, (centres[i % 24] + rng.standard_normal(16)).tolist()) for i in range(2400)]
    index = lp.fit(np.array([v for _, v in rows]), 12)
    queries = np.array([v for i, v in rows if i % 20 == 0])
    assert np.mean([len(p) for p in index.routes(queries)]) < 6
    assert np.bincount(index.parts_of(np.array([v for _, v in rows])), minlength=12).max() < 3 * 2400 / 12
    found, want = run(spark, rows, 20, part_rows=200), exact(rows, 20)
    met = np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in want[q][0]}) / 20 for q in want])
    assert met >= 0.9
    scores = {(q, i): s for q in want for i, s in want[q][0]}
    assert all(scores[q, i] == s for q in found for _, i, s in found[q] if (q, i) in scores)


def test_levels(spark, monkeypatch):
    """Rows compared in several levels under a rising bound; equal vectors are in all of them."""
    monkeypatch.setattr(lp, "SAMPLE", 300)
    monkeypatch.setattr(lp, "GROWTH", 2)
    monkeypatch.setattr(lp, "CELL_ROWS", 100)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((10, 8)) * 2
    rows = [(i, (centres[i % 10] + rng.standard_normal(8)).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[7][1]) for i in range(700)] + [(None, rows[9][1])]
    met = []
    real = lp._compared
    monkeypatch.setattr(lp, "_compared", lambda *a: met.append(a[0].count()) or real(*a))
    found, want = run(spark, rows, 20, part_rows=400), exact(rows, 20)
    assert len(met) > 2 and sum(met) == 1500 + 20 + 1  # of equal vectors one more than there are places
    assert all([r for r, _, _ in x] == list(range(1, 21)) for x in found.values()) and set(found) == set(want)
    recall = {q: len({i for _, i, _ in found[q]} & {i for i, _ in want[q][0]}) / 20 for q in want}
    assert np.mean(list(recall.values())) >= 0.9
    scores = {(q, i): s for q in want for i, s in want[q][0]}
    assert all(scores[q, i] == s for q in found for _, i, s in found[q] if (q, i) in scores)


def test_rows_of_any_length_can_be_near(spark):
    """Long vectors are near to many queries: lengths are learned as well."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * rng.lognormal(0, 0.7)).tolist()) for i in range(1500)]
    found, want = run(spark, rows, 20, part_rows=200), exact(rows, 20)
    assert np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in want[q][0]}) / 20 for q in want]) >= 0.9


def test_table_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found, want = run(spark, rows, 20, part_rows=60, kind="float"), exact(rows, 20)
    assert set(found) == set(want)
    assert np.mean([len({i for _, i, _ in found[q]} & {i for i, _ in want[q][0]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("n_parts", [3, 8])
def test_parts_are_balanced(n_parts):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((600, 6))
    graph = lp.neighbours(points, 10)
    start = lp.split(points, n_parts, np.random.default_rng(0))
    part = lp.balanced_parts(points, graph, n_parts, np.random.default_rng(0))
    inside = lambda p: (p[graph] == p[:, None]).mean()
    assert np.bincount(part).max() <= np.ceil(1.05 * 600 / n_parts) and inside(part) >= inside(start)
