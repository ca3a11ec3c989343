import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veedor.llm import heap_kmeans as hk

SCHEMA = "vec_id long, embedding array<double>"


def expected(rows, k, rounds, size):
    """Every vector against every centroid in every round, in Python integers."""
    kept = [(i, [int(np.floor(8 * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                if own:
                    centres[n] = [sum(x) // len(own) for x in zip(*own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for d, _ in near)
    return sorted((str(i), n, d, sum(e for e, m in near if m == n), total, digest[n]) for (i, _), (d, n) in zip(kept, near))


def run(spark, rows, k=4, rounds=6, size=3, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    df = df.select("*", *(F.lit(0).alias(c) for c in ("id", "v", "block", "cluster", "moved", "k")))
    return sorted((str(r[0]), *r[1:]) for r in hk.cluster(df, n_clusters=k, rounds=rounds, size=size, scale=8).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hk, "BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(3) * 3 + 6 * (i % 5)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(200)]  # a third of all rows are one vector
    assert run(spark, rows) == expected(rows, 4, 6, 3)


def test_edges(spark):
    rows = [(1, [0.5, -0.5, 0.01]), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, []),
            (7, [1.0, 2.0]), (None, [0.0, 0.0, 0.0]), (None, [5.0, 5.0, 5.0]), (8, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (8, [-1.0, -1.0, -1.0])]
    assert run(spark, rows) == expected(rows, 4, 6, 3)
    assert run(spark, rows[:2]) == expected(rows[:2], 4, 6, 3)  # fewer vectors than clusters
    assert run(spark, rows[1:3]) == [] and run(spark, []) == []
    assert run(spark, rows, k=1) == expected(rows, 1, 6, 3)
    with pytest.raises(Exception, match="would not fit"):
        run(spark, [(1, [1e9, 0.0, 0.0])])


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "vec_id string, embedding array<float>")
    assert sorted(r.id for r in hk.cluster(df, size=2).collect()) == ["a", "b"]


def test_only_expired_gaps_are_scanned(monkeypatch):
    """Clusters apart from each other: a small move of the centroids pops nothing, a large one the vectors between."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-5, 6, (100, 2)), rng.integers(995, 1006, (100, 2)), [[500, 490]]])
    centres = np.array([[0, 0], [1000, 1000]])
    heaps, _ = hk.begin(points, centres)
    scanned = []
    real = hk.rescan
    monkeypatch.setattr(hk, "rescan", lambda p, c: scanned.append(len(p)) or real(p, c))
    new = np.array([[2, 2], [1000, 1000]])
    drift = hk._travel(centres, new)
    assert hk.advance(heaps, points, new, drift) == [] and not scanned
    further = np.array([[2, 2], [980, 980]])
    moved = hk.advance(heaps, points, further, drift + hk._travel(new, further))
    assert scanned == [1] and {m["cluster"]: m["n"] for m in moved} == {0: -1, 1: 1}


def test_no_shuffle_between_rounds(spark):
    tables = hk.Bucketed(spark, 3)
    a = tables.write(spark.range(100).select(F.col("id").alias("block"), F.lit(b"x").alias("vectors")), "vectors")
    b = tables.write(spark.range(100).select(F.col("id").alias("block"), F.lit(b"y").alias("keys")), "heaps")
    met = spark.table(a).groupBy("block").cogroup(spark.table(b).groupBy("block")).applyInArrow(lambda x, y: x.select(["block"]), "block long")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 100
    tables.drop()
    assert not tables.held and not spark.catalog.tableExists(a)
