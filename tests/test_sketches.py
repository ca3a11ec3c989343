import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veedor.operators import quantiles, sketches

PROBS = {"a": 0.01, "b": 0.5, "c": 0.95}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if k % 3 else f"g{k % 7}", k % 4, rng.lognormvariate(8, 3)) for k in range(40_000)]
    data += [("hot", 1, None), ("hot", 1, float("nan")), ("none", 1, float("inf")), (None, 2, 5.0)]
    return data, spark.createDataFrame(data, "g string, y int, v double").repartition(4).cache()


def off(values, value, p):
    """How far the rank of ``value`` is from ``p``, as a share."""
    values = np.sort(values)
    lo, hi = np.searchsorted(values, value, "left") / len(values), np.searchsorted(values, value, "right") / len(values)
    return max(lo - p, p - hi, 0)


def finite(data, g=None):
    return [v for k, _, v in data if v is not None and np.isfinite(v) and (g is None or k == g)]


def test_merged_scopes(rows):
    """Any scope from the sketches of its parts, within the stated error of the rows themselves."""
    data, df = rows
    table = sketches.sketch_table(df, "v", ("g", "y"), size=512)
    (whole,) = sketches.quantiles_of(sketches.merged(table), PROBS).collect()
    assert whole.n == len(finite(data))
    assert all(off(finite(data), whole[c], p) <= 3 * sketches.rank_error(512) for c, p in PROBS.items())
    groups = {r.g: r for r in sketches.quantiles_of(sketches.merged(table, ("g",)), PROBS).collect()}
    assert groups["none"].n == 0 and groups["none"].b is None and groups[None].b == 5.0
    for g in ("hot", "g3"):
        assert groups[g].n == len(finite(data, g))
        assert all(off(finite(data, g), groups[g][c], p) <= 3 * sketches.rank_error(512) for c, p in PROBS.items())


def test_new_rows_are_added(rows):
    data, df = rows
    early = sketches.sketch_table(df.where("y < 2"), "v", ("g",))
    table = sketches.with_new_rows(early, df.where("y >= 2"), "v", ("g",))
    assert {r.g: r.n for r in table.collect()} == {g: len(finite(data, g)) for g in {k for k, _, _ in data} - {None}} | {None: 1}
    rank = table.where("g = 'hot'").select(sketches.ranks_of(table, F.lit(3000.0)).alias("r")).first().r
    assert rank == pytest.approx(np.mean(np.array(finite(data, "hot")) <= 3000.0), abs=3 * sketches.rank_error(sketches.SIZE))


def test_values_are_not_shuffled(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id * 1.5D AS v")
    plan = sketches.sketch_table(df, "v", ("g",))._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg" in plan.split("Exchange")[-1]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert sketches.sketch_table(none, "v", ("g",)).count() == 0
    (row,) = sketches.quantiles_of(sketches.sketch_table(none, "v", ()), PROBS).collect()
    assert row.n == 0 and row.a is None


# --- exact quantiles by way of sketches ----------------------------------------------------


def exact(data, g, p):
    return np.quantile(finite(data, g), p)


def test_exact_by_group(rows, monkeypatch):
    """Groups that are looked at around the ranks only; what is counted one by one is a small part."""
    data, df = rows
    seen = []
    real = quantiles._near_counts
    monkeypatch.setattr(quantiles, "_near_counts", lambda *a: seen.append(real(*a)) or seen[-1])
    found = {r.g: r for r in quantiles.exact_quantiles(df, "v", PROBS, ("g",), also={"n": F.count("*")}).collect()}
    for g in ("hot", "g0", "g5"):
        assert [found[g][c] for c in PROBS] == pytest.approx([exact(data, g, p) for p in PROBS.values()], rel=1e-12)
        assert found[g].n == sum(k == g for k, _, _ in data)
    assert found["none"].b is None and found["none"].n == 1 and found[None].b == 5.0
    assert seen[0].where("g = 'hot'").count() < 0.08 * len(finite(data, "hot"))


def test_a_missed_rank_is_noticed(rows, monkeypatch):
    """Ranges that do not hold the rank: the group is counted whole and the result is right."""
    data, df = rows
    real = quantiles._ranges
    moved = lambda f, p: real(f, p).withColumns({c: F.when(F.col("g") == "hot", F.transform(c, lambda x: x * 3 + 1)).otherwise(F.col(c)) for c in ("_lo", "_hi")})
    monkeypatch.setattr(quantiles, "_ranges", moved)
    whole = []
    count = quantiles._whole_counts
    monkeypatch.setattr(quantiles, "_whole_counts", lambda d, *a: whole.append({r.g for r in d.select("g").distinct().collect()}) or count(d, *a))
    found = {r.g: r for r in quantiles.exact_quantiles(df, "v", PROBS, ("g",)).collect()}
    assert whole == [{"hot"}]
    for g in ("hot", "g0"):
        assert [found[g][c] for c in PROBS] == pytest.approx([exact(data, g, p) for p in PROBS.values()], rel=1e-12)


# --- distinct values -----------------------------------------------------------------------


def test_distinct_values_of_months_add_up(spark):
    """Merged months equal the whole, and the whole is within the stated error; shared values count once."""
    df = spark.range(60_000).selectExpr("id % 3 AS pair", "id % 5 AS month", "concat('t', id % 20011) AS what")
    df = df.unionByName(spark.createDataFrame([(9, 1, None), (9, 2, "x"), (None, 1, "y")], "pair long, month long, what string"))
    monthly = sketches.distinct_table(df, F.col("what"), ("pair", "month"))
    merged = {r.pair: (r.n, r.d) for r in sketches.distinct_counts(sketches.distinct_merged(monthly, ("pair",)), "d").collect()}
    direct = {r.pair: (r.n, r.d) for r in sketches.distinct_counts(sketches.distinct_table(df, F.col("what"), ("pair",)), "d").collect()}
    exact = {r.pair: r.d for r in df.groupBy("pair").agg(F.count_distinct("what").alias("d")).collect()}
    assert merged.keys() == direct.keys() == exact.keys()
    for pair, (n, d) in merged.items():
        assert abs(d - exact[pair]) <= 4 * sketches.distinct_error() * exact[pair] and n == direct[pair][0]
        assert abs(direct[pair][1] - d) <= 0.02 * d
    assert merged[9] == (2, 1) and merged[None] == (1, 1)
    assert sketches.distinct_counts(sketches.distinct_merged(monthly.limit(0)), "d").first().n == 0
