import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from veedor.streaming import feeds, known_ids
from veedor.streaming.known_ids import IdIndex, build_filter, drop_all_repeats, may_hold

SCHEMA = "k string, t timestamp_ntz, v int"
START = dt.datetime(2024, 1, 1)


def rows_of(spark, *rows):
    return spark.createDataFrame([(k, START + dt.timedelta(days=d), v) for k, d, v in rows], SCHEMA)


def found(df):
    return sorted((r.k or "", r.v) for r in df.collect())


def test_filters_miss_nothing_and_rarely_err():
    rng = np.random.default_rng(1)
    for n in (1, 7, 5000):
        inside, outside = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, 20_000)
        packed = build_filter(inside)
        assert may_hold(packed, inside).all() and may_hold(packed, outside).mean() < 0.03


def test_repeats_at_any_distance(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    first = rows_of(spark, ("a", 0, 1), ("b", 0, 2), ("b", 1, 3), (None, 0, 4), (None, 0, 4), ("", 0, 5))
    first.coalesce(1).write.mode("append").parquet(source)
    feed = feeds.contract_feed(spark, source, first.schema, maxFilesPerTrigger="1")
    want = [("", 4), ("", 4), ("", 5), ("a", 1), ("b", 2)]
    assert found(drop_all_repeats(feed, "k", "t", path, 4)) == want
    rows_of(spark, ("a", 400, 6), ("c", 1, 7), (None, 400, 8)).coalesce(1).write.mode("append").parquet(source)
    assert found(drop_all_repeats(feed, "k", "t", path, 4)) == sorted([*want, ("c", 7), ("", 8)])


def test_a_batch_run_again_gives_the_same(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "index"), 4)
    one, two = rows_of(spark, ("a", 0, 1), ("b", 0, 2)), rows_of(spark, ("b", 90, 3), ("c", 0, 4))
    index.fresh(one, "k", "t", 0)
    for _ in range(2):
        assert found(index.fresh(two, "k", "t", 1)) == [("c", 4)]
    assert found(index.fresh(one.limit(0), "k", "t", 2)) == []
    assert found(index.fresh(two, "k", "t", 3)) == []


def test_false_positives_are_resolved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known_ids, "BITS_PER_ID", 1)
    index = IdIndex(spark, str(tmp_path / "index"), 1)
    ids = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(START).cast("timestamp_ntz").alias("t"), F.col("id").cast("int").alias("v"))
    index.fresh(ids(0, 2000), "k", "t", 0)
    assert sorted(r.v for r in index.fresh(ids(1000, 4000), "k", "t", 1).collect()) == list(range(2000, 4000))


def test_filters_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known_ids, "LAYERS", 2)
    index = IdIndex(spark, str(tmp_path / "index"), 2)
    for k in range(4):
        assert found(index.fresh(rows_of(spark, ("same", k, k), (f"id{k}", k, k)), "k", "t", k)) == [(f"id{k}", k)] + [("same", 0)] * (k == 0)
    assert index._done("merged", 9) == [1, 3] and index._filters(4).count() <= 2
    assert found(index.fresh(rows_of(spark, ("id0", 99, 1), ("id3", 99, 1), ("new", 0, 2)), "k", "t", 4)) == [("new", 2)]
