import datetime as dt

from pyspark.sql import functions as F

from checks.compare import connect, difference
from checks.oracles import ORACLES
from veedor.functions.flags import enrich, enriched_columns
from veedor.plans.queries import QUERIES
from veedor.sources.star import contracts
from veedor.streaming import feeds
from tests.conftest import SF


def test_flags_equal_batch(spark, tmp_path):
    df = contracts(spark, SF)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    feed = feeds.contract_feed(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger="1")
    streamed = feeds.run_available(feeds.flag_feed(feed), "flags")
    batch = enriched_columns(enrich(df))
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).isEmpty()


def test_windows_over_several_files(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a" if i % 3 else "b", start + dt.timedelta(hours=7 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    for i in range(3):  # files in time order
        part = df.where((F.col("t") >= F.lit(start + dt.timedelta(days=14 * i)).cast("timestamp_ntz"))
                        & (F.col("t") < F.lit(start + dt.timedelta(days=14 * (i + 1))).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = feeds.contract_feed(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger="1")
    days = feeds.run_available(feeds.period_counts(feed, "t", "1 day", "1 day", "k"), "days").collect()
    last = max(t for _, t in rows)
    closed = [(k, t) for k, t in rows if dt.datetime(t.year, t.month, t.day) + dt.timedelta(days=2) <= last]
    assert sum(r.n for r in days) == len(closed)
    bursts = feeds.run_available(feeds.burst_feed(feed, "t", ("k",), 2, 4, "1 day"), "burst").collect()
    assert bursts and all(r.n >= 4 and r.hasta - r.desde == dt.timedelta(days=2) for r in bursts)


def test_repeats(spark, tmp_path):
    df = spark.createDataFrame([("x", dt.datetime(2024, 1, 1)), ("x", dt.datetime(2024, 1, 2)), ("y", dt.datetime(2024, 1, 3))],
                               "id string, t timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    feed = feeds.contract_feed(spark, str(tmp_path / "in"), df.schema)
    assert feeds.run_available(feeds.drop_repeats(feed, "t", "id", "5 days"), "ids").count() == 2


def test_events_in_a_folder_of_part_files(spark, tmp_path):
    """A table that is a folder gives what the single file gives: all rows, open windows included."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_daily_counts", "stream_sessions", "stream_repeats"):
        streamed = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert difference(streamed, connect(SF).execute(ORACLES[name]).df()) == ""
        if "n" in streamed:
            assert streamed["n"].sum() == events.count()


def test_a_restart_goes_on(spark, tmp_path):
    rows = [("x", dt.datetime(2024, 1, k)) for k in range(1, 5)]
    df = spark.createDataFrame(rows, "id string, t timestamp_ntz")
    df.limit(2).coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = feeds.contract_feed(spark, str(tmp_path / "in"), df.schema)
    counts = feeds.period_counts(feed, "t", "1 day", "1 day")
    path = str(tmp_path / "out")
    feeds.run_available(counts, "days", path)
    df.subtract(df.limit(2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = feeds.run_available(counts, "days", path).collect()
    assert sorted(r.desde.day for r in again) == [1, 2] and all(r.n == 1 for r in again)
