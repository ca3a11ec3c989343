"""Trailing time-range counts that never sort an unbounded key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veedor.functions.times import HOUR_MICROS, epoch_hour, micros_in_hour
from veedor.runtime import stage

# A key with more different times than this is split by hour instead of being sorted in one
# task. There are at most (all times / HOT_ROWS) such keys. The results do not depend on it.
HOT_ROWS = 1_000_000


def trailing_counts(
    df: DataFrame,
    keys: tuple[str, ...],
    stamp: str,
    days: int,
    weight: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For each key and distinct time: ``n_filas`` rows at that time and ``n_ventana`` rows in
    ``[time - days, time]``, both ends included.

    Equals ``count(*) over (partition by keys order by stamp range between interval days day
    preceding and current row)``. Rows without a time are left out. ``weight`` is what a row
    counts, 1 by default.

    Rows with equal key and time are counted before the shuffle and staged: ``df`` is evaluated
    once. Keys of up to ``hot_rows`` times then go through one window; larger ones, if there
    are any, are split by hour.
    """
    window_days = max(1, int(days))
    rows = df.where(F.col(stamp).isNotNull()).select(
        *keys, stamp, (F.lit(1) if weight is None else weight).cast("bigint").alias("_w")
    )
    ticks = stage(rows.groupBy(*keys, stamp).agg(F.sum("_w").alias("n_filas")), "ticks")
    sizes = ticks.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = stage(sizes.where(F.col("_rows") > hot_rows).select(*keys), "hot-keys")
    if hot.isEmpty():
        return _within_key(ticks, keys, stamp, window_days)
    hot = hot.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [ticks[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
    small = _within_key(ticks.join(hot, same, "left_anti"), keys, stamp, window_days)
    large = _by_hour(ticks.join(hot, same, "left_semi"), keys, stamp, window_days)
    return small.unionByName(large)


def _within_key(ticks: DataFrame, keys: tuple[str, ...], stamp: str, days: int) -> DataFrame:
    counted = with_trailing(ticks, keys, stamp, days, F.col("n_filas"), "n_ventana")
    return counted.select(*keys, stamp, "n_filas", "n_ventana")


def with_trailing(rows: DataFrame, keys: tuple[str, ...], stamp: str, days: int, weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of a key in ``[time - days, time]``; rows without a time count for no other.

    One sort per key. Two running sums replace the sliding frame, whose cost would grow with
    the rows in the range. A key's rows meet in one task.
    """
    at = F.col(stamp)
    clock = epoch_hour(at) * HOUR_MICROS + micros_in_hour(at)
    by_time = Window.partitionBy(*keys).orderBy("_t")
    counted = F.sum(F.when(at.isNotNull(), weight))
    upto = counted.over(by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = counted.over(by_time.rangeBetween(Window.unboundedPreceding, -max(1, int(days)) * 24 * HOUR_MICROS - 1))
    found = rows.withColumn("_t", clock).withColumn(name, upto - F.coalesce(before, F.lit(0).cast("bigint")))
    return found.drop("_t")


def _by_hour(ticks: DataFrame, keys: tuple[str, ...], stamp: str, days: int) -> DataFrame:
    """The same counts for keys of any size; a key's rows never meet in one task.

    * the hours strictly inside the range are added up from hourly counts;
    * the two hours at the ends are compared by offset within (key, hour).
    """
    hours = days * 24
    at = F.col(stamp)
    ticks = ticks.withColumns({"_hour": epoch_hour(at), "_off": micros_in_hour(at)})
    none = F.lit(0).cast("bigint")
    no_time = F.lit(None).cast(ticks.schema[stamp].dataType)

    def entry(hour: Column, off: Column, time: Column, own: Column, past: Column, inner: Column):
        return [
            *[F.col(k) for k in keys], hour.alias("_hour"), off.alias("_off"), time.alias(stamp),
            own.alias("_own"), past.alias("_past"), inner.alias("_inner"),
        ]

    own = ticks.select(*entry(F.col("_hour"), F.col("_off"), at, F.col("n_filas"), none, none))
    past = ticks.select(
        *entry(F.col("_hour") + hours, F.col("_off"), no_time, none, F.col("n_filas"), none)
    )
    by_hour = Window.partitionBy(*keys).orderBy("_hour")
    until_last = F.sum("_n").over(by_hour.rangeBetween(Window.unboundedPreceding, -1))
    until_first = F.sum("_n").over(by_hour.rangeBetween(Window.unboundedPreceding, -hours))
    hourly = (
        ticks.groupBy(*keys, "_hour")
        .agg(F.sum("n_filas").alias("_n"))
        .withColumn("_inner", F.coalesce(until_last, none) - F.coalesce(until_first, none))
        .select(*entry(F.col("_hour"), none, no_time, none, none, F.col("_inner")))
    )

    one_hour = Window.partitionBy(*keys, "_hour").orderBy("_off")
    upto = one_hour.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = one_hour.rangeBetween(Window.unboundedPreceding, -1)
    whole = one_hour.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    past_since = F.sum("_past").over(whole) - F.coalesce(F.sum("_past").over(before), none)
    counted = own.unionByName(past).unionByName(hourly).select(
        *keys,
        stamp,
        F.col("_own").alias("n_filas"),
        (F.sum("_own").over(upto) + past_since + F.max("_inner").over(whole)).alias("n_ventana"),
    )
    return counted.where(F.col(stamp).isNotNull())
