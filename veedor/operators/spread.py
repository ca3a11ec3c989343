"""Joins of rows with one-row-per-group tables when a group may be very large."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veedor.runtime import stage

SALTS = 32

#: Hash buckets of a key, whose rows are counted to find keys that are too large for one task.
KEY_BUCKETS = 1 << 16
#: A bucket with more rows than this is split by the key's other columns.
HOT_BUCKET_ROWS = 500_000
#: Rows of a task, about, that are dealt by key: what they are grouped and sorted in stays small at any size.
TASK_ROWS = 250_000


def _salt(spread_by: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")


def parted_by_size(rows: DataFrame, key: str, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (staged, as they are read twice) in two parts without a key in common: those whose key has few rows, dealt
    by it, so that whatever is grouped by this key and others needs no further shuffle; and those of the hash buckets
    with more than ``hot_rows`` rows, as they are (None if there are none)."""
    hot_rows = HOT_BUCKET_ROWS if hot_rows is None else hot_rows
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")
    sizes = stage(rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")), "bucket-sizes")
    is_hot = F.col("_n") > hot_rows
    cold_rows, n_hot = sizes.agg(F.coalesce(F.sum(F.when(~is_hot, F.col("_n"))), F.lit(0)), F.count_if(is_hot)).first()
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(cold_rows / TASK_ROWS), min(parallel, math.ceil(cold_rows / 10_000)))
    if n_hot == 0:
        return rows.repartition(tasks, key), None
    hot = F.broadcast(sizes.where(is_hot).select("_bucket"))  # at most KEY_BUCKETS rows
    keyed = rows.withColumn("_bucket", bucket)
    few = keyed.join(hot, "_bucket", "left_anti").drop("_bucket")
    return few.repartition(tasks, key), keyed.join(hot, "_bucket", "left_semi").drop("_bucket")


def attach_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: tuple[str, ...],
    spread_by: tuple[str, ...],
    how: str = "inner",
) -> DataFrame:
    """Join ``stats`` (one row per key) to ``rows``; a hot key is split over SALTS tasks.

    Meant for few groups: every group is copied SALTS times. NULL keys match NULL keys.
    """
    left = rows.withColumn("_salt", _salt(spread_by))
    right = stats.withColumnsRenamed({k: f"_s_{k}" for k in keys}).withColumn(
        "_s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    same = [left["_salt"] == right["_s_salt"]] + [
        left[k].eqNullSafe(right[f"_s_{k}"]) for k in keys
    ]
    joined = left.join(right, reduce(lambda a, b: a & b, same), how)
    return joined.drop("_salt", "_s_salt", *[f"_s_{k}" for k in keys])


def attach_total(
    rows: DataFrame,
    key: str,
    measure: str,
    name: str,
    spread_by: tuple[str, ...],
    combine: Callable[[str], Column] = F.sum,
) -> DataFrame:
    """Add the sum (or ``F.min``, ``F.max``) of ``measure`` over all rows with the same key; rows
    with a NULL key drop out.

    Meant for many groups of which a few are hot. Sums are taken per (key, salt) first, so
    the second step sees at most SALTS rows per key, and the total goes back only to the
    (key, salt) pairs that exist.
    """
    salted = rows.where(F.col(key).isNotNull()).withColumn("_salt", _salt(spread_by))
    partial = salted.groupBy(key, "_salt").agg(combine(measure).alias("_part"))
    totals = (
        partial.groupBy(key)
        .agg(combine("_part").alias(name), F.collect_list("_salt").alias("_salts"))
        .select(key, name, F.explode("_salts").alias("_salt"))
    )
    return salted.join(totals, [key, "_salt"]).drop("_salt")
