"""Repeats of an id at any distance in time: an index of ids in files instead of keyed state.

Ids lie in buckets by their hash, one folder per micro-batch. Each batch also writes a Bloom filter per bucket.
A new batch asks the filters first; only ids that a filter may hold are compared with the ids themselves, in the
buckets concerned, so false positives cost a read and change nothing. After ``LAYERS`` batches the filters of a
bucket are built again as one, of the size that its ids need.

A batch reads what earlier batches wrote and overwrites its own folders, so running it again gives the same rows.
NULL ids are never repeats. Of rows of one id in a batch the earliest stays, of equal times the one with the smallest hash.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veedor.runtime import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
BITS_PER_ID = 10
PROBES = 7
LAYERS = 16
_FILTER = "bucket int, bits binary"


def _places(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of each hash, a row of ``PROBES``."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h & np.uint64(0xFFFFFFFF))[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(n_bits)


def build_filter(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, BITS_PER_ID * len(hashes) + 7 & ~7), bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    at = _places(hashes, 8 * len(raw))
    return (raw[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(1)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "bits": [build_filter(group["h"].to_numpy())]})


def _probe(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hashes = ids["h"].to_numpy()
    found = np.zeros(len(hashes), bool)
    for packed in filters["bits"]:
        found |= may_hold(packed, hashes)
    return ids.loc[found, ["h"]]


class IdIndex:
    """Ids seen so far, at ``path`` (a folder all executors reach)."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = BUCKETS):
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), n_buckets

    def _hash(self, column: Column) -> Column:
        return F.xxhash64(column.cast("string"))

    def _done(self, kind: str, before: int) -> list[int]:
        """Batches under ``before`` whose folder is complete."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        marker = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch={n}/_SUCCESS")
        return [n for n in numbers if n < before and files.exists(marker(n))]

    def _ids(self, before: int) -> DataFrame | None:
        folders = [f"{self.path}/ids/batch={n}" for n in self._done("ids", before)]
        reader = self.spark.read.schema("id string, h long, batch int, bucket int").option("basePath", f"{self.path}/ids")
        return reader.parquet(*folders) if folders else None

    def _filters(self, before: int) -> DataFrame | None:
        merged = self._done("merged", before)[-1:]
        layers = [n for n in self._done("filters", before) if not merged or n > merged[0]]
        folders = [*(f"merged/batch={n}" for n in merged), *(f"filters/batch={n}" for n in layers)]
        reader = self.spark.read.schema(_FILTER).option("recursiveFileLookup", "true")  # the folders' names are no columns here
        return reader.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def known(self, ids: DataFrame, before: int) -> DataFrame:
        """Those of ``ids`` (id as text, h, bucket; staged, distinct) that batches under ``before`` hold."""
        filters = self._filters(before)
        if filters is None:
            return ids.limit(0).select("id")
        maybe = ids.select("bucket", "h").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_probe, "h long")
        maybe = stage(ids.join(maybe.distinct(), "h", "left_semi"), "ids-maybe")
        buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # bucket numbers, at most n_buckets
        if not buckets:
            return ids.limit(0).select("id")
        stored = self._ids(before).where(F.col("bucket").isin(buckets)).select("bucket", "id")
        return maybe.join(stored, ["bucket", "id"], "left_semi").select("id")

    def fresh(self, rows: DataFrame, row_id: str, stamp: str, batch: int) -> DataFrame:
        """Rows whose id no earlier batch holds, one per id; the index then holds their ids as of ``batch``. Staged."""
        named = rows.select(F.struct("*").alias("row"))
        own = F.col(f"row.`{row_id}`")
        order = F.struct(F.col(f"row.`{stamp}`"), F.xxhash64("row"))
        one = named.where(own.isNotNull()).groupBy(own.cast("string").alias("id")).agg(F.min_by("row", order).alias("row"))
        h = self._hash(F.col("id"))
        one = stage(one.select("id", h.alias("h"), F.pmod(h, F.lit(self.n_buckets)).cast("int").alias("bucket"), "row"), "ids-batch")
        known = self.known(one.select("id", "h", "bucket"), batch)
        new = stage(one.join(known, "id", "left_anti"), "ids-new")
        ids = new.select("id", "h", "bucket").repartition("bucket")
        ids.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/batch={batch}")
        built = new.select("bucket", "h").groupBy("bucket").applyInPandas(_build, _FILTER)
        built.write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")
        if batch % LAYERS == LAYERS - 1:
            whole = self._ids(batch + 1).select("bucket", "h").groupBy("bucket").applyInPandas(_build, _FILTER)
            whole.write.mode("overwrite").parquet(f"{self.path}/merged/batch={batch}")
        return new.select("row.*").unionByName(named.where(own.isNull()).select("row.*"))


def drop_all_repeats(feed: DataFrame, row_id: str, stamp: str, path: str, n_buckets: int = BUCKETS) -> DataFrame:
    """First arrivals of what has come into ``feed``, however late a repeat is; ``path`` holds output, index and
    checkpoint, and called again with the same one the feed goes on where it stopped."""
    spark = feed.sparkSession
    index = IdIndex(spark, f"{path}/index", n_buckets)

    def take(rows: DataFrame, batch: int) -> None:
        index.fresh(rows, row_id, stamp, batch).write.mode("overwrite").parquet(f"{path}/rows/{batch}")

    writer = feed.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(take).start().awaitTermination()
    return spark.read.schema(T.StructType(feed.schema.fields)).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
