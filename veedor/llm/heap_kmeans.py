"""Centroid clustering whose bounds lie in heaps.

Vectors stay in blocks of ``BLOCK`` rows. Every block has one heap per cluster. An entry is a vector of
that cluster under its gap: the lower bound of its distance to any other centroid less the upper
bound of the distance to its own. When centroids move, no entry is touched: the cluster's
accumulated drift (how far its own centroid and the fastest other one have come) grows instead, and
an entry holds its gap plus the drift at the time it was pushed. Entries at or under the drift are
popped from the top; only their vectors are rescanned exactly, and pushed anew. All others provably stay.

Blocks are written once as a table bucketed by block, and so are the heaps of each round, so a
round joins the two without a shuffle. What moves between tasks and the driver is, per round, the count
and the component sums of the vectors that changed sides: one vector per cluster, whatever the rows.

Arithmetic is exact: components are integers, distances and sums are integers, and gaps, which are
doubles, are narrowed by more than their rounding can be.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veedor.llm.arrays import tidy
from veedor.llm.tables import delete, narrow_ids
from veedor.runtime import new_path, stage

BLOCK = 1024
#: Bytes of vectors that one task reads.
BUCKET_BYTES = 32 << 20
#: Components are at most this large in size, so that a squared distance over 64 of them fits a long.
LARGEST = 1 << 27
#: Relative rounding that bounds allow for; that of a few additions and a square root is below 1e-15.
SLACK = 1e-9

_STATE = "block long, keys binary, rows binary, sizes array<int>, moved array<struct<cluster: int, n: long, sums: array<long>>>"


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = points - centroid
    return np.einsum("ij,ij->i", d, d)


class Heaps:
    """One heap of (key, row) per cluster over the rows of a block."""

    def __init__(self, n_clusters: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(n_clusters)]

    @staticmethod
    def unpack(keys: bytes, rows: bytes, sizes: list[int]) -> Heaps:
        found, at = Heaps(len(sizes)), 0
        k, r = np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist()
        for c, n in enumerate(sizes):
            found.heaps[c] = list(zip(k[at : at + n], r[at : at + n]))
            at += n
        return found

    def pack(self) -> tuple[bytes, bytes, list[int]]:
        entries = [e for heap in self.heaps for e in heap]
        keys = np.array([k for k, _ in entries], np.float64).tobytes()
        return keys, np.array([r for _, r in entries], np.int32).tobytes(), [len(h) for h in self.heaps]

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose gap is used up, popped, and the clusters they were in."""
        rows, clusters = [], []
        for c, heap in enumerate(self.heaps):
            limit = float(drift[c])
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                clusters.append(c)
        return np.array(rows, np.int64), np.array(clusters, np.int64)

    def push(self, rows: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for r, c, k in zip(rows.tolist(), clusters.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[c], (k, r))

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for c, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = c
        return out


def rescan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each point (ties: the smaller number) and a gap that is never too wide."""
    distance = np.stack([squared(points, c) for c in centroids], axis=1)
    nearest = distance.argmin(axis=1)
    at = np.arange(len(points))
    own = np.sqrt(distance[at, nearest].astype(np.float64))
    distance[at, nearest] = np.iinfo(np.int64).max
    other = np.sqrt(distance.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(points), np.inf)
    return nearest, (other - own) - SLACK * (1 + own + np.where(np.isinf(other), 0, other))


def advance(heaps: Heaps, points: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> list[dict]:
    """Bring the heaps up to date; what each cluster gained and lost."""
    rows, before = heaps.expired(drift)
    if not len(rows):
        return []
    after, gap = rescan(points[rows], centroids)
    heaps.push(rows, after, gap + drift[after] - SLACK * drift[after])
    return _moves(points[rows], before, after)


def _moves(points: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    out = []
    moved = before != after
    for c in np.unique(np.concatenate([before[moved], after[moved]])).tolist():
        gained, lost = moved & (after == c), moved & (before == c)
        if c >= 0:
            sums = points[gained].sum(axis=0) - points[lost].sum(axis=0)
            out.append({"cluster": c, "n": int(gained.sum() - lost.sum()), "sums": sums.tolist()})
    return out


def begin(points: np.ndarray, centroids: np.ndarray) -> tuple[Heaps, list[dict]]:
    heaps = Heaps(len(centroids))
    nearest, gap = rescan(points, centroids)
    heaps.push(np.arange(len(points)), nearest, gap)
    return heaps, _moves(points, np.full(len(points), -1), nearest)


# --- tables --------------------------------------------------------------------------------


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """id, v: vectors of ``size`` finite components as integers floor(scale * x)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(v, lambda x: F.abs(x.cast("double") * scale) < float(LARGEST))
    error = F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}: squared distances would not fit a long"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("int"))
    wanted = v.isNotNull() & (F.size(v) == size) & finite
    rows = df.where(F.coalesce(wanted, F.lit(False)))
    return rows.select(narrow_ids(df, id_col).alias("id"), F.when(small, whole).otherwise(error).alias("v"))


def _packer(id_type: pa.DataType):
    def run(batches):
        held, n, number = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(BLOCK - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == BLOCK:
                    yield _block(held, number, id_type)
                    held, n, number = [], 0, number + 1
        if n:
            yield _block(held, number, id_type)

    return run


def _block(held: list[pa.RecordBatch], number: int, id_type: pa.DataType) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column("id").combine_chunks().cast(id_type)
    values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4")
    key = TaskContext.get().partitionId() << 32 | number
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), lists, pa.array([values.tobytes()], pa.binary())], ["block", "ids", "vectors"])


def _points(row: pa.Table) -> np.ndarray:
    n = len(row.column("ids")[0].values)
    return np.frombuffer(row.column("vectors")[0].as_py(), "<i4").reshape(n, -1).astype(np.int64)


def _state_row(block: int, heaps: Heaps, moved: list[dict]) -> pa.Table:
    keys, rows, sizes = heaps.pack()
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    return pa.table(
        {
            "block": pa.array([block], pa.int64()),
            "keys": pa.array([keys], pa.binary()),
            "rows": pa.array([rows], pa.binary()),
            "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "moved": pa.array([moved], kind),
        }
    )


class Bucketed:
    """Tables in the shared folder bucketed by block into the same number of buckets."""

    def __init__(self, spark: SparkSession, n_buckets: int):
        self.spark, self.n, self.held = spark, n_buckets, {}

    def write(self, df: DataFrame, name: str) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        self.held[table] = new_path(self.spark, name)
        df.write.bucketBy(self.n, "block").format("parquet").option("path", self.held[table]).saveAsTable(table)
        return table

    def drop(self, *tables: str) -> None:
        for table in tables or list(self.held):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(self.spark, self.held.pop(table))


# --- the operator --------------------------------------------------------------------------


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    n_clusters: int = 8,
    rounds: int = 10,
    size: int = 64,
    scale: int = 1024,
    seed: str = "3:",
) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors of another length, and those with a NULL or non-finite component, are left out; a NULL vector is
    too. The first centroids are the vectors of the ``n_clusters`` smallest sha256 of ``seed`` and id; a NULL
    id counts as an empty one there and comes out as NULL. Rows that repeat an id are rows of their own; if
    they are among the first, the smaller vector comes first. With fewer vectors than clusters every vector is a
    centroid at first. No kept vectors: no rows. A component of 2^27 or more after scaling is an error. Other
    columns are not looked at.
    """
    spark = df.sparkSession
    kept = kept_vectors(df, id_col, vector_col, size, scale)
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("k"), "v").orderBy("k", "v").limit(n_clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), size)
    id_type = kept.schema["id"].dataType
    result = f"id {id_type.simpleString()}, cluster int, distance long"
    if not first:
        return _finish(spark.createDataFrame([], result), centroids, {})

    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    packed = stage(kept.mapInArrow(tidy(_packer(arrow_id)), f"block long, ids array<{id_type.simpleString()}>, vectors binary"), "vector-blocks")
    n_bytes = 4 * size * BLOCK * packed.count()
    n_buckets = max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / BUCKET_BYTES))
    tables = Bucketed(spark, n_buckets)
    blocks = tables.write(packed.repartition(n_buckets, "block"), "vectors")
    delete(spark, packed)

    def started(centroids: np.ndarray):
        def run(row: pa.Table) -> pa.Table:
            return _state_row(row.column("block")[0].as_py(), *begin(_points(row), centroids))

        return spark.table(blocks).groupBy("block").applyInArrow(run, _STATE)

    def continued(state: str, centroids: np.ndarray, drift: np.ndarray, finish: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            points = _points(left)
            heaps = Heaps.unpack(*(right.column(c)[0].as_py() for c in ("keys", "rows", "sizes")))
            moved = advance(heaps, points, centroids, drift)
            if not finish:
                return _state_row(left.column("block")[0].as_py(), heaps, moved)
            at = heaps.clusters(len(points))
            distance = np.zeros(len(points), np.int64)
            for c in np.unique(at):
                distance[at == c] = squared(points[at == c], centroids[c])
            return pa.table({"id": left.column("ids").combine_chunks().flatten(), "cluster": pa.array(at, pa.int32()), "distance": pa.array(distance, pa.int64())})

        left, right = spark.table(blocks).groupBy("block"), spark.table(state).drop("moved").groupBy("block")
        return left.cogroup(right).applyInArrow(run, result if finish else _STATE)

    k = len(centroids)
    sums, counts, drift = [[0] * size for _ in range(k)], [0] * k, np.zeros(k)
    state = tables.write(started(centroids), "heaps")
    for _ in range(rounds):
        for c, d, n, s in _moved(spark.table(state)):
            sums[c][d] += s
            counts[c] += n if d == 0 else 0
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64)
        if (new == centroids).all():
            break  # further rounds would change nothing
        drift, centroids = drift + _travel(centroids, new), new
        older, state = state, tables.write(continued(state, centroids, drift, False), "heaps")
        tables.drop(older)
    rows = stage(continued(state, centroids, drift, True), "clusters")
    tables.drop()
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    return _finish(rows, centroids, inertia)


def _moved(state: DataFrame) -> list[tuple[int, int, int, int]]:
    """(cluster, component, gained rows, gained sum): at most clusters x components rows."""
    each = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("d", "s"))
    total = each.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [(r.cluster, r.d, int(r.n), int(r.s)) for r in total.collect()]


def _travel(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much a gap of each cluster can have shrunk, rounded up."""
    moved = np.sqrt(np.array([((a - b) ** 2).sum() for a, b in zip(new, old)], np.float64)) * (1 + SLACK)
    others = [max(np.delete(moved, c), default=0.0) for c in range(len(moved))]
    return (moved + np.array(others)) * (1 + SLACK)


def _finish(rows: DataFrame, centroids: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def pick(values: list, kind: str) -> Column:
        made = F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>")
        return F.get(made, F.col("cluster"))

    return rows.select(
        "id",
        "cluster",
        "distance",
        pick([inertia.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        pick(digests, "string").alias("centroid_sha256"),
    )
