"""Approximate nearest neighbours by learned partitions.

On a bounded sample: every vector's neighbours make a graph, the graph is cut into parts of equal size with
few edges between them, and small networks learn two things: which part a vector belongs to, and
in which parts the neighbours of a query lie. Every row is then placed by the first network; a
query goes to its most probable parts by the second, until their probabilities add up to a share that is
chosen on held-out vectors of the sample so that ``TARGET`` of their true neighbours are met. The
vectors of those parts are compared with the query exactly.

A part is cut into cells of bounded rows and queries, so that one part, or one vector, with a third
of all rows is spread. A query first meets the sample, which gives it a score that its last place will reach at
least; a cell only gives out rows of that score. Rows are compared in levels, each ``GROWTH`` times the one
before, and the bound rises from level to level: what cells give out stays at some ``GROWTH`` lists a query
and level, whatever the rows. Of equal vectors only the smallest ids can be among the nearest, so more of them than
a result has places are left out before anything is compared; equal query vectors are searched once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veedor.llm.arrays import tidy
from veedor.llm.tables import delete, narrow_ids
from veedor.runtime import new_path, stage

#: Distinct vectors that the networks are fitted on, about; all rows where there are fewer.
SAMPLE = 10_000
#: Rows of a part, about, and the most parts: a part needs enough of the sample to be learned.
PART_ROWS, MOST_PARTS = 2048, 256
#: Share of the true neighbours of held-out sample vectors that their parts must hold.
TARGET = 0.96
#: Rows and queries that meet in one cell, about.
CELL_ROWS, CELL_QUERIES = 4096, 2048
#: Rows of a level, as a multiple of those before it.
GROWTH = 20
HIDDEN, EPOCHS, BATCH, RATE = 128, 12, 256, 2e-3
_NEIGHBOURS = 20


class Network(NamedTuple):
    """One hidden layer; gives the probability of each part."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.a + self.b, 0) @ self.c + self.d
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


class Index(NamedTuple):
    size: int  # components of a vector
    n_parts: int
    norm: float  # the largest length in the sample
    place: Network | None  # none: there is one part
    route: Network | None
    share: float  # probability that the parts of a query add up to
    sample: np.ndarray  # rows, and the part that each is placed in
    sample_parts: np.ndarray

    @staticmethod
    def single(size: int) -> Index:
        return Index(size, 1, 1.0, None, None, 1.0, np.zeros((0, size)), np.zeros(0, np.int64))

    def least(self, vectors: np.ndarray, routes: list[np.ndarray], most: int) -> np.ndarray:
        """A score that the ``most`` best rows in the parts of each query reach; the sample's rows are among them.

        A few places more are counted: between two equally probable parts, rounding may place a row otherwise."""
        most += 4
        out = np.full(len(vectors), -np.inf)
        if len(self.sample) < most:
            return out
        slack = 1e-9 * np.linalg.norm(vectors, axis=1) * np.linalg.norm(self.sample, axis=1).max()
        for at in range(0, len(vectors), 256):
            s = vectors[at : at + 256] @ self.sample.T
            open_parts = np.zeros((len(s), self.n_parts), bool)
            for k, parts in enumerate(routes[at : at + 256]):
                open_parts[k, parts] = True
            s[~open_parts[:, self.sample_parts]] = -np.inf
            out[at : at + 256] = np.partition(s, -most, axis=1)[:, -most] - slack[at : at + 256]
        return out

    def parts_of(self, vectors: np.ndarray) -> np.ndarray:
        if self.n_parts == 1:
            return np.zeros(len(vectors), np.int64)
        return self.place.probabilities(features(vectors, self.norm)).argmax(axis=1)

    def routes(self, vectors: np.ndarray) -> list[np.ndarray]:
        if self.n_parts == 1:
            return [np.zeros(1, np.int64)] * len(vectors)
        p = self.route.probabilities(features(vectors, None))
        order = np.argsort(-p, axis=1, kind="stable")
        return [o[:n] for o, n in zip(order, visited(np.take_along_axis(p, order, 1), self.share))]


def visited(ordered: np.ndarray, share: float) -> np.ndarray:
    """How many of the probabilities, largest first, it takes to reach ``share``; two at least."""
    short = np.cumsum(ordered, axis=1, dtype=np.float64) < share
    return np.minimum(np.maximum(short.sum(axis=1) + 1, 2), ordered.shape[1])


def features(vectors: np.ndarray, norm: float | None) -> np.ndarray:
    """Direction, and length as a share of ``norm``: a query's length does not matter, a row's does."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    relative = np.zeros_like(length) if norm is None else np.minimum(length * largest / norm, 4)
    return np.hstack([scaled / length, relative]).astype(np.float32)


# --- fitting -------------------------------------------------------------------------------


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` other rows of largest inner product with each row."""
    n = len(vectors)
    out = np.zeros((n, k), np.int64)
    for at in range(0, n, 512):
        s = vectors[at : at + 512] @ vectors.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def split(vectors: np.ndarray, n_parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of equal size by repeated cuts at a quantile along the direction of most spread."""
    part = np.zeros(len(vectors), np.int64)

    def cut(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        own = vectors[rows] - vectors[rows].mean(axis=0)
        direction = rng.standard_normal(own.shape[1])
        for _ in range(8):  # power iteration
            direction = own.T @ (own @ direction)
            direction /= np.linalg.norm(direction) or 1
        order = rows[np.argsort(own @ direction, kind="stable")]
        left = n // 2
        middle = len(rows) * left // n
        cut(order[:middle], first, left)
        cut(order[middle:], first + left, n - left)

    cut(np.arange(len(vectors)), 0, n_parts)
    return part


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, n_parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cut the neighbour graph into parts of at most 5 % over equal size: starting from cuts in space,
    rows move to the part that holds most of their neighbours, those that gain most first, while there is room."""
    part = split(vectors, n_parts, rng)
    n, k = graph.shape
    ends = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    room = math.ceil(1.05 * n / n_parts)
    for _ in range(rounds):
        votes = np.zeros((n, n_parts), np.int32)
        np.add.at(votes, (ends[0], part[ends[1]]), 1)
        own = votes[np.arange(n), part]
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - own
        sizes = np.bincount(part, minlength=n_parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if not moved:
            break
    return part


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Network:
    """Cross entropy against shares per part, by Adam."""
    n_parts = target.shape[1]
    net = [
        (rng.standard_normal((x.shape[1], HIDDEN)) * math.sqrt(2 / x.shape[1])).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        (rng.standard_normal((HIDDEN, n_parts)) / math.sqrt(HIDDEN)).astype(np.float32),
        np.zeros(n_parts, np.float32),
    ]
    first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            hidden = np.maximum(x[own] @ net[0] + net[1], 0)
            error = (Network(*net).probabilities(x[own]) - target[own]) / len(own)
            back = (error @ net[2].T) * (hidden > 0)
            step += 1
            for w, g, m, v in zip(net, (x[own].T @ back, back.sum(0), hidden.T @ error, error.sum(0)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(*net)


def fit(vectors: np.ndarray, n_parts: int, target: float = TARGET, seed: int = 7) -> Index:
    """An index of ``n_parts`` parts from a sample of different vectors (float64)."""
    size = vectors.shape[1]
    if n_parts == 1 or len(vectors) <= 4 * n_parts or len(vectors) <= 2 * _NEIGHBOURS:
        return Index.single(size)
    rng = np.random.default_rng(seed)
    norm = float(np.linalg.norm(vectors, axis=1).max())
    scaled = (vectors / norm).astype(np.float32)
    graph = neighbours(scaled, _NEIGHBOURS)
    part = balanced_parts(scaled, graph, n_parts, rng)
    place = train(features(vectors, norm), np.eye(n_parts, dtype=np.float32)[part], rng)
    found = place.probabilities(features(vectors, norm)).argmax(axis=1)
    shares = np.zeros((len(vectors), n_parts), np.float32)
    np.add.at(shares, (np.repeat(np.arange(len(vectors)), _NEIGHBOURS), found[graph].ravel()), 1 / _NEIGHBOURS)
    held = rng.random(len(vectors)) < 0.2
    x = features(vectors, None)
    route = train(x[~held], shares[~held], rng)
    p = route.probabilities(x[held])
    order = np.argsort(-p, axis=1, kind="stable")
    ordered, met = np.take_along_axis(p, order, 1), np.cumsum(np.take_along_axis(shares[held], order, 1), axis=1)
    for share in [*np.arange(0.5, 1, 0.01).tolist(), 2.0]:  # the last: all parts
        if met[np.arange(len(met)), visited(ordered, share) - 1].mean() >= target:
            break
    return Index(size, n_parts, norm, place, route, share, vectors, found)


# --- tables --------------------------------------------------------------------------------


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, and two hashes of v that tell vectors apart."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    wanted = v.isNotNull() & fine & F.exists(v, lambda x: x != 0)
    kind = "float" if df.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = df.where(F.coalesce(wanted, F.lit(False))).select(narrow_ids(df, id_col).alias("id"), v.cast(f"array<{kind}>").alias("v"))
    return rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _by_length(batch: pa.RecordBatch, size: int):
    """Whether a vector has ``size`` components, and the matrix of those that have."""
    column = batch.column("v")
    fits = pc.equal(pc.list_value_length(column), size)
    own = column.filter(fits)
    return fits.to_numpy(zero_copy_only=False), _matrix(own, len(own))


def _placer(index: Index):
    def run(batches):
        for batch in batches:
            fits, vectors = _by_length(batch, index.size)
            # Vectors of another length have a part of their own: -1 - length.
            part = -1 - pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(vectors):
                part[fits] = index.parts_of(vectors)
            yield batch.append_column("part", pa.array(part, pa.int32()))

    return run


def _router(index: Index, most: int):
    def run(batches):
        for batch in batches:
            fits, vectors = _by_length(batch, index.size)
            parts = [np.array([-1 - n]) for n in pc.list_value_length(batch.column("v")).to_pylist()]
            least = np.full(batch.num_rows, -np.inf)
            if len(vectors):
                routes = index.routes(vectors)
                least[fits] = index.least(vectors, routes, most)
                for at, own in zip(np.flatnonzero(fits), routes):
                    parts[at] = own
            batch = batch.append_column("parts", pa.array([p.tolist() for p in parts], pa.list_(pa.int32())))
            yield batch.append_column("least", pa.array(least))

    return run


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def compare(rows: pa.Table, queries: pa.Table, most: int) -> pa.Table:
    """The ``most`` best rows of every query that reach its ``least``: largest inner product, then smallest id, NULL last."""
    a, b = _matrix(queries.column("v").combine_chunks(), queries.num_rows), _matrix(rows.column("v").combine_chunks(), rows.num_rows)
    ids = rows.column("id").combine_chunks()
    by_id = np.empty(len(ids), np.int64)
    by_id[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    floor = queries.column("least").to_numpy()
    slack = 1e-12 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
    found = []
    for at in range(0, len(a), 256):
        s = a[at : at + 256] @ b.T
        least = np.partition(s, -most, axis=1)[:, -most] if len(b) > most else np.full(len(s), -np.inf)
        least = np.maximum(least, floor[at : at + 256])
        q, r = np.nonzero(s >= (least - 2 * slack[at : at + 256])[:, None])
        q = q + at
        score = inner_products(a[q], b[r])
        reach = score >= floor[q]
        q, r, score = q[reach], r[reach], score[reach]
        order = np.lexsort((by_id[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < most
        found.append((q[keep], r[keep], score[keep]))
    q, r, score = (np.concatenate(x) for x in zip(*found))
    qh, qg = (queries.column(c).combine_chunks().take(pa.array(q)) for c in ("h", "g"))
    rh, rg = (rows.column(c).combine_chunks().take(pa.array(r)) for c in ("h", "g"))
    same = pc.and_(pc.equal(qh, rh), pc.equal(qg, rg))
    return pa.table({"h": qh, "g": qg, "id": ids.take(pa.array(r)), "score": pa.array(score), "same": same})


def _best(df: DataFrame, most: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*([F.col("score").desc()] if "score" in df.columns else []), F.col("id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def sample(rows: DataFrame, size: int, n: int, most: int) -> np.ndarray:
    """About ``most`` different vectors of ``size`` components out of ``n`` rows, chosen by their hash."""
    rate = min(1.0, most / max(n, 1))
    own = rows.where((F.size("v") == size) & (F.pmod("g", F.lit(1 << 30)) < math.ceil(rate * (1 << 30))))
    found = own.dropDuplicates(["h", "g"]).limit(2 * most).select("h", "v").toArrow().sort_by("h")
    return _matrix(found.column("v").combine_chunks(), found.num_rows)


def nearest(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    most: int = 20,
    part_rows: int = PART_ROWS,
    target: float = TARGET,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``most`` nearest found of every row of ``queries``, itself left out.

    ``queries`` are rows of ``df``; the row left out is one of the query's id and vector. Nearness is the inner
    product in double precision, ties go to the smaller id, a NULL id last. Vectors that are NULL, zero, or hold
    NULL or non-finite components take no part, on either side. Vectors of different lengths are not compared; the
    networks serve the most frequent length, all others are compared whole with those of their length. A query
    id that is NULL, or in several rows, has a result for each row. With up to ``part_rows`` rows there is one part,
    and the result is exact. Empty tables: no rows. Other columns are not looked at.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vector_col)
    asked = valid_vectors(queries, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.col("n").desc(), "size").first()
    kind, vector = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    if usual is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    n_parts = min(MOST_PARTS, math.ceil(usual.n / part_rows))
    index = Index.single(usual.size)
    if n_parts > 1:
        index = fit(sample(rows, usual.size, usual.n, SAMPLE), n_parts, target)
    columns = f"id {kind}, v {vector}, h long, g long"

    steps = [len(index.sample) / usual.n] if len(index.sample) else [1.0]
    while steps[-1] < 1:
        steps.append(steps[-1] * GROWTH)
    few = _best(rows, most + 1, "h", "g").drop("rank")
    share = F.pmod(F.xxhash64("g", "h"), F.lit(1 << 40)) / float(1 << 40)
    level = sum(((share >= min(f, 1.0)).cast("int") for f in steps), F.lit(0)) - (1 if len(steps) > 1 else 0)
    place = few.mapInArrow(tidy(_placer(index)), f"{columns}, part int").withColumn("level", F.greatest(level, F.lit(0)))
    path = new_path(spark, "placed-vectors")
    place.write.partitionBy("level").parquet(path)
    placed = spark.read.schema(place.schema).parquet(path)
    different = asked.dropDuplicates(["h", "g"])
    routed = stage(different.mapInArrow(tidy(_router(index, most + 1)), f"{columns}, parts array<int>, least double").drop("id"), "routed-queries")

    lists = None
    for number in range(max(1, len(steps) - 1)):
        met = _compared(placed.where(F.col("level") == number).drop("level"), routed, lists, most, kind)
        if lists is not None:
            before = lists.select("h", "g", F.explode("near").alias("x"))
            met = met.unionByName(before.select("h", "g", "x.id", "x.score", "x.same"))
        own = _best(met, most + 1, "h", "g").groupBy("h", "g")
        older, lists = lists, stage(own.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "same"))).alias("near")), "nearest")
        if older is not None:
            delete(spark, older)
    delete(spark, path)
    delete(spark, routed)
    return _own_left_out(asked.select(F.col("id").alias("query_id"), "h", "g").join(lists, ["h", "g"]), most)


def _compared(rows: DataFrame, routed: DataFrame, lists: DataFrame | None, most: int, kind: str) -> DataFrame:
    """h, g (the query's), id, score and same: of each cell the rows that can be among a query's ``most`` + 1 best."""
    if lists is not None:  # a full list's last score is the bound
        last = lists.where(F.size("near") > most).select("h", "g", F.element_at("near", -1)["score"].alias("last"))
        routed = routed.join(last, ["h", "g"], "left").withColumn("least", F.greatest("least", "last")).drop("last")
    sides = rows.select("part", F.lit(1).alias("r"), F.lit(0).alias("q")).unionByName(
        routed.select(F.explode("parts").alias("part"), F.lit(0).alias("r"), F.lit(1).alias("q"))
    )
    counts = sides.groupBy("part").agg(F.sum("r").alias("r"), F.sum("q").alias("q")).where("r > 0 AND q > 0")
    cells = stage(counts.select("part", F.ceil(F.col("r") / CELL_ROWS).cast("int").alias("n_r"), F.ceil(F.col("q") / CELL_QUERIES).cast("int").alias("n_q")), "cells")

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str, key: Column) -> DataFrame:
        met = df.join(cells, "part").withColumn(own, F.pmod(key, F.col(n_own)).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("n_r", "n_q")

    left = dealt(rows, "c", "d", "n_r", "n_q", F.xxhash64("h", "id"))
    right = dealt(routed.withColumn("part", F.explode("parts")).drop("parts"), "d", "c", "n_q", "n_r", F.col("g"))
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    empty = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("id", id_type), ("score", pa.float64()), ("same", pa.bool_())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not (rows.num_rows and queries.num_rows):
            return empty.empty_table()
        return compare(rows, queries, most + 1)

    keys = ("part", "c", "d")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"h long, g long, id {kind}, score double, same boolean")


def _own_left_out(found: DataFrame, most: int) -> DataFrame:
    """``near`` holds one place more than wanted: the query itself, if it is there, or the last one goes."""
    own = F.transform("near", lambda x: F.coalesce(x["same"] & x["id"].eqNullSafe(F.col("query_id")), F.lit(False)))
    at = F.array_position(own, True) - 1
    rest = F.slice(F.filter("near", lambda x, i: i != F.col("own")), 1, most)
    places = found.withColumn("own", at).select("query_id", F.posexplode(rest).alias("i", "x"))
    return places.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
