"""Isolation Forest (Liu, Ting and Zhou, 2008): trees grown in parallel, scores on workers."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The functions below travel to the executors whole: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
SAMPLE = 256
MIN_ROWS = 10
_SPARE = 1.5  # candidates drawn per tree, so that a short draw is practically impossible

_TREE_SCHEMA = (
    "arbol int, filas int, variable array<int>, corte array<double>, "
    "izquierda array<int>, derecha array<int>, largo array<double>"
)

_TREE_COLUMNS = ("variable", "corte", "izquierda", "derecha", "largo")
_MODEL_SCHEMA = (
    "arbol int, variable array<int>, corte array<double>, izquierda array<int>, derecha array<int>, "
    "largo array<double>, escala double, columnas array<string>, minimo double, maximo double"
)


def _expected_path(m: int) -> float:
    """Average path of an unsuccessful search among m rows."""
    if m < 2:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1) + np.euler_gamma) - 2.0 * (m - 1) / m


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: at most ``trees`` x (2 x SAMPLE - 1) nodes whatever the input size."""

    trees: list[dict]
    scale: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _score_rows(self.trees, self.scale, rows)


#: Rows scored at a time, as many as an Arrow batch has by default: their nodes and values stay in the processor's cache.
_BLOCK = 10_000


def _levels(tree: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree with every leaf carried down to its lowest level: node k's children are 2k + 1 and 2k + 2, so that a step
    is arithmetic. (variable and cut of the inner nodes, lengths of the lowest level.)"""
    variable, cut, at = [], [], np.zeros(1, dtype=np.int64)
    while (tree["variable"][at] >= 0).any():
        inner = tree["variable"][at] >= 0
        variable.append(np.where(inner, tree["variable"][at], 0))
        cut.append(tree["corte"][at])
        children = np.where(inner, tree["izquierda"][at], at), np.where(inner, tree["derecha"][at], at)
        at = np.stack(children, axis=1).ravel()
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return flat(variable, np.int64), flat(cut, float), tree["largo"][at]


def _score_rows(trees: list[dict], scale: float, rows: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / scale) of every row, one tree level at a time for a block of rows."""
    if not trees or scale == 0.0:
        return np.zeros(len(rows))
    total = np.zeros(len(rows))
    levelled = [_levels(tree) for tree in trees]
    for first in range(0, len(rows), _BLOCK):
        block = rows[first : first + _BLOCK]
        n = len(block)
        values = np.ascontiguousarray(block.T).ravel()  # value of variable v in row r: v * n + r
        line, own = np.arange(n), total[first : first + n]
        node, place, value, cuts = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
        below = np.empty(n, bool)
        for variable, cut, length in levelled:
            if not len(cut):
                own += length[0]
                continue
            starts = variable * n
            np.less(values[starts[0] : starts[0] + n], cut[0], out=below)  # all rows stand at the root
            np.subtract(2, below, out=node)
            for _ in range(len(length).bit_length() - 2):
                # mode="clip" writes to ``out`` without a copy; every index is in range.
                np.take(starts, node, out=place, mode="clip")
                place += line
                np.take(values, place, out=value, mode="clip")
                np.take(cut, node, out=cuts, mode="clip")
                np.less(value, cuts, out=below)
                node *= 2
                node += 2
                node -= below
            node -= len(cut)
            np.take(length, node, out=value, mode="clip")
            own += value
    return np.exp2(-total / len(trees) / scale)


def draw_samples(
    df: DataFrame,
    features: tuple[str, ...],
    keys: tuple[str, ...],
    trees: int,
    sample: int,
    seed: int,
    n: int,
) -> DataFrame:
    """(arbol, u, h, x): of ``n`` rows at most ``sample`` rows per tree, chosen by hashing the row key.

    The choice does not depend on partitioning: every row is offered to every tree with the same
    small chance, independently, whatever the number of rows.
    """
    share = F.lit(_SPARE * sample / max(n, 1))

    def unit(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))

    base = df.select(
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.xxhash64(F.lit(seed), *keys).alias("h"),
    )
    # A fixed number of partitions: these few rows are otherwise merged into one task, and
    # all trees would grow there.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    offered = (
        # Exploded, the offers are made in compiled code; nearly all end at the filter, in the same loop.
        base.select("x", "h", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("arbol"))
        .withColumn("u", unit(F.col("h"), F.col("arbol")))
        .where(F.col("u") < share)
        .repartition(tasks, "arbol")
    )
    rank = F.row_number().over(Window.partitionBy("arbol").orderBy("u", "h", "x"))
    return offered.withColumn("_r", rank).where(F.col("_r") <= sample).select("arbol", "u", "h", "x")


def _grow(sample: int, seed: int):
    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["u", "h"], kind="stable")
        rows = np.vstack(group["x"].to_numpy())
        number = int(group["arbol"].iloc[0])
        rng = np.random.default_rng([seed, number])
        limit = math.ceil(math.log2(max(len(rows), 2)))
        variable, cut, left, right, length = [], [], [], [], []

        def leaf(members: np.ndarray, depth: int) -> int:
            variable.append(-1)
            cut.append(0.0)
            left.append(-1)
            right.append(-1)
            length.append(depth + _expected_path(len(members)))
            return len(variable) - 1

        pending = [(leaf(rows, 0), rows, 0)]
        while pending:
            node, members, depth = pending.pop()
            low, high = members.min(axis=0), members.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= limit or len(members) < 2 or len(varied) == 0:
                continue
            chosen = int(rng.choice(varied))
            # In (low, high]: both sides get a row.
            at = high[chosen] - rng.random() * (high[chosen] - low[chosen])
            below = members[:, chosen] < at
            if not below.any() or below.all():
                continue
            variable[node], cut[node] = chosen, float(at)
            left[node] = leaf(members[below], depth + 1)
            right[node] = leaf(members[~below], depth + 1)
            pending.append((left[node], members[below], depth + 1))
            pending.append((right[node], members[~below], depth + 1))
        return pd.DataFrame(
            {
                "arbol": [number], "filas": [len(rows)], "variable": [variable], "corte": [cut],
                "izquierda": [left], "derecha": [right], "largo": [length],
            }
        )

    return grow


def fit_forest(
    df: DataFrame,
    features: tuple[str, ...],
    keys: tuple[str, ...],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
    n: int | None = None,
) -> Forest:
    """Grow the trees in parallel; only the finished ones (bounded) reach the driver.

    ``n`` is the row count when it is already known.
    """
    drawn = draw_samples(df, features, keys, trees, sample, seed, df.count() if n is None else n)
    grown = drawn.groupBy("arbol").applyInPandas(_grow(sample, seed), _TREE_SCHEMA).collect()
    flat = [
        {c: np.asarray(row[c]) for c in ("variable", "corte", "izquierda", "derecha", "largo")}
        for row in sorted(grown, key=lambda r: r["arbol"])
    ]
    return Forest(flat, _expected_path(max((row["filas"] for row in grown), default=0)))


def with_anomaly(
    df: DataFrame, features: tuple[str, ...], forest: Forest, name: str, n: int | None = None
) -> DataFrame:
    """Add the anomaly score in (0, 1); with fewer than MIN_ROWS rows it is 0 for all."""
    if (df.count() if n is None else n) < MIN_ROWS:
        return df.withColumn(name, F.lit(0.0))
    model = df.sparkSession.sparkContext.broadcast((forest.trees, forest.scale))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_score_rows(*model.value, batch.to_numpy(dtype=float)), dtype=float)

    inputs = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    return df.withColumn(name, score(inputs))


def normalized(df: DataFrame, source: str, name: str) -> DataFrame:
    """Min-max to [0, 1]; 0 for all rows when the range is under 1e-12."""
    low, high = df.agg(F.min(source), F.max(source)).first()
    if low is None or high - low < 1e-12:
        return df.withColumn(name, F.lit(0.0))
    return df.withColumn(name, (F.col(source) - F.lit(low)) / F.lit(high - low))


@dataclass(frozen=True)
class SavedForest:
    """A fitted forest with the columns it reads and the range of the raw scores it was fitted on."""

    forest: Forest
    features: tuple[str, ...]
    low: float
    high: float
    version: int

    def scored(self, df: DataFrame, raw: str, name: str) -> DataFrame:
        """Add the raw score and its place in the range of the fit, 0 to 1; no state and no refit, so a feed will do.

        Rows outside the range get its nearest end. A model of too few rows, or of equal scores, gives 0.
        """
        found = with_anomaly(df, self.features, self.forest, raw, n=MIN_ROWS if self.forest.trees else 0)
        span = self.high - self.low
        place = (F.col(raw) - F.lit(self.low)) / F.lit(span) if span >= 1e-12 else F.lit(0.0)
        return found.withColumn(name, F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)))


def fit_saved(df: DataFrame, features: tuple[str, ...], keys: tuple[str, ...], version: int = 1, **options) -> SavedForest:
    """Fit on ``df`` (staged, as it is read several times) and take the range of its scores."""
    n = df.count()
    forest = fit_forest(df, features, keys, n=n, **options) if n >= MIN_ROWS else Forest([], 0.0)
    low, high = with_anomaly(df, features, forest, "_raw", n).agg(F.min("_raw"), F.max("_raw")).first()
    return SavedForest(forest, tuple(features), low or 0.0, high or 0.0, version)


def save_forest(spark: SparkSession, model: SavedForest, path: str) -> None:
    """The model as a folder of its version under ``path``: a row per tree. A version is written once."""
    head = (model.forest.scale, list(model.features), model.low, model.high)
    trees = [(k, *(t[c].tolist() for c in _TREE_COLUMNS), *head) for k, t in enumerate(model.forest.trees)]
    empty = (-1, *([] for _ in _TREE_COLUMNS), *head)  # a model without trees keeps its columns
    table = spark.createDataFrame(trees or [empty], _MODEL_SCHEMA)
    table.coalesce(1).write.parquet(f"{path}/version={model.version}")


def load_forest(spark: SparkSession, path: str, version: int | None = None) -> SavedForest:
    """A version of the model at ``path``, the newest by default."""
    table = spark.read.schema(f"{_MODEL_SCHEMA}, version int").parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("arbol").collect()  # one row per tree
    if not rows:
        raise ValueError(f"no version {version} at {path}")
    trees = [{c: np.asarray(r[c]) for c in _TREE_COLUMNS} for r in rows if r["arbol"] >= 0]
    head = rows[0]
    return SavedForest(Forest(trees, head["escala"]), tuple(head["columnas"]), head["minimo"], head["maximo"], version)
