"""Quantile sketches that are kept, merged and asked without the rows they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Size parameter of kept sketches: some 80 KB for a large group, less for a small one.
SIZE = 4096


def rank_error(size: int) -> float:
    """Share of the rows by which a rank may be off, with 99 % confidence, for a sketch of that size."""
    return 2.296 / size**0.9021


def sketch(value: Column, size: int = SIZE) -> Column:
    """Aggregate: a KLL sketch of the values that are not NULL; partly made before any shuffle."""
    return F.kll_sketch_agg_double(value, F.lit(size))


def sketch_table(df: DataFrame, value: str, by: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """``by``, ``n`` and ``bosquejo``: one row per group, made in one pass; values themselves are not shuffled.

    NULL, NaN and infinite values are left out; a group without others has ``n`` 0.
    """
    v = F.col(value).cast("double")
    seen = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    return df.groupBy(*by).agg(F.count(seen).alias("n"), sketch(seen, size).alias("bosquejo"))


def merged(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A coarser scope: the groups of a sketch table added up to ``by``; equals sketching their rows."""
    return table.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double("bosquejo").alias("bosquejo"))


def with_new_rows(table: DataFrame, df: DataFrame, value: str, by: tuple[str, ...], size: int = SIZE) -> DataFrame:
    """The table after rows have been added: only the new rows are read."""
    return merged(table.unionByName(sketch_table(df, value, by, size)), by)


def quantiles_of(table: DataFrame, probs: dict[str, float]) -> DataFrame:
    """A column per name instead of the sketch; NULL for a group without values.

    A value is one of the rows'. With 99 % confidence its rank is within ``rank_error`` of the wanted one.
    """
    at = F.kll_sketch_get_quantile_double("bosquejo", F.array(*[F.lit(float(p)) for p in probs.values()]))
    found = table.withColumn("_q", F.when(F.col("n") > 0, at))
    return found.select(*[c for c in table.columns if c != "bosquejo"], *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(probs)])


def ranks_of(table: DataFrame, value: Column) -> Column:
    """Share of a group's rows up to a constant value; NULL for a group without values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_rank_double("bosquejo", value))


# --- distinct values -----------------------------------------------------------------------

#: Base-two logarithm of the size of a distinct sketch.
DISTINCT_SIZE = 12


def distinct_error(size: int = DISTINCT_SIZE) -> float:
    """Standard error of an estimate, as a share of it; small numbers are all but exact."""
    return 1.04 / 2 ** (size / 2)


def distinct_table(df: DataFrame, what: Column, by: tuple[str, ...], size: int = DISTINCT_SIZE) -> DataFrame:
    """``by``, ``n`` (rows) and ``distintos``: a sketch per group, say pair and month; partly made before the shuffle.

    NULLs are not counted among the values. Exact counting (``count_distinct``) cannot be added up over
    groups; these can.
    """
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(what, F.lit(size)).alias("distintos"))


def distinct_merged(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A coarser scope, values that several groups share counted once."""
    return table.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.hll_union_agg("distintos").alias("distintos"))


def distinct_counts(table: DataFrame, name: str) -> DataFrame:
    """The estimate under ``name`` instead of the sketch."""
    return table.withColumn(name, F.hll_sketch_estimate("distintos")).drop("distintos")
