"""Exact quantiles without bringing a group's values together or moving most of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veedor.operators.sketches import rank_error, sketch
from veedor.runtime import single_value, stage

# Buckets per factor e of magnitude, and finer ones inside a bucket. A quantile only ever
# looks at the values of the one or two fine buckets that hold its ranks.
BUCKETS_PER_E = 1024
FINE_BUCKETS = 1024

# Size of the sketches that say where to look, and the share of a group on each side of a rank that is
# looked at. A rank outside is noticed, and its group counted in full.
SKETCH = 2048
AROUND = 3 * rank_error(SKETCH)


def _bucket(value: Column) -> Column:
    """Coarse bucket that never decreases as the value grows."""
    size = F.floor(F.log1p(F.abs(value)) * BUCKETS_PER_E)
    return F.when(value < 0, -size).otherwise(size)


def _fine(value: Column, low: Column, high: Column) -> Column:
    """Equal-width bucket between the smallest and largest value of a coarse one."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.floor(share * (FINE_BUCKETS - 1))).otherwise(F.lit(0))


def _running(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``_upto``: rows counted in ``_n`` up to and including this one, within ``keys``."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_upto", F.sum("_n").over(upto))


def _join_targets(values: DataFrame, targets: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = targets.withColumnsRenamed({c: f"_t{c}" for c in keys})
    same = [values[c].eqNullSafe(renamed[f"_t{c}"]) for c in keys]
    joined = values.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_t{c}" for c in keys])


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: tuple[str, ...] = (), weight: str | None = None,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: ``by`` columns plus one double column per name.

    NULL, NaN and infinite values are ignored; a group without values is missing (for
    ``by=()`` the one row holds NULL). ``weight`` names how many rows a row stands for. ``also`` are
    aggregates of all rows of each group, taken in the first pass; groups without values are then kept.

    1. One pass makes a sketch per group: where each wanted rank lies, give or take ``AROUND``.
    2. A second pass counts equal values there, and all other rows by the gap between two such ranges that
       they lie in. Only the values in the ranges move, some percent of the rows.
    3. ``_placed`` finds the exact ranks among these counts. If one lies in a gap, which the sketches
       allow with small probability, that group is counted whole.

    A table that is read from one place is read twice; one that joins several is evaluated once, into a file of
    the columns it has (pass those needed). A weighted one is counted in full.
    """
    if weight is None and df._jdf.queryExecution().optimizedPlan().collectLeaves().size() > 1:
        df = stage(df if also else df.select(*by, value), "quantile-values")
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    if weight is not None:
        return _placed(_whole_counts(df.where(finite), v, by, F.col(weight)), probs, by).drop("_missed")
    seen = F.when(finite, v)
    first = df.groupBy(*by).agg(
        sketch(seen, SKETCH).alias("_sketch"), F.count(seen).alias("_n"), *[c.alias(name) for name, c in (also or {}).items()]
    )
    ranges = stage(_ranges(first, probs).drop("_sketch"), "quantile-ranges")
    found = stage(_placed(_near_counts(df.where(finite), v, ranges.drop(*(also or {})), len(probs), by), probs, by), "quantiles")
    missed = found.where("_missed")
    if not missed.isEmpty():
        rows = _join_targets(df.where(finite), missed.select(*by), list(by), "left_semi") if by else df.where(finite)
        again = _placed(_whole_counts(rows, v, by, F.lit(1)), probs, by)
        found = found.where("NOT _missed").unionByName(again)
    found = found.drop("_missed")
    if not also:
        return found
    groups = ranges.select(*by, *also)
    return _join_targets(groups, found, list(by), "left") if by else groups.crossJoin(F.broadcast(found))


def _ranges(first: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Add ``_lo`` and ``_hi``: per rank, ascending, the values around it. Small groups are looked at whole."""
    wanted = sorted(probs.values())

    def ends(shift: float, outside: float) -> Column:
        ranks = [p + shift for p in wanted]
        at = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(min(max(r, 0.0), 1.0)) for r in ranks]))
        inner = F.transform(at, lambda q, i: F.when(F.get(F.lit([0.0 < r < 1.0 for r in ranks]), i), q).otherwise(outside))
        return F.when(F.col("_n") * AROUND >= 4, inner).otherwise(F.lit([outside] * len(ranks)))

    return first.withColumns({"_lo": ends(-AROUND, float("-inf")), "_hi": ends(AROUND, float("inf"))})


def _near_counts(df: DataFrame, v: Column, ranges: DataFrame, n_ranges: int, by: tuple[str, ...]) -> DataFrame:
    """(by, _v, _n, _out): rows per value in the ranges; rows of a gap under the smallest of their values."""
    rows = df.select(*by, v.alias("_v"))
    if by:
        rows = _join_targets(rows, ranges.drop("_n"), list(by))
    else:
        only = ranges.first()
        rows = rows.withColumns({c: F.array(*[F.lit(x) for x in only[c]]) for c in ("_lo", "_hi")})
    value = F.col("_v")
    lo, hi = ([F.get(c, F.lit(i)) for i in range(n_ranges)] for c in ("_lo", "_hi"))
    inside = reduce(lambda a, b: a | b, [(value >= x) & (value <= y) for x, y in zip(lo, hi)])
    gap = reduce(lambda a, b: a + b, [(value > y).cast("int") for y in hi])
    keyed = rows.select(*by, "_v", inside.alias("_in"), gap.alias("_gap"))
    counts = keyed.groupBy(*by, "_gap", F.when(F.col("_in"), value).alias("_k")).agg(F.count("*").alias("_n"), F.min("_v").alias("_v"))
    return stage(counts.select(*by, "_v", "_n", F.col("_k").isNull().alias("_out")), "quantile-counts")


def _whole_counts(df: DataFrame, v: Column, by: tuple[str, ...], weight: Column) -> DataFrame:
    """Rows per value and group, map-side combined."""
    counts = df.select(*by, v.alias("_v"), weight.cast("bigint").alias("_n")).groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
    return stage(counts.withColumn("_out", F.lit(False)), "quantile-counts")


def _placed(values: DataFrame, probs: dict[str, float], by: tuple[str, ...]) -> DataFrame:
    """The quantiles of values (by, _v, _n, _out), and ``_missed``: whether a rank fell on an ``_out`` row.

    1. Count per (group, bucket); running counts tell which buckets hold the wanted ranks.
    2. Only values of those buckets are joined, and the same two steps over fine buckets leave
       a handful of values to rank.

    A group with a third of all rows is spread over its buckets, unlike an exact
    ``percentile``, which keeps every distinct value of a group in one buffer.
    """
    values = values.withColumn("_b", _bucket(F.col("_v")))
    group, coarse = list(by), [*by, "_b"]

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def holds(rank: Column) -> Column:
        """Whether the rows before ``_upto`` and not before ``_upto - _n`` include the rank."""
        return (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))

    ranks = [side(position(p)) for p in probs.values() for side in (F.floor, F.ceil)]
    wanted = reduce(lambda a, b: a | b, [holds(r) for r in ranks])

    histogram = values.groupBy(*coarse).agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    totals = Window.partitionBy(*group) if by else Window.partitionBy(F.lit(0))
    targets = (
        _running(histogram, group, "_b")
        .withColumn("_total", F.max("_upto").over(totals))
        .where(wanted)
        .select(*coarse, (F.col("_upto") - F.col("_n")).alias("_before"), "_total", "_lo", "_hi")
    )
    if by:
        # Two buckets per group and quantile: Spark broadcasts the staged table if it is small.
        targets = stage(targets, "quantile-buckets")
    else:
        targets = F.broadcast(targets)  # one group: at most two rows per quantile

    fine = [*coarse, "_f"]
    distinct = (
        _join_targets(values, targets, coarse)
        .withColumn("_f", _fine(F.col("_v"), F.col("_lo"), F.col("_hi")))
        .select(*fine, "_before", "_total", "_v", "_n", "_out")
    )
    per_fine = distinct.groupBy(*fine, "_before", "_total").agg(F.sum("_n").alias("_n"))
    fine_targets = (
        _running(per_fine, coarse, "_f")
        .withColumn("_upto", F.col("_upto") + F.col("_before"))
        .where(wanted)
        .select(*fine, (F.col("_upto") - F.col("_n")).alias("_start"))
    )
    if not by:
        fine_targets = F.broadcast(fine_targets)
    few = _join_targets(distinct, fine_targets, fine)
    placed = _running(few, fine, "_v").withColumn("_upto", F.col("_upto") + F.col("_start"))

    picks = []
    for i, p in enumerate(probs.values()):
        for side, rank in (("lo", F.floor(position(p))), ("hi", F.ceil(position(p)))):
            picks.append(F.max(F.when(holds(rank), F.col("_v"))).alias(f"_{side}{i}"))
    picks.append(F.max(wanted & F.col("_out")).alias("_missed"))
    picked = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)

    def between(i: int, p: float) -> Column:
        # From the nearer end, so that two equal neighbours give exactly their value.
        share = position(p) - F.floor(position(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(share < 0.5, lo + (hi - lo) * share).otherwise(hi - (hi - lo) * (1 - share))

    return picked.select(
        *by, *[between(i, p).alias(name) for i, (name, p) in enumerate(probs.items())], "_missed"
    )


def quantile_value(df: DataFrame, value: str, p: float) -> Column:
    """One quantile of the whole column as a literal; NULL without values."""
    return F.lit(single_value(exact_quantiles(df, value, {"q": p}))).cast("double")
