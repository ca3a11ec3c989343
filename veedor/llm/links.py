"""Groups of linked nodes without all pairs of a bucket.

Nodes that share a key are candidates. A key's nodes are first compared with one of them, its
centre, so a key costs as many comparisons as it has nodes. What links joins into components. Left
over are pairs of one key in different components; looking at those that may be near completes the
components exactly: every other pair is inside one component already or cannot link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veedor.runtime import stage

#: Rows of at most 32 bytes up to which a staged table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast of a staged table of few rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leftover_pairs(placed: DataFrame, near: Column) -> DataFrame:
    """Distinct pairs (a, b), a < b, of one key but different components for which ``near`` holds.

    ``placed`` has key, node, component and whatever ``near`` looks at: columns by their names for one
    node and with ``x_`` before them for the other. In each key only nodes outside its most frequent
    component look for others, so that a large group linked already is not compared within itself.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("main"))
    mixed = stage(mixed.where("k > 1").select("key", "main"), "link-mixed")
    rows = stage(placed.join(mixed, "key").withColumn("odd", F.col("component") != F.col("main")).drop("main"), "link-rows")
    seek = rows.where("odd").drop("odd")
    seek = seek.withColumnsRenamed({c: f"x_{c}" for c in seek.columns if c != "key"})
    found = seek.join(rows, "key").where(
        (F.col("component") != F.col("x_component")) & (~F.col("odd") | (F.col("x_component") < F.col("component"))) & near
    )
    return found.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``links`` (a, b); staged.

    Alternating stars (Kiveris et al., 2014): each round ties the neighbours of a node to the
    smallest one it sees, until the edges are stars around the roots. Neighbourhoods are only
    reduced to a minimum, never gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = stage(edges, "edges")
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "edge-minima")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stage(large, "edges-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "edge-minima")
        tied = large.join(least, "u")
        tied_up = tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(tied_up.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges-small")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stage(roots.union(edges.select(F.col("v"), F.col("v"))).distinct(), "components")
