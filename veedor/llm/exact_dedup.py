"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z only; NULL counts as empty. Of equal texts
the row with the largest id stays (a NULL id is smallest); of rows that share that id, one. A row
whose length is unique is never hashed, one whose (length, prefix hash) is unique never read in
full. Only counts per key are shuffled with the rows' ids: texts move in ``keep_one`` alone.

Empty tables give empty results; other columns of the table, whatever their names, play no part.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veedor.runtime import stage

PREFIX_CHARS = 64
FULL = ["size", "prefix", "full"]


def fold(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII alone take the faster function."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def _prefix(text: Column) -> Column:
    return F.xxhash64(fold(F.substring(text, 1, PREFIX_CHARS)))


def _full(text: Column) -> Column:
    return F.unhex(F.sha2(fold(text).cast("binary"), 256))


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return stage(rows.groupBy(*keys).count().where("count > 1").select(*keys), name)


def surviving_keys(rows: DataFrame) -> DataFrame:
    """The (size, prefix) keys that more than one of ``rows`` has; lengths are refined first."""
    lengths = _repeated(rows.select("size"), ["size"], "dup-lengths")
    return _repeated(rows.select("size", "prefix").join(lengths, "size", "left_semi"), ["size", "prefix"], "dup-prefixes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (SHA-256 of the folded text).

    As every row's digest is asked for, it is taken in the one scan, beside length and prefix hash;
    the refinement then runs on these narrow rows.
    """
    text = F.col(text_col)
    rows = stage(
        docs.select(F.col(id_col).alias("id"), _size(text).alias("size"), _prefix(text).alias("prefix"), _full(text).alias("full")),
        "dup-rows",
    )
    keys = surviving_keys(rows)
    alone = rows.join(keys, ["size", "prefix"], "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full"
    )
    again = rows.join(keys, ["size", "prefix"], "left_semi")
    groups = stage(again.groupBy(*FULL).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "dup-groups")
    # rows that repeat an id within a group are counted, then told apart by their place
    members = again.groupBy(*FULL, "id").agg(F.count("*").alias("copies"))
    shared = (
        members.join(groups, FULL)
        .select("id", "keep_id", "group_size", "full", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("place"))
        .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "full")
    )
    return alone.unionByName(shared).withColumn("digest", F.lower(F.hex("full"))).drop("full")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; full content is read for surviving keys only."""
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct("*").alias("row")).select("row", _size(text).alias("size"), _prefix(text).alias("prefix"))
    keys = surviving_keys(rows)
    alone = rows.join(keys, ["size", "prefix"], "left_anti").select("row")
    best = F.max_by("row", F.struct(F.col(f"row.`{id_col}`"), text))
    shared = (
        rows.join(keys, ["size", "prefix"], "left_semi")
        .withColumn("full", _full(text))
        .groupBy(*FULL)
        .agg(best.alias("row"))
        .select("row")
    )
    return alone.unionByName(shared).select("row.*")
