"""Records of delimited text files that may span lines, without reading a file in one task.

Whether a line ends inside quotes depends on whether it began there: every line is a function
from {outside, inside} to {outside, inside}. Within a split of a file the functions are composed
by running windows, between splits over one row per split. Lines that begin outside start a record.

A record that is closed is gathered whatever its length. One whose quote never closes before the end
of its file is broken: it is given out line by line, and its lines are no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veedor.runtime import stage

_SPLIT = ["file", "block"]


def _line_functions(line: Column, sep: str, quote: str) -> tuple[Column, Column]:
    """Whether the line ends inside quotes, beginning outside and beginning inside."""
    q, s = re.escape(quote), re.escape(sep)
    inside = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
    field = f"(?:{q}{inside}{q}[^{s}]*+|[^{q}{s}][^{s}]*+|)"
    tail = f"(?:{field}{s})*+{q}{inside}$"
    return line.rlike(f"(?s)^{tail}"), line.rlike(f"(?s)^(?:{inside}$|{inside}{q}[^{s}]*+{s}{tail})")


def _composed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``_flips`` and ``_known``: the composition of all functions up to each row.

    A row's function either gives ``_value`` whatever came before, or (NULL) keeps or flips it.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flips = rows.withColumn("_flips", F.sum("_flip").over(upto))
    known = F.when(F.col("_value").isNotNull(), F.struct("_value", "_flips"))
    return flips.withColumn("_known", F.last(known, ignorenulls=True).over(upto))


def _after(begin: Column) -> Column:
    """State after the composed functions, for the state ``begin`` before them."""
    start = F.coalesce(F.col("_known._value"), begin)
    flips = F.col("_flips") - F.coalesce(F.col("_known._flips"), F.lit(0))
    return (start + flips) % 2


def read_records(spark: SparkSession, path: str | list[str], sep: str, quote: str, encoding: str = "UTF-8") -> DataFrame:
    """record, number (place from 0 among the lines of the file's first split; NULL further on), broken.

    A line without the quote leaves the state as it is, so states are composed over the lines with one only. A split that
    begins outside and never goes on inside after a line is calm: its lines are its records and stay where they are read.
    Only the lines of the other splits are moved.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() != "UTF-8" else F.col("value")
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r$", "")).otherwise(text).alias("line"),
    )
    splits = _split_states(lines, sep, quote)
    calm = lines.join(splits.where("_calm").select(*_SPLIT, "_first"), _SPLIT)
    number = F.when(F.col("block") == 0, F.col("at") - F.col("_first"))
    alone = calm.select(F.col("line").alias("record"), number.alias("number"), F.lit(False).alias("broken"))
    if splits.where(~F.col("_calm")).isEmpty():
        return alone.where("record != ''")
    return alone.unionByName(_moved_records(lines, splits, sep, quote)).where("record != ''")


def _line_states(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """Lines with ``_value`` and ``_flip``, their functions."""
    outside, within = _line_functions(F.col("line"), sep, quote)
    return lines.withColumns({"_outside": outside.cast("int"), "_within": within.cast("int")}).select(
        *lines.columns,
        F.when(F.col("_outside") == F.col("_within"), F.col("_outside")).alias("_value"),
        F.when(F.col("_outside") > F.col("_within"), 1).otherwise(0).alias("_flip"),
    )


def _split_states(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """A row per split: ``_first`` (its first line), ``_begin`` (state at its beginning), ``_open`` (whether its file ends
    inside quotes), ``_calm``; staged."""
    quoted = _line_states(lines.where(F.contains("line", F.lit(quote))), sep, quote).select(*_SPLIT, "at", "_value", "_flip")
    states = _composed(quoted, _SPLIT, "at").withColumn("_from_outside", _after(F.lit(0)))
    last = states.groupBy(*_SPLIT).agg(F.max_by(F.struct("_flips", "_known"), "at").alias("l"), F.max("_from_outside").alias("_inside"))
    every = lines.groupBy(*_SPLIT).agg(F.min("at").alias("_first")).join(last, _SPLIT, "left")
    # one row per split from here to its state at the beginning
    ended = F.when(F.col("l._known").isNotNull(), (F.col("l._known._value") + F.col("l._flips") - F.col("l._known._flips")) % 2)
    splits = every.select(
        *_SPLIT, "_first", F.coalesce("_inside", F.lit(0)).alias("_inside"), ended.alias("_value"),
        F.coalesce(F.col("l._flips") % 2, F.lit(0)).alias("_flip"),
    )
    ends = _composed(splits, ["file"], "block").withColumn("_end", _after(F.lit(0)))
    by_file = Window.partitionBy("file").orderBy("block")
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begin, left_open = F.coalesce(F.lag("_end").over(by_file), F.lit(0)), F.last("_end").over(whole) == 1
    begins = ends.select(*_SPLIT, "_first", "_inside", begin.alias("_begin"), left_open.alias("_open"))
    calm = (F.col("_begin") == 0) & (F.col("_inside") == 0)
    return stage(begins.withColumn("_calm", calm).drop("_inside"), "csv-splits")


def _moved_records(lines: DataFrame, splits: DataFrame, sep: str, quote: str) -> DataFrame:
    """The records of the splits that are not calm; a calm one after them ends a record without a line of its own."""
    restless = splits.where(~F.col("_calm")).select(*_SPLIT, "_begin", "_open")
    rows = _composed(_line_states(lines.join(restless, _SPLIT), sep, quote), _SPLIT, "at").drop("_value", "_flip")
    by_line = Window.partitionBy(*_SPLIT).orderBy("at")
    placed = rows.withColumn("_state", _after(F.col("_begin")))
    placed = placed.withColumns(
        {"_before": F.coalesce(F.lag("_state").over(by_line), F.col("_begin")), "number": F.row_number().over(by_line) - 1}
    ).withColumn("number", F.when(F.col("block") == 0, F.col("number")))
    starts = F.when(F.col("_before") == 0, F.col("at"))
    placed = placed.withColumn("_start", F.last(starts, ignorenulls=True).over(by_line))
    single = (F.col("_before") == 0) & (F.col("_state") == 0)
    columns = [*_SPLIT, "at", "line", "_start", "number", "_open", single.alias("_single")]
    placed = stage(placed.select(*columns), "csv-placed")

    # the first lines of a split may belong to a record that began in an earlier one
    latest = placed.groupBy(*_SPLIT).agg(F.max("_start").alias("_latest"))
    by_file = Window.partitionBy("file").orderBy("block")
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    last_of = lambda window: F.last("_latest", ignorenulls=True).over(window)
    latest = latest.select(*_SPLIT, last_of(earlier).alias("_earlier"), last_of(whole).alias("_final"))
    parts = placed.where(~F.col("_single")).join(stage(latest, "csv-latest"), _SPLIT)
    parts = parts.withColumn("_record", F.coalesce("_start", "_earlier"))
    broken = F.col("_open") & (F.col("_record") == F.col("_final"))
    gathered = (
        parts.where(~broken)
        .groupBy("file", "_record")
        .agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("_lines"), F.min("number").alias("number"))
        .select(F.array_join("_lines.line", "\n").alias("record"), "number", F.lit(False).alias("broken"))
    )
    alone = placed.where("_single").select(F.col("line").alias("record"), "number", F.lit(False).alias("broken"))
    torn = parts.where(broken).select(F.col("line").alias("record"), "number", F.lit(True).alias("broken"))
    return alone.unionByName(gathered).unionByName(torn)
