"""A sorted copy of a table whose pages are found without counting through it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veedor.operators.listing import PAGE_SIZE, page_order
from veedor.runtime import set_for, stage

#: Rows of a file, about: a page reads one file, or two where it lies across their border.
FILE_ROWS = 1_000_000
#: Rows of a staged file and bytes of such files that one task deals out by range: what it holds does not grow with the table.
STAGED_ROWS, TASK_BYTES = 250_000, "32m"


class PageDirectory:
    """Rows in page order in files, and a small table that says how many rows lie before each.

    ``rows/`` holds the files, in order of their names; ``files/`` has (file, n, before, first_id). The copy is a
    snapshot: rows that come later are in the next one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(df: DataFrame, path: str, file_rows: int = FILE_ROWS, n_rows: int | None = None) -> PageDirectory:
        """One shuffle by ranges of the order. Rows that are equal in every column are spread by their
        place in the input, so that many copies of one row do not meet in one file.

        ``df`` is staged, as it is read for its size, for the ranges and for the rows: its joins are made once, and
        not in the tasks that hold the rows they deal out. Those read small files, a few each."""
        directory = PageDirectory(df.sparkSession, path)
        df = stage(df, "page-rows", maxRecordsPerFile=STAGED_ROWS)
        n_files = max(1, math.ceil((df.count() if n_rows is None else n_rows) / file_rows))
        order = page_order(df)
        placed = df.withColumn("_place", F.monotonically_increasing_id())
        with set_for(directory.spark, "spark.sql.files.maxPartitionBytes", TASK_BYTES):
            dealt = placed.repartitionByRange(n_files, *order, F.col("_place")).sortWithinPartitions(*order)
            dealt.drop("_place").write.parquet(f"{directory.path}/rows")
        rows = directory._rows(df.schema)
        counts = rows.select(F.col("_metadata.file_name").alias("file"), F.col("id_contrato").alias("id")).groupBy("file")
        files = stage(counts.agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "files")  # a row per file
        before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        files.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{directory.path}/files")
        return directory

    def _rows(self, schema=None) -> DataFrame:
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(f"{self.path}/rows")

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def n_rows(self) -> int:
        return self.files().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (from 0; a negative one counts as 0) with the row number ``n_fila``, as ``listing.page``.

        Any page costs the same: its file's row groups are read, others are not opened. A page past the end is empty.
        """
        start = max(0, number) * size
        end = start + size
        held = self.files().where((F.col("before") < end) & (F.col("before") + F.col("n") > start))
        found = held.select("file", "before").orderBy("file").limit(size).collect()  # each holds a row of the page
        schema = self._rows().schema
        if not found:
            return self.spark.createDataFrame([], schema).withColumn("n_fila", F.lit(None).cast("bigint"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{r.file}" for r in found])
        return self._numbered(rows, found).where((F.col("n_fila") > start) & (F.col("n_fila") <= end)).orderBy("n_fila")

    def last_page(self, size: int = PAGE_SIZE) -> DataFrame:
        return self.page(max(0, math.ceil(self.n_rows() / size) - 1), size)

    def position(self, row_id: str) -> int:
        """Rows before the first one of this id or a larger one: ``position // size`` is its page. Opens one file."""
        files = self.files()
        last = files.where(F.col("first_id") < row_id).orderBy(F.col("file").desc()).first()
        if last is None:
            return 0
        rows = self.spark.read.schema(self._rows().schema).parquet(f"{self.path}/rows/{last.file}")
        return last.before + rows.where(F.col("id_contrato") < row_id).count()

    @staticmethod
    def _numbered(rows: DataFrame, files: list) -> DataFrame:
        before: Column = F.lit(None)
        for r in files:
            before = F.when(F.col("_metadata.file_name") == r.file, F.lit(r.before)).otherwise(before)
        return rows.withColumn("n_fila", (before + F.col("_metadata.row_index") + 1).cast("bigint"))
