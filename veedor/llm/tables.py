"""Staged tables and ids of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delete(spark: SparkSession, what: str | DataFrame) -> None:
    """Remove a staged table, by its path or as it was read, that nothing will read again."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    names = [what] if isinstance(what, str) else [f.rsplit("/", 1)[0] for f in what.inputFiles()]
    for name in dict.fromkeys(names):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(configuration).delete(path, True)


def narrow_ids(df: DataFrame, id_col: str) -> Column:
    """The id as a long, an int or else as a string."""
    kind = df.schema[id_col].dataType.typeName()
    if kind in ("byte", "short"):
        return F.col(id_col).cast("int")
    return F.col(id_col) if kind in ("long", "integer", "string") else F.col(id_col).cast("string")
