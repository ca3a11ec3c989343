"""GeoJSON feature collections as small dimension tables; geometry stays opaque text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_PROPERTIES = T.StructType(
    [T.StructField("DPTO_CNMBR", T.StringType()), T.StructField("MPIO_CNMBR", T.StringType())]
)
_FEATURE = T.StructType(
    [T.StructField("properties", _PROPERTIES), T.StructField("geometry", T.StringType())]
)
COLLECTION = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """orden, dpto, mpio, geometria in file order; features without a department are left out."""
    document = spark.read.schema(COLLECTION).option("multiLine", "true").json(path)
    features = document.select(F.posexplode("features").alias("orden", "f"))
    name = F.trim(F.col("f.properties.DPTO_CNMBR"))
    return features.select(
        F.col("orden").cast("bigint").alias("orden"),
        name.alias("dpto"),
        F.trim(F.col("f.properties.MPIO_CNMBR")).alias("mpio"),
        F.col("f.geometry").alias("geometria"),
    ).where(F.coalesce(F.col("dpto"), F.lit("")) != "")
