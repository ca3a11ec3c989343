"""Region catalog: which cities each department has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veedor.functions.names import case_folded
from veedor.functions.parsing import is_present


def casefold_order(name: Column) -> list[Column]:
    return [case_folded(name), name]


def region_pairs(df: DataFrame) -> DataFrame:
    """Distinct trimmed (departamento, ciudad), both present."""
    return (
        df.where(is_present(F.col("departamento")) & is_present(F.col("ciudad")))
        .select(F.trim("departamento").alias("departamento"), F.trim("ciudad").alias("ciudad"))
        .distinct()
    )


def nested_catalog(pairs: DataFrame) -> DataFrame:
    """One row per department with its cities in case-insensitive order.

    Input is already distinct, so an array holds one entry per city of the department.
    """
    ordered = F.array_sort(F.collect_list(F.struct(case_folded(F.col("ciudad")).alias("k"), "ciudad")))
    return pairs.groupBy("departamento").agg(
        F.transform(ordered, lambda e: e["ciudad"]).alias("ciudades")
    )


def catalog_document(pairs: DataFrame, source: str) -> DataFrame:
    """The one-row document form: source, generated_at, department list, map of city lists."""
    rows = F.array_sort(
        F.collect_list(F.struct(case_folded(F.col("departamento")).alias("k"), "departamento", "ciudades"))
    )
    return nested_catalog(pairs).agg(
        F.lit(source).alias("source"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.transform(rows, lambda r: r["departamento"]).alias("departamentos"),
        F.map_from_entries(
            F.transform(rows, lambda r: F.struct(r["departamento"], r["ciudades"]))
        ).alias("ciudades_por_departamento"),
    )


def save_catalog(pairs: DataFrame, path: str, source: str) -> None:
    catalog_document(pairs, source).write.mode("overwrite").json(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """(departamento, ciudad, orden) of a saved document; None when missing or unreadable."""
    schema = (
        "source string, generated_at string, departamentos array<string>, "
        "ciudades_por_departamento map<string, array<string>>"
    )
    try:
        document = spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException:
        return None
    cities = document.select(F.explode("ciudades_por_departamento").alias("departamento", "c"))
    table = cities.select("departamento", F.posexplode("c").alias("orden", "ciudad"))
    return None if table.isEmpty() else table.select("departamento", "ciudad", "orden")


def resolve_catalog(
    spark: SparkSession,
    path: str,
    api_rows: Callable[[], DataFrame] | None,
    export_rows: Callable[[], DataFrame],
) -> tuple[DataFrame, str]:
    """First non-empty source: API rows, saved document, export; with its label.

    API and export results are saved, a loaded document is not rewritten.
    """
    if api_rows is not None:
        try:
            pairs = region_pairs(api_rows())
            if not pairs.isEmpty():
                save_catalog(pairs, path, "api")
                return load_catalog(spark, path), "api"
        except AnalysisException:
            pass  # no landed pages: go on with the saved document
    saved = load_catalog(spark, path)
    if saved is not None:
        return saved, "json"
    pairs = region_pairs(export_rows())
    save_catalog(pairs, path, "csv")
    found = load_catalog(spark, path)
    empty = pairs.select("departamento", "ciudad", F.lit(0).alias("orden"))
    return (found if found is not None else empty), "csv"
