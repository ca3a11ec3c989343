"""Counts, pages and place lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veedor.functions.flags import plottable
from veedor.functions.parsing import is_present

PAGE_SIZE = 10
FALLBACK_YEARS = (2000, 2030)


def filtered_counts(enriched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Contracts, and those with positive value and duration, in one pass."""
    return enriched.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(plottable()).alias("n_elegibles")
    )


def year_range(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First and last start year, or the fallback pair when there is no date."""
    years = df.groupBy(*by).agg(
        F.min(F.year("fecha_inicio")).alias("lo"), F.max(F.year("fecha_inicio")).alias("hi")
    )
    first, last = FALLBACK_YEARS
    return years.select(
        *by,
        F.coalesce("lo", F.lit(first)).cast("bigint").alias("anio_min"),
        F.coalesce("hi", F.lit(last)).cast("bigint").alias("anio_max"),
    )


def page_order(df: DataFrame) -> list[Column]:
    """By id, then by every other sortable column: pages neither repeat nor miss a row."""
    rest = [c for c in df.columns if c != "id_contrato"]
    return [F.col(f"`{c}`").asc_nulls_last() for c in ["id_contrato", *rest]]


def page(df: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of whole rows ordered by id, with the row number ``n_fila``.

    Early pages keep only a short list per task. The work grows with the page number, so
    deep reading should use ``page_after``.
    """
    skip = max(0, number) * size
    rows = df.orderBy(*page_order(df)).offset(skip).limit(size)
    # At most ``size`` rows reach this window.
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*page_order(df)))
    return rows.withColumn("n_fila", (position + skip).cast("bigint"))


def page_after(df: DataFrame, last: dict | None, delivered: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """The next rows in page order: the same cost for every page, whatever the ids.

    ``last`` is the last row delivered (or the values of its first sort columns), and
    ``delivered`` how many rows equal to it were delivered so far (see ``next_cursor``): rows
    that are equal in every column can only be told apart by their number.
    """
    if last is None:
        return df.orderBy(*page_order(df)).limit(size)
    names = [c for c in ["id_contrato", *(c for c in df.columns if c != "id_contrato")] if c in last]
    rest = F.lit(True)  # equal in all columns: not before the cursor
    for name in reversed(names):
        column, value = F.col(f"`{name}`"), F.lit(last[name]).cast(df.schema[name].dataType)
        after = F.lit(False) if last[name] is None else column.isNull() | (column > value)
        rest = after | (column.eqNullSafe(value) & rest)
    # implied by the rest, and simple enough for the scan
    reach = F.lit(True) if last.get("id_contrato") is None else F.col("id_contrato").isNull() | (F.col("id_contrato") >= last["id_contrato"])
    return df.where(reach & rest).orderBy(*page_order(df)).offset(delivered).limit(size)


def next_cursor(rows: list[dict], last: dict | None = None, delivered: int = 0) -> tuple[dict | None, int]:
    """Cursor after a page: its last row, and how many rows equal to it have been delivered."""
    if not rows:
        return last, delivered
    same = next((k for k, row in enumerate(reversed(rows)) if row != rows[-1]), len(rows))
    return rows[-1], same + (delivered if same == len(rows) and rows[-1] == last else 0)


def page_bounds(counts: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Number of pages (at least 1) and the requested page (from 1) moved into range."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(size))).cast("bigint")
    return counts.select(
        "*", pages.alias("paginas"), F.least(F.greatest(F.lit(number), F.lit(1)), pages).alias("pagina")
    )


def by_department(df: DataFrame) -> DataFrame:
    """Contracts per trimmed department name."""
    named = df.where(is_present(F.col("departamento")))
    return named.groupBy(F.trim("departamento").alias("departamento")).agg(
        F.count("*").alias("n_contratos")
    )


def by_city(df: DataFrame) -> DataFrame:
    """Contracts per department and trimmed city name."""
    named = df.where(is_present(F.col("ciudad")))
    return named.groupBy("departamento", F.trim("ciudad").alias("ciudad")).agg(
        F.count("*").alias("n_contratos")
    )


def city_list(df: DataFrame) -> DataFrame:
    """Contracts per department and city; missing names are one labelled group."""
    label = F.coalesce(F.nullif(F.trim("ciudad"), F.lit("")), F.lit("(vacío / null)"))
    return df.groupBy("departamento", label.alias("ciudad")).agg(F.count("*").alias("n_contratos"))


def first_rows(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Sorted rows up to a limit; with None all of them.

    A limit keeps its rows in one task at the end, so ask for everything with None, not
    with a very large number.
    """
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def ranked(df: DataFrame, measure: str, *keys: str) -> DataFrame:
    """Largest measure first, ties by key."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])


def numbered(report: DataFrame, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``puesto``: the place of a row of a report in its sorted form, from 1, in each group.

    For aggregates only (one row per place name or month): a group's rows meet in one task.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return report.withColumn("puesto", F.row_number().over(group.orderBy(*order)).cast("bigint"))


def largest_first(*keys: str) -> list[Column]:
    """Order of the place reports: most contracts first, ties by name."""
    return [F.col("n_contratos").desc(), *[F.col(k).asc_nulls_last() for k in keys]]


def numbered_cities(cities: DataFrame) -> DataFrame:
    """``city_list`` in order, with the number of cities of the department."""
    each = Window.partitionBy("departamento")
    return numbered(cities, largest_first("ciudad"), ("departamento",)).withColumn(
        "n_ciudades", F.count("*").over(each)
    )
