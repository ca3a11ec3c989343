"""Filters by place and time."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.times import in_year, ntz


@dataclass(frozen=True)
class Scope:
    """Department, city and start year; a part left empty does not filter.

    Text comparison is exact. The year is a half-open range on fecha_inicio, plus
    anio_inicio on a partitioned copy, so that whole partitions are skipped.
    """

    departamento: str | None = None
    ciudad: str | None = None
    anio: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.departamento:
            df = df.where(F.col("departamento") == self.departamento)
        if self.ciudad:
            df = df.where(F.col("ciudad") == self.ciudad)
        if self.anio is not None:
            if "anio_inicio" in df.columns:
                df = df.where(F.col("anio_inicio") == self.anio)
            df = df.where(in_year(F.col("fecha_inicio"), self.anio))
        return df


@dataclass(frozen=True)
class DateBucket:
    """Half-open range of start dates (ISO days); an open end is None."""

    name: str
    start: str | None = None
    end: str | None = None

    def condition(self) -> Column:
        stamp = F.col("fecha_inicio")
        parts = []
        if self.start:
            parts.append(stamp >= ntz(f"{self.start} 00:00:00"))
        if self.end:
            parts.append(stamp < ntz(f"{self.end} 00:00:00"))
        condition = stamp.isNotNull()
        for part in parts:
            condition = condition & part
        return condition


# The three ranges of start dates.
START_BUCKETS = (
    DateBucket("2024_2026", "2024-01-01", "2027-01-01"),
    DateBucket("solo_2020", "2020-01-01", "2021-01-01"),
    DateBucket("antes_2020", None, "2020-01-01"),
)


def count_where(df: DataFrame, conditions: Mapping[str, Column | str]) -> DataFrame:
    """One count per named condition, all in one pass: one row, one column each."""
    as_columns = {
        name: F.expr(c) if isinstance(c, str) else c for name, c in conditions.items()
    }
    return df.agg(*[F.count_if(c).alias(name) for name, c in as_columns.items()])


def bucket_counts(df: DataFrame, scopes: Mapping[str, Column], buckets=START_BUCKETS) -> DataFrame:
    """Rows of (alcance, one count per bucket); a contract counts in every scope it meets."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in scopes.items()]))
    names = df.sparkSession.createDataFrame([(n,) for n in scopes], "alcance string")
    counted = (
        df.withColumn("alcance", F.explode(labels))
        .groupBy("alcance")
        .agg(*[F.count_if(b.condition()).alias(b.name) for b in buckets])
    )
    return names.join(counted, "alcance", "left").na.fill(0)


def spelling_variants(column: str, name: str, plain: str) -> dict[str, str]:
    """The six predicates tried in order for a department name with an accent."""

    def equal(expr: str, value: str) -> str:
        return f"{expr} = '{value.replace(chr(39), chr(39) * 2)}'"

    return {
        "como_se_escribe": equal(column, name),
        "mayusculas": equal(column, name.upper()),
        "sin_acento": equal(column, plain),
        "mayusculas_sin_acento": equal(column, plain.upper()),
        "upper_con_acento": equal(f"upper({column})", name.upper()),
        "upper_sin_acento": equal(f"upper({column})", plain.upper()),
    }


def first_match(df: DataFrame, conditions: Mapping[str, Column | str]) -> DataFrame:
    """The first condition with any row: (variante, n); NULL and 0 when none matches."""
    counts = count_where(df, conditions)
    hits = [F.when(F.col(n) > 0, F.struct(F.lit(n).alias("variante"), F.col(n).alias("n"))) for n in conditions]
    first = F.coalesce(*hits)
    return counts.select(
        first["variante"].alias("variante"), F.coalesce(first["n"], F.lit(0)).alias("n")
    )


def city_variants(city: str) -> dict[str, Column]:
    """Equality, upper-case equality and substring tests for one city."""
    return {
        "igual": F.col("ciudad") == city,
        "mayusculas": F.upper("ciudad") == city.upper(),
        "contiene": F.col("ciudad").contains(city),
    }
