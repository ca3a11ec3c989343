"""Descriptive reports: modality, months, value against duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.flags import cost_per_day, plottable
from veedor.operators.listing import first_rows, page_order, ranked
from veedor.operators.quantiles import exact_quantiles, quantile_value

TOP_MODALITIES = 15
SCATTER_ROWS = 2500
BINS = 48


def modality_stats(enriched: DataFrame, limit: int | None = TOP_MODALITIES) -> DataFrame:
    """Contracts and median positive value per modality, most frequent first."""
    label = F.coalesce(F.nullif(F.trim("modalidad"), F.lit("")), F.lit("(sin modalidad)"))
    values = enriched.select(label.alias("modalidad_g"), F.when(F.col("valor_num") > 0, F.col("valor_num")).alias("valor"))
    medians = exact_quantiles(values, "valor", {"mediana_valor": 0.5}, ("modalidad_g",), also={"n": F.count("*")})
    report = ranked(medians, "n", "modalidad_g")
    return report if limit is None else report.limit(limit)


def monthly_series(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Contracts per start month (``yyyy-MM``); months without contracts are absent."""
    started = df.where(F.col("fecha_inicio").isNotNull())
    month = F.date_format("fecha_inicio", "yyyy-MM").alias("anio_mes")
    return started.groupBy(*by, month).agg(F.count("*").alias("n_contratos"))


def scatter_points(enriched: DataFrame) -> DataFrame:
    """Contracts with positive value and duration, with their cost per day."""
    return enriched.where(plottable()).withColumn("costo_por_dia", cost_per_day())


def scatter_sample(enriched: DataFrame, limit: int | None = SCATTER_ROWS) -> DataFrame:
    """The first eligible contracts by id (not a random sample)."""
    points = scatter_points(enriched).select(
        "id_contrato", "valor_num", "duracion_dias", "costo_por_dia",
        "modalidad", "tipo_contrato", "nombre_entidad", "proveedor",
    )
    return first_rows(points, page_order(points), limit)


def trim_at_p99(points: DataFrame, value: str = "costo_por_dia") -> DataFrame:
    """Finite positive values up to their 0.99 quantile."""
    finite = points.where(F.abs(F.col(value)) < F.lit(float("inf")))
    top = quantile_value(finite, value, 0.99)
    return finite.where((F.col(value) <= top) & (F.col(value) > 0))


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins over min..max, the last one closed; empty bins are listed.

    Columns bin, lo, hi, centro, n. When all values are equal the range is widened by 0.5
    on both sides.
    """
    v = F.col(value)
    a, b = df.agg(F.min(v), F.max(v)).first()
    if a is None:
        bins_found = df.sparkSession.range(0)
    else:
        bins_found = df.sparkSession.range(bins)
        a, b = (a - 0.5, b + 0.5) if a == b else (float(a), float(b))
    low, high = F.lit(a).cast("double"), F.lit(b).cast("double")

    def edge(i: Column) -> Column:
        step = (high - low) / F.lit(float(bins))
        return F.when(i >= bins, high).otherwise(i * step + low)

    guess = F.least(
        F.floor((v - low) * (F.lit(float(bins)) / (high - low))), F.lit(bins - 1)
    )
    # Rounding can put a value next to an inner edge one bin off: the edges decide.
    g = F.col("_g")
    located = df.where(v.isNotNull()).select(v.alias(value), guess.alias("_g")).select(
        F.when(v < edge(g), g - 1)
        .when((v >= edge(g + 1)) & (g < bins - 1), g + 1)
        .otherwise(g)
        .alias("bin")
    )
    counts = located.groupBy("bin").agg(F.count("*").alias("n"))
    lo, hi = edge(F.col("bin")), edge(F.col("bin") + 1)
    return bins_found.select(F.col("id").alias("bin")).join(counts, "bin", "left").select(
        "bin", lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("centro"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def axis_extents(points: DataFrame) -> DataFrame:
    """Log10 axis ranges of value and duration: floors 500 and 1, margins 1.2 and 1.08."""

    def finite(name: str) -> Column:
        v = F.col(name).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)

    ends = points.agg(
        F.greatest(F.min(finite("valor_num")), F.lit(500.0)).alias("v0"),
        (F.max(finite("valor_num")) * 1.2).alias("v1"),
        F.greatest(F.min(finite("duracion_dias")), F.lit(1.0)).alias("d0"),
        (F.max(finite("duracion_dias")) * 1.08).alias("d1"),
    ).where(F.col("v1").isNotNull() & F.col("d1").isNotNull())
    return ends.select(
        F.log10("v0").alias("valor_lo"), F.log10("v1").alias("valor_hi"),
        F.log10("d0").alias("duracion_lo"), F.log10("d1").alias("duracion_hi"),
    )
