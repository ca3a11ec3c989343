"""Contract-level signals: outliers, sector deviation, relationship age, modality risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.flags import cost_per_day, incoherent_duration_or_signature, modality_risk
from veedor.functions.parsing import is_present
from veedor.operators.quantiles import exact_quantiles
from veedor.operators.spread import attach_stats
from veedor.runtime import stage

SIGMAS = 3.0


def value_outliers(
    df: DataFrame, value: str, category: str, row_id: str, sigmas: float = SIGMAS
) -> DataFrame:
    """Rows whose value is more than ``sigmas`` sample deviations above their category mean."""
    valued = df.where(F.col(value).isNotNull())
    stats = valued.groupBy(category).agg(
        F.avg(value).alias("media"), F.stddev_samp(value).alias("desviacion")
    )
    rows = attach_stats(valued, stage(stats, "category-stats"), (category,), (row_id,))
    return rows.where(F.col(value) > F.col("media") + sigmas * F.col("desviacion"))


def sector_deviation(enriched: DataFrame, sector: str) -> DataFrame:
    """Percent difference of each valid contract from the median value of its sector."""
    valid = enriched.where(F.col("flag_valor_invalido") == 0)
    medians = exact_quantiles(valid, "valor_num", {"mediana_sector": 0.5}, (sector,))
    rows = attach_stats(valid, medians, (sector,), ("id_contrato",))
    change = F.col("valor_num") / F.col("mediana_sector") - 1
    return rows.withColumn("desviacion_pct", F.lit(100.0) * change)


def relationship_age(df: DataFrame) -> DataFrame:
    """Days between a supplier's first contract and each of its contracts."""
    dated = df.where(is_present(F.col("doc_proveedor")) & F.col("fecha_inicio").isNotNull())
    first = dated.groupBy("doc_proveedor").agg(F.min("fecha_inicio").alias("primer_contrato"))
    # Staged, both sides of the join are plain inputs and adaptive execution splits a hot supplier.
    rows = dated.join(stage(first, "first-contracts"), "doc_proveedor")
    age = F.datediff("fecha_inicio", "primer_contrato").cast("bigint")
    return rows.withColumn("antiguedad_dias", age)


def with_modality_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("puntuacion_modalidad", modality_risk(F.col("modalidad")))


def inconsistent(enriched: DataFrame) -> DataFrame:
    """Contracts with zero or negative duration, or signed after the start."""
    return enriched.where(incoherent_duration_or_signature())


def contract_features(enriched: DataFrame) -> DataFrame:
    """Model inputs of one contract: value, term, modality points, cost per day."""
    scored = with_modality_risk(enriched)

    def log(name: str) -> Column:
        return F.log1p(F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)))

    return scored.withColumn("costo_por_dia", cost_per_day()).withColumns(
        {
            "f_valor": log("valor_num"),
            "f_plazo": log("duracion_dias"),
            "f_modalidad": F.coalesce("puntuacion_modalidad", F.lit(0)).cast("double"),
            "f_costo_dia": log("costo_por_dia"),
        }
    )


CONTRACT_FEATURES = ("f_valor", "f_plazo", "f_modalidad", "f_costo_dia")
