"""Readable risk rules: flags, weighted score, texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BURST_MIN = 3

# Rule -> weight, description, phrase of the explanation.
RULES = {
    "contratacion_directa": (
        0.15, "Ratio contratación directa ≥ 50 %", "alta contratación directa"),
    "frecuencia_temporal": (
        0.25, "≥ 3 contratos en ventana corta", "ráfaga de contratos en ventana corta"),
    "proveedor_dominante": (
        0.20, "Concentración del proveedor en la entidad ≥ 25 %", "proveedor dominante en la entidad"),
    "objeto_generico": (
        0.10, "≥ 50 % de contratos con objeto muy corto (< 30 car.)", "objetos contractuales genéricos"),
    "costo_dia_extremo": (
        0.15, "Costo/día promedio en percentil 90+ del cohorte", "costo/día promedio elevado"),
}
ANOMALY_PHRASE = "patrón agregado atípico (Isolation Forest)"
ANOMALY_FROM = 0.7


def rule_catalog(spark: SparkSession) -> DataFrame:
    rows = [(name, weight, text) for name, (weight, text, _) in RULES.items()]
    return spark.createDataFrame(rows, "regla string, peso double, descripcion string")


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def with_rules(pairs: DataFrame, cost_limit: Column, burst_min: int = BURST_MIN) -> DataFrame:
    """Add one boolean per rule, score_reglas and reglas_disparadas."""
    conditions = {
        "contratacion_directa": F.col("ratio_directa") >= 0.5,
        "frecuencia_temporal": F.col("max_contratos_ventana") >= burst_min,
        "proveedor_dominante": F.col("concentracion_entidad") >= 0.25,
        "objeto_generico": F.col("pct_objeto_corto") >= 0.5,
        "costo_dia_extremo": F.coalesce("costo_dia_promedio", F.lit(0.0)) >= cost_limit,
    }
    flagged = pairs.withColumns(conditions)
    points = [F.when(F.col(r), F.lit(w)).otherwise(F.lit(0.0)) for r, (w, _, _) in RULES.items()]
    texts = [F.when(F.col(r), F.lit(text)) for r, (_, text, _) in RULES.items()]
    return flagged.withColumns(
        {
            "score_reglas": clip01(reduce(lambda a, b: a + b, points)),
            "reglas_disparadas": F.concat_ws("; ", *texts),
        }
    )


def explanation() -> Column:
    """Phrases of the fired rules and of a high anomaly score, else the two scores."""
    phrases = [F.when(F.col(r), F.lit(phrase)) for r, (_, _, phrase) in RULES.items()]
    phrases.append(F.when(F.col("score_anomalia") >= ANOMALY_FROM, F.lit(ANOMALY_PHRASE)))
    fired = F.concat_ws("; ", *phrases)
    plain = F.concat(
        F.lit("combinación de scores (reglas="), F.format_number("score_reglas", 2),
        F.lit(", anomalía="), F.format_number("score_anomalia", 2), F.lit(")"),
    )
    return F.when(fired != "", fired).otherwise(plain)
