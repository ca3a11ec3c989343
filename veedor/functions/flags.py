"""Derived values and coherence flags of one contract, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.names import normalize_name
from veedor.functions.parsing import compute_once, parse_money
from veedor.schema import ENRICHED_COLUMNS, FLAG_COLUMNS

SHORT_TEXT = 30

# Words of a modality -> risk points.
MODALITY_RISK = (
    ("DIRECTA", 10),
    ("ABREVIADA", 5),
    ("LICITACION PUBLICA", 1),
)


def _bit(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


MEASURES = ("valor_num", "longitud_objeto", "duracion_dias")


def with_measures(
    df: DataFrame, decimal_comma: bool = False, only: tuple[str, ...] = MEASURES
) -> DataFrame:
    """Add valor_num, longitud_objeto and duracion_dias, or only the named ones."""
    cheap = {
        "longitud_objeto": F.length(F.trim(F.coalesce("objeto_raw", F.lit("")))).cast("bigint"),
        "duracion_dias": F.datediff("fecha_fin", "fecha_inicio").cast("bigint"),
    }
    if "valor_num" in only:
        df = compute_once(df, "valor_num", parse_money(F.col("valor_raw"), decimal_comma))
    return df.withColumns({name: value for name, value in cheap.items() if name in only})


def with_flags(df: DataFrame) -> DataFrame:
    """Add the five 0/1 flags; a comparison with a missing date gives 0."""
    firma, inicio, fin = F.col("fecha_firma"), F.col("fecha_inicio"), F.col("fecha_fin")
    valor = F.col("valor_num")
    return df.withColumns(
        {
            "flag_fin_antes_inicio": _bit(fin < inicio),
            "flag_firma_despues_inicio": _bit(firma > inicio),
            "flag_valor_invalido": _bit(valor.isNull() | (valor <= 0)),
            "flag_objeto_muy_corto": _bit(F.col("longitud_objeto") < SHORT_TEXT),
            "flag_duracion_negativa": _bit(F.col("duracion_dias") < 0),
        }
    )


def enrich(df: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """Every measure and flag; other columns are kept."""
    return with_flags(with_measures(df, decimal_comma))


def enriched_columns(df: DataFrame) -> DataFrame:
    return df.select(*ENRICHED_COLUMNS)


def any_flag() -> Column:
    return reduce(lambda a, b: a + b, [F.col(f) for f in FLAG_COLUMNS]) > 0


def bad_duration() -> Column:
    return F.coalesce(F.col("duracion_dias") <= 0, F.lit(True))


def bad_dates() -> Column:
    """Date incoherence in the wide sense: a late signature counts."""
    return (
        (F.col("flag_fin_antes_inicio") == 1)
        | (F.col("flag_firma_despues_inicio") == 1)
        | (F.col("flag_duracion_negativa") == 1)
    )


def discarded() -> Column:
    """Contracts left out of the pair analysis. Late signatures and short texts stay in."""
    return (
        (F.col("flag_valor_invalido") == 1)
        | (F.col("flag_fin_antes_inicio") == 1)
        | (F.col("flag_duracion_negativa") == 1)
        | bad_duration()
    )


def plottable() -> Column:
    """Positive value and positive duration."""
    return (F.col("duracion_dias") > 0) & (F.col("valor_num") > 0)


def cost_per_day() -> Column:
    days = F.abs(F.col("duracion_dias")).cast("double")
    return F.try_divide(F.col("valor_num"), days)


def is_direct(modality: Column) -> Column:
    return _bit(F.lower(F.coalesce(modality, F.lit(""))).contains("direct"))


def incoherent_duration_or_signature() -> Column:
    """Zero or negative duration, or a signature after the start."""
    return (F.col("duracion_dias") <= 0) | (F.col("flag_firma_despues_inicio") == 1)


def modality_risk(modality: Column) -> Column:
    """Risk points of a modality, NULL when it is none of the rated ones."""
    key = normalize_name(modality)
    return F.coalesce(*[F.when(key.contains(word), points) for word, points in MODALITY_RISK])
