"""Counts of coherence flags and of discarded contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.flags import any_flag, bad_dates, bad_duration, discarded, enriched_columns
from veedor.operators.listing import first_rows, page_order
from veedor.schema import FLAG_COLUMNS

# Flag -> label of the distribution chart.
FLAG_LABELS = {
    "n_fin_antes_inicio": "Fin antes de inicio",
    "n_firma_despues_inicio": "Firma después de inicio",
    "n_valor_invalido": "Valor inválido",
    "n_objeto_muy_corto": "Objeto muy corto",
    "n_duracion_negativa": "Duración negativa",
}


def _percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.greatest(F.lit(1), whole)


def quality_summary(enriched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Total, five flag counts and contracts with any flag, in one pass.

    With ``by`` the report of every group (say each department and year) comes from the
    same pass; without it there is one row, with zeros for an empty input.
    """
    counts = [F.count_if(F.col(f) == 1).alias(f"n_{f.removeprefix('flag_')}") for f in FLAG_COLUMNS]
    return enriched.groupBy(*by).agg(
        F.count("*").alias("total"), *counts, F.count_if(any_flag()).alias("n_con_alguna_alerta")
    )


def population_counts(enriched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Contracts seen, discarded and analyzed, and counts by cause.

    The causes overlap and two of them (late signature, empty text) do not discard.
    """
    return enriched.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(discarded()).alias("n_discarded"),
        F.count_if(~discarded()).alias("n_analyzed"),
        F.count_if(F.col("flag_valor_invalido") == 1).alias("n_discard_valor"),
        F.count_if(bad_dates()).alias("n_discard_fechas"),
        F.count_if(bad_duration()).alias("n_discard_duracion"),
        F.count_if(F.col("longitud_objeto") == 0).alias("n_discard_objeto_vacio"),
    )


def alert_distribution(summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The flag counts of a summary as (regla, n) rows, zero rows left out."""
    labelled = summary.select(*by, *[F.col(c).alias(label) for c, label in FLAG_LABELS.items()])
    long = labelled.unpivot(list(by), list(FLAG_LABELS.values()), "regla", "n")
    return long.where(F.col("n") > 0)


def quality_kpis(enriched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Percent of contracts with a flag and percent discarded."""
    counts = enriched.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(any_flag()).alias("n_con_alguna_alerta"),
        F.count_if(discarded()).alias("n_discarded"),
    )
    return counts.withColumns(
        {
            "pct_con_alerta": _percent(F.col("n_con_alguna_alerta"), F.col("total")),
            "pct_descartado": _percent(F.col("n_discarded"), F.col("total")),
        }
    )


def quality_sample(enriched: DataFrame, limit: int | None = 500) -> DataFrame:
    """First contracts by id with every measure and flag; ties by all columns."""
    rows = enriched_columns(enriched)
    return first_rows(rows, page_order(rows), limit)
