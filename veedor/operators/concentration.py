"""How much of an entity's contracting goes to one supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veedor.functions.flags import is_direct
from veedor.functions.parsing import is_present
from veedor.operators.listing import first_rows, ranked
from veedor.operators.spread import attach_total, parted_by_size
from veedor.operators.windows import trailing_counts, with_trailing
from veedor.runtime import stage
from veedor.schema import PAIR_KEYS

TOP_PAIRS = 30


def pair_counts(df: DataFrame) -> DataFrame:
    """Contracts per entity and supplier, with names: a different spelling is another pair."""
    return df.groupBy(*PAIR_KEYS).agg(F.count("*").alias("contratos_par"))


def concentration_index(df: DataFrame) -> DataFrame:
    """Share of each pair in its entity's contracts; both ids must be present."""
    known = df.where(is_present(F.col("nit_entidad")) & is_present(F.col("doc_proveedor")))
    # Staged: totals and pairs come from one pass over contracts.
    pairs = attach_total(
        stage(pair_counts(known), "pair-counts"), "nit_entidad", "contratos_par", "contratos_entidad",
        ("nombre_entidad", "doc_proveedor", "proveedor"),
    )
    share = F.col("contratos_par").cast("double") / F.col("contratos_entidad")
    return pairs.withColumn("indice_concentracion", share)


def top_concentration(df: DataFrame, limit: int | None = TOP_PAIRS) -> DataFrame:
    """Highest shares first, then larger pairs, then key."""
    order = [
        F.col("indice_concentracion").desc_nulls_last(),
        F.col("contratos_par").desc(),
        *[F.col(k).asc_nulls_last() for k in PAIR_KEYS],
    ]
    return first_rows(concentration_index(df), order, limit)


_STARTS = ("nit_entidad", "doc_proveedor", "fecha_inicio")


def trailing_concentration(df: DataFrame, days: int = 365, hot_rows: int | None = None) -> DataFrame:
    """At each start date of a pair: the supplier's share of the entity's contracts in the
    ``days`` before it. ``hot_rows`` as in ``parted_by_size``."""
    known = df.where(F.col("nit_entidad").isNotNull() & F.col("doc_proveedor").isNotNull() & F.col("fecha_inicio").isNotNull())
    # Staged: contracts are read once. Those of all but huge entities then move once, to the task of their entity.
    few, many = parted_by_size(stage(known.select(*_STARTS), "pair-starts"), "nit_entidad", hot_rows)
    starts = few.groupBy(*_STARTS).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    both = with_trailing(starts, ("nit_entidad", "doc_proveedor"), "fecha_inicio", days, n, "contratos_par")
    both = with_trailing(both, ("nit_entidad",), "fecha_inicio", days, n, "contratos_entidad").drop("_n")
    if many is not None:
        both = both.unionByName(_trailing_of_many(many, days))
    share = F.col("contratos_par").cast("double") / F.col("contratos_entidad")
    return both.select(*_STARTS, "contratos_par", "contratos_entidad", share.alias("indice"))


def _trailing_of_many(rows: DataFrame, days: int) -> DataFrame:
    """The same counts for entities of any size, whose rows never meet in one task."""
    starts = stage(rows.groupBy(*_STARTS).agg(F.count("*").alias("n")), "pair-starts")
    n = F.col("n")
    pair = trailing_counts(starts, ("nit_entidad", "doc_proveedor"), "fecha_inicio", days, n)
    entity = trailing_counts(starts, ("nit_entidad",), "fecha_inicio", days, n).select(
        "nit_entidad", "fecha_inicio", F.col("n_ventana").alias("contratos_entidad")
    )
    return pair.join(entity, ["nit_entidad", "fecha_inicio"]).select(
        *_STARTS, F.col("n_ventana").alias("contratos_par"), "contratos_entidad"
    )


def direct_burst(df: DataFrame, days: int = 30, minimum: int = 2) -> DataFrame:
    """Suppliers with at least ``minimum`` direct awards within ``days`` days."""
    direct = df.where((is_direct(F.col("modalidad")) == 1) & is_present(F.col("doc_proveedor")))
    peak = trailing_counts(direct, ("doc_proveedor",), "fecha_inicio", days)
    per_supplier = peak.groupBy("doc_proveedor").agg(
        F.sum("n_filas").cast("bigint").alias("n_directos"),
        F.max("n_ventana").cast("bigint").alias("max_directos_ventana"),
    )
    return ranked(
        per_supplier.where(F.col("max_directos_ventana") >= minimum),
        "max_directos_ventana", "doc_proveedor",
    )


def direct_ratio(enriched: DataFrame) -> DataFrame:
    """Value awarded directly over value awarded otherwise, per entity; NULL without the latter."""
    direct = is_direct(F.col("modalidad")) == 1
    money = F.col("valor_num")
    sums = enriched.where(F.col("flag_valor_invalido") == 0).groupBy("nit_entidad").agg(
        F.coalesce(F.sum(F.when(direct, money)), F.lit(0.0)).alias("valor_directo"),
        F.coalesce(F.sum(F.when(~direct, money)), F.lit(0.0)).alias("valor_competitivo"),
    )
    return sums.withColumn(
        "ratio_directa", F.try_divide(F.col("valor_directo"), F.col("valor_competitivo"))
    )
