"""One row per entity and supplier: what the rules and the model look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veedor.functions.flags import SHORT_TEXT, cost_per_day, discarded, is_direct
from veedor.operators.spread import attach_total, parted_by_size
from veedor.operators.windows import trailing_counts, with_trailing
from veedor.runtime import stage
from veedor.schema import PAIR_KEYS

BURST_DAYS = 10
OBJECT_PREFIX = 50


def analyzed(enriched: DataFrame) -> DataFrame:
    """Contracts that take part in the pair analysis."""
    return enriched.where(~discarded())


_IDS = ("nit_entidad", "doc_proveedor")


def burst_peaks(rows: DataFrame, days: int = BURST_DAYS) -> DataFrame:
    """Most contracts of a pair of ids within ``days`` days."""
    counts = trailing_counts(rows, _IDS, "fecha_inicio", days)
    return counts.groupBy(*_IDS).agg(
        F.max("n_ventana").cast("bigint").alias("max_contratos_ventana")
    )


def object_start() -> Column:
    """What two contracts' objects have to share to count as one."""
    return F.left(F.trim(F.coalesce("objeto_raw", F.lit(""))), F.lit(OBJECT_PREFIX))


def _narrow(rows: DataFrame) -> DataFrame:
    """What the features of a pair are made of."""
    return rows.select(
        *PAIR_KEYS, "fecha_inicio", "valor_num", "duracion_dias", "longitud_objeto",
        cost_per_day().alias("costo_dia"),
        is_direct(F.col("modalidad")).cast("double").alias("directa"),
        object_start().alias("inicio_objeto"),
    )


def _measures() -> list[Column]:
    short = F.when(F.col("longitud_objeto") < SHORT_TEXT, 1.0).otherwise(0.0)
    return [
        F.count("*").alias("n_contratos"),
        F.sum("valor_num").alias("suma_valor"),
        F.avg("valor_num").alias("promedio_valor"),
        F.avg("costo_dia").alias("costo_dia_promedio"),
        F.avg("duracion_dias").alias("duracion_promedio"),
        F.avg("directa").alias("ratio_directa"),
        F.avg(short).alias("pct_objeto_corto"),
        F.count_distinct("inicio_objeto").alias("diversidad_objetos"),
        F.min("longitud_objeto").alias("min_longitud_objeto"),
    ]


_COLUMNS = (
    *PAIR_KEYS, "n_contratos", "suma_valor", "promedio_valor", "costo_dia_promedio",
    "duracion_promedio", "ratio_directa", "pct_objeto_corto", "diversidad_objetos",
    "min_longitud_objeto", "max_contratos_ventana", "concentracion_entidad", "n_entidad_anio",
)


def pair_features(enriched: DataFrame, days: int = BURST_DAYS, hot_rows: int | None = None) -> DataFrame:
    """Features of every pair over the analyzed contracts.

    Entity totals come from the pairs themselves, not from a second pass over contracts.
    The burst belongs to the two ids, so spellings of a name share it; without a supplier id
    (or without dates) it is the pair's contract count.

    Contracts of all but huge entities (``hot_rows``, see ``parted_by_size``) move once, to the task of their entity,
    where pairs, bursts and totals are made; those of huge ones are spread.
    """
    # Staged: contracts are joined, parsed and filtered once.
    rows = stage(_narrow(analyzed(enriched).where(F.col("nit_entidad").isNotNull())), "pair-contracts")
    few, many = parted_by_size(rows, "nit_entidad", hot_rows)
    found = _features_within_entity(few, days)
    if many is not None:
        found = found.unionByName(_features_spread(many, days))
    share = F.col("n_contratos").cast("double") / F.col("n_entidad_anio")
    burst = F.coalesce("max_contratos_ventana", "n_contratos").alias("max_contratos_ventana")
    made = {"max_contratos_ventana": burst, "concentracion_entidad": share.alias("concentracion_entidad")}
    return found.select(*[made.get(c, F.col(c)) for c in _COLUMNS])


def _features_within_entity(rows: DataFrame, days: int) -> DataFrame:
    """Pairs of rows that lie dealt by entity: every grouping holds the entity, so none needs a shuffle."""
    windows = with_trailing(rows, _IDS, "fecha_inicio", days, F.lit(1).cast("bigint"), "_ventana")
    burst = F.when(F.col("doc_proveedor").isNotNull() & F.col("fecha_inicio").isNotNull(), F.col("_ventana"))
    pairs = windows.withColumn("_ventana", burst).groupBy(*PAIR_KEYS).agg(*_measures(), F.max("_ventana").alias("_ventana"))
    return pairs.withColumns(
        {
            "max_contratos_ventana": F.max("_ventana").over(Window.partitionBy(*_IDS)),
            "n_entidad_anio": F.sum("n_contratos").over(Window.partitionBy("nit_entidad")),
        }
    ).drop("_ventana")


def _features_spread(rows: DataFrame, days: int) -> DataFrame:
    """The same for entities of any size, whose rows never meet in one task."""
    aggregate = stage(rows.groupBy(*PAIR_KEYS).agg(*_measures()), "pair-aggregate")
    pairs = attach_total(
        aggregate, "nit_entidad", "n_contratos", "n_entidad_anio",
        ("nombre_entidad", "doc_proveedor", "proveedor"),
    )
    peaks = burst_peaks(rows.where(F.col("doc_proveedor").isNotNull()), days).select(
        F.col("nit_entidad").alias("_nit"), F.col("doc_proveedor").alias("_doc"),
        F.lit(False).alias("_sin_doc"), "max_contratos_ventana",
    )
    # Pairs without a supplier id match nothing; a hash as join value keeps them apart, so
    # that they do not all land in one task.
    filler = F.xxhash64("nombre_entidad", "proveedor").cast("string")
    keyed = pairs.withColumns(
        {
            "_clave": F.coalesce("doc_proveedor", filler),
            "_falta": F.col("doc_proveedor").isNull(),
        }
    )
    joined = keyed.join(
        peaks,
        (keyed["nit_entidad"] == peaks["_nit"])
        & (keyed["_clave"] == peaks["_doc"])
        & (keyed["_falta"] == peaks["_sin_doc"]),
        "left",
    )
    return joined.drop("_clave", "_falta", "_nit", "_doc", "_sin_doc")


MODEL_FEATURES = (
    "log_n_contratos",
    "log_suma_valor",
    "log_promedio_valor",
    "f_ratio_directa",
    "f_concentracion",
    "f_ventana",
    "log_costo_dia",
    "log_duracion",
    "f_diversidad",
    "f_objeto_corto",
    "repeticion_objeto",
)


def model_features(pairs: DataFrame) -> DataFrame:
    """Add the eleven model inputs; what is not a finite number becomes 0."""

    def clean(value: Column) -> Column:
        v = value.cast("double")
        good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        return F.when(good, v).otherwise(F.lit(0.0))

    def number(name: str) -> Column:
        return F.col(name).cast("double")

    ratio = number("diversidad_objetos") / F.greatest(F.col("n_contratos"), F.lit(1))
    repeated = F.lit(1.0) - F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    inputs = (
        F.log1p(number("n_contratos")),
        F.log1p(number("suma_valor")),
        F.log1p(number("promedio_valor")),
        number("ratio_directa"),
        number("concentracion_entidad"),
        number("max_contratos_ventana"),
        F.log1p(F.coalesce(number("costo_dia_promedio"), F.lit(0.0))),
        F.log1p(F.coalesce(number("duracion_promedio"), F.lit(0.0))),
        number("diversidad_objetos"),
        number("pct_objeto_corto"),
        repeated,
    )
    return pairs.withColumns({n: clean(v) for n, v in zip(MODEL_FEATURES, inputs)})
