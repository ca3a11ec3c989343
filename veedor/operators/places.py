"""Match department and city texts to the official map and fill the map with volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.names import (
    CITY_ALIASES,
    DEPARTMENT_ALIASES,
    UNDEFINED_PLACE,
    lookup,
    normalize_name,
    place_text,
    ranking_label,
)
from veedor.operators.listing import ranked

MAX_LENGTH_GAP = 22
RANKING_ROWS = 40


def _has_name(norm: Column) -> Column:
    return (norm != "") & (norm != UNDEFINED_PLACE)


def department_index(features: DataFrame) -> DataFrame:
    """Normalized name -> official name; the last feature wins when two normalize alike."""
    return features.groupBy(normalize_name(F.col("dpto")).alias("_norm")).agg(
        F.max_by("dpto", "orden").alias("_oficial")
    )


def match_departments(df: DataFrame, features: DataFrame, name: str = "departamento") -> DataFrame:
    """Add ``dpto``: alias table first, then equal normalized names, else NULL."""
    keyed = df.withColumn("_n", normalize_name(F.col(name)))
    index = department_index(features)
    joined = keyed.join(index, (keyed["_n"] == index["_norm"]) & _has_name(keyed["_n"]), "left")
    official = F.coalesce(lookup(DEPARTMENT_ALIASES, F.col("_n")), F.col("_oficial"))
    return joined.withColumn("dpto", official).drop("_n", "_norm", "_oficial")


def match_departments_collated(df: DataFrame, features: DataFrame, name: str = "departamento") -> DataFrame:
    """``match_departments`` by collation, for names in any script; of several equal features the last one wins."""
    official = features.groupBy(place_text(F.col("dpto")).alias("_norm")).agg(F.max_by("dpto", "orden").alias("_oficial"))
    aliases = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(o).alias("oficial")) for a, o in DEPARTMENT_ALIASES.items()])
    keyed = df.withColumn("_n", place_text(F.col(name)))
    alias = F.filter(aliases, lambda x: F.collate(x["alias"], "UNICODE_CI_AI") == F.col("_n"))
    usable = (F.col("_n") != "") & (F.col("_n") != F.collate(F.lit(UNDEFINED_PLACE), "UNICODE_CI_AI"))
    joined = keyed.withColumn("_a", F.get(alias, F.lit(0))["oficial"]).join(official, (F.col("_n") == F.col("_norm")) & usable, "left")
    return joined.withColumn("dpto", F.coalesce("_a", "_oficial")).drop("_n", "_a", "_norm", "_oficial")


def department_fill(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Every department of the map in file order with its volume, 0 when it has none."""
    sums = (
        match_departments(counts, features)
        .where(F.col("dpto").isNotNull())
        .groupBy("dpto")
        .agg(F.sum("n_contratos").alias("_n"))
    )
    return features.select("orden", "dpto").join(sums, "dpto", "left").select(
        "orden", "dpto", F.coalesce("_n", F.lit(0)).cast("double").alias("z")
    )


def unmatched_departments(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Department texts without a place on the map, largest first."""
    missing = match_departments(counts, features).where(F.col("dpto").isNull())
    return ranked(missing.select("departamento", "n_contratos"), "n_contratos", "departamento")


def match_cities(cities: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Add ``mpio`` and ``nivel`` to (dpto, ciudad, ...) rows; cities without a match drop out.

    Level 1: alias; 2: equal normalized names; 3: one name contains the other and lengths
    differ by at most MAX_LENGTH_GAP. Within a level the first municipality of the file wins.
    The official municipalities of a department (about a hundred) travel as one array, so no
    city x municipality rows are made.
    """
    named = municipalities.withColumn("_norm", normalize_name(F.col("mpio"))).where(
        F.coalesce(F.col("_norm"), F.lit("")) != ""
    )
    per_department = named.groupBy("dpto").agg(
        F.array_sort(F.collect_list(F.struct("orden", "mpio", "_norm"))).alias("_mpios")
    )
    keyed = cities.withColumn("_c", normalize_name(F.col("ciudad"))).where(_has_name(F.col("_c")))
    alias = lookup(CITY_ALIASES, F.col("_c"))

    def first(test) -> Column:
        return F.try_element_at(F.filter(F.col("_mpios"), test), F.lit(1))["mpio"]

    def similar(m: Column) -> Column:
        name, city = m["_norm"], F.col("_c")
        inside = name.contains(city) | city.contains(name)
        return inside & (F.abs(F.length(name) - F.length(city)) <= MAX_LENGTH_GAP)

    levels = [
        first(lambda m: m["_norm"] == alias),
        first(lambda m: m["_norm"] == F.col("_c")),
        first(similar),
    ]
    found = keyed.join(per_department, "dpto").withColumn(
        "_m",
        F.coalesce(
            *[
                F.when(v.isNotNull(), F.struct(v.alias("mpio"), F.lit(i).alias("nivel")))
                for i, v in enumerate(levels, start=1)
            ]
        ),
    )
    return found.where(F.col("_m").isNotNull()).select(*cities.columns, "_m.mpio", "_m.nivel")


def municipality_volumes(matched: DataFrame) -> DataFrame:
    """Volumes of all cities of a municipality added up, with its largest city (ties by name)."""
    size_order = F.struct((-F.col("n_contratos")).alias("n"), F.col("ciudad"))
    return matched.groupBy("dpto", "mpio").agg(
        F.sum("n_contratos").alias("n_contratos"),
        F.min_by(F.col("ciudad"), size_order).alias("ciudad"),
    )


def catalog_city(catalog: DataFrame, municipalities: DataFrame) -> DataFrame:
    """First catalog city (by ``orden``) that lands on each municipality."""
    return match_cities(catalog, municipalities).groupBy("dpto", "mpio").agg(
        F.min_by("ciudad", F.struct("orden", "ciudad")).alias("ciudad_catalogo")
    )


def municipality_fill(
    municipalities: DataFrame, volumes: DataFrame, catalog_cities: DataFrame
) -> DataFrame:
    """Every municipality with volume (0 when none), the city text to filter by and a label."""
    official = municipalities.where(F.coalesce(F.col("mpio"), F.lit("")) != "").select("dpto", "mpio")
    city = F.coalesce("ciudad", "ciudad_catalogo", F.lit(""))
    return (
        official.join(volumes, ["dpto", "mpio"], "left")
        .join(catalog_cities, ["dpto", "mpio"], "left")
        .select(
            "dpto", "mpio",
            F.coalesce("n_contratos", F.lit(0)).cast("double").alias("z"),
            city.alias("ciudad_filtro"),
            F.when(city != "", city).otherwise(F.col("mpio")).alias("etiqueta"),
        )
    )


def department_volume(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Volume of each requested ``nombre``: exact text, else the largest department whose
    normalized name is equal, else 0."""
    exact = counts.groupBy(F.trim("departamento").alias("_exacto")).agg(
        F.sum("n_contratos").alias("_n1")
    )
    near = counts.groupBy(normalize_name(F.col("departamento")).alias("_parecido")).agg(
        F.max("n_contratos").alias("_n2")
    )
    asked = requests.withColumns(
        {"_t": F.trim("nombre"), "_k": normalize_name(F.col("nombre"))}
    )
    return (
        asked.join(exact, asked["_t"] == exact["_exacto"], "left")
        .join(near, asked["_k"] == near["_parecido"], "left")
        .select("nombre", F.coalesce("_n1", "_n2", F.lit(0)).cast("bigint").alias("n_contratos"))
    )


def department_ranking(counts: DataFrame, limit: int | None = RANKING_ROWS) -> DataFrame:
    """Largest departments with their short label; with None all of them."""
    top = ranked(counts, "n_contratos", "departamento")
    top = top if limit is None else top.limit(limit)
    return top.withColumn("etiqueta", ranking_label(F.col("departamento")))
