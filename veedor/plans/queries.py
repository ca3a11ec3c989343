"""Registered queries: every operator over whole tables, one callable each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veedor.functions.flags import discarded, enrich, enriched_columns, is_direct, with_measures
from veedor.functions.names import BOGOTA, normalize_name, ranking_label, value_label
from veedor.functions.parsing import parse_timestamp
from veedor.operators import concentration, explore, listing, places, publish, quality, scope, signals, sketches
from veedor.operators.isolation import fit_forest, fit_saved, load_forest, normalized, save_forest, with_anomaly
from veedor.operators.pairs import MODEL_FEATURES, analyzed, burst_peaks, model_features, object_start, pair_features
from veedor.operators.quantiles import exact_quantiles, quantile_value
from veedor.operators.rules import RULES, rule_catalog, with_rules
from veedor.operators.scope import DateBucket, Scope
from veedor.operators.substrings import match_cities_indexed
from veedor.operators.windows import trailing_counts
from veedor.plans.risk import RiskOptions, run_risk
from veedor.runtime import delete_path, new_path, shuffles_dropped, stage
from veedor.schema import EXPORT_COLUMNS, PAIR_KEYS
from veedor.sources import catalog, export, geojson
from veedor.sources.buckets import BucketTable
from veedor.sources.directory import PageDirectory
from veedor.sources.star import contracts, table
from veedor.streaming import feeds, views
from veedor.streaming.bursts import exact_burst_feed
from veedor.streaming.known_ids import drop_all_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

REGION_YEAR = Scope("ASIA", None, 1997)
BURST_DAYS = 60
RULES_ONLY = RiskOptions(
    weight_rules=1.0, weight_model=0.0, burst_days=BURST_DAYS, burst_min=2, display_limit=None
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich(contracts(spark, d))


def _with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("anio", F.year("fecha_inicio").cast("bigint"))


def _fixed(value: Column, digits: int = 5) -> Column:
    """Rounding for comparisons, with the same double arithmetic as the checking SQL.

    It rounds up from .7: a mean of cents often lies exactly on a half, and there the last
    bit of a sum taken in another order would decide.
    """
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.3) / scale


def _fix(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: _fixed(F.col(c), n) for c, n in digits.items()})


# --- quality -------------------------------------------------------------------------------


@query
def quality_summary(spark, d):
    return quality.quality_summary(_with_year(_enriched(spark, d)), ("departamento", "anio"))


@query
def quality_summary_region_year(spark, d):
    return quality.quality_summary(REGION_YEAR.apply(_enriched(spark, d)))


@query
def quality_sample(spark, d):
    return quality.quality_sample(_enriched(spark, d))


@query
def enriched_contracts(spark, d):
    return enriched_columns(_enriched(spark, d))


@query
def alert_distribution(spark, d):
    by = ("departamento",)
    return quality.alert_distribution(quality.quality_summary(_enriched(spark, d), by), by)


@query
def quality_kpis(spark, d):
    kpis = quality.quality_kpis(_with_year(_enriched(spark, d)), ("departamento", "anio"))
    return _fix(kpis, pct_con_alerta=5, pct_descartado=5)


@query
def population_counts(spark, d):
    return quality.population_counts(_with_year(_enriched(spark, d)), ("departamento", "anio"))


@query
def inconsistent_contracts(spark, d):
    return signals.inconsistent(_enriched(spark, d)).select(
        "id_contrato", "duracion_dias", "flag_firma_despues_inicio"
    )


# --- counts, pages, filters ----------------------------------------------------------------


@query
def count_filtered(spark, d):
    return listing.filtered_counts(
        _with_year(_enriched(spark, d)), ("departamento", "ciudad", "anio")
    )


@query
def year_range(spark, d):
    return listing.year_range(
        contracts(spark, d, "departamento", "ciudad", "fecha_inicio"), ("departamento", "ciudad")
    )


@query
def page_by_id(spark, d):
    return listing.page(contracts(spark, d), 3)


@query
def page_deep(spark, d):
    """The last page, from a sorted copy and its directory."""
    return PageDirectory.build(contracts(spark, d), new_path(spark, "pages"), file_rows=20_000).last_page()


@query
def page_keyset(spark, d):
    return listing.page_after(contracts(spark, d), {"id_contrato": "2000-"})


@query
def page_bounds(spark, d):
    counts = listing.filtered_counts(_with_year(_enriched(spark, d)), ("departamento", "anio"))
    return listing.page_bounds(counts.select("departamento", "anio", "n"), 40)


@query
def date_buckets(spark, d):
    buckets = (
        DateBucket("desde_1996_hasta_1998", "1996-01-01", "1999-01-01"),
        DateBucket("solo_1999", "1999-01-01", "2000-01-01"),
        DateBucket("antes_1996", None, "1996-01-01"),
    )
    in_region = F.col("departamento") == "AMERICA"
    scopes = {"region": in_region, "ciudad": in_region & (F.col("ciudad") == "NATION_11")}
    df = contracts(spark, d, "departamento", "ciudad", "fecha_inicio")
    return scope.bucket_counts(df, scopes, buckets)


@query
def predicate_variants(spark, d):
    variants = scope.spelling_variants("departamento", "América", "America")
    return scope.first_match(contracts(spark, d, "departamento"), variants)


@query
def predicate_counts(spark, d):
    df = contracts(spark, d, "departamento", "ciudad", "fecha_inicio", "modalidad")
    free = {"libre": "departamento = 'ASIA' AND upper(modalidad) like '%DIRECTA%' AND fecha_inicio IS NOT NULL"}
    return scope.count_where(df, {**scope.city_variants("Nation_1"), **scope.city_variants("NATION_1"), **free})


# --- descriptive reports -------------------------------------------------------------------


@query
def modality_stats(spark, d):
    df = contracts(spark, d, "modalidad", "valor_raw")
    return explore.modality_stats(with_measures(df, only=("valor_num",)))


@query
def monthly_series(spark, d):
    months = explore.monthly_series(contracts(spark, d, "departamento", "fecha_inicio"), ("departamento",))
    return listing.numbered(months, [F.col("anio_mes")], ("departamento",))


@query
def scatter_sample(spark, d):
    return _fix(explore.scatter_sample(_enriched(spark, d)), costo_por_dia=5)


def _cost_points(spark: SparkSession, d: str) -> DataFrame:
    """Staged: the quantile, the limits and the bins each read it."""
    df = contracts(spark, d, "id_contrato", "fecha_inicio", "fecha_fin", "valor_raw")
    points = explore.scatter_points(with_measures(df, only=("valor_num", "duracion_dias")))
    return stage(points.select("id_contrato", "valor_num", "duracion_dias", "costo_por_dia"), "points")


@query
def cost_per_day_trim(spark, d):
    points = explore.trim_at_p99(_cost_points(spark, d))
    return _fix(points.select("id_contrato", "costo_por_dia"), costo_por_dia=5)


@query
def cost_histogram(spark, d):
    bins = explore.histogram(explore.trim_at_p99(_cost_points(spark, d)), "costo_por_dia")
    return _fix(bins, lo=5, hi=5, centro=5)


@query
def axis_extents(spark, d):
    ends = explore.axis_extents(_cost_points(spark, d))
    return _fix(ends, valor_lo=8, valor_hi=8, duracion_lo=8, duracion_hi=8)


@query
def value_labels(spark, d):
    raw = with_measures(contracts(spark, d, "id_contrato", "valor_raw"), only=("valor_num",))
    value = F.col("valor_num")
    # The same amounts seen as pesos, thousands and hundred thousands of pesos.
    return raw.select(
        "id_contrato",
        value_label(value).alias("etiqueta"),
        value_label(value * 1000).alias("etiqueta_miles"),
        value_label(value * 100000).alias("etiqueta_cien_miles"),
    )


@query
def value_quantiles(spark, d):
    df = with_measures(contracts(spark, d, "departamento", "valor_raw"), only=("valor_num",))
    found = exact_quantiles(df, "valor_num", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ("departamento",))
    return _fix(found, p10=5, p50=5, p99=5)


@query
def quantile_sketches(spark, d):
    """Sketches per place and year, added to when later years arrive, merged per place and over all; and
    whether the answers' ranks, counted in the contracts, are as near as promised."""
    df = _with_year(with_measures(contracts(spark, d, "departamento", "fecha_inicio", "valor_raw"), only=("valor_num",)))
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    by = ("departamento", "anio")
    early = stage(sketches.sketch_table(df.where("anio < 1996"), "valor_num", by), "sketches")
    table = stage(sketches.with_new_rows(early, df.where("anio >= 1996"), "valor_num", by), "sketches")
    places = sketches.merged(table, ("departamento",)).withColumnRenamed("departamento", "ambito")
    scopes = places.unionByName(sketches.merged(table).withColumn("ambito", F.lit("(todo)")))
    answers = stage(sketches.quantiles_of(scopes, probs), "sketch-quantiles")
    rows = df.select("valor_num", F.explode(F.array("departamento", F.lit("(todo)"))).alias("ambito")).where("valor_num IS NOT NULL")
    met = rows.join(answers, "ambito")
    counts = met.groupBy("ambito", "n").agg(
        *[F.count_if(F.col("valor_num") < F.col(q)).alias(f"{q}_antes") for q in probs],
        *[F.count_if(F.col("valor_num") <= F.col(q)).alias(f"{q}_hasta") for q in probs],
    )
    error = 2 * sketches.rank_error(sketches.SIZE)
    near = [
        F.struct(
            F.lit(q).alias("cuantil"),
            ((F.col(f"{q}_antes") <= (p + error) * F.col("n")) & (F.col(f"{q}_hasta") >= (p - error) * F.col("n"))).alias("dentro"),
        )
        for q, p in probs.items()
    ]
    return counts.select("ambito", F.col("n").cast("bigint").alias("n"), F.inline(F.array(*near)))


# --- concentration -------------------------------------------------------------------------



@query
def concentration_index(spark, d):
    found = concentration.concentration_index(contracts(spark, d, *PAIR_KEYS))
    return _fix(found, indice_concentracion=8)


@query
def concentration_top(spark, d):
    return _fix(concentration.top_concentration(contracts(spark, d, *PAIR_KEYS)), indice_concentracion=8)


@query
def trailing_concentration(spark, d):
    df = contracts(spark, d, "nit_entidad", "doc_proveedor", "fecha_inicio")
    return _fix(concentration.trailing_concentration(df), indice=8)


@query
def direct_burst_30d(spark, d):
    return concentration.direct_burst(contracts(spark, d, "doc_proveedor", "modalidad", "fecha_inicio"))


@query
def direct_ratio(spark, d):
    found = concentration.direct_ratio(_enriched(spark, d))
    return _fix(found, valor_directo=2, valor_competitivo=2, ratio_directa=5)


@query
def relationship_age(spark, d):
    df = contracts(spark, d, "id_contrato", "doc_proveedor", "fecha_inicio")
    return signals.relationship_age(df).select("id_contrato", "primer_contrato", "antiguedad_dias")


@query
def sigma_outliers(spark, d):
    found = signals.value_outliers(table(spark, d, "events"), "value", "event_type", "event_id")
    return _fix(found.select("event_id", "event_type", "value", "media"), media=5)


@query
def sigma_outliers_contracts(spark, d):
    valid = _enriched(spark, d).where(F.col("flag_valor_invalido") == 0)
    found = signals.value_outliers(valid, "valor_num", "tipo_contrato", "id_contrato", 1.6)
    return found.select("id_contrato", "tipo_contrato", "valor_num")


@query
def sector_deviation(spark, d):
    found = signals.sector_deviation(_enriched(spark, d), "tipo_contrato")
    return _fix(found.select("id_contrato", "tipo_contrato", "desviacion_pct"), desviacion_pct=5)


@query
def modality_risk(spark, d):
    df = contracts(spark, d, "id_contrato", "modalidad")
    return signals.with_modality_risk(df).withColumn("es_directa", is_direct(F.col("modalidad")))


# --- places --------------------------------------------------------------------------------


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """Contracts whose place names are written the way each modality's office writes them."""
    df = contracts(spark, d, "departamento", "ciudad", "modalidad", "fecha_inicio")
    dep, city, mode = F.col("departamento"), F.col("ciudad"), F.col("modalidad")
    region = (
        F.when(mode == "Contratación directa", dep)
        .when(mode == "Licitación pública", F.concat(F.lit("  "), F.lower(dep), F.lit(" ")))
        .when(mode == "Contratación Directa (con ofertas)", F.translate(dep, "AEIOU", "ÁÉÍÓÚ"))
        .when((mode == "Mínima cuantía") & (dep == "AMERICA"), "Distrito Capital de Bogotá")
        .when(mode == "Mínima cuantía", F.concat(F.lit("Zona "), dep))
        .otherwise("No Definido")
    )
    place = (
        F.when(mode == "Contratación directa", city)
        .when((mode == "Licitación pública") & (city == "NATION_6"), "Santa Fe de Bogotá")
        .when(mode == "Licitación pública", F.lower(city))
        .when(mode == "Contratación Directa (con ofertas)", F.concat(F.lit("Ciudad de "), city))
        .when(mode == "Mínima cuantía", F.left(city, F.lit(8)))
        .otherwise(" ")
    )
    return df.withColumns({"departamento": region, "ciudad": place})


def _map(spark: SparkSession, d: str) -> DataFrame:
    """Official places as a feature table: regions are departments, nations municipalities."""
    joined = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        F.col("n_nationkey").cast("bigint").alias("orden"),
        F.when(F.col("r_name") == "AMERICA", BOGOTA).otherwise(F.col("r_name")).alias("dpto"),
        F.when(F.col("n_name") == "NATION_6", BOGOTA).otherwise(F.col("n_name")).alias("mpio"),
    )


def _departments(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d).groupBy("dpto").agg(F.min("orden").alias("orden"))


def _city_counts(spark: SparkSession, d: str) -> DataFrame:
    """Staged: names are compared once a place. Over the contracts' own plan the conditions on a name would be moved
    below the count and be met once a contract."""
    return stage(listing.by_city(_spelled(spark, d)), "city-counts")


def _cities(spark: SparkSession, d: str) -> DataFrame:
    counts = _city_counts(spark, d)
    matched = places.match_departments(counts, _departments(spark, d))
    return (
        matched.where(F.col("dpto").isNotNull())
        .groupBy("dpto", "ciudad")
        .agg(F.sum("n_contratos").alias("n_contratos"))
    )


@query
def by_department(spark, d):
    return listing.numbered(listing.by_department(_spelled(spark, d)), listing.largest_first("departamento"))


@query
def by_city(spark, d):
    return listing.numbered(listing.by_city(_spelled(spark, d)), listing.largest_first("ciudad"), ("departamento",))


@query
def city_list(spark, d):
    return listing.numbered_cities(listing.city_list(_spelled(spark, d)))


@query
def department_rank(spark, d):
    return places.department_ranking(listing.by_department(_spelled(spark, d)), None)


@query
def region_pairs(spark, d):
    return catalog.region_pairs(_spelled(spark, d))


@query
def region_catalog(spark, d):
    nested = catalog.nested_catalog(catalog.region_pairs(_spelled(spark, d)))
    return nested.select(
        "departamento", F.size("ciudades").cast("bigint").alias("n_ciudades"),
        F.array_join("ciudades", "|").alias("ciudades"),
    )


@query
def region_catalog_saved(spark, d):
    path = new_path(spark, "catalog")
    found, label = catalog.resolve_catalog(spark, path, None, lambda: _spelled(spark, d))
    return found.select("departamento", "ciudad", F.col("orden").cast("bigint").alias("orden"), F.lit(label).alias("origen"))


def _catalog_from(spark: SparkSession, d: str, path: str, api) -> DataFrame:
    found, label = catalog.resolve_catalog(spark, path, api, lambda: _spelled(spark, d).limit(0))
    return found.select("departamento", "ciudad", F.col("orden").cast("bigint").alias("orden"), F.lit(label).alias("origen"))


@query
def region_catalog_api(spark, d):
    """The API's rows come first and are saved."""
    return _catalog_from(spark, d, new_path(spark, "catalog"), lambda: _spelled(spark, d))


@query
def region_catalog_json(spark, d):
    """Without an API the saved document is next."""
    path = new_path(spark, "catalog")
    catalog.save_catalog(catalog.region_pairs(_spelled(spark, d)), path, "api")
    return _catalog_from(spark, d, path, None)


@query
def region_match_collated(spark, d):
    """``region_match`` by collation."""
    counts = listing.by_department(_spelled(spark, d))
    return places.match_departments_collated(counts, _departments(spark, d))


@query
def region_match(spark, d):
    counts = listing.by_department(_spelled(spark, d))
    return places.match_departments(counts, _departments(spark, d))


@query
def region_fill(spark, d):
    return places.department_fill(listing.by_department(_spelled(spark, d)), _departments(spark, d))


@query
def region_unmatched(spark, d):
    return places.unmatched_departments(
        listing.by_department(_spelled(spark, d)), _departments(spark, d)
    )


def _map_from_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The map written as a GeoJSON document and read back."""
    path = new_path(spark, "geojson")
    properties = F.struct(F.col("dpto").alias("DPTO_CNMBR"), F.col("mpio").alias("MPIO_CNMBR"))
    feature = F.struct(properties.alias("properties"), F.lit(None).cast("string").alias("geometry"))
    ordered = F.array_sort(F.collect_list(F.struct("orden", feature.alias("f"))))
    _map(spark, d).agg(F.transform(ordered, lambda e: e["f"]).alias("features")).write.json(path)
    return geojson.read_features(spark, path)


@query
def region_fill_geojson(spark, d):
    """The same fill with the map read from a GeoJSON document."""
    departments = _map_from_geojson(spark, d).groupBy("dpto").agg(F.min("orden").alias("orden"))
    return places.department_fill(listing.by_department(_spelled(spark, d)), departments)


@query
def city_tier_match(spark, d):
    return places.match_cities(_cities(spark, d), _map(spark, d))


@query
def city_tier_index(spark, d):
    """``city_tier_match`` by an index of letter groups."""
    return match_cities_indexed(_cities(spark, d), _map(spark, d))


@query
def municipality_volumes(spark, d):
    return places.municipality_volumes(places.match_cities(_cities(spark, d), _map(spark, d)))


def _catalog_cities(spark: SparkSession, d: str) -> DataFrame:
    """Cities of each department in catalog order (``orden`` from the name order itself)."""
    pairs = catalog.region_pairs(_spelled(spark, d))
    nested = catalog.nested_catalog(pairs).select("departamento", F.posexplode("ciudades").alias("orden", "ciudad"))
    matched = places.match_departments(nested, _departments(spark, d))
    return matched.where(F.col("dpto").isNotNull()).select("dpto", "ciudad", "orden")


def _municipality_fill(spark: SparkSession, d: str, municipalities: DataFrame) -> DataFrame:
    counts = places.match_departments(_city_counts(spark, d), _departments(spark, d))
    volumes = places.municipality_volumes(
        places.match_cities(
            counts.where(F.col("dpto").isNotNull()).select("dpto", "ciudad", "n_contratos"), municipalities
        )
    )
    first = places.catalog_city(_catalog_cities(spark, d), municipalities)
    return listing.numbered(places.municipality_fill(municipalities, volumes, first), [F.col("mpio")], ("dpto",))


@query
def municipality_fill(spark, d):
    return _municipality_fill(spark, d, _map(spark, d))


@query
def municipality_fill_geojson(spark, d):
    """The same fill with the municipalities read from a GeoJSON document."""
    return _municipality_fill(spark, d, _map_from_geojson(spark, d).select("orden", "dpto", "mpio"))


@query
def department_volume(spark, d):
    asked = _departments(spark, d).select(F.col("dpto").alias("nombre")).unionByName(
        _departments(spark, d).select(F.concat(F.lit("Zona "), F.lower("dpto")).alias("nombre"))
    )
    return places.department_volume(asked, listing.by_department(_spelled(spark, d)))


@query
def normalized_names(spark, d):
    """Names as keys: accents, case, inner blanks and labels."""
    names = _spelled(spark, d).groupBy("departamento", "ciudad").agg(F.count("*").alias("n"))
    return names.select(
        "departamento", "ciudad", "n",
        normalize_name(F.concat_ws("   ", "departamento", "ciudad")).alias("clave"),
        ranking_label(F.col("departamento")).alias("etiqueta"),
    )


# --- pairs, rules, model -------------------------------------------------------------------


def _burst_input(spark: SparkSession, d: str) -> DataFrame:
    cols = ("nit_entidad", "doc_proveedor", "fecha_firma", "fecha_inicio", "fecha_fin", "valor_raw")
    return analyzed(enrich(contracts(spark, d, *cols).withColumn("objeto_raw", F.lit(""))))


@query
def burst_window(spark, d):
    return trailing_counts(
        _burst_input(spark, d), ("nit_entidad", "doc_proveedor"), "fecha_inicio", BURST_DAYS
    )


@query
def burst_max(spark, d):
    return burst_peaks(_burst_input(spark, d), BURST_DAYS)


@query
def burst_window_hot(spark, d):
    """The same windows with every key split by hour, as only very large ones are by default."""
    return trailing_counts(
        _burst_input(spark, d), ("nit_entidad", "doc_proveedor"), "fecha_inicio", BURST_DAYS, hot_rows=0
    )


@query
def burst_window_nation(spark, d):
    """A busier grain: place and supplier, default window."""
    df = contracts(spark, d, "ciudad", "doc_proveedor", "fecha_inicio")
    return trailing_counts(df, ("ciudad", "doc_proveedor"), "fecha_inicio", 10)


@query
def burst_window_events(spark, d):
    """Times with fractions of a second."""
    return trailing_counts(table(spark, d, "events"), ("user_id", "event_type"), "ts", 2)


_PAIR_DIGITS = {
    "suma_valor": 2, "promedio_valor": 5, "costo_dia_promedio": 5, "duracion_promedio": 5,
    "ratio_directa": 5, "pct_objeto_corto": 5, "concentracion_entidad": 8,
}


@query
def pair_features_60d(spark, d):
    return _fix(pair_features(_enriched(spark, d), BURST_DAYS), **_PAIR_DIGITS)


@query
def pair_diversity_sketch(spark, d):
    """Distinct object texts from sketches per pair and month, merged per pair and per supplier; and whether they are
    as near to the exact count as promised."""
    cols = ("nit_entidad", "doc_proveedor", "fecha_firma", "fecha_inicio", "fecha_fin", "valor_raw", "objeto_raw")
    rows = analyzed(enrich(contracts(spark, d, *cols))).select(
        "nit_entidad", "doc_proveedor", F.date_format("fecha_inicio", "yyyy-MM").alias("mes"), object_start().alias("objeto")
    )
    monthly = stage(sketches.distinct_table(rows, F.col("objeto"), ("nit_entidad", "doc_proveedor", "mes")), "diversity")
    found = []
    for scope, by in (("par", ("nit_entidad", "doc_proveedor")), ("proveedor", ("doc_proveedor",))):
        estimated = sketches.distinct_counts(sketches.distinct_merged(monthly, by), "estimado")
        exact = rows.groupBy(*by).agg(F.count_distinct("objeto").alias("exacto"))
        near = F.abs(F.col("estimado") - F.col("exacto")) <= 4 * sketches.distinct_error() * F.col("exacto")
        met = estimated.join(exact, list(by)).withColumns({"ambito": F.lit(scope), "dentro": near})
        entity = F.col("nit_entidad") if "nit_entidad" in by else F.lit(None).cast("string")
        found.append(met.select("ambito", entity.alias("nit_entidad"), "doc_proveedor", F.col("n").cast("bigint").alias("n"), "exacto", "dentro"))
    return found[0].unionByName(found[1])


def _staged_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stage(pair_features(_enriched(spark, d), BURST_DAYS), "pairs")


@query
def rule_scores(spark, d):
    large = _staged_pairs(spark, d).where(F.col("n_contratos") >= 2)
    limit = quantile_value(large, "costo_dia_promedio", 0.9)
    ruled = with_rules(large, limit, burst_min=2)
    return ruled.select(*PAIR_KEYS, *RULES, F.round("score_reglas", 2).alias("score_reglas"), "reglas_disparadas")


@query
def rule_firing(spark, d):
    """The rule catalog with the number of pairs that fire each rule."""
    large = _staged_pairs(spark, d).where(F.col("n_contratos") >= 2)
    limit = quantile_value(large, "costo_dia_promedio", 0.9)
    fired = with_rules(large, limit, burst_min=2).agg(*[F.count_if(F.col(r)).alias(r) for r in RULES])
    long = fired.unpivot([], list(RULES), "regla", "n_pares")
    return rule_catalog(spark).join(long, "regla")


@query
def rules_ranking(spark, d):
    return _fix(
        run_risk(_enriched(spark, d), RULES_ONLY).ranking, suma_valor=2, ratio_directa=5, concentracion_entidad=8, score_final=5,
        score_reglas=5, score_anomalia=5,
    )


@query
def pair_model_features(spark, d):
    found = model_features(pair_features(_enriched(spark, d), BURST_DAYS))
    return _fix(found.select(*PAIR_KEYS, *MODEL_FEATURES), **{f: 5 for f in MODEL_FEATURES})


@query
def forest_scores(spark, d):
    pairs = stage(model_features(pair_features(_enriched(spark, d))), "pair-features")
    forest = fit_forest(pairs, MODEL_FEATURES, PAIR_KEYS)
    raw = stage(with_anomaly(pairs, MODEL_FEATURES, forest, "crudo"), "pair-scores")
    return normalized(raw, "crudo", "score_anomalia").select(*PAIR_KEYS, "crudo", "score_anomalia")


@query
def contract_forest_scores(spark, d):
    """The model on contracts instead of pairs."""
    wanted = ("id_contrato", *signals.CONTRACT_FEATURES)
    rows = stage(signals.contract_features(_enriched(spark, d)).select(*wanted), "contract-features")
    forest = fit_forest(rows, signals.CONTRACT_FEATURES, ("id_contrato",))
    return with_anomaly(rows, signals.CONTRACT_FEATURES, forest, "score_anomalia").select(
        "id_contrato", "score_anomalia"
    )


@query
def blended_ranking(spark, d):
    """Blend, alert, explanation and order with given anomaly scores: a hash of the ids."""
    digits = F.substring(F.md5(F.concat_ws("|", "nit_entidad", "doc_proveedor")), 1, 4)
    given = F.conv(digits, 16, 10).cast("double") / 65536
    options = RiskOptions(burst_days=BURST_DAYS, burst_min=2, display_limit=None)
    return _fix(
        run_risk(_enriched(spark, d), options, given).ranking, suma_valor=2, ratio_directa=5, concentracion_entidad=8,
        score_final=5, score_reglas=5, score_anomalia=5,
    )


@query
def hybrid_ranking(spark, d):
    return run_risk(_enriched(spark, d)).ranking


@query
def run_counts(spark, d):
    return run_risk(_enriched(spark, d)).run


@query
def run_counts_rules(spark, d):
    run = run_risk(_enriched(spark, d), RULES_ONLY).run
    return _fix(run, costo_dia_p90=5, tasa_alerta=8)


# --- ingest --------------------------------------------------------------------------------


def _export_files(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "export-csv")
    names = {v: k for k, v in EXPORT_COLUMNS.items()}
    rows = contracts(spark, d).withColumnsRenamed(names).withColumn("Estado", F.lit("Activo"))
    # a compressed file is read in one task: it is kept small
    with shuffles_dropped(spark):
        rows.write.option("header", "true").option("timestampNTZFormat", "MM/dd/yyyy hh:mm:ss a").option(
            "escape", '"'
        ).option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option(
            "compression", "gzip"
        ).option("maxRecordsPerFile", 200_000).csv(path)
    return path


@query
def csv_ingest(spark, d):
    """Export written as CSV with its own headings, read back, copied to partitioned Parquet."""
    good, _ = export.land_export(spark, _export_files(spark, d), new_path(spark, "landed"), consume=True)
    rows, by = _with_year(enrich(good)), ("departamento", "anio", "Estado")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("longitud_objeto").alias("texto"), F.sum("duracion_dias").alias("dias"),
        F.sum(F.col("valor_num").cast("decimal(18,2)")).cast("double").alias("valor"),
        F.max("fecha_fin").alias("ultimo_fin"),
    )
    # counted apart: beside other sums every id would move with all of them
    ids = rows.groupBy(*by).agg(F.count_distinct("id_contrato").alias("n_ids")).toDF(*[f"_{c}" for c in by], "n_ids")
    same = F.struct(*by).eqNullSafe(F.struct(*[F.col(f"_{c}") for c in by]))
    return sums.join(ids, same).select(*by, "n", "n_ids", "texto", "dias", "valor", "ultimo_fin")


@query
def csv_records(spark, d):
    """An export with line breaks inside quotes, short, long and badly quoted records."""
    path = new_path(spark, "records")
    key = F.col("o_orderkey")
    note = (
        F.when(key % 7 == 0, F.lit('"línea uno\nlínea ""dos"", fin"'))
        .when(key % 17 == 0, F.lit('a 5" b'))
        .when(key % 19 == 0, F.lit('"x"" y"'))
        .otherwise(F.lit("z"))
    )
    status = F.when(key % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(","), "o_orderstatus"))
    more = F.when(key % 13 == 0, F.lit(",de más")).otherwise(F.lit(""))
    lines = table(spark, d, "orders").select(F.concat(key.cast("string"), F.lit(","), note, status, more).alias("value"))
    lines.write.text(path)
    rows = export.read_text_table(spark, path, header=False, columns=["id", "nota", "estado"])
    return rows.select(F.col("id").cast("bigint").alias("id"), "nota", "estado", F.col(export.REJECT).isNotNull().alias("rechazado"))


@query
def tsv_headings(spark, d):
    """Files with two heading lines each, of which the second names the columns, separated by tabs."""
    path, files = new_path(spark, "tsv"), 8
    text = F.concat_ws("\t", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, d, "orders").select(F.pmod("o_orderkey", F.lit(files)).cast("int").alias("f"), F.col("o_orderkey").alias("k"), text.alias("value"))
    heads = spark.createDataFrame([(f, k, v) for f in range(files) for k, v in ((-2, "Pedidos"), (-1, "clave\tprioridad\tfecha"))], "f int, k long, value string")
    heads.unionByName(rows).repartition("f").sortWithinPartitions("f", "k").drop("k").write.partitionBy("f").text(path)
    found = export.read_text_table(spark, [f"{path}/f={f}" for f in range(files)], sep="\t", header_count=2, column_header=2)
    return found.select(F.col("clave").cast("bigint").alias("clave"), "prioridad", "fecha", F.col(export.REJECT).isNotNull().alias("rechazado"))


@query
def csv_result(spark, d):
    """The department report written as CSV with a header and read back."""
    path = new_path(spark, "result")
    export.write_csv(listing.by_department(_spelled(spark, d)), path)
    return spark.read.schema("departamento string, n_contratos bigint").csv(path, header=True, ignoreLeadingWhiteSpace=False)


@query
def saved_runs(spark, d):
    """The results of every department, kept apart by the parameters of their runs."""
    path = new_path(spark, "runs")
    months = stage(explore.monthly_series(contracts(spark, d, "departamento", "fecha_inicio"), ("departamento",)), "months")
    for region in [r[0] for r in months.select("departamento").distinct().collect()]:  # a run per department
        export.save_run(months.where(F.col("departamento") == region).drop("departamento"), path, region=region, version=2)
    return spark.read.schema("anio_mes string, n_contratos bigint, region string, version bigint").parquet(path)


@query
def saved_transform_file(spark, d):
    """A saved transform parses a later file, edits its columns and takes its action on the table."""
    base, changes, _ = _change_sets(spark, d)
    path = new_path(spark, "changes")
    named = changes.select(F.col("o_orderkey").alias("Clave"), F.col("o_orderstatus").alias("Estado"), F.col("o_totalprice").alias("Precio"))
    named.write.option("header", "true").option("sep", ";").csv(path)
    saved = publish.TransformConfig(
        "cambios",
        read_options={"sep": ";", "multiline": False},
        steps=({"rename": {"Clave": "o_orderkey", "Estado": "o_orderstatus", "Precio": "o_totalprice"}},),
        action="upsert",
    )
    loaded = publish.TransformConfig.from_json(saved.to_json()).load(spark, path, base, "o_orderkey")
    return _fix(loaded, o_totalprice=2)


@query
def partitioned_copy(spark, d):
    """Scope filter on the partitioned copy: only one year and department are read."""
    path = new_path(spark, "contracts")
    export.write_contracts(contracts(spark, d), path)
    rows = REGION_YEAR.apply(export.read_contracts(spark, path))
    return quality.population_counts(enrich(rows))


@query
def json_pages(spark, d):
    """Pages that overlap by one department are read as one table without repeats."""
    path = new_path(spark, "pages")
    api = contracts(spark, d, "id_contrato", "departamento", "ciudad", "fecha_inicio").select(
        "id_contrato", "departamento", "ciudad",
        F.date_format("fecha_inicio", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("fecha_de_inicio_del_contrato"),
    )
    # Compressed: most of a JSON page is its field names. Each task's file is one split when it is read.
    api.write.json(f"{path}/a", compression="gzip")
    api.where(F.col("departamento") == "ASIA").write.json(f"{path}/b", compression="gzip")
    rows = export.read_pages(spark, f"{path}/*", lines=True)
    return rows.groupBy("departamento").agg(
        F.count("*").alias("n"), F.min("fecha_inicio").alias("primera"), F.max("fecha_inicio").alias("ultima")
    )


@query
def timestamp_texts(spark, d):
    """Event times written in the forms the API uses, parsed back."""
    ts = F.col("ts")
    text = (
        F.when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss'Z'"))
        .when(F.col("event_type") == "signup", F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_type") == "error", F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" sin hora")))
        .otherwise("sin fecha")
    )
    return table(spark, d, "events").select("event_id", parse_timestamp(text).alias("leido"))


# --- publishing ----------------------------------------------------------------------------


def _cleaned(spark: SparkSession, d: str) -> publish.Cleaned:
    rows = contracts(spark, d, "id_contrato", "valor_raw", "modalidad")
    text = rows.withColumn("valor", F.replace(F.col("valor_raw"), F.lit("$ "), F.lit("")))
    return publish.cast_columns(text, {"valor": "number"}, "id_contrato", ("valor",))


@query
def cast_errors(spark, d):
    return _cleaned(spark, d).errors


@query
def cast_rows(spark, d):
    return _cleaned(spark, d).rows.select("id_contrato", "valor")


@query
def cast_error_counts(spark, d):
    return publish.error_counts(_cleaned(spark, d).errors)


@query
def guessed_types(spark, d):
    orders = table(spark, d, "orders")
    text = orders.select(
        *[F.col(c).cast("string").alias(c) for c in orders.columns],
        (F.col("o_totalprice") > 200000).cast("string").alias("caro"),
        F.lit(" ").alias("vacia"),
    )
    return publish.guess_types(text)


@query
def row_id_check(spark, d):
    lines = table(spark, d, "lineitem")
    by_line = publish.row_id_check(
        lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")), "id"
    ).withColumn("columna", F.lit("linea"))
    by_order = publish.row_id_check(table(spark, d, "orders"), "o_orderkey").withColumn("columna", F.lit("orden"))
    return by_line.unionByName(by_order)


def _change_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Published orders, changes (new prices of open orders and new orders) and deleted ids."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = orders.where(F.col("o_orderstatus") != "P")
    changes = orders.where(F.col("o_orderstatus") != "F").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    deletes = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000))
    return base, changes, deletes.select("o_orderkey")


@query
def upsert(spark, d):
    base, changes, _ = _change_sets(spark, d)
    return _fix(publish.upsert(base, changes, "o_orderkey"), o_totalprice=2)


@query
def replace_delete(spark, d):
    base, changes, deletes = _change_sets(spark, d)
    path = new_path(spark, "published")
    publish.replace_rows(publish.upsert(base, changes, "o_orderkey"), path)
    left = publish.delete_rows(spark.read.parquet(path), deletes, "o_orderkey")
    return _fix(left, o_totalprice=2)


@query
def upsert_buckets(spark, d):
    """The rows of ``replace_delete``, by changes that rewrite the touched buckets of a published table."""
    base, changes, deletes = _change_sets(spark, d)
    published = BucketTable.create(base, new_path(spark, "buckets"), "o_orderkey", 64)
    published.upsert(changes)
    published.delete(deletes)
    return _fix(published.read(), o_totalprice=2)


@query
def load_stats(spark, d):
    base, changes, deletes = _change_sets(spark, d)
    return publish.load_stats(base, changes, "o_orderkey", deletes, _cleaned(spark, d).errors)


@query
def last_change(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return publish.last_per_id(events, "user_id", "event_id")


@query
def saved_transform(spark, d):
    saved = publish.TransformConfig(
        "ordenes",
        steps=(
            {"rename": {"o_orderkey": "id", "o_totalprice": "precio"}},
            {"add": {"caro": "precio >= 200000"}},
            {"transform": {"o_orderstatus": "lower(o_orderstatus)"}},
            {"drop": ["o_custkey", "o_orderdate"]},
            {"reorder": ["precio", "id"]},
        ),
    )
    return publish.TransformConfig.from_json(saved.to_json()).apply(table(spark, d, "orders"))


@query
def sorted_page(spark, d):
    order = [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)]
    rows = publish.page_rows(table(spark, d, "orders"), order, offset=100)
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice")


# --- streams -------------------------------------------------------------------------------


def _event_feed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.contract_feed(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def _contract_feed(spark: SparkSession, d: str, *columns: str, **options: str) -> DataFrame:
    path = new_path(spark, "feed")
    arrived = contracts(spark, d, *columns)
    arrived.write.parquet(path)
    return feeds.contract_feed(spark, path, arrived.schema, **options)


@query
def stream_flags(spark, d):
    return feeds.run_available(feeds.flag_feed(_contract_feed(spark, d)), "stream-flags")


@query
def stream_daily_counts(spark, d):
    def build(feed):
        return feeds.period_counts(feed, "ts", "1 day", "1 day", "event_type")

    return feeds.run_to_end(_event_feed(spark, d), "ts", build, "stream-daily")


@query
def stream_burst(spark, d):
    feed = _contract_feed(spark, d, "ciudad", "doc_proveedor", "fecha_inicio")

    def build(feed):
        return feeds.burst_feed(feed, "fecha_inicio", ("ciudad", "doc_proveedor"), 10, 3, "30 days")

    return feeds.run_to_end(feed, "fecha_inicio", build, "stream-burst")


@query
def stream_burst_exact(spark, d):
    """The windows of ``burst_window``, from a feed that arrives in several batches."""
    cols = ("nit_entidad", "doc_proveedor", "fecha_firma", "fecha_inicio", "fecha_fin", "valor_raw")
    feed = _contract_feed(spark, d, *cols, maxFilesPerTrigger="8")
    keys = ("nit_entidad", "doc_proveedor")

    def build(feed):
        rows = enrich(feed.withColumn("objeto_raw", F.lit("")))
        return exact_burst_feed(rows, "fecha_inicio", keys, BURST_DAYS, "4000 days", (~discarded()).cast("int"))

    return feeds.run_to_end(feed, "fecha_inicio", build, "stream-burst-exact", keyed_state=True)


#: Buckets of the published contracts, and of the line items' files as much as a part of them takes (in at most 8 parts).
KEPT_BUCKETS, KEPT_PART_BYTES = 64, 8 << 20


def _kept_parts(spark: SparkSession, d: str) -> int:
    lines = table(spark, d, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(1, min(8, int(str(lines)) // KEPT_PART_BYTES))


def _kept_report(
    spark: SparkSession, d: str, spec: views.ViewSpec, columns: tuple[str, ...], rows: Callable[[DataFrame], DataFrame] = lambda df: df
) -> views.KeptView:
    """The contracts (the columns the report is made of) as they came to be, in three loads: wrong amounts and places
    first, then the right ones, then the rows that should not have been there are deleted. Each load's signed rows arrive
    as files, which go once they are folded in. Versions that a load replaced are deleted."""
    # Selected, not asked of ``contracts``: that would leave out joins, which decide about rows where keys repeat or are NULL.
    names = ["id_contrato", "departamento", "valor_raw", *columns]
    right = contracts(spark, d).select(*names)
    published = BucketTable.create(right.limit(0), new_path(spark, "contracts"), "id_contrato", KEPT_BUCKETS)
    twice = F.pmod(F.xxhash64("id_contrato"), F.lit(7)) == 0
    given = right.withColumn("_extra", F.explode(F.when(twice, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    given = given.withColumn("id_contrato", F.when(F.col("_extra"), F.concat("id_contrato", F.lit("-x"))).otherwise(F.col("id_contrato")))
    staged, n_parts = new_path(spark, "contracts"), _kept_parts(spark, d)
    with shuffles_dropped(spark):
        placed = given.withColumn("_part", published.part(given.select(*names), n_parts))
        placed.write.option("compression", "zstd").partitionBy("_part").parquet(staged)
    given = spark.read.schema(T.StructType([*given.schema, T.StructField("_part", T.IntegerType())])).parquet(staged)
    parts = [given.where(F.col("_part") == k) for k in range(n_parts)]
    wrong = F.pmod(F.xxhash64("id_contrato"), F.lit(3)) == 0

    def mistaken(part):
        own = wrong & ~F.col("_extra")
        return part.withColumns({"valor_raw": F.when(own, "N/D").otherwise(F.col("valor_raw")), "departamento": F.when(own, "?").otherwise(F.col("departamento"))})

    loads = (
        [(mistaken(p).select(*names), None) for p in parts],
        [(p.where(wrong & ~F.col("_extra")).select(*names), None) for p in parts],
        [(None, p.where("_extra").select("id_contrato")) for p in parts],
    )
    arriving = new_path(spark, "changes")

    kept = views.new_view(spark, spec, rows(right))
    checkpoint = new_path(spark, "kept")
    for load in loads:
        for changes, deletes in load:
            with shuffles_dropped(spark):
                views.signed_changes(published, changes, deletes).write.mode("append").option("compression", "zstd").parquet(arriving)
        signed = spark.read.parquet(arriving)
        views.keep_views(feeds.contract_feed(spark, arriving, signed.schema), [kept], checkpoint, rows)
        for file in signed.inputFiles():
            delete_path(spark, file)
        kept.table.drop_old()
        if load[0][0] is not None:
            published.upsert(*[changes for changes, _ in load])
        else:
            published.delete(*[deletes for _, deletes in load])
        published.drop_old()
    delete_path(spark, staged)
    return kept


@query
def kept_quality(spark, d):
    """``quality_summary`` kept up to date over loads with updates and deletes."""
    columns = ("fecha_firma", "fecha_inicio", "fecha_fin", "objeto_raw")
    kept = _kept_report(spark, d, views.quality_view(("departamento", "anio")), columns, lambda df: _with_year(enrich(df)))
    return kept.read().drop("n_elegibles")


@query
def kept_concentration(spark, d):
    """``concentration_index`` of pair counts kept the same way."""
    return _fix(views.concentration_of(_kept_report(spark, d, views.pairs_view(), PAIR_KEYS).read()), indice_concentracion=8)


@query
def stream_sessions(spark, d):
    def build(feed):
        return feeds.activity_sessions(feed, "ts", "user_id", "6 hours", "1 day")

    return feeds.run_to_end(_event_feed(spark, d), "ts", build, "stream-sessions")


@query
def stream_repeats(spark, d):
    feed = _event_feed(spark, d).withColumn("copia", F.explode(F.array(F.lit(0), F.lit(0))))
    found = feeds.run_available(feeds.drop_repeats(feed, "ts", "event_id", "40 days"), "stream-repeats")
    return found.select("event_id", "user_id", "event_type", "value")


@query
def stream_repeats_ever(spark, d):
    """First arrivals by an index of ids: every event arrives again 60 days later, past any watermark."""
    path = new_path(spark, "feed-repeats")
    events = table(spark, d, "events")
    later = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS")).withColumn("value", -F.col("value"))
    for rows in (events, later):
        rows.write.mode("append").parquet(path)
    feed = feeds.contract_feed(spark, path, events.schema, maxFilesPerTrigger="8")
    return drop_all_repeats(feed, "event_id", "ts", new_path(spark, "stream-repeats-ever")).select("event_id", "user_id", "event_type", "value")


@query
def stream_forest_scores(spark, d):
    """Contracts of a feed scored by a model that was fitted on all contracts, saved and read again."""
    features, path = signals.CONTRACT_FEATURES, new_path(spark, "forest-model")
    rows = stage(signals.contract_features(_enriched(spark, d)).select("id_contrato", *features), "contract-features")
    save_forest(spark, fit_saved(rows, features, ("id_contrato",)), path)
    arriving = signals.contract_features(enrich(_contract_feed(spark, d)))
    scored = load_forest(spark, path).scored(arriving.select("id_contrato", *features), "crudo", "score_anomalia")
    return feeds.run_available(scored.select("id_contrato", "crudo", "score_anomalia"), "stream-forest")
