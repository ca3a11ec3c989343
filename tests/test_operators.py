import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veedor.functions.flags import enrich
from veedor.operators import concentration, explore, listing, quality, scope
from veedor.operators.pairs import pair_features
from veedor.operators.quantiles import exact_quantiles
from veedor.operators.spread import attach_stats, attach_total
from veedor.operators.listing import next_cursor, page_after
from veedor.operators.windows import trailing_counts


def one(df):
    return df.collect()[0]


# --- quantiles -----------------------------------------------------------------------------


@pytest.mark.parametrize("numbers", [
    [5.0], [1.0, 2.0], [3.0] * 7, [-5.0, 0.0, 0.5, -0.5, 1e12, -1e9, 2.0, 2.0],
    [random.Random(7).lognormvariate(8, 3) for _ in range(500)],
    [round(random.Random(3).uniform(0, 1), 2) for _ in range(300)],
])
def test_quantiles_equal_numpy(spark, numbers):
    df = spark.createDataFrame([(v,) for v in numbers], "v double").repartition(3)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    got = one(exact_quantiles(df, "v", probs))
    assert list(got) == pytest.approx([np.quantile(numbers, p) for p in probs.values()], rel=1e-12, abs=1e-12)


def test_quantiles_by_group(spark):
    rows = [("hot", float(i % 97)) for i in range(3000)] + [("x", 1.0), ("x", 4.0), (None, 2.0), ("none", None),
            ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in exact_quantiles(df, "v", {"q": 0.5}, ("g",)).collect()}
    assert got == {"hot": float(np.median([i % 97 for i in range(3000)])), "x": 2.5, None: 2.0}


def test_quantiles_of_nothing(spark):
    assert one(exact_quantiles(spark.createDataFrame([], "v double"), "v", {"q": 0.5})).q is None


# --- trailing counts -----------------------------------------------------------------------


def brute(rows, days):
    out = {}
    for k, t in rows:
        if t is not None:
            low = t - dt.timedelta(days=days)
            out[(k, t)] = (
                sum(1 for a, b in rows if a == k and b == t),
                sum(1 for a, b in rows if a == k and b is not None and low <= b <= t),
            )
    return out


@pytest.mark.parametrize("step", ["day", "hour", "micro"])
@pytest.mark.parametrize("days", [1, 10])
@pytest.mark.parametrize("hot_rows", [0, 60, 10**6])  # all keys split, one key split, none
def test_trailing_counts(spark, step, days, hot_rows):
    rng = random.Random(days)
    start = dt.datetime(2024, 2, 20)
    make_time = {
        "day": lambda: start + dt.timedelta(days=rng.randrange(25)),
        "hour": lambda: start + dt.timedelta(hours=rng.randrange(24 * 20)),
        "micro": lambda: start + dt.timedelta(microseconds=rng.randrange(20 * 86_400_000_000)),
    }[step]
    rows = [(rng.choice(["hot", "hot", "b", None]), make_time()) for _ in range(150)]
    # Exactly the window apart, one microsecond more, and a missing time.
    base = rows[0][1]
    rows += [("hot", base + dt.timedelta(days=days)), ("hot", base + dt.timedelta(days=days, microseconds=1)), ("b", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz").repartition(5)
    got = {(r.k, r.t): (r.n_filas, r.n_ventana) for r in trailing_counts(df, ("k",), "t", days, hot_rows=hot_rows).collect()}
    assert got == brute(rows, days)


def test_days_before_1970_and_leap_day(spark):
    rows = [("a", dt.datetime(1969, 12, 31, 23, 59)), ("a", dt.datetime(1970, 1, 1)), ("a", dt.datetime(2024, 2, 29)),
            ("a", dt.datetime(2024, 3, 10))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    for hot_rows in (0, 100):
        counts = trailing_counts(df, ("k",), "t", 10, hot_rows=hot_rows).collect()
        assert {(r.k, r.t): (r.n_filas, r.n_ventana) for r in counts} == brute(rows, 10)


# --- joins that spread hot keys -------------------------------------------------------------


def test_attach_total_and_stats(spark):
    rows = [("hot" if i % 3 else f"k{i}", f"r{i}", 1) for i in range(300)] + [(None, "n", 1)]
    df = spark.createDataFrame(rows, "k string, r string, n int")
    total = attach_total(df, "k", "n", "t", ("r",)).collect()
    assert len(total) == 300 and {r.t for r in total if r.k == "hot"} == {200}
    stats = df.groupBy("k").agg(F.count("*").alias("c"))
    with_stats = attach_stats(df, stats, ("k",), ("r",)).collect()
    assert len(with_stats) == 301 and [r.c for r in with_stats if r.k is None] == [1]


# --- filters and lists ----------------------------------------------------------------------


def test_scope(make):
    df = make({}, {"fecha_inicio": "2023-12-31 23:59:59"}, {"fecha_inicio": "2024-12-31 23:59:59"},
              {"fecha_inicio": "2025-01-01"}, {"fecha_inicio": None}, {"departamento": "Bolivar"}, {"ciudad": "Turbaco"})
    assert scope.Scope("Bolívar", None, 2024).apply(df).count() == 3
    assert scope.Scope("Bolívar", "", 2024).apply(df).count() == 3
    assert scope.Scope("Bolívar", "Cartagena", 2024).apply(df).count() == 2
    assert scope.Scope().apply(df).count() == 7


def test_first_match_and_buckets(make):
    df = make({"departamento": "BOLIVAR"}, {"departamento": "Bolivar"}, {"fecha_inicio": "2020-05-01"},
              {"fecha_inicio": "2019-12-31 23:00:00"})
    upper_only = df.where("departamento = 'BOLIVAR'")
    assert tuple(one(scope.first_match(upper_only, scope.spelling_variants("departamento", "Bolívar", "Bolivar")))) == (
        "mayusculas_sin_acento", 1)
    nothing = df.where("departamento = 'x'")
    assert tuple(one(scope.first_match(nothing, scope.spelling_variants("departamento", "Bolívar", "Bolivar")))) == (None, 0)
    rows = scope.bucket_counts(df, {"todo": F.lit(True), "nada": F.col("ciudad") == "x"}).collect()
    assert {r.alcance: tuple(r)[1:] for r in rows} == {"todo": (2, 1, 1), "nada": (0, 0, 0)}
    assert scope.spelling_variants("d", "L'X", "L'X")["como_se_escribe"] == "d = 'L''X'"


def test_years_pages(make):
    df = make(*[{"fecha_inicio": f"20{10 + i}-01-01"} for i in range(12)])
    assert tuple(one(listing.year_range(df))) == (2010, 2021)
    assert tuple(one(listing.year_range(df.where("false")))) == (2000, 2030)
    assert [(r.id_contrato, r.n_fila) for r in listing.page(df, 1, 5).orderBy("n_fila").collect()] == [
        (f"C{i:04d}", i + 1) for i in range(5, 10)]
    assert [r.id_contrato for r in listing.page(df, -3, 2).orderBy("n_fila").collect()] == ["C0000", "C0001"]
    assert [r.id_contrato for r in listing.page_after(df, {"id_contrato": "C0009"}, 1, 5).collect()] == ["C0010", "C0011"]
    assert listing.page_after(df, None, size=3).count() == 3
    counts = listing.filtered_counts(enrich(df)).select("n")
    assert [tuple(one(listing.page_bounds(counts, n, 5)))[1:] for n in (0, 2, 99)] == [(3, 1), (3, 2), (3, 3)]
    assert tuple(one(listing.page_bounds(counts.select(F.lit(0).alias("n")), 1, 5)))[1:] == (1, 1)


def test_city_list(make):
    df = make({"ciudad": " "}, {"ciudad": None}, {"ciudad": " Cartagena "}, {"ciudad": "Cartagena"})
    assert {r.ciudad: r.n_contratos for r in listing.city_list(df).collect()} == {"(vacío / null)": 2, "Cartagena": 2}
    assert {r.ciudad: r.n_contratos for r in listing.by_city(df).collect()} == {"Cartagena": 2}


# --- reports --------------------------------------------------------------------------------


def test_quality_of_nothing(make):
    empty = enrich(make({})).where("false")
    assert set(one(quality.quality_summary(empty))) == {0}
    assert set(one(quality.population_counts(empty))) == {0}
    assert one(quality.quality_kpis(empty)).pct_con_alerta == 0


def test_population_adds_up(make):
    df = enrich(make({}, {"valor_raw": "x", "fecha_firma": "2030-01-01"}, {"fecha_firma": "2030-01-01"}, {"objeto_raw": " "}))
    r = one(quality.population_counts(df))
    assert r.total == r.n_discarded + r.n_analyzed == 4
    assert (r.n_discarded, r.n_discard_valor, r.n_discard_fechas, r.n_discard_objeto_vacio) == (1, 1, 2, 1)


def test_modality(make):
    df = enrich(make({"modalidad": " "}, {"modalidad": None}, {"modalidad": "A", "valor_raw": "x"},
                     {"modalidad": "B", "valor_raw": "1"}, {"modalidad": "B", "valor_raw": "4"}, {"modalidad": "B", "valor_raw": "-9"}))
    assert [tuple(r) for r in explore.modality_stats(df).collect()] == [
        ("B", 3, 2.5), ("(sin modalidad)", 2, 1000.0), ("A", 1, None)]


@pytest.mark.parametrize("numbers", [
    [4.0, 4.0], [0.0, 48.0, 1.0, 47.0], [i / 10 for i in range(1, 300)],
    [random.Random(1).lognormvariate(5, 2) for _ in range(1000)],
])
def test_histogram_equals_numpy(spark, numbers):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    rows = explore.histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(numbers, bins=48)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.lo for r in rows] + [rows[-1].hi] == pytest.approx(edges.tolist())


def test_histogram_of_nothing(spark):
    assert explore.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_trim_and_extents(make):
    df = enrich(make(*[{"valor_raw": str(1000 * (i + 1)), "fecha_fin": "2024-01-20"} for i in range(100)]))
    points = explore.scatter_points(df)
    assert explore.trim_at_p99(points).count() == 99
    r = one(explore.axis_extents(points))
    assert r.valor_lo == pytest.approx(3) and r.valor_hi == pytest.approx(np.log10(120000))
    assert explore.axis_extents(points.where("false")).count() == 0


def test_concentration(make):
    df = make({}, {}, {"doc_proveedor": "D2"}, {"doc_proveedor": " "}, {"doc_proveedor": None}, {"nit_entidad": ""},
              {"proveedor": "Prov S.A."})
    rows = {(r.doc_proveedor, r.proveedor): (r.contratos_par, r.contratos_entidad) for r in concentration.top_concentration(df).collect()}
    assert rows == {("D1", "Prov"): (2, 4), ("D2", "Prov"): (1, 4), ("D1", "Prov S.A."): (1, 4)}


def test_direct_burst(make):
    direct = {"modalidad": "Contratación directa"}
    df = make({**direct, "fecha_inicio": "2024-01-01"}, {**direct, "fecha_inicio": "2024-01-31", "nit_entidad": "N2"},
              {**direct, "fecha_inicio": "2024-03-31"}, {"fecha_inicio": "2024-01-02"}, {**direct, "doc_proveedor": "D9"})
    assert [tuple(r) for r in concentration.direct_burst(df).collect()] == [("D1", 3, 2)]


# --- pairs ----------------------------------------------------------------------------------


def test_pair_features(make):
    dates = ["2024-01-01", "2024-01-11", "2024-01-11", "2024-01-12"]
    rows = [{"fecha_inicio": d, "proveedor": "P1" if i < 2 else "P2"} for i, d in enumerate(dates)]
    rows += [{"doc_proveedor": None, "proveedor": "S"}, {"doc_proveedor": None, "proveedor": "S"},
             {"nit_entidad": None}, {"doc_proveedor": " ", "proveedor": "B"}, {"valor_raw": "N/D"}]
    got = {(r.doc_proveedor, r.proveedor): r for r in pair_features(enrich(make(*rows))).collect()}
    assert set(got) == {("D1", "P1"), ("D1", "P2"), (None, "S"), (" ", "B")}
    # Two spellings share the burst of their ids; 1 and 12 January are 11 days apart.
    assert got["D1", "P1"].max_contratos_ventana == got["D1", "P2"].max_contratos_ventana == 3
    assert got["D1", "P1"].n_contratos == 2 and got["D1", "P1"].n_entidad_anio == 7
    assert got[None, "S"].max_contratos_ventana == 2
    assert got["D1", "P1"].concentracion_entidad == pytest.approx(2 / 7)
    assert got["D1", "P1"].diversidad_objetos == 1 and got["D1", "P1"].ratio_directa == 0.0


def test_hot_pair(make):
    rows = [{"fecha_inicio": f"2024-01-{1 + i % 28:02d}", "fecha_fin": "2024-06-01"} for i in range(600)]
    rows += [{"nit_entidad": f"N{i}", "doc_proveedor": f"D{i}"} for i in range(2, 300)]
    got = pair_features(enrich(make(*rows))).where("nit_entidad = 'N1'").collect()
    assert len(got) == 1 and got[0].n_contratos == 600
    assert got[0].max_contratos_ventana == max(
        sum(1 for i in range(600) if 0 <= d - i % 28 <= 10) for d in range(28))


def test_quantiles_of_values_in_one_bucket(spark):
    rng = random.Random(11)
    numbers = [0.43 + rng.random() * 1e-9 for _ in range(2000)] + [0.43] * 50
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = one(exact_quantiles(df, "v", {"a": 0.013, "b": 0.5, "c": 0.95}))
    assert list(got) == pytest.approx([np.quantile(numbers, p) for p in (0.013, 0.5, 0.95)], rel=1e-15)


def test_keyset_pages_see_every_row_once(make):
    df = make(*[{"id_contrato": i, "ciudad": c} for i, c in (("A", "x"), ("A", "x"), ("A", None), ("B", "y"), (None, "z"), (None, "z"), (None, None))])
    for size in (1, 2, 3):
        seen, last, delivered = [], None, 0
        while rows := [r.asDict() for r in page_after(df, last, delivered, size).collect()]:
            seen += rows
            last, delivered = next_cursor(rows, last, delivered)
        assert sorted(map(str, seen)) == sorted(str(r.asDict()) for r in df.collect())
