import numpy as np
import pytest
from pyspark.sql import functions as F

from veedor.functions.flags import enrich
from veedor.operators.isolation import Forest, fit_forest, normalized, with_anomaly
from veedor.operators.rules import explanation, rule_catalog, with_rules
from veedor.plans.risk import RANKING_COLUMNS, RiskOptions, run_risk


def many_pairs(make, n, outlier=False):
    rows = []
    for i in range(n):
        for j in range(2 + i % 3):
            rows.append({
                "nit_entidad": f"N{i % 5}", "nombre_entidad": f"E{i % 5}", "doc_proveedor": f"D{i}", "proveedor": f"P{i}",
                "fecha_inicio": f"2024-0{1 + (i + j) % 6}-01", "fecha_fin": f"2024-0{7 + (i + j) % 3}-01",
                "valor_raw": str(1000 + 37 * i + j), "objeto_raw": f"obra número {i} y parte {j} de la vía principal",
            })
    if outlier:
        for j in range(9):
            rows.append({"nit_entidad": "NX", "doc_proveedor": "DX", "proveedor": "PX", "fecha_inicio": "2024-01-02",
                         "fecha_fin": "2024-01-03", "valor_raw": "9000000000", "modalidad": "Contratación directa", "objeto_raw": "varios"})
    return enrich(make(*rows))


def test_planted_outlier_is_first(make):
    result = run_risk(many_pairs(make, 60, outlier=True))
    top = result.ranking.collect()
    assert tuple(result.ranking.columns) == RANKING_COLUMNS
    assert top[0].doc_proveedor == "DX" and top[0].score_anomalia == 1.0
    assert top[0].score_reglas == pytest.approx(0.85)
    assert "patrón agregado atípico" in top[0].razon_priorizacion
    scored = result.scored.collect()
    assert all(0 <= r.score_final <= 1 and 0 <= r.score_anomalia <= 1 for r in scored)
    assert min(r.score_anomalia for r in scored) == 0
    limit = np.percentile([r.score_final for r in scored], 95)
    assert {r.doc_proveedor for r in scored if r.score_final >= limit} == {r.doc_proveedor for r in top}
    run = result.run.collect()[0]
    assert (run.n_pairs, run.n_pairs_scored, run.n_alerts) == (61, 61, len(top))


def test_same_ranking_for_any_partitioning_and_contamination(make):
    df = many_pairs(make, 40, outlier=True)

    def scores(parts, **options):
        rows = run_risk(df.repartition(parts), RiskOptions(**options)).ranking.collect()
        return [(r.doc_proveedor, round(r.score_final, 9)) for r in rows]

    assert scores(1) == scores(7) == scores(3, contamination=0.4)


def test_few_pairs(make):
    assert run_risk(many_pairs(make, 1)).ranking.count() == 0
    none = run_risk(many_pairs(make, 3).where("false"))
    assert none.ranking.count() == 0 and tuple(none.ranking.columns) == RANKING_COLUMNS
    assert none.run.collect()[0].n_alerts == 0
    for n, active in ((2, False), (9, False), (12, True)):
        scored = run_risk(many_pairs(make, n)).scored.collect()
        assert len(scored) == n
        assert any(r.score_anomalia > 0 for r in scored) == active


def test_equal_scores_alert_all(make):
    rows = [{"nit_entidad": f"N{i}", "doc_proveedor": f"D{i}"} for i in range(20) for _ in range(2)]
    result = run_risk(enrich(make(*rows)))
    assert result.run.collect()[0].n_alerts == 20


def test_rules_text(spark):
    pairs = spark.createDataFrame(
        [(0.5, 3, 0.25, 0.5, None), (0.49, 2, 0.24, 0.49, 1.0), (1.0, 9, 1.0, 1.0, 11.0)],
        "ratio_directa double, max_contratos_ventana long, concentracion_entidad double, pct_objeto_corto double, costo_dia_promedio double")
    ruled = with_rules(pairs, F.lit(10.0)).withColumn("score_anomalia", F.lit(0.125))
    rows = ruled.select("score_reglas", "reglas_disparadas", explanation().alias("x")).collect()
    assert [round(r.score_reglas, 9) for r in rows] == [0.7, 0.0, 0.85]
    assert rows[1].reglas_disparadas == ""
    assert rows[1].x == "combinación de scores (reglas=0.00, anomalía=0.12)"
    assert rows[0].reglas_disparadas.count("; ") == 3 and rows[0].x.startswith("alta contratación directa; ráfaga")
    assert [r.peso for r in rule_catalog(spark).collect()] == [0.15, 0.25, 0.20, 0.10, 0.15]


def test_forest_finds_far_points(spark):
    rng = np.random.default_rng(0)
    points = [(f"r{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))] + [("far", 12.0, -12.0)]
    df = spark.createDataFrame(points, "id string, a double, b double").repartition(6)
    forest = fit_forest(df, ("a", "b"), ("id",))
    assert len(forest.trees) == 100 and all(len(t["variable"]) <= 511 for t in forest.trees)
    scored = with_anomaly(df, ("a", "b"), forest, "s")
    assert scored.orderBy(F.col("s").desc()).first().id == "far"
    again = with_anomaly(df, ("a", "b"), fit_forest(df.repartition(2), ("a", "b"), ("id",)), "s")
    assert scored.orderBy("id").collect() == again.orderBy("id").collect()


def test_large_input_draw(spark):
    df = spark.range(100_000).select("id", F.rand(1).alias("a"))
    forest = fit_forest(df, ("a",), ("id",), trees=20, sample=64)
    assert len(forest.trees) == 20
    assert Forest([], 0.0).score(np.zeros((3, 1))).tolist() == [0, 0, 0]


def test_normalized(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double")
    assert sorted(r.y for r in normalized(df, "x", "y").collect()) == [0, 0.5, 1]
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.y for r in normalized(flat, "x", "y").collect()] == [0, 0]


def test_scores_follow_the_paths(spark):
    """Every row's score from its path through each tree, one step at a time."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double, c double")
    forest = fit_forest(df, ("a", "b", "c"), ("id",), trees=10, sample=64)

    def path(tree, point):
        node = 0
        while tree["variable"][node] >= 0:
            left = point[tree["variable"][node]] < tree["corte"][node]
            node = tree["izquierda" if left else "derecha"][node]
        return tree["largo"][node]

    expected = [2 ** (-np.mean([path(t, p) for t in forest.trees]) / forest.scale) for p in points]
    assert forest.score(points) == pytest.approx(expected)
    harmonic = sum(1 / k for k in range(1, 64))
    assert forest.scale == pytest.approx(2 * harmonic - 2 * 63 / 64, abs=0.02)
    assert all(len(t["largo"]) <= 127 and max(t["largo"]) >= 4 for t in forest.trees)
    got = with_anomaly(df, ("a", "b", "c"), forest, "s").orderBy("id").collect()
    assert [r.s for r in got] == pytest.approx(expected)


def test_scope_of_one_year(make):
    rows = [{"fecha_inicio": f"20{20 + i % 2}-03-0{1 + i % 3}", "fecha_fin": "2023-01-01", "doc_proveedor": f"D{i % 7}"} for i in range(60)]
    from veedor.operators.scope import Scope

    run = run_risk(Scope("Bolívar", None, 2020).apply(enrich(make(*rows)))).run.collect()[0]
    assert (run.total, run.n_analyzed) == (30, 30)
