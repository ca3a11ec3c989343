"""Work whose bytes moved or written must grow no faster than the input."""

import os
import time

import numpy as np
import pytest

from veedor.functions.flags import enrich
from veedor.operators import isolation, pairs, spread
from veedor.operators.concentration import trailing_concentration
from veedor.operators.windows import trailing_counts
from veedor.plans import queries
from veedor.runtime import new_path, stage
from veedor.sources import star
from veedor.sources.buckets import BucketTable
from veedor.streaming import feeds, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def tables(spark, path):
    """One row in every table of the star schema."""
    for name, ddl in star.TABLES.items():
        kinds = [c.split() for c in ddl.split(", ")]
        text = {"string": "'x'", "timestamp_ntz": "timestamp_ntz'2024-01-01'"}
        spark.sql("select " + ", ".join(f"cast({text.get(t, '1')} as {t}) {c}" for c, t in kinds)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def some(make):
    days = [f"2024-0{1 + k % 6}-{1 + 3 * k % 28:02d}" for k in range(60)]
    return make(
        *[
            {
                "nit_entidad": None if k % 29 == 0 else f"N{k % 5 % 3}", "doc_proveedor": None if k % 7 == 0 else f"D{k % 2}",
                "nombre_entidad": None if k % 13 == 0 else f"Name {k % 2}", "fecha_firma": "2024-01-01", "fecha_inicio": None if k % 31 == 0 else days[k],
                "fecha_fin": "2024-12-31", "valor_raw": str(10 * k), "objeto_raw": f"text {k % 9}",
            }
            for k in range(60)
        ]
    )


def rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_place_names_are_compared_once_a_place(spark, tmp_path):
    leaves = queries._cities(spark, tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in leaves


def test_orders_meet_customers_before_lines(spark, tmp_path):
    found = star.contracts(spark, tables(spark, tmp_path), "ciudad")
    assert found.collect() == [("x",)]
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    lines = tree.split("\n")
    depth = {k: next(x.index("Relation") for x in lines if "Relation" in x and k in x) for k in ("l_orderkey", "c_custkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]


def test_json_pages_are_written_compressed(spark, tmp_path, monkeypatch):
    paths, real = [], queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda s, name: paths.append(real(s, name)) or paths[-1])
    data = tables(spark, tmp_path)
    assert [(r.departamento, r.n) for r in queries.json_pages(spark, data).collect()] == [("x", 1)]
    assert all(f.endswith(".gz") for f in spark.read.text(f"{paths[0]}/*").inputFiles())
def test_trailing_concentration_moves_contracts_once(spark, make):
    contracts = some(make)
    few = trailing_concentration(contracts, 40)
    assert shuffles(few) == 0 and plan(few).count("REPARTITION_BY_NUM") == 1
    assert rows(few) == rows(trailing_concentration(contracts, 40, hot_rows=0)) == rows(trailing_concentration(contracts, 40, hot_rows=15))
    known = contracts.where("nit_entidad is not null and doc_proveedor is not null")
    entity = {(r.nit_entidad, r.fecha_inicio): r.n_ventana for r in trailing_counts(known, ("nit_entidad",), "fecha_inicio", 40).collect()}
    assert entity and all(entity[r.nit_entidad, r.fecha_inicio] == r.contratos_entidad for r in few.collect())


def test_parts_have_no_key_in_common(spark):
    df = spark.range(1000).selectExpr("if(id < 600, 'hot', cast(id % 40 as string)) k", "id")
    few, many = spread.parted_by_size(df, "k", 100)
    assert {r.k for r in many.collect()} == {"hot"} and few.count() == 400 and many.count() == 600


def test_pair_features_move_contracts_once(make):
    few = pairs.pair_features(enrich(some(make)))
    assert shuffles(few) == 0 and plan(few).count("REPARTITION_BY_NUM") == 1


def test_huge_entities_give_the_same_features(make):
    contracts = enrich(some(make))
    few = rows(pairs.pair_features(contracts))
    assert few == rows(pairs.pair_features(contracts, hot_rows=0)) == rows(pairs.pair_features(contracts, hot_rows=15)) and len(few) > 10


def test_a_change_moves_rows_once(spark, monkeypatch):
    base = spark.range(50).selectExpr("if(id > 45, null, id % 40) id", "id v")
    table = BucketTable.create(base, new_path(spark, "one-shuffle"), "id", 4)
    seen, real = [], BucketTable._written

    def written(self, df, now):
        seen.append(plan(df).count("Exchange"))
        return real(self, df, now)

    monkeypatch.setattr(BucketTable, "_written", written)
    table.upsert(spark.createDataFrame([(3, 100), (99, 101), (None, 102)], "id long, v long"))
    table.delete(spark.createDataFrame([(5,), (None,)], "id long"))
    found = sorted((r.id is None, r.id or 0, r.v) for r in table.read().collect())
    kept = [(k % 40, k) for k in range(46) if k % 40 not in (3, 5)] + [(3, 100), (99, 101)]
    assert found == sorted([(False, *x) for x in kept] + [(True, 0, v) for v in (46, 47, 48, 49, 102)])
    assert seen == [1, 1]


def test_a_batch_is_not_copied(spark, tmp_path, monkeypatch):
    names, real = [], views.stage
    monkeypatch.setattr(views, "stage", lambda df, name: names.append((name, df.columns)) or real(df, name))
    spark.sql("select 'a' k, 1 v, 'wide' w, 1 signo").write.parquet(str(tmp_path / "in"))
    spec = views.ViewSpec(("k",), {"n": queries.F.lit(True)})
    kept = views.new_view(spark, spec, spark.read.parquet(str(tmp_path / "in")).drop("signo"))
    feed = feeds.contract_feed(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    views.keep_views(feed, [kept], str(tmp_path / "check"))
    assert kept.read().collect() == [("a", 1)] and names and not any("w" in columns for _, columns in names)


def _kept_blocks(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()


def test_shuffle_files_go_with_the_job_that_staged(spark):
    before = _kept_blocks(spark)
    staged = [stage(spark.range(20_000).selectExpr("id % 997 k").groupBy("k").count(), "gone") for _ in range(3)]
    until = time.time() + 20
    while _kept_blocks(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert _kept_blocks(spark) <= before and [x.count() for x in staged] == [997] * 3


def test_a_change_in_parts_is_the_same_change(spark):
    base = spark.range(60).selectExpr("if(id > 55, null, id % 50) id", "id v")
    changes = spark.range(30, 90).selectExpr("id", "-id v")
    ids = spark.range(5, 75, 3).toDF("id")
    found = []
    for n in (1, 3, 4):
        table = BucketTable.create(base, new_path(spark, "parts"), "id", 4)
        of = lambda df, n=n, table=table: [df.where(table.part(df, n) == k) for k in range(n)]
        assert table.upsert(*of(changes)).version == 2 and table.delete(*of(ids)).version == 3
        found.append(sorted((r.id is None, r.id or 0, r.v) for r in table.read().collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 60
    with pytest.raises(ValueError, match="same bucket"):
        table.upsert(changes, changes)
    assert table.versions()[-1] == 3


def test_kept_reports_leave_no_copies_of_the_contracts(spark, tmp_path, monkeypatch):
    """Files that were folded in and the staged rows go; parts of a load change nothing."""
    made, real = [], queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda spark, name: made.append(real(spark, name)) or made[-1])
    d = tables(spark, tmp_path)
    whole = rows(queries.kept_concentration(spark, d))
    monkeypatch.setattr(queries, "KEPT_PART_BYTES", 1)
    assert rows(queries.kept_concentration(spark, d)) == whole and len(whole) == 1
    left = [p for p in made if any(f.endswith(".parquet") for _, _, files in os.walk(p) for f in files)]
    assert len([p for p in made if "changes-" in p]) == 2 and not any("changes-" in p for p in left)
    assert len([p for p in left if "/contracts-" in p]) == 2  # the published ones


def test_the_export_goes_when_it_is_landed(spark, tmp_path, monkeypatch):
    made, real = [], queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda spark, name: made.append(real(spark, name)) or made[-1])
    found = queries.csv_ingest(spark, tables(spark, tmp_path))
    assert [(r.n, r.n_ids) for r in found.collect()] == [(1, 1)]
    assert not [p for p in made if "export-csv" in p and os.path.exists(p)]


def test_offers_are_made_in_compiled_code(spark):
    df = spark.range(100).selectExpr("id", "double(id) x")
    drawn = isolation.draw_samples(df, ("x",), ("id",), 5, 8, 1, 100)
    assert "lambdafunction" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {r.arbol for r in drawn.collect()} == set(range(5))


def test_levels_lead_to_the_leaf_of_each_row():
    tree = {"variable": [1, -1, 0, -1, -1], "corte": [0.5, 0, 0.25, 0, 0], "izquierda": [1, -1, 3, -1, -1], "derecha": [2, -1, 4, -1, -1], "largo": [1.0, 2.0, 0.0, 4.0, 8.0]}
    tree = {c: np.asarray(v) for c, v in tree.items()}
    variable, cut, length = isolation._levels(tree)
    assert len(cut) == 3 and length.tolist() == [2.0, 2.0, 4.0, 8.0]
    values = np.array([[0.9, 0.1], [0.1, 0.7], [0.3, 0.7], [np.nan, np.nan]] * 6000)
    found = isolation._score_rows([tree], 1.0, values)
    assert np.array_equal(found, np.exp2(-np.array([2.0, 4.0, 8.0, 8.0] * 6000)))
