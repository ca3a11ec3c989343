import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veedor import runtime
from veedor.operators import places
from veedor.operators.scope import Scope
from veedor.schema import CONTRACT_SCHEMA, EXPORT_COLUMNS
from veedor.sources import catalog, export, geojson

HEADER = [*EXPORT_COLUMNS, "Estado"]


def csv_line(**values):
    row = {"ID Contrato": "1", "Nit Entidad": "007", "Departamento": "05", "Ciudad": "Cali",
           "Fecha de Inicio del Contrato": "01/25/2024", "Valor del Contrato": '"$ 1,000"', "Estado": "Activo", **values}
    return ",".join(row.get(c, "") for c in HEADER)


def test_export(spark, tmp_path):
    lines = [
        ",".join(HEADER),
        csv_line(),
        csv_line(**{"ID Contrato": "2", "Objeto del Contrato": '"dos\nlíneas ""citadas"""'}),
        "3,corto",
        csv_line(**{"ID Contrato": "4"}) + ",de,más",
        csv_line(**{"ID Contrato": "5", "Fecha de Inicio del Contrato": "sin fecha"}),
    ]
    (tmp_path / "e.csv").write_text("\n".join(lines), encoding="utf-8")
    good, rejects = export.land_export(spark, str(tmp_path / "e.csv"), str(tmp_path / "out"))
    rows = {r.id_contrato: r for r in good.collect()}
    assert set(rows) == {"1", "2", "5"} and rejects.count() == 2
    assert rows["1"].nit_entidad == "007" and rows["1"].departamento == "05" and rows["1"].Estado == "Activo"
    assert rows["1"].anio_inicio == 2024 and rows["5"].fecha_inicio is None
    assert rows["2"].objeto_raw == 'dos\nlíneas "citadas"' and rows["1"].valor_raw == "$ 1,000"
    assert set(CONTRACT_SCHEMA.names) <= set(good.columns)
    assert Scope("05", None, 2024).apply(good).count() == 2


def test_an_export_is_copied_in_portions(spark, tmp_path, monkeypatch):
    """Some landed files at a time; what was taken over is deleted where the caller says so."""
    for k in range(6):
        lines = [",".join(HEADER), csv_line(**{"ID Contrato": f"a{k}"}), f"{k},corto", csv_line(**{"ID Contrato": f"b{k}", "Departamento": ""})]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.csv").write_text("\n".join(lines), encoding="utf-8")
    monkeypatch.setattr(export, "PORTION_BYTES", 1)
    modes, real = [], export.write_contracts
    monkeypatch.setattr(export, "write_contracts", lambda df, path, mode="overwrite": modes.append(mode) or real(df, path, mode))
    found = []
    for n, consume in enumerate((False, True)):
        good, rejects = export.land_export(spark, str(tmp_path / "in"), str(tmp_path / f"out{n}"), consume=consume)
        found.append((sorted(map(str, good.collect())), sorted(map(str, rejects.collect()))))
        assert (tmp_path / "in").exists() != consume and any((tmp_path / f"out{n}" / "landing").glob("*.parquet")) != consume
    assert found[0] == found[1] and [len(x) for x in found[0]] == [12, 6] and modes.count("append") > 2


def test_long_records_stay_whole_and_broken_ones_are_no_rows(spark, tmp_path):
    long = "\n".join(f"línea {k}, con ""coma" for k in range(150_000))
    (tmp_path / "long.csv").write_text(f'1,"{long}"\n2,z\n', encoding="utf-8")
    (tmp_path / "open.csv").write_text('3,z\n4,"y\n5,x\n6\n7,"w"\n8,"v\n9,u', encoding="utf-8")
    read = lambda name: export.read_text_table(spark, str(tmp_path / name), header=False, columns=["record", "broken"])
    assert len(long) > 2_000_000
    for name, columns in (("long.csv", ["record", "broken"]), ("long.csv", ["broken", "record"])):
        rows = export.read_text_table(spark, str(tmp_path / name), header=False, columns=columns).collect()
        assert sorted(tuple(r) for r in rows) == [("1", long, None), ("2", "z", None)]
    good = {r[0]: r[1] for r in read("open.csv").collect() if r[2] is None}
    torn = sorted(r[2] for r in read("open.csv").collect() if r[2] is not None and r[0] is None)
    assert good.get("3") == "z" and not {"5", "6", "9"} & set(good) and torn[-1] == "9,u"


def test_only_lines_of_splits_with_broken_lines_are_moved(spark, tmp_path):
    """Splits of whole lines are read in place, those with records over several lines beside them too."""
    calm = [(str(k), f'con "{k}", x' if k % 3 else "") for k in range(4000)]
    torn = [(f"t{k}", f'uno\n"{k}", dos\r\n\n' if k % 500 == 7 else "z") for k in range(4000)]
    rows = {"a.csv": calm, "b.csv": torn, "c.csv": [(f"c{k}", "z") for k in range(9)]}
    for name, records in rows.items():
        quoted = [k + ',"' + v.replace('"', '""') + '"' if set(v) & set('",\n\r') else f"{k},{v}" for k, v in records]
        (tmp_path / name).write_bytes("\n".join(["id,nota", *quoted]).encode())
    plain = export.read_text_table(spark, str(tmp_path / "a.csv"))
    moved = plain._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in moved and "hashpartitioning" not in moved
    assert sorted((r.id, r.nota or "") for r in plain.collect()) == sorted(calm)
    with runtime.set_for(spark, "spark.sql.files.maxPartitionBytes", "4096"):
        found = export.read_text_table(spark, str(tmp_path)).collect()
    want = [(k, v.replace("\r\n", "\n")) for records in rows.values() for k, v in records]
    assert sorted((r.id, r.nota or "") for r in found) == sorted(want) and not any(r[export.REJECT] for r in found)


def test_table_options(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes("x\tñ\n1\t'a\tb'\n".encode("latin-1"))
    df = export.read_text_table(spark, str(tmp_path / "t.tsv"), sep="\t", quote="'", encoding="ISO-8859-1")
    assert df.columns == ["x", "ñ", export.REJECT]
    assert [tuple(r)[:2] for r in df.collect()] == [("1", "a\tb")]
    bare = export.read_text_table(spark, str(tmp_path / "t.tsv"), sep="\t", header=False, columns=["p", "q"],
                                  quote="'", encoding="ISO-8859-1", multiline=False)
    assert bare.count() == 2


def test_pages(spark, tmp_path):
    page = [{"id_contrato": "1", "departamento": "A", "fecha_de_inicio_del_contrato": "2024-01-01T00:00:00.000"},
            {"id_contrato": "2", "departamento": "A"}, {"departamento": "B"}]
    (tmp_path / "p0.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "p1.json").write_text(json.dumps(page[1:] + [{"departamento": "C"}]))
    rows = export.read_pages(spark, str(tmp_path)).collect()
    assert sorted(((r.id_contrato or "-") + r.departamento) for r in rows) == ["-B", "-C", "1A", "2A"]


def test_csv_sink_and_saved_run(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, n int")
    export.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0].x == "a"
    for year in (2023, 2024):
        export.save_run(df, str(tmp_path / "r"), departamento="Bolívar", anio=year)
    assert spark.read.parquet(str(tmp_path / "r")).where("anio = 2024").count() == 1


def test_catalog_fallback(spark, make, tmp_path):
    path = str(tmp_path / "cat")
    df = make({"ciudad": " b"}, {"ciudad": "A"}, {"ciudad": "A"}, {"ciudad": ""}, {"departamento": None})
    api = make({"ciudad": "api"})
    empty = df.where("false")

    def resolve(source):
        found, label = catalog.resolve_catalog(spark, path, source, lambda: df)
        return [r.ciudad for r in found.orderBy("departamento", "orden").collect()], label

    assert catalog.load_catalog(spark, path) is None
    assert resolve(lambda: empty) == (["A", "b"], "csv")
    assert resolve(lambda: spark.read.parquet(str(tmp_path / "missing"))) == (["A", "b"], "json")
    assert resolve(lambda: api) == (["api"], "api")
    assert resolve(None) == (["api"], "json")
    (tmp_path / "bad.json").write_text("{nope")
    assert catalog.load_catalog(spark, str(tmp_path / "bad.json")) is None
    document = catalog.catalog_document(catalog.region_pairs(df), "csv").collect()[0]
    assert document.departamentos == ["Bolívar"] and document.ciudades_por_departamento == {"Bolívar": ["A", "b"]}


@pytest.fixture
def features(spark, tmp_path):
    def feature(d, m=None):
        return {"type": "Feature", "properties": {"DPTO_CNMBR": d, "MPIO_CNMBR": m},
                "geometry": {"type": "Point", "coordinates": [1, 2]}}

    collection = {"type": "FeatureCollection", "features": [
        feature("BOLÍVAR", "CARTAGENA DE INDIAS"), feature("BOLÍVAR", "TURBACO"), feature(None, "x"),
        feature("BOGOTÁ, D.C.", "BOGOTÁ, D.C."), feature("BOLÍVAR", ""), feature("CAUCA", "TURBACO")]}
    (tmp_path / "g.geojson").write_text(json.dumps(collection), encoding="utf-8")
    return geojson.read_features(spark, str(tmp_path / "g.geojson"))


def test_places(spark, features):
    assert [r.orden for r in features.orderBy("orden").collect()] == [0, 1, 3, 4, 5]
    assert '"coordinates":[1,2]' in features.first().geometria.replace(" ", "")
    departments = features.groupBy("dpto").agg(F.min("orden").alias("orden"))
    counts = spark.createDataFrame(
        [("Bolívar", 5), ("BOLIVAR ", 2), ("Distrito  Capital", 4), ("No Definido", 9), ("Narnia", 1)],
        "departamento string, n_contratos long")
    fill = places.department_fill(counts, departments).orderBy("orden").collect()
    assert [(r.dpto, r.z) for r in fill] == [("BOLÍVAR", 7.0), ("BOGOTÁ, D.C.", 4.0), ("CAUCA", 0.0)]
    assert [r.departamento for r in places.unmatched_departments(counts, departments).collect()] == ["No Definido", "Narnia"]
    asked = spark.createDataFrame([("BOLIVAR",), ("bolívar",), ("x",)], "nombre string")
    assert {r.nombre: r.n_contratos for r in places.department_volume(asked, counts).collect()} == {
        "BOLIVAR": 2, "bolívar": 5, "x": 0}


def test_cities(spark, features):
    cities = spark.createDataFrame(
        [("BOLÍVAR", "Cartagena", 7), ("BOLÍVAR", "cartagena de indias", 7), ("CAUCA", "Turbaco", 1),
         ("BOGOTÁ, D.C.", "Bogotá", 3), ("BOLÍVAR", "No Definido", 2), ("BOLÍVAR", "Turbaco" + "x" * 22, 1),
         ("BOLÍVAR", "Turbaco" + "y" * 23, 1), ("CAUCA", "Popayán", 1), ("BOLÍVAR", " ", 1)],
        "dpto string, ciudad string, n_contratos long")
    got = {r.ciudad: (r.mpio, r.nivel) for r in places.match_cities(cities, features).collect()}
    assert got == {"Cartagena": ("CARTAGENA DE INDIAS", 3), "cartagena de indias": ("CARTAGENA DE INDIAS", 2),
                   "Turbaco": ("TURBACO", 2), "Bogotá": ("BOGOTÁ, D.C.", 1), "Turbaco" + "x" * 22: ("TURBACO", 3)}
    volumes = places.municipality_volumes(places.match_cities(cities, features))
    listed = spark.createDataFrame([("BOLÍVAR", "Turbaco", 0), ("CAUCA", "El Turbaco", 1)], "dpto string, ciudad string, orden int")
    full = places.municipality_fill(features, volumes.where("mpio <> 'TURBACO'"), places.catalog_city(listed, features))
    rows = {(r.dpto, r.mpio): (r.z, r.ciudad_filtro, r.etiqueta) for r in full.collect()}
    assert rows[("BOLÍVAR", "CARTAGENA DE INDIAS")] == (14.0, "Cartagena", "Cartagena")
    assert rows[("CAUCA", "TURBACO")] == (0.0, "El Turbaco", "El Turbaco") and len(rows) == 4


def test_shared_dir(spark):
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = runtime.stage(spark.range(3).withColumn("t", F.lit("2024-01-01").cast("timestamp_ntz")), "x")
    assert staged.count() == 3 and staged.inputFiles()[0].startswith("file://" + runtime.shared_dir(spark))


def test_drop_staged(tmp_path, spark):
    kept = runtime.stage(spark.range(2), "x")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert runtime.drop_staged(spark) >= 1
    assert not Path(folder).exists() and runtime.drop_staged(spark) == 0


def test_heading_of_several_files(spark, tmp_path):
    """Only one file is opened for the names; every file's heading lines are no rows."""
    for k in range(3):
        (tmp_path / f"f{k}.tsv").write_bytes(f"Título {k}\r\na\tb ñ\r\n{k}\tx\r\n{k + 10}\t\"y\nz\"\r\n".encode("latin-1"))
    found = export.read_text_table(spark, str(tmp_path), sep="\t", encoding="ISO-8859-1", header_count=2, column_header=2)
    assert found.columns == ["a", "b ñ", export.REJECT]
    assert sorted(r.a for r in found.collect()) == ["0", "1", "10", "11", "12", "2"]
    assert {r[1] for r in found.collect()} == {"x", "y\nz"}
    with pytest.raises(ValueError, match="no line 9"):
        export.read_text_table(spark, str(tmp_path), sep="\t", header_count=9, column_header=9)
