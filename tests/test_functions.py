import datetime as dt

import pytest
from pyspark.sql import functions as F

from veedor.functions import flags
from veedor.functions.names import lookup, normalize_name, ranking_label, value_label, DEPARTMENT_ALIASES
from veedor.functions.parsing import parse_export_date, parse_money, parse_timestamp


def values(spark, texts, expr, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_money(spark):
    cases = {
        "$ 1,000": 1000.0, "1e5": 1e5, " 5 ": 5.0, "+7": 7.0, "1.": 1.0, ".5": 0.5, "\t3": 3.0,
        "-5": -5.0, "0": 0.0, "N/D": None, "": None, "1.234.567,00": None, "1_000": None, "1d": None,
        "nan": None, "inf": None, "1e999": None, "(5)": None, "0x10": None, "4 ": 4.0, None: None,
        ".": None, "1\t0": None,
    }
    assert values(spark, list(cases), parse_money) == list(cases.values())
    assert values(spark, ["1.234.567,50", "$ 10"], lambda c: parse_money(c, True)) == [1234567.5, 10.0]


def test_timestamps(spark):
    cases = {
        "2024-01-01T00:00:00.000": dt.datetime(2024, 1, 1),
        "2024-01-02 03:04:05Z": dt.datetime(2024, 1, 2, 3, 4, 5),
        "2024-01-03": dt.datetime(2024, 1, 3),
        "2024-01-03T05": dt.datetime(2024, 1, 3, 5),
        "2024-01-04 nada": dt.datetime(2024, 1, 4),
        "2024-01-05T06:00:00+05:00": dt.datetime(2024, 1, 5, 6),
        "2024-13-01": None, "ayer": None, "": None, None: None,
    }
    assert values(spark, list(cases), parse_timestamp) == list(cases.values())


def test_export_dates(spark):
    cases = {
        "01/25/2024": dt.datetime(2024, 1, 25),
        "1/5/2024 12:00:00 AM": dt.datetime(2024, 1, 5),
        "01/05/2024 12:30:00 PM": dt.datetime(2024, 1, 5, 12, 30),
        "01/05/2024 01:30 pm": dt.datetime(2024, 1, 5, 13, 30),
        "01/05/2024 23:59:58": dt.datetime(2024, 1, 5, 23, 59, 58),
        "2024-01-05 10:00:00": dt.datetime(2024, 1, 5, 10),
        "25/01/2024": None, "x/y": None, None: None,
    }
    assert values(spark, list(cases), parse_export_date) == list(cases.values())
    assert values(spark, ["25/01/2024"], lambda c: parse_export_date(c, "dmy")) == [dt.datetime(2024, 1, 25)]


def test_names(spark):
    texts = ["  Bolívar ", "Bolívar", "NARIÑO", "San  Andrés y", "güican"]
    assert values(spark, texts, normalize_name) == ["BOLIVAR", "BOLIVAR", "NARINO", "SAN ANDRES Y", "GUICAN"]
    found = values(spark, ["San Andrés, Providencia y Santa Catalina", "Cauca"],
                   lambda c: lookup(DEPARTMENT_ALIASES, normalize_name(c)))
    assert found[0].startswith("ARCHIPIÉLAGO") and found[1] is None
    assert values(spark, [" ", "nan", "Distrito Capital", "bogotá", " Cauca "], ranking_label) == [
        "(Sin nombre)", "(Sin nombre)", "Bogotá (D.C.)", "Bogotá (D.C.)", "Cauca"]


@pytest.mark.parametrize("value, text", [
    (2.5e9, "2.5 MM COP"), (1e9, "1 MM COP"), (1.23456789e12, "1234.5679 MM COP"), (1.5e6, "1.5 M COP"),
    (1e6, "1 M COP"), (999.5, "1,000 COP"), (2.5, "2 COP"), (-1234.0, "-1,234 COP"), (None, ""),
    (float("inf"), ""), (float("nan"), ""),
])
def test_value_label(spark, value, text):
    assert values(spark, [value], value_label, "double") == [text]


def flag_row(make, **row):
    return flags.enrich(make(row)).collect()[0]


def test_flags(make):
    r = flag_row(make, fecha_fin="2024-01-09")
    assert (r.flag_fin_antes_inicio, r.flag_duracion_negativa, r.duracion_dias) == (1, 1, -1)
    r = flag_row(make, fecha_inicio="2024-01-10 10:00:00", fecha_fin="2024-01-10 08:00:00")
    assert (r.flag_fin_antes_inicio, r.flag_duracion_negativa, r.duracion_dias) == (1, 0, 0)
    assert flag_row(make, fecha_firma="2024-03-01").flag_firma_despues_inicio == 1
    assert flag_row(make, fecha_firma=None, fecha_fin=None).duracion_dias is None
    for text, expected in ((29 * "a", 1), (30 * "a", 0), ("   ", 1), (None, 1)):
        assert flag_row(make, objeto_raw=text).flag_objeto_muy_corto == expected
    for value, expected in (("0", 1), ("-5", 1), ("N/D", 1), (None, 1), ("1", 0)):
        assert flag_row(make, valor_raw=value).flag_valor_invalido == expected


def test_discard_and_direct(make):
    df = flags.enrich(make(
        {}, {"fecha_firma": "2025-01-01"}, {"objeto_raw": None}, {"fecha_fin": None},
        {"fecha_fin": "2024-01-10"}, {"valor_raw": "0"},
    ))
    got = [r[0] for r in df.orderBy("id_contrato").select(flags.discarded()).collect()]
    assert got == [False, False, False, True, True, True]
    modes = make({"modalidad": "Contratación DIRECTA (con ofertas)"}, {"modalidad": None}, {"modalidad": "Abreviada"})
    direct = [tuple(r) for r in modes.orderBy("id_contrato").select(
        flags.is_direct(F.col("modalidad")), flags.modality_risk(F.col("modalidad"))).collect()]
    assert direct == [(1, 10), (0, None), (0, 5)]


def test_a_date_is_read_once(spark):
    """However often its time is looked at: the regular expressions are most of an ingest."""
    plan = spark.createDataFrame([], "x string").select(parse_export_date(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("AaPp") == 1
