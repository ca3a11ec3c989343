from pyspark.sql import functions as F

from veedor.functions.names import case_folded, place_text
from veedor.operators.places import match_departments, match_departments_collated
from veedor.sources.catalog import nested_catalog


def test_case_folding_of_every_letter(spark):
    """As Python folds them, but for a few old scripts whose small letters one of the two does not know."""
    points = [p for p in range(1, 0x2FFF) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(chr(p),) for p in points], "c string")
    wrong = {r.c for r in df.select("c", case_folded(F.col("c")).alias("f")).collect() if r.f != r.c.casefold()}
    assert len(wrong) < 0.01 * len(points) and not wrong & set("straßeẞSTRASSEµſŉÄÖÜñÑİıΣςσΆάЙйЖж")


def test_order_and_equality(spark):
    rows = [("D", c) for c in ("straße", "STRASSE", "Strasb", "ıl", "Il", "Άλφα", "άλφα", "ζ", "Σας", "ΣΑΣ")]
    got = nested_catalog(spark.createDataFrame(rows, "departamento string, ciudad string")).first().ciudades
    assert got == sorted((c for _, c in rows), key=lambda c: (c.casefold(), c))
    pairs = [("straße", "STRASSE", True), ("Bogotá", "Bogotá", True), ("Ñ", "n", True), ("ΆΛΦΑ", "αλφα", True), ("Żółw", "ZÓŁW", True),
             (" San  José ", "SAN JOSE", True), ("abc", "abd", False), ("École", "ECOLE", True), ("Й", "и", None)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    for r in df.withColumn("got", place_text(F.col("a")) == place_text(F.col("b"))).collect():
        assert r.same is None or r.got == r.same, r
    assert df.select(place_text(F.col("b")).alias("p")).unionByName(df.select(place_text(F.col("a")).alias("p"))).distinct().count() < 2 * len(pairs) - 5


def test_departments_by_collation(spark):
    features = spark.createDataFrame([(0, "ATLÁNTICO"), (1, "Großau"), (2, "BOGOTÁ, D.C."), (3, "Atlántico")], "orden int, dpto string")
    names = ["atlantico", "Atlántico ", "GROSSAU", "Distrito Capital", "no definido", "", None, "nowhere"]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "departamento string, k int")
    got = {r.k: r.dpto for r in match_departments_collated(df, features).collect()}
    assert got == {0: "Atlántico", 1: "Atlántico", 2: "Großau", 3: "BOGOTÁ, D.C.", 4: None, 5: None, 6: None, 7: None}
    plain = {r.k: r.dpto for r in match_departments(df, features).collect()}
    assert {k: v for k, v in got.items() if k != 2} == {k: v for k, v in plain.items() if k != 2}
