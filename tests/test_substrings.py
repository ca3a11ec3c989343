import random

from pyspark.sql import functions as F

from veedor.operators import substrings
from veedor.operators.places import match_cities


def rows(df):
    return sorted(map(str, df.collect()))


def test_as_by_comparing_all(spark):
    """Words of few letters, so that texts contain each other often; one department holds most."""
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("abñé ") for _ in range(rng.randint(0, most)))
    cities = [(rng.choice("XXXXY"), word(7), i) for i in range(500)] + [("X", None, 1), (None, "ab", 2), ("X", "ab" * 30, 3), ("X", "Á", 4)]
    names = [(rng.choice("XXXXY"), word(9), i) for i in range(150)] + [("X", None, 900), ("X", "a" * 40, 901), ("Z", "ab", 902)]
    c = spark.createDataFrame(cities, "dpto string, ciudad string, n_contratos long")
    m = spark.createDataFrame(names, "dpto string, mpio string, orden int")
    want = rows(match_cities(c, m))
    assert len(want) > 300 and rows(substrings.match_cities_indexed(c, m)) == want


def test_aliases_and_nothing(spark):
    c = spark.createDataFrame([("D", "Cartagena de Indias", 1), ("D", "no definido", 2), ("D", "", 3)], "dpto string, ciudad string, n_contratos long")
    m = spark.createDataFrame([("D", "CARTAGENA", 1), ("D", "INDIAS", 0)], "dpto string, mpio string, orden int")
    assert rows(substrings.match_cities_indexed(c, m)) == rows(match_cities(c, m)) != []
    assert substrings.match_cities_indexed(c.limit(0), m).count() == substrings.match_cities_indexed(c, m.limit(0)).count() == 0


def test_compared_names_stay_few(spark, monkeypatch):
    """20,000 names and 2,000 texts: the rows that are compared letter by letter grow with the matches."""
    names = spark.range(20_000).select(F.lit("X").alias("g"), F.sha2(F.col("id").cast("string"), 256).substr(1, 14).alias("nombre"), F.col("id").cast("int").alias("orden"))
    texts = names.where("orden % 10 = 0").select("g", F.expr("substr(nombre, 3, 8)").alias("texto"))
    found, real = {}, type(names).where

    def where(self, c):
        if {"texto", "nombre", "letras"} <= set(self.columns):
            found[len(found)] = self
        return real(self, c)

    monkeypatch.setattr(type(names), "where", where)
    out = substrings.first_containing(texts, names, "g", 22)
    got = {r.texto: r.orden for r in out.collect()}
    assert len(got) == 2000 and all(o % 10 == 0 for o in got.values())
    compared = sum(df.count() for df in found.values())
    assert compared < 200 * 2000  # of 40,000,000 pairs
