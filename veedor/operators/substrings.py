"""Containment between many texts and many names, by an index of their letter groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veedor.functions.names import CITY_ALIASES, lookup, normalize_name
from veedor.operators.places import MAX_LENGTH_GAP, _has_name
from veedor.runtime import stage

#: Letters of a group. A text that is not longer is a group itself.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct groups of ``size`` neighbouring letters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    made = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, made).otherwise(F.array().cast("array<string>"))


def first_containing(texts: DataFrame, names: DataFrame, group: str, most_longer: int) -> DataFrame:
    """(group, texto, orden) of the first name, by ``orden``, that contains the text or that the text contains, with lengths
    at most ``most_longer`` apart; texts without one are left out.

    ``texts`` has different (group, texto), ``names`` (group, nombre, orden), all without NULL or empty texts. What
    is compared letter by letter are, for a text, the names with the text's rarest letter group, and those
    whose own rarest group the text holds: each name is filed once under that one. A text of up to ``GRAM``
    letters is a group itself; for it the first name of each group is known beforehand, so the shortest texts, which
    many names contain, meet one row.
    """
    size = F.length("nombre")
    filed = stage(names.select(group, "nombre", "orden", F.explode(grams(F.col("nombre"))).alias("letras")), "name-grams")
    rarity = stage(filed.groupBy(group, "letras").agg(F.count("*").alias("n")), "gram-counts")
    far = F.abs(F.length("nombre") - F.length("texto")) <= most_longer

    # A text inside a name: short ones by their own group, others by the rarest of theirs.
    short_groups = F.flatten(F.array(*[grams(F.col("nombre"), k) for k in range(1, GRAM + 1)]))
    near_enough = names.select(group, "orden", size.alias("largo"), F.explode(short_groups).alias("texto")).where(
        F.col("largo") - F.length("texto") <= most_longer
    )
    firsts = near_enough.groupBy(group, "texto").agg(F.min("orden").alias("orden"))
    short = texts.where(F.length("texto") <= GRAM).join(firsts, [group, "texto"])

    long = texts.where(F.length("texto") > GRAM).select(group, "texto", F.explode(grams(F.col("texto"))).alias("letras"))
    seen = long.join(rarity, [group, "letras"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = seen.groupBy(group, "texto").agg(F.min(F.struct("n", "letras")).alias("r")).where("r.n > 0")
    met = rarest.select(group, "texto", F.col("r.letras").alias("letras")).join(filed, [group, "letras"])
    inside = met.where(far & F.col("nombre").contains(F.col("texto")))

    # A name inside a text: the name's rarest group is among the text's.
    own = filed.join(rarity, [group, "letras"]).groupBy(group, "nombre", "orden").agg(F.min(F.struct("n", "letras")).alias("r"))
    tiny = names.where(size < GRAM).select(group, "nombre", "orden", F.col("nombre").alias("letras"))
    signed = own.select(group, "nombre", "orden", F.col("r.letras").alias("letras")).unionByName(tiny)
    every = F.flatten(F.array(*[grams(F.col("texto"), k) for k in range(1, GRAM + 1)]))
    held = texts.select(group, "texto", F.explode(every).alias("letras")).join(signed, [group, "letras"])
    around = held.where(far & F.col("texto").contains(F.col("nombre")))

    parts = [x.select(group, "texto", "orden") for x in (short, inside, around)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(group, "texto").agg(F.min("orden").alias("orden"))


def match_cities_indexed(cities: DataFrame, municipalities: DataFrame) -> DataFrame:
    """``places.match_cities`` for catalogs of any size: the same rows, no work per city and municipality.

    Equal names are found by a join on the name, contained ones by ``first_containing``; every different text of a
    department is looked for once.
    """
    names = stage(
        municipalities.select("dpto", "mpio", "orden", normalize_name(F.col("mpio")).alias("nombre")).where(
            F.coalesce(F.col("nombre"), F.lit("")) != ""
        ),
        "names",
    )
    # Staged: the texts to look for and the rows they go back to come from one evaluation of ``cities``.
    keyed = stage(cities.withColumn("_c", normalize_name(F.col("ciudad"))).where(_has_name(F.col("_c"))), "city-rows")
    asked = stage(keyed.select("dpto", F.col("_c").alias("texto")).where(F.col("dpto").isNotNull()).distinct(), "city-texts")
    first = names.groupBy("dpto", "nombre").agg(F.min("orden").alias("orden"))

    def equal(text: Column, level: int) -> DataFrame:
        wanted = asked.select("dpto", "texto", text.alias("nombre"))
        return wanted.join(first, ["dpto", "nombre"]).select("dpto", "texto", "orden", F.lit(level).alias("nivel"))

    contained = first_containing(asked, names, "dpto", MAX_LENGTH_GAP).withColumn("nivel", F.lit(3))
    levels = equal(lookup(CITY_ALIASES, F.col("texto")), 1).unionByName(equal(F.col("texto"), 2)).unionByName(contained)
    best = levels.groupBy("dpto", "texto").agg(F.min(F.struct("nivel", "orden")).alias("m"))
    places = names.groupBy("dpto", "orden").agg(F.min("mpio").alias("mpio"))
    chosen = best.select("dpto", F.col("texto").alias("_c"), "m.nivel", "m.orden").join(places, ["dpto", "orden"])
    found = keyed.join(chosen.select("dpto", "_c", "mpio", "nivel"), ["dpto", "_c"])
    return found.select(*cities.columns, "mpio", "nivel")
