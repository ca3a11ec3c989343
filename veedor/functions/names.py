"""Place names and display labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from veedor.functions.parsing import strip_blanks

BOGOTA = "BOGOTÁ, D.C."
SAN_ANDRES = "ARCHIPIÉLAGO DE SAN ANDRÉS, PROVIDENCIA Y SANTA CATALINA"

# Normalized department text -> official department name.
DEPARTMENT_ALIASES = {
    "DISTRITO CAPITAL DE BOGOTA": BOGOTA,
    "DISTRITO CAPITAL": BOGOTA,
    "SAN ANDRES": SAN_ANDRES,
    "ARCHIPIELAGO DE SAN ANDRES": SAN_ANDRES,
    "SAN ANDRES, PROVIDENCIA Y SANTA CATALINA": SAN_ANDRES,
}

# Normalized city text -> normalized municipality name.
CITY_ALIASES = {
    "BOGOTA": "BOGOTA, D.C.",
    "SANTA FE DE BOGOTA": "BOGOTA, D.C.",
}

UNDEFINED_PLACE = "NO DEFINIDO"


def _composed_letters() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and their base letters."""
    composed, plain = [], []
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(point))
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            composed.append(chr(point))
            plain.append(base[0])
    return "".join(composed), "".join(plain)


_COMPOSED, _PLAIN = _composed_letters()


def normalize_name(text: Column) -> Column:
    """Upper case without accents, blanks collapsed: the key for matching place names."""
    bare = F.regexp_replace(F.translate(text.cast("string"), _COMPOSED, _PLAIN), r"\p{Mn}+", "")
    return F.upper(F.regexp_replace(strip_blanks(bare), r"(?U)\s+", " "))


def case_folded(text: Column) -> Column:
    """Full case folding: ``straße`` and ``STRASSE`` are equal, which ``lower`` alone does not see.

    The dotless i is a letter of its own.
    """
    kept = F.upper(F.translate(text.cast("string"), "ıẞ", "\ue000ß"))
    return F.lower(F.translate(kept, "\ue000", "ı"))  # lower(upper(x)) alone would be simplified to lower(x)


def place_text(text: Column) -> Column:
    """A place name without outer blanks and runs of blanks, compared without regard to case and accents, in any
    script: equality, ``distinct``, joins and order of this column follow Unicode's collation at its first level."""
    return F.collate(F.regexp_replace(strip_blanks(text.cast("string")), r"(?U)\s+", " "), "UNICODE_CI_AI")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL when the key is absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def ranking_label(name: Column) -> Column:
    """Short department label for rankings."""
    text = strip_blanks(F.coalesce(name.cast("string"), F.lit("")))
    low = F.lower(text)
    return (
        F.when(low.isin("", "nan", "none"), "(Sin nombre)")
        .when(low.contains("distrito capital") | low.contains("bogot"), "Bogotá (D.C.)")
        .otherwise(text)
    )


def value_label(value: Column) -> Column:
    """Peso amount: ``MM`` for thousands of millions, ``M`` for millions, else whole pesos."""
    v = value.cast("double")

    def scaled(unit: float, digits: int, suffix: str) -> Column:
        plain = F.replace(F.format_number(v / F.lit(unit), digits), F.lit(","), F.lit(""))
        return F.concat(F.regexp_replace(plain, r"\.?0+$", ""), F.lit(suffix))

    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return (
        F.when(~finite, "")
        .when(v >= 1e9, scaled(1e9, 4, " MM COP"))
        .when(v >= 1e6, scaled(1e6, 3, " M COP"))
        .otherwise(F.concat(F.format_number(v, 0), F.lit(" COP")))
    )
