"""Text to number, text to timestamp, blank tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Characters of a decimal number. Any other one (after currency signs, separators and blanks
# are gone) makes the text no number, also where a SQL cast would take it: 1d, 1_000, nan, inf.
_NUMBER_CHARACTERS = "0123456789+-.eE"
_OTHER_BLANKS = "\t\n\x0b\x0c\r\u00a0\u2007\u202f"

_EDGE_BLANKS = r"(?U)^\s+|\s+$"
_ISO_STAMP = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(T\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)
_SLASH_DAY = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_SLASH_STAMP = r"^(\d{1,2})/(\d{1,2})/(\d{4})[ T]+(\d{1,2}:\d{2}(?::\d{2})?)\s*(?:[AaPp][Mm])?$"


def strip_blanks(text: Column) -> Column:
    """Trim every kind of white space, no-break space included."""
    return F.regexp_replace(text, _EDGE_BLANKS, "")


def is_present(value: Column) -> Column:
    """Neither NULL nor only spaces."""
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def to_number(text: Column) -> Column:
    """Decimal text as a finite double, else NULL."""
    plain = F.btrim(text, F.lit(_OTHER_BLANKS + " "))
    only_digits = F.translate(plain, _NUMBER_CHARACTERS, "") == ""
    number = F.when(only_digits, plain.try_cast("double"))
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def parse_money(raw: Column, decimal_comma: bool = False) -> Column:
    """Money text as a finite double, else NULL.

    ``$``, ``,`` and spaces are deleted and ``.`` is the decimal point. With
    ``decimal_comma`` the roles of ``.`` and ``,`` are exchanged (``1.234.567,00``).
    """
    text = raw.cast("string")
    if decimal_comma:
        return to_number(F.translate(F.translate(text, "$. ", ""), ",", "."))
    return to_number(F.translate(text, "$, ", ""))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters above it will refer to several times.

    As a plain projection it would be copied into each of those filters and evaluated once
    per mention; a one-row generator is not. Filters on other columns still move below it.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def parse_timestamp(raw: Column) -> Column:
    """ISO text as TIMESTAMP_NTZ; otherwise its first ten characters as a date, else NULL.

    A trailing Z and offsets are dropped: the wall-clock fields are what counts.
    """
    text = strip_blanks(raw.cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"^([^ ]*) ", "$1T")
    head = F.substring(text, 1, 10)
    whole = F.when(text.rlike(_ISO_STAMP), F.translate(text, ",", ".").try_cast("timestamp_ntz"))
    hour_only = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}$"), F.concat(text, F.lit(":00")).try_cast("timestamp_ntz")
    )
    day = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date").cast("timestamp_ntz"))
    return F.coalesce(whole, hour_only, day)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` mentions it, in branches too."""
    return F.transform(F.array(value), use).getItem(0)


def parse_export_date(raw: Column, order: str = "mdy") -> Column:
    """Date of a CSV export: ISO forms, or ``/`` forms in ``mdy`` or ``dmy`` order,
    with an optional 24-hour or AM/PM time."""
    day = "$3-$1-$2" if order == "mdy" else "$3-$2-$1"

    def on_the_clock(text: Column, timed: Column) -> Column:
        half, hour = F.lower(F.right(text, F.lit(2))), F.hour(timed)
        shift = F.when((half == "pm") & (hour < 12), 12).when((half == "am") & (hour == 12), -12).otherwise(0)
        return timed + F.make_dt_interval(hours=shift)

    def read(text: Column) -> Column:
        timed = F.regexp_replace(text, _SLASH_STAMP, f"{day} $4").try_cast("timestamp_ntz")
        bare = F.regexp_replace(text, _SLASH_DAY, day).try_cast("timestamp_ntz")
        slashed = F.when(text.contains(":"), _once(timed, lambda t: on_the_clock(text, t))).otherwise(bare)
        return F.when(text.contains("/"), slashed).otherwise(parse_timestamp(raw))

    return _once(F.btrim(raw.cast("string"), F.lit(_OTHER_BLANKS + " ")), read)
