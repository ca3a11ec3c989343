"""Wall-clock times: literals, year ranges, counts of hours and microseconds.

TIMESTAMP_NTZ values are handled without any time zone, so results do not depend on the session.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_MICROS = 3_600_000_000


def ntz(text: str) -> Column:
    """TIMESTAMP_NTZ literal."""
    return F.lit(text).cast("timestamp_ntz")


def year_start(year: int) -> Column:
    return ntz(f"{year:04d}-01-01 00:00:00")


def in_year(stamp: Column, year: int) -> Column:
    """Half-open range, which reaches the Parquet scan; ``year(x) = y`` would not."""
    return (stamp >= year_start(year)) & (stamp < year_start(year + 1))


def epoch_hour(stamp: Column) -> Column:
    """Hours since 1970-01-01 00:00 on the same clock."""
    days = F.datediff(stamp, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 24 + F.hour(stamp)


def micros_in_hour(stamp: Column) -> Column:
    seconds = F.extract(F.lit("SECOND"), stamp)
    return F.minute(stamp).cast("bigint") * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def as_instant(stamp: Column) -> Column:
    """The TIMESTAMP whose UTC clock shows ``stamp``: what watermarks and windows need."""
    return F.timestamp_micros(epoch_hour(stamp) * HOUR_MICROS + micros_in_hour(stamp))


def as_wall_clock(instant: Column) -> Column:
    """The UTC clock of a TIMESTAMP as TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), ntz("1970-01-01 00:00:00"))
