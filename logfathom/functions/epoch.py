"""Time columns as epoch microseconds, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds of a column: an instant as it is, a time without zone as UTC, a number as it is.

    A time without zone is put together from its parts, since any cast to an instant would pass through the session's
    zone and shift or merge the hours around a change of its clocks.
    """
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        seconds = (F.unix_date(c.cast("date")).cast("bigint") * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("bigint")
    return c.cast("bigint")


def iso_of(us: Column) -> Column:
    """``2024-03-05T09:59:59.000000`` of epoch microseconds in UTC, whatever the session's zone."""
    day = F.expr("date'1970-01-01'")
    within = F.pmod(us, F.lit(86_400_000_000))
    seconds = F.floor(within / 1_000_000)
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.date_add(day, F.floor(us / 86_400_000_000).cast("int")).cast("string"), F.lit("T"), part(F.floor(seconds / 3600), 2), F.lit(":"), part(F.pmod(F.floor(seconds / 60), F.lit(60)), 2), F.lit(":"), part(F.pmod(seconds, F.lit(60)), 2), F.lit("."), part(F.pmod(within, F.lit(1_000_000)), 6))
