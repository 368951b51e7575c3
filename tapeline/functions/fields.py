"""Keys, signs and time bounds."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

KEY_SEPARATOR = "|"


def composite_key(*names: str) -> Column:
    """Key parts joined by ``|``; a null part is kept as an empty one, not skipped."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    return F.concat_ws(KEY_SEPARATOR, *parts)


def key_part(key: str, position: int) -> Column:
    """The part at a 1-based ``position`` of a composite key."""
    return F.split_part(F.col(key), F.lit(KEY_SEPARATOR), F.lit(position))


def signed_quantity(side: str = "side", quantity: str = "quantity") -> Column:
    """+quantity for BUY, -quantity for SELL, null for any other side."""
    q = F.col(quantity)
    return F.when(F.col(side) == "BUY", q).when(F.col(side) == "SELL", -q)


def on_date(column: str, day: date | str) -> Column:
    """Half-open range over one calendar day.

    The bounds are literals of the column's own type (strings are coerced by the
    analyzer and folded), so the range reaches the Parquet scan.
    """
    start = date.fromisoformat(day) if isinstance(day, str) else day
    end = date.fromordinal(start.toordinal() + 1)
    c = F.col(column)
    return (c >= F.lit(f"{start} 00:00:00")) & (c < F.lit(f"{end} 00:00:00"))


def instant(value: datetime, dtype: DataType) -> Column:
    """A literal instant in the type of the column it will be compared with."""
    return F.lit(value.isoformat(sep=" ")).cast(dtype)


def week_start(as_of: datetime, dtype: DataType) -> Column:
    """Monday 00:00 of the week of ``as_of``."""
    return F.date_trunc("week", F.lit(as_of.isoformat(sep=" ")).cast("timestamp")).cast(dtype)


def days_before(as_of: datetime, days: int, dtype: DataType) -> Column:
    return instant(as_of, dtype) - F.make_dt_interval(F.lit(days))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``, independent of the session time zone."""
    gap = end - start
    seconds = (
        F.extract(F.lit("DAY"), gap).cast("long") * 86400
        + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
    )
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def event_instant(column: str, dtype: DataType) -> Column:
    """A TIMESTAMP for watermarks: zone-less times are read as UTC in any session."""
    if isinstance(dtype, TimestampType):
        return F.col(column)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(micros_between(epoch, F.col(column).cast("timestamp_ntz")))


def utc_date(instant: Column) -> Column:
    """Calendar date of a TIMESTAMP in UTC, in any session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))
