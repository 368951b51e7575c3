"""Continuous forms of the state, count and deduplication operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.fields import event_instant, signed_quantity, utc_date
from tapeline.operators.state import POSITION_KEY, fixed_width


_EVENT_TIME = "__event_time"


def _timed(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    """The stream with a watermark on a TIMESTAMP copy of its business time."""
    instant = event_instant(time, stream.schema[time].dataType)
    return stream.withColumn(_EVENT_TIME, instant).withWatermark(_EVENT_TIME, lateness)


def latest_stream(
    stream: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "offset"
) -> DataFrame:
    """Last record of each key; run in update mode.

    Ordered by offset, so business time may arrive in any order. Fixed-width values
    stay single columns, which keeps the hash aggregate. A deletion marker is a last record
    like any other here; drop it where the changes are folded (``current_table``).
    """
    types = stream.select(*values).schema
    grouped, newest = stream.groupBy(*keys), F.max(order).alias(order)
    if all(fixed_width(f.dataType) for f in types):
        return grouped.agg(newest, *[F.max_by(v, order).alias(v) for v in values])
    last = F.max_by(F.struct(*values), order).alias("__v")
    return grouped.agg(newest, last).select(*keys, order, "__v.*")


def net_positions_stream(fills: DataFrame, keys: Sequence[str] = POSITION_KEY) -> DataFrame:
    """Net quantity of each key; in update mode one row per changed key and batch."""
    return fills.groupBy(*keys).agg(
        F.sum(signed_quantity()).alias("net_quantity"), F.max("offset").alias("offset")
    )


def fills_by_date_stream(
    fills: DataFrame, time: str = "exec_time", lateness: str = "1 day"
) -> DataFrame:
    """Fills per business date in one-day windows.

    In append mode a day is emitted once the watermark has passed it, and later rows
    are dropped; in complete mode every row counts.
    """
    return (
        _timed(fills, time, lateness)
        .groupBy(F.window(_EVENT_TIME, "1 day"))
        .agg(F.count("*").alias("n_fills"))
        .select(utc_date(F.col("window.start")).alias("trade_date"), "n_fills")
    )


def dedup_stream(
    stream: DataFrame,
    key: Sequence[str],
    log_time: str | None = None,
    lateness: str = "1 day",
    spread_by: str | None = None,
    spread: int = 32,
) -> DataFrame:
    """Drops records sent again with the same primary key; run in append mode.

    Without ``log_time`` every key stays in the state, so no record is ever dropped for
    being late, in whatever order files are replayed; keep the state in RocksDB. With
    ``log_time``, the time of *arrival* (``_meta.timestamp``), keys are forgotten
    ``lateness`` after it. It must follow the order of arrival: business time does not.

    Deduplication has no map-side step, so all copies of one record would meet in one
    task. With ``spread_by`` (a column that differs between copies, such as the log
    offset) a first stage drops copies within ``spread`` slices of each key and the
    second stage sees at most ``spread`` of them.
    """
    timed = _timed(stream, log_time, lateness) if log_time else stream

    def once(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.dropDuplicatesWithinWatermark(columns) if log_time else rows.dropDuplicates(columns)

    if spread_by is not None:
        sliced = timed.withColumn("__slice", F.pmod(F.xxhash64(spread_by), F.lit(spread)))
        timed = once(sliced, [*key, "__slice"]).drop("__slice")
    return once(timed, list(key)).drop(_EVENT_TIME)
