"""Current state of keyed, superseding records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

from tapeline.functions.fields import signed_quantity
from tapeline.plans.prefix import BLOCK_BITS, running_sum

POSITION_KEY = ("clearing_member_id", "account", "contract_series")
_FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def fixed_width(dtype: DataType) -> bool:
    """True for types a hash aggregate can update in place."""
    return isinstance(dtype, _FIXED_WIDTH)


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("offset",),
    drop_deleted: str | None = None,
    method: str | None = None,
) -> DataFrame:
    """The last record of each key by ``order``, which is total inside a key.

    Two plans, both of which reduce to one row per key and task before the shuffle:

    * ``aggregate``: ``max_by`` per column in a hash aggregate, for one order column
      and fixed-width columns. Needs no sort.
    * ``window``: ``row_number() = 1``, which Spark turns into a limit per group on
      both sides of the exchange. For everything else: a ``max_by`` over strings or
      structs would fall back to a sort aggregate, which measures slower.

    ``drop_deleted`` names a payload column whose null in the *last* record means the
    key was deleted.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rest = [c for c in df.columns if c not in keys]
    if method is None:
        flat = len(order) == 1 and order[0] in types and all(fixed_width(types[c]) for c in rest)
        method = "aggregate" if flat else "window"
    if method == "aggregate":
        by = order[0]
        picks = [F.max(c).alias(c) if c == by else F.max_by(c, by).alias(c) for c in rest]
        out = df.groupBy(*keys).agg(*picks).select(*df.columns)
    else:
        last_first = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        out = (
            df.withColumn("__rn", F.row_number().over(last_first))
            .filter(F.col("__rn") == 1)
            .drop("__rn")
        )
    return out.filter(F.col(drop_deleted).isNotNull()) if drop_deleted else out


def running_positions(
    fills: DataFrame,
    keys: Sequence[str] = POSITION_KEY,
    order: str = "offset",
    block_bits: int | None = BLOCK_BITS,
) -> DataFrame:
    """The position log: every fill with its key's signed sum so far, in log order."""
    signed = fills.withColumn("__signed", signed_quantity())
    return running_sum(signed, keys, order, "__signed", "net_quantity", block_bits).drop("__signed")


def current_net_positions(
    positions: DataFrame, keys: Sequence[str] = POSITION_KEY, order: str = "offset"
) -> DataFrame:
    """Net quantity of the last snapshot of each key."""
    narrow = positions.select(*keys, F.col(order).alias("offset"), "net_quantity")
    return latest_per_key(narrow, keys).select(*keys, "net_quantity")


def positions_as_of(
    positions: DataFrame,
    at_offset,
    keys: Sequence[str] = POSITION_KEY,
    order: str = "offset",
) -> DataFrame:
    """State when the log stood at ``at_offset`` (a number or a scalar column)."""
    return current_net_positions(positions.filter(F.col(order) <= at_offset), keys, order)


def net_from_fills(fills: DataFrame, keys: Sequence[str] = POSITION_KEY) -> DataFrame:
    """Current net quantity straight from fills.

    Equal to the last snapshot of each key, but a plain sum: it combines map-side,
    needs no order, and is the form to use where only the current state is asked.
    """
    return fills.groupBy(*keys).agg(F.sum(signed_quantity()).alias("net_quantity"))
