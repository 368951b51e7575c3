"""Questions about net positions, right readings and the known wrong ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators.state import current_net_positions

_WHO = ("contract_series", "clearing_member_id")


def total_of(current: DataFrame) -> DataFrame:
    """Sum of |net| per series over positions that are already current."""
    return current.groupBy("contract_series").agg(
        F.sum(F.abs("net_quantity")).alias("total_abs_net")
    )


def total_abs_net(positions: DataFrame, order: str = "offset") -> DataFrame:
    """Sum of |net| over the current snapshot of each key, per series."""
    return total_of(current_net_positions(positions, order=order))


def open_interest(positions: DataFrame, order: str = "offset") -> DataFrame:
    """Half of that: every contract has a long and a short holder."""
    return total_abs_net(positions, order).select(
        "contract_series",
        (F.col("total_abs_net").cast("decimal(28,2)") / 2).cast("decimal(18,2)").alias("open_interest"),
    )


def history_sum(positions: DataFrame) -> DataFrame:
    """Signed sum over all snapshots, superseded ones included (a wrong answer)."""
    return positions.groupBy("contract_series").agg(F.sum("net_quantity").alias("history_sum"))


def history_abs_sum(positions: DataFrame) -> DataFrame:
    """Sum of |net| over all snapshots, superseded ones included (a wrong answer)."""
    return positions.groupBy("contract_series").agg(
        F.sum(F.abs("net_quantity")).alias("history_abs_sum")
    )


def short_members_any(positions: DataFrame, order: str = "offset") -> DataFrame:
    """Members short in at least one account now.

    The sign is tested after the state is taken: below it, the filter would bring
    back superseded short snapshots.
    """
    return current_net_positions(positions, order=order).filter("net_quantity < 0").select(
        *_WHO
    ).distinct()


def short_members_net(positions: DataFrame, order: str = "offset") -> DataFrame:
    """Members short over all their accounts together now."""
    return (
        current_net_positions(positions, order=order)
        .groupBy(*_WHO)
        .agg(F.sum("net_quantity").alias("net"))
        .filter("net < 0")
        .select(*_WHO)
    )


def short_anytime_members(positions: DataFrame) -> DataFrame:
    """Members with any short snapshot in history (a wrong answer)."""
    return positions.filter("net_quantity < 0").select(*_WHO).distinct()


def sell_side_members(fills: DataFrame, member: str = "executing_member") -> DataFrame:
    """Members with a SELL fill: side is not direction (a wrong answer)."""
    return (
        fills.filter(F.col("side") == "SELL")
        .select("contract_series", F.col(member).alias("clearing_member_id"))
        .distinct()
    )


def short_members_either(positions: DataFrame, order: str = "offset") -> DataFrame:
    """Members short under either reading."""
    return short_members_any(positions, order).union(short_members_net(positions, order)).distinct()


def sell_not_short(fills: DataFrame, positions: DataFrame) -> DataFrame:
    """Sellers that are not short in any account."""
    return sell_side_members(fills).subtract(short_members_any(positions))


def sell_and_short(fills: DataFrame, positions: DataFrame) -> DataFrame:
    """Sellers that are also short in some account."""
    return sell_side_members(fills).intersect(short_members_any(positions))
