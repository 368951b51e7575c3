"""Fills, trades, trade reports and parties."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.fields import days_before, instant, on_date, week_start
from tapeline.operators.state import latest_per_key
from tapeline.plans.joins import left_lookup, lookup_join

# Actions after which a report no longer stands for a live trade.
TERMINAL_ACTIONS = ("EROR", "TERM")


def is_live(action: str = "action_type") -> Column:
    """Not a terminal action. A null action is not live either (SQL ``NOT IN``)."""
    return ~F.col(action).isin(*TERMINAL_ACTIONS)


# --- counts ---------------------------------------------------------------------

def count_fills(fills: DataFrame) -> DataFrame:
    return fills.agg(F.count("*").alias("n_fills"))


def count_orders(fills: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct orders; one order fans out to several fills."""
    distinct = F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")
    return fills.agg(distinct.alias("n_orders"))


def count_trades(reports: DataFrame) -> DataFrame:
    """Distinct trade identifiers; every trade is reported by both sides."""
    return reports.agg(F.count_distinct("uti").alias("n_trades"))


def count_reports(reports: DataFrame) -> DataFrame:
    """Report rows: the wrong answer to "how many trades"."""
    return reports.agg(F.count("*").alias("n_reports"))


def fills_by_date(fills: DataFrame, time: str = "exec_time") -> DataFrame:
    """Fills per business date (not log date)."""
    return fills.groupBy(F.to_date(time).alias("trade_date")).agg(F.count("*").alias("n_fills"))


def fills_on_date(fills: DataFrame, day: date | str, time: str = "exec_time") -> DataFrame:
    return fills.filter(on_date(time, day)).agg(F.count("*").alias("n_fills"))


def series_fills(fills: DataFrame, series: str) -> DataFrame:
    return fills.filter(F.col("contract_series") == series)


# --- life of a report -----------------------------------------------------------

def latest_action(
    reports: DataFrame, order: Sequence[str] = ("reporting_timestamp", "offset")
) -> DataFrame:
    """Last action of each trade by reporting time, then log offset."""
    narrow = reports.select("uti", "action_type", *order)
    return latest_per_key(narrow, ["uti"], order)


def live_utis(
    reports: DataFrame, order: Sequence[str] = ("reporting_timestamp", "offset")
) -> DataFrame:
    """Trades whose last action is not terminal."""
    return latest_action(reports, order).filter(is_live()).select("uti")


def live_trades(
    reports: DataFrame, order: Sequence[str] = ("reporting_timestamp", "offset")
) -> DataFrame:
    return live_utis(reports, order).agg(F.count("*").alias("n_live"))


def live_trades_anti(reports: DataFrame) -> DataFrame:
    """All trades less those with a terminal action, as an anti join.

    Both sides are made distinct first: that combines map-side and leaves both
    partitioned by the join key.
    """
    everything = reports.select("uti").filter(F.col("uti").isNotNull()).distinct()
    ended = reports.filter(F.col("action_type").isin(*TERMINAL_ACTIONS)).select("uti").distinct()
    return everything.join(ended, "uti", "left_anti").agg(F.count("*").alias("n_live"))


def live_trades_semi(reports: DataFrame) -> DataFrame:
    """Trades with a non-terminal row at their last reporting time, as a semi join.

    Rows are made distinct before the join, so many copies of one report shuffle as
    one row; the count of distinct trades does not change.
    """
    rows = reports.select("uti", "reporting_timestamp", "action_type").distinct()
    last = reports.groupBy("uti").agg(F.max("reporting_timestamp").alias("reporting_timestamp"))
    return (
        rows.join(last, ["uti", "reporting_timestamp"], "left_semi")
        .filter(is_live())
        .agg(F.count_distinct("uti").alias("n_live"))
    )


def all_utis_distractor(reports: DataFrame) -> DataFrame:
    """Trades with any non-terminal row: the wrong answer to "how many are live"."""
    return reports.filter(is_live()).agg(F.count_distinct("uti").alias("n_utis"))


def with_default_filters(df: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A table's standing SQL filters, all applied."""
    for condition in filters:
        df = df.filter(F.expr(condition))
    return df


# --- parties --------------------------------------------------------------------

def both_sides(reports: DataFrame, *carry: str) -> DataFrame:
    """One row per party of each report, in a single scan."""
    party = F.explode(F.array("counterparty_1", "counterparty_2")).alias("party")
    return reports.select(*carry, party)


def trades_per_party(reports: DataFrame) -> DataFrame:
    return both_sides(reports, "uti").groupBy("party").agg(
        F.count_distinct("uti").alias("n_trades")
    )


def live_trades_per_party(
    reports: DataFrame, order: Sequence[str] = ("reporting_timestamp", "offset")
) -> DataFrame:
    """As above, only trades whose last action is not terminal.

    One pass: a trade keeps its last action and the few parties that reported it.
    """
    parties = F.array_union(
        F.collect_set("counterparty_1"), F.collect_set("counterparty_2")
    )
    nobody = F.count_if(F.col("counterparty_1").isNull() | F.col("counterparty_2").isNull()) > 0
    per_trade = reports.groupBy("uti").agg(
        F.max_by("action_type", F.struct(*order)).alias("action_type"),
        F.when(nobody, F.array_append(parties, F.lit(None).cast("string")))
        .otherwise(parties).alias("parties"),
    )
    return (
        per_trade.filter(is_live() & F.col("uti").isNotNull())
        .select(F.explode("parties").alias("party"))
        .groupBy("party")
        .agg(F.count("*").alias("n_trades"))
    )


def party_activity(reports: DataFrame) -> DataFrame:
    """Rows, notional, time span and currencies per party."""
    sides = both_sides(reports, "notional", "notional_currency", "reporting_timestamp")
    return sides.groupBy("party").agg(
        F.count("*").alias("n_reports"),
        F.sum("notional").alias("total_notional"),
        F.min("reporting_timestamp").alias("first_report"),
        F.max("reporting_timestamp").alias("last_report"),
        F.count_distinct("notional_currency").alias("n_currencies"),
    )


def top_parties(reports: DataFrame, k: int = 25) -> DataFrame:
    """The k busiest parties; ties go to the smaller name."""
    return trades_per_party(reports).orderBy(F.desc("n_trades"), "party").limit(k)


def reported_this_week(
    reports: DataFrame, as_of: datetime, time: str = "reporting_timestamp"
) -> DataFrame:
    """Rows from Monday 00:00 of the week of ``as_of`` until ``as_of``."""
    dtype = reports.schema[time].dataType
    c = F.col(time)
    return reports.filter((c >= week_start(as_of, dtype)) & (c < instant(as_of, dtype)))


def reported_last_days(
    reports: DataFrame, as_of: datetime, days: int = 7, time: str = "reporting_timestamp"
) -> DataFrame:
    """Rows of the ``days`` before ``as_of``, both ends included."""
    dtype = reports.schema[time].dataType
    return reports.filter(
        F.col(time).between(days_before(as_of, days, dtype), instant(as_of, dtype))
    )


def week_top_parties(reports: DataFrame, as_of: datetime, k: int = 25) -> DataFrame:
    return top_parties(reported_this_week(reports, as_of), k)


def last_days_top_parties(
    reports: DataFrame, as_of: datetime, days: int = 7, k: int = 25
) -> DataFrame:
    return top_parties(reported_last_days(reports, as_of, days), k)


# --- joins ----------------------------------------------------------------------

def fills_with_orders(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills with their order (many to one)."""
    return lookup_join(fills, orders, "order_id")


def current_contracts(refdata: DataFrame, order: str = "version") -> DataFrame:
    """Last version of each series' reference data."""
    return latest_per_key(refdata, ["contract_series"], [order])


def _units(number: Column, places: int) -> Column:
    """A number as a whole count of its smallest unit, without a scale to lose."""
    scaled = number.cast(f"decimal(30,{places})") * F.lit(10**places)
    return F.round(scaled).cast("decimal(38,0)")


def notional(price: Column, multiplier: Column, quantity: Column) -> Column:
    """price x multiplier x lots, rounded once to 2 decimals.

    Prices count with up to 6 decimals, multipliers and lots with up to 2. The product is
    one of whole numbers, so no factor has a bound of its own: it is exact below 10**28, and
    null beyond.
    """
    exact = F.try_multiply(F.try_multiply(_units(price, 6), _units(multiplier, 2)), _units(quantity, 2))
    # In units of 10**-10; only the product is rounded.
    return (F.round(exact, -8) / F.lit(10**10).cast("decimal(11,0)")).cast("decimal(30,2)")


def fill_notionals(
    fills: DataFrame, refdata: DataFrame, order: str = "version"
) -> DataFrame:
    """Fills with underlying and notional by the last version of the reference data."""
    ref = current_contracts(
        refdata.select("contract_series", "underlying", "contract_multiplier", order), order
    ).drop(order)
    joined = lookup_join(fills, ref, "contract_series")
    return joined.withColumn("notional", notional(
        F.col("price"), F.col("contract_multiplier"), F.col("quantity")))


def notional_by_underlying(
    fills: DataFrame, refdata: DataFrame, order: str = "version"
) -> DataFrame:
    return (
        fill_notionals(fills, refdata, order)
        .groupBy("underlying")
        .agg(
            F.count("*").alias("n_fills"),
            F.sum("notional").cast("decimal(38,2)").alias("notional"),
        )
    )


def reports_with_fills(
    reports: DataFrame, fills: DataFrame, spread_by: str | None = "report_id"
) -> DataFrame:
    """Reports with the fill they are about; a report without one is kept."""
    return left_lookup(reports, fills, "exec_id", spread_by)


def clearing_with_fills(
    events: DataFrame, fills: DataFrame, spread_by: str | None = "event_id"
) -> DataFrame:
    """Clearing events with the fill they are about, where there is one."""
    return left_lookup(events, fills, "exec_id", spread_by)


def pair_transfers(events: DataFrame) -> DataFrame:
    """Give-ups with their take-ups, by the transfer part of the event id.

    The two halves carry unrelated execution ids, so those cannot pair them. One
    conditional aggregate, no self join; an unmatched half shows a null.
    """
    give, take = F.col("event_type") == "GIVE_UP", F.col("event_type") == "TAKE_UP"
    return (
        events.filter(give | take)
        .groupBy(F.expr("left(event_id, length(event_id) - 1)").alias("transfer_id"))
        .agg(
            F.max(F.when(give, F.col("clearing_member_id"))).alias("from_member"),
            F.max(F.when(take, F.col("clearing_member_id"))).alias("to_member"),
            F.max("event_time").alias("event_time"),
        )
    )
