from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F
from trades_fixture import as_dict, one

from tapeline.operators import trades


def test_counts_right_and_wrong(book):
    assert one(trades.count_fills(book.fills)) == {"n_fills": 6}
    assert one(trades.count_orders(book.fills)) == {"n_orders": 3}
    assert one(trades.count_orders(book.fills, approximate=True)) == {"n_orders": 3}
    assert one(trades.count_trades(book.reports)) == {"n_trades": 6}
    assert one(trades.count_reports(book.reports)) == {"n_reports": 14}


def test_three_forms_of_live_trades_agree(book):
    for form in (trades.live_trades, trades.live_trades_anti, trades.live_trades_semi):
        assert one(form(book.reports)) == {"n_live": 5}
    assert one(trades.all_utis_distractor(book.reports)) == {"n_utis": 6}


def test_a_modified_trade_is_live_a_terminated_one_is_not(spark):
    rows = [
        (0, "U1", "NEWT", 9), (1, "U1", "MODI", 10),
        (2, "U2", "NEWT", 9), (3, "U2", "TERM", 10),
        (4, "U3", "NEWT", 9), (5, "U3", None, 10),
        (6, "U4", "EROR", 10), (7, "U4", "NEWT", 10),  # same time: the later offset wins
    ]
    reports = spark.createDataFrame(
        [(o, u, a, datetime(2026, 7, 20, h)) for o, u, a, h in rows],
        "offset bigint, uti string, action_type string, reporting_timestamp timestamp_ntz",
    )
    assert {r.uti for r in trades.live_utis(reports).collect()} == {"U1", "U4"}


def test_dates_follow_business_time(book):
    assert as_dict(trades.fills_by_date(book.fills), "trade_date", "n_fills") == {
        date(2026, 7, 20): 4, date(2026, 7, 21): 2,
    }
    assert one(trades.fills_on_date(book.fills, "2026-07-21")) == {"n_fills": 2}
    assert one(trades.fills_on_date(book.fills, date(2026, 7, 22))) == {"n_fills": 0}


def test_parties(book):
    assert trades.both_sides(book.reports).count() == 2 * book.reports.count()
    assert as_dict(trades.trades_per_party(book.reports), "party", "n_trades") == {
        "LEI-M1": 4, "LEI-M2": 2, "C0": 3, "C1": 3,
    }
    assert as_dict(trades.live_trades_per_party(book.reports), "party", "n_trades") == {
        "LEI-M1": 4, "LEI-M2": 1, "C0": 3, "C1": 2,
    }
    assert [r.party for r in trades.top_parties(book.reports, 3).collect()] == ["LEI-M1", "C0", "C1"]
    m2 = trades.party_activity(book.reports).filter("party = 'LEI-M2'").first()
    assert (m2.n_reports, m2.total_notional, m2.n_currencies) == (6, Decimal("1400.00"), 1)


def test_week_runs_from_monday_to_now(book):
    # 2026-07-20 is a Monday.
    now = datetime(2026, 7, 20, 11, 30)
    week = trades.reported_this_week(book.reports, now)
    assert {r.uti for r in week.collect()} == {"UTI0", "UTI2", "UTI4"}
    assert trades.reported_this_week(book.reports, datetime(2026, 7, 19, 23)).count() == 0
    last = trades.reported_last_days(book.reports, datetime(2026, 7, 27, 12, 5), 7)
    assert {r.uti for r in last.collect()} == {"UTI1", "UTI3", "UTI5"}


def test_notional_uses_the_current_version_once(book):
    detail = trades.fill_notionals(book.fills, book.refdata)
    assert detail.count() == 6
    assert detail.filter("offset = 0").first().notional == Decimal("25000.00")
    total = as_dict(trades.notional_by_underlying(book.fills, book.refdata), "underlying", "notional")
    assert total == {"DAX": Decimal(100 * 25 * 82), "EURO STOXX 50": Decimal(100 * 10 * 7)}


def test_notional_rounds_to_two_decimals(spark):
    fills = spark.createDataFrame([("S", "10.01", "3")], "contract_series string, price string, quantity string")
    ref = spark.createDataFrame([("S", "U", "0.05", 1)],
                                "contract_series string, underlying string, contract_multiplier string, version bigint")
    row = trades.fill_notionals(fills, ref).first()
    assert row.notional == Decimal("1.50")  # 1.5015


def test_reports_without_a_fill_stay(book, spark):
    lone = book.reports.limit(0).unionByName(
        book.reports.filter("offset < 4").withColumn("exec_id", F.lit(None).cast("string"))
    )
    fills = book.fills.select("exec_id", "side")
    joined = trades.reports_with_fills(book.reports.unionByName(lone), fills)
    assert joined.count() == 18
    assert joined.filter("exec_id IS NULL AND side IS NULL").count() == 4
    assert joined.filter("exec_id = 'EXE1' AND side = 'SELL'").count() == 2


def test_transfers_pair_by_id_not_by_execution(spark):
    events = spark.createDataFrame(
        [
            ("GUP001G", "GIVE_UP", "EXE1", "M1", datetime(2026, 7, 20)),
            ("GUP001T", "TAKE_UP", "EXE9", "M2", datetime(2026, 7, 20)),
            ("GUP002G", "GIVE_UP", "EXE2", "M3", datetime(2026, 7, 20)),
            ("CLR001", "NOVATION", "EXE1", "M1", datetime(2026, 7, 20)),
        ],
        "event_id string, event_type string, exec_id string, clearing_member_id string, "
        "event_time timestamp_ntz",
    )
    pairs = {r.transfer_id: (r.from_member, r.to_member) for r in trades.pair_transfers(events).collect()}
    assert pairs == {"GUP001": ("M1", "M2"), "GUP002": ("M3", None)}


def test_default_filters_add_up(book):
    kept = trades.with_default_filters(book.reports, ["action_type <> 'EROR'", "offset > 1"])
    assert kept.count() == 10


def test_empty_topics_give_zero_counts(book):
    none = book.reports.limit(0)
    assert one(trades.count_trades(none)) == {"n_trades": 0}
    assert one(trades.live_trades(none)) == {"n_live": 0}
    assert trades.party_activity(none).count() == 0
