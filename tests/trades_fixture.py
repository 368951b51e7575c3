"""Six fills whose answers were worked out by hand."""

from __future__ import annotations

from datetime import datetime
from types import SimpleNamespace

FILLS = [
    # offset, order, member, account, series, side, quantity, exec_time
    (0, "O1", "M1", "A1", "FDAX", "BUY", 10, "2026-07-20 10:00"),
    (1, "O1", "M1", "A1", "FDAX", "SELL", 25, "2026-07-21 09:00"),
    (2, "O2", "M1", "P1", "FDAX", "BUY", 40, "2026-07-20 08:30"),
    (3, "O2", "M2", "A1", "FDAX", "SELL", 5, "2026-07-20 12:00"),
    (4, "O3", "M2", "A1", "FDAX", "BUY", 2, "2026-07-20 11:00"),
    (5, "O3", "M1", "A1", "FESX", "SELL", 7, "2026-07-21 08:00"),
]


def build(spark) -> SimpleNamespace:
    from pyspark.sql import functions as F

    from tapeline.operators.state import running_positions

    fills = spark.createDataFrame(
        [
            (off, f"EXE{off}", order, series, side, qty, 100, member, member, acct,
             datetime.fromisoformat(time))
            for off, order, member, acct, series, side, qty, time in FILLS
        ],
        "offset bigint, exec_id string, order_id string, contract_series string, side string, "
        "quantity bigint, price decimal(18,2), executing_member string, "
        "clearing_member_id string, account string, exec_time timestamp_ntz".replace(
            "price decimal(18,2)", "price bigint"
        ),
    ).withColumn("price", F.col("price").cast("decimal(18,2)"))

    reports, off = [], 0
    actions = [(f, "NEWT", 5) for f in FILLS] + [(FILLS[3], "EROR", 65)]
    for fill, action, minutes in actions:
        parties = (f"LEI-{fill[2]}", f"C{fill[0] % 2}")
        for first, other in (parties, parties[::-1]):
            time = datetime.fromisoformat(fill[7])
            stamped = time.replace(minute=(time.minute + minutes) % 60,
                                   hour=time.hour + (time.minute + minutes) // 60)
            reports.append((off, f"R{off}", f"UTI{fill[0]}", first, other, f"EXE{fill[0]}",
                            action, None if action == "EROR" else 100 * fill[6], "EUR", stamped))
            off += 1
    reports = spark.createDataFrame(
        reports,
        "offset bigint, report_id string, uti string, counterparty_1 string, "
        "counterparty_2 string, exec_id string, action_type string, notional bigint, "
        "notional_currency string, reporting_timestamp timestamp_ntz",
    ).withColumn("notional", F.col("notional").cast("decimal(18,2)"))

    refdata = spark.createDataFrame(
        [("FDAX", "DAX", 25, 1), ("FESX", "EURO STOXX 50", 10, 1), ("FDAX", "DAX", 25, 2)],
        "contract_series string, underlying string, contract_multiplier bigint, version bigint",
    )
    return SimpleNamespace(
        fills=fills, reports=reports, refdata=refdata, positions=running_positions(fills)
    )


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()
