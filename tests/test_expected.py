"""Values at each scale that were worked out beforehand with other SQL."""

import pytest
from trades_fixture import as_dict, one

from tapeline.operators import audits
from tapeline.plans.registry import QUERIES
from tapeline.sources import tables

# sf, purchase total and history, click total and history, reports, live, keys out of order
EXPECTED = [
    ("0.001", 5356, 1708, 5567, -18956, 2300, 900, 5),
    ("0.01", 42071, 25535, 43321, -206716, 23000, 9000, 21),
    ("0.1", 424296, 2330022, 417343, -16519854, 230000, 90000, 25),
]


@pytest.mark.parametrize("sf,buy,buy_hist,click,click_hist,reports,live,late", EXPECTED)
def test_expected_values(spark, sf, buy, buy_hist, click, click_hist, reports, live, late):
    def run(name):
        return QUERIES[name](spark, f"/root/testdata/sf{sf}")

    rows = run("history_inflation").select("contract_series", "total_abs_net", "history_sum").collect()
    totals = {r[0]: (r[1], r[2]) for r in rows}
    assert totals["purchase"] == (buy, buy_hist) and totals["click"] == (click, click_hist)
    assert as_dict(run("total_abs_net"), "contract_series", "total_abs_net")["click"] == click
    assert one(run("count_reports")) == {"n_reports": reports}
    n_live, n_trades = one(run("live_trades"))["n_live"], one(run("count_trades"))["n_trades"]
    assert n_live == live <= n_trades <= reports
    assert one(run("order_audit"))["n_out_of_order"] == late
    # The tables themselves are without these faults; the queries put some in and find them.
    where = spark, f"/root/testdata/sf{sf}"
    whole = audits.position_reconcile(tables.positions(*where), tables.fills(*where))
    assert one(whole)["n_different"] == 0 and one(run("position_reconcile"))["n_different"] > 0
    mirrored = audits.dual_side_audit(tables.reports(*where)).collect()
    assert all(r.n_unmirrored == 0 for r in mirrored)
    assert any(r.n_unmirrored > 0 for r in run("dual_side_audit").collect())


@pytest.mark.parametrize("sf,anyone,net", [
    ("0.001", "M2 M3 M4", "M2 M4"), ("0.01", "M2 M3 M4", "M2 M3 M4"), ("0.1", "M2 M4", "M2 M4"),
])
def test_short_members(spark, sf, anyone, net):
    def members(name):
        rows = QUERIES[name](spark, f"/root/testdata/sf{sf}").filter("contract_series = 'purchase'")
        return " ".join(sorted(r.clearing_member_id for r in rows.collect()))

    assert (members("short_members_any"), members("short_members_net")) == (anyone, net)
    assert members("sell_side_members") == "M0 M1 M2 M3 M4"


def test_declared_tables_are_as_stored(spark):
    from tapeline.sources import tables

    for name in tables.SCHEMAS:
        stored = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema
        declared = tables.table(spark, "/root/testdata/sf0.001", name).schema
        assert declared.simpleString() == stored.simpleString()
