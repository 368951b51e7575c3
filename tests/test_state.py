import random

import pytest
from trades_fixture import as_dict

from tapeline.operators import positions, state
from tapeline.operators.records import assign_offsets
from tapeline.plans.prefix import running_sum


def _nets(df):
    return {(r.clearing_member_id, r.account, r.contract_series): r.net_quantity for r in df.collect()}


def test_running_positions_by_hand(book):
    assert as_dict(book.positions, "offset", "net_quantity") == {0: 10, 1: -15, 2: 40, 3: -5, 4: -3, 5: -7}


def test_latest_is_by_offset_not_business_time(book):
    assert _nets(state.current_net_positions(book.positions)) == {
        ("M1", "A1", "FDAX"): -15, ("M1", "P1", "FDAX"): 40,
        ("M2", "A1", "FDAX"): -3, ("M1", "A1", "FESX"): -7,
    }
    by_time = state.current_net_positions(book.positions, order="exec_time")
    assert _nets(by_time)[("M2", "A1", "FDAX")] == -5


def test_last_snapshot_is_the_signed_sum(book):
    assert _nets(state.net_from_fills(book.fills)) == _nets(state.current_net_positions(book.positions))


def test_state_at_an_offset(book):
    assert _nets(state.positions_as_of(book.positions, 3)) == {
        ("M1", "A1", "FDAX"): -15, ("M1", "P1", "FDAX"): 40, ("M2", "A1", "FDAX"): -5,
    }


@pytest.mark.parametrize("columns", [["k", "offset", "v"], ["k", "offset", "v", "name"]])
def test_both_plans_of_latest_agree_in_any_input_order(spark, columns):
    rnd = random.Random(5)
    rows = [(rnd.randrange(9), i, rnd.choice([None, *range(5)]), f"n{i}") for i in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, offset bigint, v bigint, name string").repartition(5)
    df = df.select(*columns)
    want = {}
    for row in sorted(rows, key=lambda r: r[1]):
        want[row[0]] = row[: len(columns)]
    for method in (None, "window") if "name" in columns else (None, "window", "aggregate"):
        got = {r[0]: tuple(r) for r in state.latest_per_key(df, ["k"], method=method).collect()}
        assert got == want


def test_plan_of_latest(spark):
    df = spark.range(10).selectExpr("id % 3 AS k", "id AS offset", "id AS v", "cast(id AS string) AS s")
    narrow = state.latest_per_key(df.drop("s"), ["k"])._jdf.queryExecution().executedPlan().toString()
    wide = state.latest_per_key(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in narrow and "Sort" not in narrow
    assert wide.count("WindowGroupLimit") == 2 and "Partial" in wide


def test_deleted_keys_are_dropped_only_on_request(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, 7), ("b", 0, None)],
                               "k string, offset bigint, v bigint")
    assert state.latest_per_key(df, ["k"]).count() == 2
    assert [r.k for r in state.latest_per_key(df, ["k"], drop_deleted="v").collect()] == ["b"]


@pytest.mark.parametrize("block_bits", [0, 3, 20])
def test_running_sum_is_exact_for_any_block_size(spark, block_bits):
    rnd = random.Random(block_bits)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]), o - 100, rnd.choice([None, 3, -2, 8]))
            for o in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(6)
    want, sums = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            sums[k] = sums.get(k, 0) + v
        want[o] = sums.get(k)
    got = running_sum(df, ["k"], "o", "v", "s", block_bits)
    assert got.columns == ["k", "o", "v", "s"]
    assert {r.o: r.s for r in got.collect()} == want


def test_offsets_are_dense_and_keys_stay_together(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("concat('k', id % 37) AS key", "id * 3 AS sent")
    rows = assign_offsets(df, "key", "sent", partitions=3, block_bits=6).collect()
    assert len(rows) == 5000
    parts, keys = {}, {}
    for r in rows:
        parts.setdefault(r.partition, []).append((r.offset, r.sent))
        keys.setdefault(r.key, set()).add(r.partition)
    assert all(len(p) == 1 for p in keys.values()) and set(parts) <= {0, 1, 2}
    for entries in parts.values():
        entries.sort()
        assert [o for o, _ in entries] == list(range(len(entries)))
        assert [s for _, s in entries] == sorted(s for _, s in entries)


def test_totals_and_their_distractors(book):
    p = book.positions
    assert as_dict(positions.total_abs_net(p), "contract_series", "total_abs_net") == {"FDAX": 58, "FESX": 7}
    assert as_dict(positions.history_sum(p), "contract_series", "history_sum") == {"FDAX": 27, "FESX": -7}
    assert as_dict(positions.history_abs_sum(p), "contract_series", "history_abs_sum") == {"FDAX": 73, "FESX": 7}
    halves = as_dict(positions.open_interest(p), "contract_series", "open_interest")
    assert {k: float(v) for k, v in halves.items()} == {"FDAX": 29.0, "FESX": 3.5}


def _members(df, series="FDAX"):
    return sorted(r.clearing_member_id for r in df.collect() if r.contract_series == series)


def test_readings_of_short(book):
    p, f = book.positions, book.fills
    assert _members(positions.short_members_any(p)) == ["M1", "M2"]
    assert _members(positions.short_members_net(p)) == ["M2"]
    assert _members(positions.short_members_either(p)) == ["M1", "M2"]
    assert _members(positions.short_anytime_members(p)) == ["M1", "M2"]
    assert _members(positions.sell_side_members(f)) == ["M1", "M2"]
    assert _members(positions.sell_not_short(f, p)) == []
    assert _members(positions.sell_and_short(f, p)) == ["M1", "M2"]
