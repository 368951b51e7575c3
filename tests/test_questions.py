"""The eight questions, end to end."""

import json

import pytest
from paths import SF_SMALL
from trades_fixture import one

from tapeline.operators import positions, questions, scoring, state
from tapeline.plans.shared import fresh_path
from tapeline.sources import tables, topics
from tapeline.streaming import continuous
from tapeline.streaming import tables as sinks

# Published current net positions and the totals that follow from them.
NETS = {
    "DCMFOO|A1|FDAX-2026-09": -149,
    "DCMFOO|A1|FESX-2026-09": -106,
    "DCMFOO|A1|FGBL-2026-09": -59,
    "DCMFOO|A1|OESX-2026-09-C-5400": -162,
    "DCMFOO|A1|OESX-2026-09-P-5000": -109,
    "DCMFOO|P1|FDAX-2026-09": -259,
    "DCMFOO|P1|FESX-2026-09": -168,
    "DCMFOO|P1|FGBL-2026-09": -269,
    "DCMFOO|P1|OESX-2026-09-C-5400": -218,
    "DCMFOO|P1|OESX-2026-09-P-5000": -119,
    "DCMQUX|A1|FDAX-2026-09": -212,
    "DCMQUX|A1|FESX-2026-09": -90,
    "DCMQUX|A1|FGBL-2026-09": -100,
    "DCMQUX|A1|OESX-2026-09-C-5400": -199,
    "DCMQUX|A1|OESX-2026-09-P-5000": -42,
    "DCMQUX|P1|FDAX-2026-09": -270,
    "DCMQUX|P1|FESX-2026-09": -304,
    "DCMQUX|P1|FGBL-2026-09": -356,
    "DCMQUX|P1|OESX-2026-09-C-5400": -179,
    "DCMQUX|P1|OESX-2026-09-P-5000": -15,
    "GCMABC|A1|FDAX-2026-09": 229,
    "GCMABC|A1|FESX-2026-09": 107,
    "GCMABC|A1|FGBL-2026-09": 26,
    "GCMABC|A1|OESX-2026-09-C-5400": 333,
    "GCMABC|A1|OESX-2026-09-P-5000": 124,
    "GCMABC|P1|FDAX-2026-09": 286,
    "GCMABC|P1|FESX-2026-09": 237,
    "GCMABC|P1|FGBL-2026-09": -4,
    "GCMABC|P1|OESX-2026-09-C-5400": 37,
    "GCMABC|P1|OESX-2026-09-P-5000": 144,
    "GCMBAR|A1|FDAX-2026-09": 42,
    "GCMBAR|A1|FESX-2026-09": -93,
    "GCMBAR|A1|FGBL-2026-09": 0,
    "GCMBAR|A1|OESX-2026-09-C-5400": 79,
    "GCMBAR|A1|OESX-2026-09-P-5000": 67,
    "GCMBAR|P1|FDAX-2026-09": 66,
    "GCMBAR|P1|FESX-2026-09": -40,
    "GCMBAR|P1|FGBL-2026-09": -161,
    "GCMBAR|P1|OESX-2026-09-C-5400": 222,
    "GCMBAR|P1|OESX-2026-09-P-5000": 19,
    "GCMXYZ|A1|FDAX-2026-09": -25,
    "GCMXYZ|A1|FESX-2026-09": 250,
    "GCMXYZ|A1|FGBL-2026-09": 9,
    "GCMXYZ|A1|OESX-2026-09-C-5400": 39,
    "GCMXYZ|A1|OESX-2026-09-P-5000": 45,
    "GCMXYZ|P1|FDAX-2026-09": 250,
    "GCMXYZ|P1|FESX-2026-09": 245,
    "GCMXYZ|P1|FGBL-2026-09": 114,
    "GCMXYZ|P1|OESX-2026-09-C-5400": 162,
    "GCMXYZ|P1|OESX-2026-09-P-5000": 256,
}
TOTALS = {"FDAX-2026-09": 1788, "FESX-2026-09": 1640, "OESX-2026-09-P-5000": 940,
          "OESX-2026-09-C-5400": 1630, "FGBL-2026-09": 1098}


@pytest.fixture(scope="module")
def published(spark):
    """The published state as the last snapshots of a log with older ones before them."""
    rows, offset = [], 0
    for stale in (True, False):
        for key, net in NETS.items():
            rows.append((offset, *key.split("|"), -net + 1 if stale else net))
            offset += 1
    return spark.createDataFrame(
        rows, "offset bigint, clearing_member_id string, account string, contract_series string, "
        "net_quantity bigint")


def test_published_totals(published):
    got = {r.contract_series: r.total_abs_net for r in positions.total_abs_net(published).collect()}
    assert got == TOTALS
    halves = {r.contract_series: r.open_interest for r in positions.open_interest(published).collect()}
    assert {k: float(v) * 2 for k, v in halves.items()} == TOTALS


def test_published_short_members(published):
    def fdax(df):
        rows = df.filter("contract_series = 'FDAX-2026-09'").collect()
        return sorted(r.clearing_member_id for r in rows)

    assert fdax(positions.short_members_any(published)) == ["DCMFOO", "DCMQUX", "GCMXYZ"]
    assert fdax(positions.short_members_net(published)) == ["DCMFOO", "DCMQUX"]
    assert len(fdax(positions.short_anytime_members(published))) == 5


def test_scalar_truth_by_hand(book):
    truth = {
        r.id: (r.truth, {d.label: d.value for d in r.distractors})
        for r in questions.scalar_truth(book.fills, book.reports, "2026-07-21").collect()
    }
    assert truth == {
        "q1_control_count": (6, {}),
        "q2_fanout_orders": (3, {"count_star_fills": 6}),
        "q3_emir_trade_count": (6, {"report_record_count": 14}),
        "q4_live_trades": (5, {"all_utis": 6}),
        "q8_event_time": (2, {}),
    }


def test_scorecard_of_a_stored_run(spark, book):
    def block(**totals):
        return [json.dumps({"contract_series": k, "total": v}) for k, v in totals.items()]

    cells = [
        ("q1_control_count", "semantic", "SELECT COUNT(*) FROM f", ['{"n": 6}'], "PASS"),
        ("q2_fanout_orders", "baseline", "SELECT COUNT(*) FROM f", ['[{"n": 6}]'], "FAIL"),
        ("q2_fanout_orders", "semantic", "SELECT COUNT(DISTINCT order_id) FROM f", None, "PASS"),
        ("q3_emir_trade_count", "baseline", "SELECT COUNT(DISTINCT uti) FROM r", ['{"n": 14}'], "FAIL"),
        ("q4_live_trades", "semantic", "... NOT IN ('EROR', 'TERM')", ['{"n": 99}'], "PASS"),
        ("q5_open_interest", "baseline", "SELECT SUM(ABS(net_quantity)) FROM p", block(FDAX=27, FESX=7), "FAIL"),
        ("q5_open_interest", "semantic", "... row_number() ...", block(FDAX=58, FESX=7), "PASS"),
        ("q6_counterparty_homonym", "semantic", "SELECT counterparty_1 FROM `emir.trade-reports`", None, "PASS"),
        ("q7_side_vs_direction", "semantic", "", ['[{"member": "M1"}, {"member": "M2"}]'], "PASS"),
        ("q7_side_vs_direction", "baseline", "", ['[{"member": "M3"}]'], "FAIL"),
        ("q8_event_time", "baseline", "WHERE _meta.timestamp > 1", ["no rows"], "FAIL"),
    ]
    runs = spark.createDataFrame([c[:4] for c in cells],
                                 "id string, condition string, sql string, result array<string>")
    card = questions.score_runs(
        runs,
        questions.scalar_truth(book.fills, book.reports, "2026-07-21"),
        questions.group_truth(book.positions),
        questions.member_truth(book.positions, "FDAX"),
        spark.createDataFrame([("M1",), ("M2",), ("M3",)], "member string"),
        measure="total",
    )
    got = {(r.id, r.condition): r.verdict for r in card.collect()}
    assert got == {c[:2]: c[4] for c in cells}
    effect = one(scoring.content_effect(card, "semantic", "baseline"))
    assert (effect["treated_rate"], effect["control_rate"]) == (1.0, 0.0)


@pytest.fixture(scope="module")
def stored_log(spark):
    path = fresh_path(spark, "test-log")
    topics.write_log(tables.topic_log(spark, SF_SMALL), path)
    return path


def test_questions_as_sql_over_a_stored_log(spark, stored_log):
    topics.register_topics(topics.open_topics(topics.read_log(spark, stored_log)))

    def number(sql):
        return spark.sql(sql).first()[0]

    fills, reports = "`etd.executions`", "`emir.trade-reports`"
    assert number(f"SELECT count(*) FROM {fills}") == 1000
    assert number(f"SELECT count(DISTINCT uti) FROM {reports}") == 1000
    assert number(f"SELECT count(*) FROM {reports}") == 2300
    # Last action per trade: by window and by a pair of values in a subquery.
    assert number(f"""
        WITH acts AS (SELECT *, row_number() OVER w AS back FROM {reports}
                      WINDOW w AS (PARTITION BY uti ORDER BY reporting_timestamp DESC))
        SELECT count(*) FROM acts WHERE back = 1 AND action_type NOT IN ('TERM', 'EROR')""") == 900
    assert number(f"""
        WITH ends AS (SELECT uti, max(reporting_timestamp) FROM {reports} GROUP BY ALL)
        SELECT count(DISTINCT uti) FROM {reports}
        WHERE action_type NOT IN ('TERM', 'EROR')
          AND (uti, reporting_timestamp) IN (SELECT * FROM ends)""") == 900
    totals = {
        r.contract_series: int(r.total)
        for r in spark.sql("""
            WITH now AS (SELECT contract_series, max_by(net_quantity, _meta.offset) AS net
                         FROM `etd.positions` GROUP BY _key, contract_series)
            SELECT contract_series, sum(abs(net)) AS total FROM now GROUP BY ALL""").collect()
    }
    assert (totals["purchase"], totals["click"]) == (5356, 5567)
    on_day = tables.fills(spark, SF_SMALL).filter("to_date(exec_time) = '2024-01-15'").count()
    assert number(f"""SELECT count(*) FROM {fills}
        WHERE exec_time >= timestamp('2024-01-15') AND exec_time < timestamp('2024-01-16')""") == on_day
    top = spark.sql(f"""
        SELECT party, count(DISTINCT uti) AS n
        FROM {reports} LATERAL VIEW explode(array(counterparty_1, counterparty_2)) p AS party
        GROUP BY party ORDER BY n DESC, party LIMIT 1""").first()
    assert tuple(top) == ("LEI-M4", 226)


def test_operators_over_a_stored_log_use_its_offsets(spark, stored_log):
    decoded = topics.open_topics(topics.read_log(spark, stored_log))["etd.positions"]
    total = positions.total_abs_net(decoded, order="_meta.offset")
    assert {r.contract_series: int(r.total_abs_net) for r in total.collect()}["purchase"] == 5356
    wide = state.latest_per_key(decoded.withColumn("offset", decoded._meta.offset), ["_key"])
    assert wide.count() == 50


def test_stored_log_as_a_stream(spark, stored_log):
    stream = topics.stream_log(spark, stored_log).filter("topic = 'etd.positions'")
    decoded = topics.decode_topic(stream, topics.CONTRACTS["etd.positions"])
    last = continuous.latest_stream(
        decoded.selectExpr("_key", "_meta.offset AS offset", "net_quantity"), ["_key"], ["net_quantity"]
    )
    got = sinks.current_table(spark, last, ["_key"], "test-stream-log")
    current = state.current_net_positions(tables.positions(spark, SF_SMALL))
    want = {"|".join(tuple(r)[:3]): r.net_quantity for r in current.collect()}
    assert {r._key: int(r.net_quantity) for r in got.collect()} == want
