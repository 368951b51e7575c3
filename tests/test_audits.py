from datetime import datetime, timedelta

from pyspark.sql import functions as F
from trades_fixture import one

from tapeline.operators import audits, trades


def test_grain(book):
    assert one(audits.grain_audit(book.fills, ["order_id"])) == {
        "n_rows": 6, "n_keys": 3, "n_repeated_keys": 3, "max_rows_per_key": 2,
    }
    assert one(audits.grain_audit(book.fills, ["exec_id"]))["n_repeated_keys"] == 0
    assert one(audits.grain_audit(book.fills.limit(0), ["exec_id"])) == {
        "n_rows": 0, "n_keys": 0, "n_repeated_keys": 0, "max_rows_per_key": 0,
    }


def test_fanout(spark, book):
    orders = spark.createDataFrame([("O1",), ("O2",), ("O9",)], "order_id string")
    assert one(audits.fanout_audit(orders, book.fills, "order_id")) == {
        "n_parents": 3, "n_children": 6, "n_childless_parents": 1, "n_orphans": 2, "max_children": 2,
    }


def test_homonyms(book):
    parties = trades.both_sides(book.reports)
    assert one(audits.homonym_audit(parties, "party", book.fills, "clearing_member_id")) == {
        "n_left": 4, "n_right": 2, "n_common": 0, "share": 0.0, "unlike": True,
    }
    same = one(audits.homonym_audit(book.fills, "executing_member", book.positions, "clearing_member_id"))
    assert same["n_common"] == 2 and same["share"] == 1.0 and not same["unlike"]


def test_a_stray_common_value_does_not_make_columns_alike(spark):
    left, right = spark.range(2000).toDF("a"), spark.range(1999, 4000).toDF("b")
    row = one(audits.homonym_audit(left, "a", right, "b"))
    assert row["n_common"] == 1 and row["share"] == 1 / 2000 and row["unlike"]
    assert not one(audits.homonym_audit(left, "a", right, "b", least_share=1e-4))["unlike"]
    assert one(audits.homonym_audit(left.limit(0), "a", right, "b"))["share"] is None


def test_reconcile_keeps_fractions(spark, book):
    half = book.fills.withColumn("quantity", F.col("quantity").cast("decimal(18,2)") + F.when(
        F.col("offset") == 5, F.lit(0.5).cast("decimal(18,2)")).otherwise(0))
    row = one(audits.position_reconcile(book.positions, half))
    assert row["n_different"] == 1 and float(row["total_difference"]) == 0.5


def test_dual_sides(book):
    whole = {r.action_type: (r.n_mirrored, r.n_unmirrored) for r in audits.dual_side_audit(book.reports).collect()}
    assert whole == {"NEWT": (6, 0), "EROR": (1, 0)}
    broken = book.reports.filter("report_id <> 'R0'").withColumn(
        "counterparty_2", F.when(F.col("report_id") == "R2", F.lit(None)).otherwise(F.col("counterparty_2"))
    )
    rows = {r.action_type: (r.n_mirrored, r.n_unmirrored) for r in audits.dual_side_audit(broken).collect()}
    assert rows == {"NEWT": (4, 2), "EROR": (1, 0)}
    # Twice the same direction is not a mirror.
    twice = book.reports.filter("report_id = 'R0'")
    assert audits.dual_side_audit(twice.union(twice)).first().n_unmirrored == 1


def test_order(book):
    keys = ["clearing_member_id", "account", "contract_series"]
    assert one(audits.order_audit(book.positions, keys, "exec_time")) == {"n_keys": 4, "n_out_of_order": 1}


def test_inflation_and_reconcile(book):
    rows = {r.contract_series: tuple(r)[1:] for r in audits.history_inflation(book.positions).collect()}
    assert rows == {"FDAX": (58, 27, 73), "FESX": (7, -7, 7)}
    assert one(audits.position_reconcile(book.positions, book.fills)) == {
        "n_keys": 4, "n_different": 0, "total_difference": 0,
    }
    lost = book.fills.filter("offset <> 5 AND offset <> 2")
    assert one(audits.position_reconcile(book.positions, lost)) == {
        "n_keys": 4, "n_different": 2, "total_difference": 47,
    }


def test_ingest_skew_percentiles_are_exact(spark):
    day = datetime(2026, 7, 20, 23, 0)
    lags = [timedelta(microseconds=i * i * 997 - 5_000_000) for i in range(1, 301)]
    df = spark.createDataFrame([(day, day + lag) for lag in lags], "b timestamp_ntz, l timestamp_ntz")
    micros = sorted(int(lag / timedelta(microseconds=1)) for lag in lags)
    row = one(audits.ingest_skew(df.repartition(5), "b", "l"))
    assert (row["n_rows"], row["max_lag_us"], row["n_other_date"]) == (300, micros[-1], 0)
    assert [row[f"p{p}_lag_us"] for p in (50, 90, 99)] == [micros[149], micros[269], micros[296]]
    assert row["avg_lag_us"] == sum(micros) // 300


def test_ingest_skew_of_nothing(spark):
    df = spark.createDataFrame([], "b timestamp_ntz, l timestamp_ntz")
    row = one(audits.ingest_skew(df, "b", "l"))
    assert row["n_rows"] == 0 and row["p50_lag_us"] is None
