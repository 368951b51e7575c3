"""Stored states against exact answers; values as of a time; Variant fields; observed writes."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from tapeline.operators import records, sketches, trades
from tapeline.plans import prefix
from tapeline.sources import topics
from tapeline.sources.contracts import EXECUTIONS

START = dt.datetime(2024, 1, 1)


def times(spark, lags, days):
    rows = [(START + dt.timedelta(days=d), START + dt.timedelta(days=d, microseconds=lag) if lag is not None else None)
            for lag, d in zip(lags, days)]
    return spark.createDataFrame(rows, "business timestamp_ntz, log timestamp_ntz")


def test_percentiles_of_merged_days_are_near(spark):
    """Heavy tails, a hot day, one value for a third of the rows; any range of days."""
    rng = random.Random(1)
    lags = [rng.choice([7, int(rng.paretovariate(0.7) * 1000), rng.randint(0, 10**9)]) for _ in range(30_000)]
    days = [0 if rng.random() < 0.4 else rng.randint(1, 30) for _ in lags]
    df = times(spark, lags, days).repartition(5)
    states = sketches.lag_sketches(df, "business", "log")
    assert states.count() == 31
    for low, high in ((0, 30), (0, 0), (5, 9)):
        own = [x for x, d in zip(lags, days) if low <= d <= high]
        some = states.filter(F.col("trade_date").between(
            (START + dt.timedelta(days=low)).date(), (START + dt.timedelta(days=high)).date()))
        for r in sketches.lag_percentiles(some, (1, 25, 50, 75, 90, 99)).collect():
            below, up_to = sum(x < r.lag_us for x in own), sum(x <= r.lag_us for x in own)
            assert r.n_rows == len(own)
            error = sketches.KLL_ERROR * len(own)
            assert below - error <= r.p / 100 * len(own) <= up_to + error
    found = sketches.rank_errors(df, "business", "log", sketches.lag_percentiles(states))
    assert all(r.rank_error <= sketches.KLL_ERROR and r.n_rows == len(lags) for r in found.collect())


def test_lags_without_times_and_without_rows(spark):
    df = times(spark, [None, 5, None], [0, 1, 1])
    states = sketches.lag_sketches(df, "business", "log")
    assert [r.n_rows for r in states.collect()] == [1]
    assert {r.lag_us for r in sketches.lag_percentiles(states).collect()} == {5}
    assert sketches.lag_percentiles(states.filter("false")).count() == 0
    assert sketches.rank_errors(df, "business", "log", sketches.lag_percentiles(states.filter("false"))).count() == 0


def test_distinct_counts_of_merged_groups(spark):
    """Values that several days share count once; nulls do not count."""
    df = spark.range(40_000).select(
        (F.col("id") % 9_000).cast("string").alias("v"), (F.col("id") % 13).alias("day"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias("party"))
    df = df.withColumn("v", F.when(F.col("v") != "7", F.col("v")))
    states = sketches.distinct_sketches(df, "v", ["party", "day"])
    exact = {r.party: r.n for r in df.groupBy("party").agg(F.count_distinct("v").alias("n")).collect()}
    for r in sketches.distinct_from(states, ["party"]).collect():
        assert abs(r.n_distinct - exact[r.party]) <= sketches.HLL_ERROR * exact[r.party] + 1
    whole = sketches.distinct_from(states).first()
    assert whole.n_rows == 40_000 and abs(whole.n_distinct - 8_999) <= sketches.HLL_ERROR * 8_999


def test_common_values_beyond_the_size_of_a_sketch(spark):
    a = spark.range(100_000).select(F.col("id").alias("x"), (F.col("id") + 500_000).alias("y"))
    b = spark.range(50_000, 250_000).select(F.col("id").cast("string").alias("z"),
                                            F.lit(None).cast("string").alias("none"))
    found = sketches.homonym_matrix(sketches.column_sketches({"a": (a, ["x", "y"]), "b": (b, ["z", "none"])}))
    got = {(r.left_column, r.right_column): r for r in found.collect()}
    assert len(got) == 6
    r = got["a.x", "b.z"]
    assert abs(r.n_common - 50_000) < sketches.THETA_ERROR * 250_000 and not r.unlike
    assert got["a.x", "a.y"].unlike and got["a.x", "a.y"].n_common == 0
    assert got["a.x", "b.none"].unlike and got["a.x", "b.none"].share is None


def brute_as_of(rows, versions):
    out = []
    for key, at, name in rows:
        known = [(f, o, v) for k, f, o, v in versions if k == key and f is not None and at is not None and f <= at]
        out.append((key, at, name, max(known, key=lambda x: x[:2])[2] if known else None))
    return out


def test_as_of_equals_brute_force(spark):
    """A key with most rows, blocks without versions, ties, null times and null values."""
    rng = random.Random(4)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(keys), rng.choice([None, *range(-300, 9000, 7)]), f"n{i}") for i in range(1500)]
    versions = [(rng.choice(keys), rng.choice([None, *range(0, 5000, 3)]), i, rng.choice([None, f"v{i}"]))
                for i in range(120)] + [("b", 70, 900, "x"), ("b", 70, 901, "y")]
    left = spark.createDataFrame(rows, "k string, at long, value string").repartition(4)
    right = spark.createDataFrame(versions, "k string, since long, seq long, value string")
    want = [(k, at, v) for k, at, _, v in brute_as_of([r for r in rows if r[0]], versions)]
    for bits in (0, 4, 9, 40):
        got = prefix.as_of(left, right, ["k"], "at", "since", ["value"], "seq", bits).filter("k is not null")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["k", "at", "value"]
    none = prefix.as_of(left, right.filter("false"), ["k"], "at", "since", ["value"], "seq")
    assert none.count() == len(rows) and none.filter("value is not null").count() == 0


def test_as_of_does_not_gather_a_hot_key(spark):
    rows = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    versions = spark.range(0, 100_000, 1000).select(
        F.lit("hot").alias("k"), F.col("id").alias("since"), F.col("id").alias("seq"), F.col("id").alias("v"))
    met = prefix.as_of(rows, versions, ["k"], "at", "since", ["v"], "seq", 10)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # Rows are dealt by key and block, so a key is as many pieces as it has blocks.
    assert "hashpartitioning(k" in plan and "__block" in plan.split("hashpartitioning(k")[1][:40]
    assert met.filter(F.col("v") != F.col("at") - F.col("at") % 1000).count() == 0
    assert met.count() == 100_000


def test_lots_of_any_size(spark):
    cases = [("1.005", "25", "20000000"), ("0.000001", "0.01", "0.01"), ("-3.333333", "7", "123456789.25"),
             ("99999999999.123456", "12345678.9", "99999999"), ("1.5", "1", None), ("0.005", "1", "1"),
             ("-0.005", "1", "1")]
    df = spark.createDataFrame([tuple(None if x is None else Decimal(x) for x in c) for c in cases],
                               "p decimal(20,6), m decimal(20,2), q decimal(20,2)")
    got = df.select(trades.notional(F.col("p"), F.col("m"), F.col("q")).alias("n")).collect()
    for (p, m, q), row in zip(cases, got):
        if q is None:
            assert row.n is None
            continue
        with localcontext(prec=60):
            exact = Decimal(p) * Decimal(m) * Decimal(q)
            assert row.n == exact.quantize(Decimal("0.01"), rounding="ROUND_HALF_UP"), (p, m, q)
    huge = spark.createDataFrame([(Decimal(10) ** 11, Decimal(10) ** 10, Decimal(10) ** 12)],
                                 "p decimal(20,6), m decimal(20,2), q decimal(20,2)")
    assert huge.select(trades.notional(F.col("p"), F.col("m"), F.col("q")).alias("n")).first().n is None


def test_variant_fields_of_odd_texts(spark):
    texts = [None, "", "[1]", "7", "null", '{"a":null}', '{"a":1e400}', '{"a":1,"a":2}', '{"b.c":"x"}', "{",
             '{"a":"2024-01-01"}', '{"a":"12"}', '{"a":12.50}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in records.open_variant(df, "t", {"a": "bigint", "b.c": "string"}, ["i"]).collect()}
    assert len(got) == len(texts)
    assert all(got[i].a is None and got[i].a_kind is None for i in (0, 1, 2, 3, 4, 8, 9))
    assert got[5].a_kind == "null" and got[5].a is None
    assert got[8]["b.c"] == "x" and got[8]["b.c_kind"] == "string"
    assert got[10].a_kind == "string" and got[10].a is None
    assert (got[11].a_kind, got[11].a) == ("string", 12)
    assert (got[12].a_kind, got[12].a) == ("number", 12)


def test_type_drift_of_nested_and_missing_fields(spark):
    texts = ['{"exec_id":"E1","quantity":1}', '{"exec_id":"E2","quantity":2.5}', '{"exec_id":3,"legs":[1]}',
             '{"legs":[{"a":1}],"price":null}', "no json", "[1]", None]
    log = spark.createDataFrame([("t", str(i), t, None) for i, t in enumerate(texts)], topics.ENVELOPE)
    got = {r.field: r for r in topics.type_drift(log, EXECUTIONS).collect()}
    assert got["exec_id"].mixed and got["exec_id"].n_records == 3
    assert not got["quantity"].mixed and got["quantity"].n_records == 2
    assert got["legs"].mixed and not got["legs"].declared
    assert got["price"].n_records == 1 and not got["price"].mixed
    assert got["side"].declared and got["side"].n_records == 0 and got["side"].seen is None


def test_observed_write_reads_once_and_reports_the_same(spark, tmp_path):
    raw = spark.createDataFrame(
        [("1", "a", "x"), ("b", "z", "y"), (None, None, None)], "n string, kind string, more string")
    schema = spark.createDataFrame([], "n int, kind string, gone date").schema
    enums = {"kind": ["a"]}
    rows, report = records.observe_conformance(raw, schema, enums, keep=["more"])
    rows.write.parquet(f"{tmp_path}/rows")
    assert spark.read.parquet(f"{tmp_path}/rows").columns == ["more", "n", "kind", "gone"]
    want = records.conformance_report(raw, schema, enums)
    assert sorted(map(tuple, report().collect())) == sorted(map(tuple, want.collect()))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan and plan.count("Scan") == 1 and "Exchange" not in plan
