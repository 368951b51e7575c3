"""Plan shapes: what is pushed down, combined early, broadcast or split."""

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from tapeline.operators import audits, positions, trades
from tapeline.plans import joins, prefix
from tapeline.plans.registry import QUERIES
from tapeline.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def test_date_range_reaches_the_scan(spark):
    text = plan(QUERIES["fills_on_date"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_series_filter_reaches_the_scan_below_the_state(spark):
    one = tables.fills(spark, SF_SMALL).filter("contract_series = 'purchase'")
    assert "EqualTo(event_type,purchase)" in plan(one)


@pytest.mark.parametrize("name", ["count_trades", "trades_per_party", "count_reports"])
def test_reports_are_scanned_once_and_pruned(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    assert text.count("FileScan") == 1
    assert "props" not in text and "value" not in text.split("ReadSchema")[1]


def test_week_bounds_are_constants(spark):
    text = plan(QUERIES["week_top_parties"](spark, SF_SMALL))
    assert "date_trunc" not in text and "2024-01-15" in text
    assert "TakeOrderedAndProject" in text


def test_position_totals_combine_before_the_shuffle(spark):
    log = tables.positions(spark, SF_SMALL)
    text = plan(positions.total_abs_net(log))
    assert "partial_max_by" in text and "SortAggregate" not in text


def test_no_query_uses_a_cross_join_or_python(spark):
    for name, query in QUERIES.items():
        if name.startswith("stream_") or name == "written_topic":
            continue
        text = plan(query(spark, SF_SMALL))
        assert "CartesianProduct" not in text, name
        assert "Python" not in text and "ArrowEval" not in text, name
        if "BroadcastNestedLoopJoin" in text:
            raise AssertionError(name)


def test_lookups_are_not_hinted(spark):
    """The session's byte threshold decides, and no job runs while a plan is made."""
    facts = spark.range(1000).selectExpr("id % 10 AS k", "id")
    lookup = spark.range(10).selectExpr("id AS k", "id * 2 AS v")
    small = joins.lookup_join(facts, lookup, "k")
    assert "BroadcastHashJoin" in plan(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = joins.lookup_join(facts, lookup, "k")
        assert "SortMergeJoin" in plan(large)
        assert sorted(small.collect()) == sorted(large.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# These keep a log, a table or a stream's state in the shared folder.
WRITING = {"topic_snapshot", "written_topic", "topic_sql"}


def test_plans_are_made_without_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    for name, query in QUERIES.items():
        if name.startswith("stream_") or name in WRITING:
            continue
        group = f"planning-{name}"
        spark.sparkContext.setJobGroup(group, name)
        query(spark, SF_SMALL)
        assert not tracker.getJobIdsForGroup(group), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_running_sums_have_bounded_windows(spark):
    """Carries come in two levels, and every window has a key."""
    rows = spark.range(5000).selectExpr("id % 3 AS k", "id AS o", "id % 7 AS v")
    blocked = prefix.running_sum(rows, ["k"], "o", "v", "s", block_bits=4)
    plain = prefix.running_sum(rows, ["k"], "o", "v", "s", block_bits=None)
    text, simple = plan(blocked), plan(plain)
    assert "__group" in text and "SinglePartition" not in text
    # A log of many keys: no block totals, one shuffle.
    assert simple.count("Exchange hashpartitioning") == 1 and "__block" not in simple
    assert sorted(blocked.collect()) == sorted(plain.collect())
    with pytest.raises(ValueError):
        prefix.running_sum(rows, [], "o", "v", "s")
    skew = audits.ingest_skew(
        spark.range(100).selectExpr("timestamp_ntz '2024-01-01 00:00:00' AS b",
                                    "timestamp_ntz '2024-01-02 00:00:00' AS l"), "b", "l")
    windows = [line for line in plan(skew).splitlines() if "Window [" in line]
    assert windows and all("], [p#" in line for line in windows)


def test_bucketed_topics_join_without_a_shuffle(spark, tmp_path):
    from tapeline.sources import topics

    fills = tables.fills(spark, SF_SMALL).select("exec_id", "side")
    reports = tables.reports(spark, SF_SMALL).select("exec_id", "report_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        topics.save_bucketed(fills, "bucketed_fills", str(tmp_path / "f"), "exec_id", 4)
        topics.save_bucketed(reports, "bucketed_reports", str(tmp_path / "r"), "exec_id", 4)
        joined = trades.reports_with_fills(
            spark.table("bucketed_reports"), spark.table("bucketed_fills"), spread_by=None
        )
        assert "Exchange" not in plan(joined)
        assert joined.filter("side IS NOT NULL").count() == 2300
        assert 4 <= len(list((tmp_path / "f").glob("*.parquet"))) <= 16
        hot = spark.range(4000).selectExpr("CAST(NULL AS string) AS exec_id", "id AS report_id")
        topics.save_bucketed(hot, "bucketed_hot", str(tmp_path / "h"), "exec_id", 4)
        assert len(list((tmp_path / "h").glob("*.parquet"))) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def small_skew_limits(spark):
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _skewed(spark, null=False):
    hot = F.lit(None).cast("long") if null else F.lit(7).cast("long")
    return spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, hot).otherwise(F.col("id") % 5000).alias("order_id"),
        F.xxhash64("id").alias("payload"),
        F.col("id").alias("event_id"),
    )


def test_a_hot_order_is_split(spark, small_skew_limits):
    orders = spark.range(5000).selectExpr("id AS order_id", "id * 3 AS account")
    joined = trades.fills_with_orders(_skewed(spark), orders)
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 60_000


def test_rows_without_a_key_are_spread(spark, small_skew_limits):
    events = _skewed(spark, null=True).withColumnRenamed("order_id", "exec_id")
    fills = spark.range(5000).selectExpr("id AS exec_id", "id * 3 AS lots")
    joined = trades.clearing_with_fills(events, fills)
    assert joined.count() == 60_000
    assert joined.filter("lots IS NOT NULL").count() == 40_000
    assert joined.columns == ["exec_id", "payload", "event_id", "lots"]
    shuffled = events.withColumn(
        "p", F.when(F.col("exec_id").isNull(), F.pmod(F.xxhash64("event_id"), F.lit(joins.NULL_SPREAD)))
    )
    assert shuffled.filter("exec_id IS NULL").select("p").distinct().count() > 900
