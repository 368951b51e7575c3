from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from trades_fixture import as_dict

from tapeline.operators import state, trades
from tapeline.plans.registry import QUERIES
from tapeline.plans.shared import fresh_path, shared_base
from tapeline.sources import tables
from tapeline.streaming import continuous
from tapeline.streaming import tables as sinks

from paths import SF_SMALL


@pytest.fixture(scope="module")
def slices(spark, tmp_path_factory):
    """The events in five files, so that a stream sees five batches."""
    path = str(tmp_path_factory.mktemp("slices") / "events")
    tables.table(spark, SF_SMALL, "events").repartitionByRange(5, "event_id").write.parquet(path)
    return path


@pytest.fixture
def fill_stream(spark, slices):
    schema = spark.read.parquet(slices).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(slices)
    return tables.fills_from(stream)


def _nets(df):
    return {tuple(r[k] for k in state.POSITION_KEY): r.net_quantity for r in df.collect()}


def test_net_positions_equal_the_batch_form(spark, fill_stream):
    log = sinks.changelog_table(spark, continuous.net_positions_stream(fill_stream), "net")
    assert log.select("batch_id").distinct().count() == 5
    current = state.latest_per_key(log, list(state.POSITION_KEY), ["batch_id"])
    assert _nets(current) == _nets(state.net_from_fills(tables.fills(spark, SF_SMALL)))


def test_latest_equals_the_batch_form(spark, fill_stream):
    keys = ["executing_member"]
    stream = continuous.latest_stream(fill_stream, keys, ["exec_id", "side"])
    got = sinks.current_table(spark, stream, keys, "latest")
    want = state.latest_per_key(
        tables.fills(spark, SF_SMALL).select(*keys, "offset", "exec_id", "side"), keys
    )
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_days_equal_the_batch_form(spark, fill_stream):
    got = sinks.complete_table(spark, continuous.fills_by_date_stream(fill_stream), "days")
    want = trades.fills_by_date(tables.fills(spark, SF_SMALL))
    assert as_dict(got, "trade_date", "n_fills") == as_dict(want, "trade_date", "n_fills")


@pytest.mark.parametrize("spread_by", [None, "copy"])
def test_records_sent_again_are_dropped(spark, tmp_path, spread_by):
    start = datetime(2026, 7, 20)
    schema = "id string, t timestamp, copy bigint"
    for batch in range(3):
        rows = [(f"r{i}", start + timedelta(minutes=i), batch * 1000 + i) for i in range(20)]
        rows += [("hot", start, batch * 1000 + 100 + i) for i in range(200)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = continuous.dedup_stream(stream, ["id"], "t", "1 day", spread_by)
    rows = sinks.append_table(spark, once, "dedup").collect()
    assert sorted(r.id for r in rows) == sorted([f"r{i}" for i in range(20)] + ["hot"])


@pytest.mark.parametrize("merge_every", [1, 2, 16])
def test_state_table_follows_and_survives_a_repeated_batch(spark, merge_every):
    table = sinks.StateTable(spark, fresh_path(spark, "test-state"), "k string, offset bigint, v string",
                             ["k"], merge_every=merge_every)
    table.create()
    assert table.read().count() == 0

    def batch(*rows):
        return spark.createDataFrame(rows, "k string, offset bigint, v string")

    def held():
        return {r.k: r.v for r in table.read().collect()}

    table.upsert(batch(("a", 1, "a1"), ("a", 2, "a2"), ("b", 5, "b5")), 0)
    assert held() == {"a": "a2", "b": "b5"}
    second = batch(("b", 4, "b4"), ("c", 1, "c1"))  # an older record does not win
    table.upsert(second, 1)
    table.upsert(second, 1)
    assert held() == {"a": "a2", "b": "b5", "c": "c1"}
    # A batch that died before its commit is not visible and can run again.
    batch(("zzz", 9, "half")).write.parquet(f"{table.base}/batches/2-died")
    assert "zzz" not in held()
    table.upsert(batch(("a", 3, "a3")), 2)
    assert held() == {"a": "a3", "b": "b5", "c": "c1"}


def test_state_table_of_a_stream(spark, fill_stream):
    base = fresh_path(spark, "test-follow")
    schema = "clearing_member_id string, account string, contract_series string, exec_id string, offset bigint"
    table = sinks.StateTable(spark, f"{base}/t", schema, list(state.POSITION_KEY), merge_every=3)
    table.create()
    table.follow(fill_stream.select(*state.POSITION_KEY, "exec_id", "offset"), f"{base}/c")
    want = state.latest_per_key(
        tables.fills(spark, SF_SMALL).select(*state.POSITION_KEY, "exec_id", "offset"),
        list(state.POSITION_KEY),
    )
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    # Batches 0 to 4 in a cycle of three: a full version at 2, deltas at 3 and 4.
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in table._visible(None)] == ["2", "3", "4"]


def test_readers_survive_repeated_batches_and_commits_stay_few(spark, tmp_path):
    table = sinks.StateTable(spark, str(tmp_path / "t"), "k string, offset bigint, v string", ["k"],
                             merge_every=2, drop_deleted="v")
    table.create()
    rows = lambda *r: spark.createDataFrame(r, "k string, offset bigint, v string")
    table.upsert(rows(("a", 1, "a1"), ("b", 1, "b1")), 0)
    reading = table.read()
    for _ in range(2):
        table.upsert(rows(("a", 1, "a1"), ("b", 1, "b1")), 0)
    assert sorted(r.v for r in reading.collect()) == ["a1", "b1"]
    # A deletion marker outlives a merge: an older record does not bring the key back.
    table.upsert(rows(("b", 5, None)), 1)
    table.upsert(rows(("b", 4, "late")), 2)
    assert [r.k for r in table.read().collect()] == ["a"]
    for batch in range(3, 12):
        table.upsert(rows(("c", batch, f"c{batch}")), batch)
    assert sorted(r.v for r in table.read().collect()) == ["a1", "c11"]
    assert len(list((tmp_path / "t/commits").glob("period=*"))) <= 2


def test_deletion_markers_in_a_folded_stream(spark, tmp_path):
    schema = "k string, offset bigint, v bigint"
    for rows in ([("a", 1, 1), ("b", 2, 2)], [("b", 3, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest = continuous.latest_stream(stream, ["k"], ["v"])
    kept = sinks.current_table(spark, latest, ["k"], "marked", drop_deleted="v")
    assert [tuple(r) for r in kept.select("k", "v").collect()] == [("a", 1)]


STREAMS = ("stream_latest", "stream_net_positions", "stream_fills_by_date", "stream_dedup",
           "stream_state_table")


@pytest.fixture(scope="module")
def one_file(spark):
    return {name: sorted(map(repr, QUERIES[name](spark, SF_SMALL).collect())) for name in STREAMS}


@pytest.mark.parametrize("name", STREAMS)
def test_a_table_of_several_files_newest_day_first(spark, tmp_path, one_file, name):
    events = tables.table(spark, SF_SMALL, "events")
    for day in range(4, -1, -1):
        events.filter(F.pmod(F.dayofmonth("ts"), F.lit(5)) == day).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(repr, QUERIES[name](spark, str(tmp_path)).collect())) == one_file[name]


def test_no_record_is_late_for_deduplication(spark, tmp_path):
    """1,000 fills in five batches, newest day first."""
    path = str(tmp_path / "events")
    days = tables.table(spark, SF_SMALL, "events").withColumn("d", F.ntile(5).over(W.orderBy("ts")))
    schema = tables.table(spark, SF_SMALL, "events").schema
    for d in range(5, 0, -1):
        days.filter(F.col("d") == d).drop("d").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    fills = tables.fills_from(stream).select("exec_id", "exec_time", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    for spread_by in (None, "copy"):
        once = continuous.dedup_stream(fills, ["exec_id"], spread_by=spread_by)
        assert sinks.append_table(spark, once, "late").select("exec_id").distinct().count() == 1000


@pytest.mark.parametrize("name", STREAMS)
def test_streams_without_input(spark, tmp_path, name):
    tables.table(spark, SF_SMALL, "events").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_base(spark) == named.rstrip("/")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_state_is_spread_over_its_partitions(spark, tmp_path):
    """All keys of a stopped stream, and no state partition with far more than its share."""
    from tapeline.streaming import state

    spark.range(4000).select((F.col("id") % 1000).alias("k"), F.lit(1).alias("v")).write.parquet(
        f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, v int").parquet(f"{tmp_path}/in")
    counts = stream.groupBy("k").agg(F.sum("v").alias("n"))
    sinks.run_available(counts, lambda batch, _: batch.write.format("noop").mode("overwrite").save(),
                        "update", f"{tmp_path}/checkpoint")
    rows = state.state_rows(spark, f"{tmp_path}/checkpoint").collect()
    assert sorted((r["k"], r["sum"]) for r in rows) == [(k, 4) for k in range(1000)]
    spread = [r["n_keys"] for r in state.state_spread(spark, f"{tmp_path}/checkpoint").collect()]
    assert sum(spread) == 1000 and max(spread) < 2 * sum(spread) / len(spread)
