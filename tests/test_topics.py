import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.operators import records
from tapeline.sources import contracts, topics


def _envelopes(spark, topic, payloads):
    rows = [
        (topic, key, value if isinstance(value, str) else json.dumps(value), (i % 3, i, datetime(2026, 7, 22)))
        for i, (key, value) in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, topics.ENVELOPE)


REFERENCE = [
    ("FDAX", {"contract_series": "FDAX", "product_type": "FUTURE", "underlying": "IDX",
              "contract_multiplier": 40, "expiry_date": "2027-01-15"}),
    ("FDAX", {"contract_series": "FDAX", "product_type": "FUTURE", "underlying": "IDX",
              "contract_multiplier": 40, "expiry_date": "2027-01-15", "version": 2}),
    ("BAD", {"contract_series": "BAD", "product_type": "SWAP", "underlying": None,
             "contract_multiplier": "many", "expiry_date": "soon"}),
    ("JUNK", "not json"),
]


def test_decode_ignores_unknown_fields_and_survives_bad_ones(spark):
    decoded = topics.decode_topic(
        _envelopes(spark, "refdata.contracts", REFERENCE), contracts.CONTRACTS_REF
    )
    assert decoded.columns == ["_key", "_meta", *contracts.CONTRACTS_REF.schema.names]
    rows = {(r._key, r._meta.offset): r for r in decoded.collect()}
    assert rows["FDAX", 1].contract_multiplier == Decimal("40.00")
    assert rows["FDAX", 1].expiry_date == date(2027, 1, 15)
    bad = rows["BAD", 2]
    assert (bad.product_type, bad.contract_multiplier, bad.expiry_date) == ("SWAP", None, None)
    assert rows["JUNK", 3].contract_series is None


def test_decode_reads_payload_numbers_and_times(spark):
    fill = {"exec_id": "EXE1", "order_id": "O", "contract_series": "S", "side": "BUY", "quantity": 7,
            "price": 101.5, "executing_member": "M", "exec_time": "2026-07-20T08:30:00"}
    row = topics.decode_topic(_envelopes(spark, "t", [("EXE1", fill)]), contracts.EXECUTIONS).first()
    assert (row.quantity, row.price, row.exec_time) == (Decimal(7), Decimal("101.50"), datetime(2026, 7, 20, 8, 30))


def test_conformance_report_counts_each_kind_of_defect(spark):
    contract = contracts.CONTRACTS_REF
    raw = topics.decode_json(
        _envelopes(spark, "refdata.contracts", REFERENCE), contracts.text_schema(contract.schema)
    )
    report = {r.column_name: tuple(r)[1:] for r in
              records.conformance_report(raw, contract.schema, contract.enums).collect()}
    assert report["product_type"] == (4, 1, 0, 1)
    assert report["contract_multiplier"] == (4, 1, 1, 0)
    assert report["expiry_date"] == (4, 1, 1, 0)
    assert report["underlying"] == (4, 2, 0, 0)
    assert len(report) == len(contract.schema)


def test_conform_adds_missing_and_encodes_many_typed_fields(spark):
    df = spark.sql("SELECT 1 AS a, array(1, 2) AS b, named_struct('x', 1) AS c, 'z' AS extra")
    want = T.StructType.fromDDL("a string, b string, c string, d decimal(5,2)")
    assert records.conform_topic(df, want).first().asDict() == {
        "a": "1", "b": "[1,2]", "c": '{"x":1}', "d": None,
    }
    text = records.many_types_to_string(df, ["a", "c"])
    assert text.first()[:3] == ("1", [1, 2], '{"x":1}')
    variant = spark.sql("""SELECT parse_json('{"a": 1}') AS v""")
    assert records.many_types_to_string(variant, ["v"]).first().v == '{"a":1}'


def test_flatten_names_paths_and_resolves_collisions(spark):
    df = spark.sql("""SELECT 'k' AS _key, 1 AS `class`, named_struct('initial', 2.5D, 'ccy', 'EUR',
        'deep', named_struct('x-y', 3)) AS margin, array(1) AS tags""")
    flat = records.flatten(df, keep=["_key"])
    assert flat.columns == ["_key", "class", "margin_initial", "margin_ccy", "margin_deep_x_y", "tags"]
    assert flat.schema["margin_deep_x_y"].metadata == {"path": "margin.deep.x-y"}
    assert flat.first()[1:5] == (1, 2.5, "EUR", 3)
    assert records.flatten(df.select("_key")).columns == ["_key"]
    twice = records.flatten(df.withColumn("margin_ccy", F.lit(1)))
    assert [c for c in twice.columns if c.startswith("margin_ccy")] == ["margin_ccy", "margin_ccy_2"]
    assert twice.schema["margin_ccy_2"].metadata == {"path": "margin_ccy"}


def test_collections_as_json(spark):
    df = spark.sql("SELECT array('a', NULL) AS l, map('k', 1) AS m, 5 AS n")
    assert tuple(records.encode_collections(df).first()) == ('["a",null]', '{"k":1}', 5)


def test_drift_shows_unknown_and_unsent_fields(spark):
    envelopes = _envelopes(spark, "refdata.contracts", REFERENCE)
    few = envelopes.filter("_key = 'FDAX'")
    rows = {r.field: (r.n_records, r.declared) for r in
            topics.field_drift(few, contracts.CONTRACTS_REF).collect()}
    assert rows["version"] == (1, False) and rows["underlying"] == (2, True)
    fills = {r.field: (r.n_records, r.declared) for r in
             topics.field_drift(envelopes, contracts.EXECUTIONS).collect()}
    assert fills["side"] == (0, True) and fills["underlying"] == (3, False)


def test_envelope_round_trip_keeps_nulls_and_microseconds(spark):
    df = spark.createDataFrame(
        [("M1", "A1", None, datetime(2026, 7, 20, 1, 2, 3, 456789))],
        "member string, account string, series string, t timestamp_ntz",
    )
    row = records.to_topic(df, "x", ["member", "account", "series"]).first()
    assert row._key == "M1|A1|" and row._meta is None
    assert json.loads(row.value) == {
        "member": "M1", "account": "A1", "series": None, "t": "2026-07-20T01:02:03.456789",
    }


def test_log_is_partitioned_by_topic_and_reads_prune(spark, tmp_path):
    log = _envelopes(spark, "refdata.contracts", REFERENCE).unionByName(
        _envelopes(spark, "other", [("k", {"a": 1})])
    )
    path = str(tmp_path / "log")
    topics.write_log(log, path)
    one = topics.read_topic(spark, path, "other")
    assert one.count() == 1 and one.columns == log.columns
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan
    parts = topics.split_topics(topics.read_log(spark, path), ["refdata.contracts", "other"])
    assert {t: d.count() for t, d in parts.items()} == {"refdata.contracts": 4, "other": 1}


def test_json_lines_log(spark, tmp_path):
    log = _envelopes(spark, "t", [("k", {"a": 1})])
    log.write.json(str(tmp_path / "j"))
    assert topics.read_log(spark, str(tmp_path / "j"), "json").first() == log.first()


def test_kafka_rows_become_envelopes_and_back(spark):
    rows = spark.createDataFrame(
        [(bytearray(b"k"), bytearray(b'{"a":1}'), "t", 2, 17, datetime(2026, 7, 20), 0)],
        "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
        "timestampType int",
    )
    envelope = topics.from_kafka_rows(rows)
    assert envelope.schema.simpleString() == spark.createDataFrame([], topics.ENVELOPE).schema.simpleString()
    row = envelope.first()
    assert (row._key, row.value, row._meta.partition, row._meta.offset) == ("k", '{"a":1}', 2, 17)
    assert bytes(topics.to_kafka_rows(envelope).first().value) == b'{"a":1}'
    assert topics.kafka_options("h:1", ["a", "b"], startingOffsets="earliest") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "earliest",
    }


def test_topics_answer_sql_under_their_own_names(spark):
    positions = [
        ("M1|A1|FDAX", {"position_key": "M1|A1|FDAX", "clearing_member_id": "M1", "account": "A1",
                        "contract_series": "FDAX", "net_quantity": q, "as_of_time": f"2026-07-20T0{i}:00:00"})
        for i, q in enumerate([10, -15])
    ]
    topics.register_topics(topics.open_topics(_envelopes(spark, "etd.positions", positions)))
    current = spark.sql("""
        SELECT sum(abs(net_quantity)) AS total FROM (
            SELECT *, row_number() OVER (PARTITION BY _key ORDER BY _meta.offset DESC) AS n
            FROM `etd.positions`) WHERE n = 1""")
    assert current.first().total == Decimal("15.00")
    assert spark.sql("SELECT count(*) AS n FROM `emir.trade-reports`").first().n == 0


def test_registered_schemas_map_to_spark_types():
    value = {
        "type": "record", "name": "R",
        "fields": [
            {"name": "id", "type": "string"},
            {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["A", "B"]}},
            {"name": "amount", "type": ["null", {"type": "bytes", "logicalType": "decimal",
                                                 "precision": 18, "scale": 2}]},
            {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
            {"name": "day", "type": {"type": "int", "logicalType": "date"}},
            {"name": "tod", "type": {"type": "int", "logicalType": "time-millis"}},
            {"name": "any", "type": ["null", "string", "long"]},
            {"name": "tags", "type": {"type": "array", "items": "int"}},
            {"name": "attrs", "type": {"type": "map", "values": "double"}},
            {"name": "raw", "type": {"type": "fixed", "name": "F", "size": 4}},
            {"name": "odd", "type": "no-such-type"},
            {"name": "margin", "type": {"type": "record", "name": "M", "fields": [
                {"name": "initial", "type": ["null", "double"]}, {"name": "ok", "type": "boolean"}]}},
        ],
    }
    contract = contracts.registered_contract("t", value)
    assert contract.key == ("id",) and contract.enums == {"kind": ("A", "B")}
    assert contract.schema.simpleString() == (
        "struct<id:string,kind:string,amount:decimal(18,2),at:timestamp_ntz,day:date,tod:string,"
        "any:string,tags:array<int>,attrs:map<string,double>,raw:binary,odd:string,"
        "margin:struct<initial:double,ok:boolean>>"
    )
    assert contract.schema["amount"].nullable and not contract.schema["id"].nullable
    key = {"type": "record", "name": "K", "fields": [{"name": "a", "type": "string"}]}
    assert contracts.registered_contract("t", value, key).key == ("a",)
    assert contracts.registered_contract("t", value, None, ("x", "y")).key == ("x", "y")


def test_declared_topics():
    assert {t for t, c in contracts.CONTRACTS.items() if c.compacted} == {"etd.positions", "refdata.contracts"}
    for contract in contracts.CONTRACTS.values():
        assert set(contract.key) <= set(contract.schema.names)
        assert set(contract.enums) <= set(contract.schema.names)


def test_a_rerun_replaces_what_it_wrote(spark, tmp_path):
    log = topics.RunLog(spark, f"{tmp_path}/log")
    part = lambda *keys: spark.createDataFrame(
        [("t" if k < "m" else "u", k, "{}", None) for k in keys], topics.ENVELOPE)
    keys = lambda: sorted(r["_key"] for r in log.read().collect())
    assert log.read().count() == 0 and log.read().columns == ["topic", "_key", "value", "_meta"]
    log.write(part("a", "b", "z"), "monday")
    log.write(part("c"), "tuesday")
    open_reader = log.read()
    log.write(part("a", "y"), "monday")
    assert keys() == ["a", "c", "y"]
    # A reader that was open before still sees what it opened.
    assert sorted(r["_key"] for r in open_reader.collect()) == ["a", "b", "c", "z"]
    # What a lost run left without a commit is not read.
    part("x").write.partitionBy("topic").parquet(f"{tmp_path}/log/data-lost")
    assert keys() == ["a", "c", "y"]
    assert len(log.folders()) == 2


def test_runs_take_the_records_as_stored(spark, monkeypatch):
    """Neither the run nor its repetition derives and encodes the records anew."""
    from tapeline.plans.registry import QUERIES

    seen, write = [], topics.RunLog.write

    def noted(log, envelopes, run):
        seen.append((run, envelopes._jdf.queryExecution().optimizedPlan().toString()))
        write(log, envelopes, run)

    monkeypatch.setattr(topics.RunLog, "write", noted)
    rows = {r["topic"]: r["n_records"] for r in QUERIES["rewritten_log"](spark, SF_SMALL).collect()}
    assert [run for run, _ in seen] == ["daily", "reference", "daily"]
    assert all("Window" not in text and "to_json" not in text for _, text in seen)
    assert rows == {r["topic"]: r["n_records"] for r in QUERIES["topic_counts"](spark, SF_SMALL).collect()}


def rows_scanned(df) -> int:
    """Rows that the scan handed on, after running ``df``."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.sha1(F.col("id").cast("string")).alias("uti"), F.col("id").alias("n"))
    path = f"{tmp_path}/lookup"
    topics.save_for_lookup(rows, path, "uti", most_keys=5_000, group_bytes=1 << 18)
    key = rows.filter("n = 777").first()["uti"]
    one = topics.lookup(spark, path, "uti", [key])
    assert [r["n"] for r in one.collect()] == [777]
    assert rows_scanned(one) < 20_000
    # A key that is nowhere, though inside the limits of some group.
    assert rows_scanned(topics.lookup(spark, path, "uti", [key[:-1] + "x"])) < 20_000


def test_bloom_filters_skip_groups_of_wide_limits(spark, tmp_path):
    """In an unsorted store the limits of every group span the key; the filters still tell."""
    rows = spark.range(100_000).select(
        F.sha1(F.col("id").cast("string")).alias("uti"), F.col("id").alias("n")).coalesce(1)
    key = rows.filter("n = 777").first()["uti"]
    scanned = {}
    for bloom in ("true", "false"):
        path = f"{tmp_path}/{bloom}"
        (rows.write.option("parquet.bloom.filter.enabled#uti", bloom)
         .option("parquet.bloom.filter.expected.ndv#uti", "5000")
         .option("parquet.enable.dictionary", "false").option("parquet.block.size", str(1 << 18)).parquet(path))
        scanned[bloom] = rows_scanned(topics.lookup(spark, path, "uti", [key]))
    assert scanned["true"] < 0.3 * scanned["false"]
