"""The five topics, derived from the given tables by projection.

``events`` becomes fills, positions, reports and clearing events; ``part`` becomes
reference data; ``lineitem`` and ``orders`` are fills and orders with a real fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.fields import composite_key
from tapeline.operators.records import assign_offsets, to_topic
from tapeline.operators.state import running_positions

# Percent of BUY per member number, least biased in the middle.
BUY_PERCENT = (80, 72, 25, 50, 22)


# Columns of the given tables. Declared, so that no file is opened to
# infer them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _member(number: Column) -> Column:
    return F.concat(F.lit("M"), (number % 5).cast("string"))


def _id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def props_number() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def fills_from(events: DataFrame) -> DataFrame:
    """One fill per event. ``offset`` is the send number."""
    member, number = F.col("user_id") % 5, F.col("event_id")
    buys = F.element_at(F.array(*[F.lit(p) for p in BUY_PERCENT]), (member + 1).cast("int"))
    return events.select(
        number.alias("offset"),
        _id("EXE", number).alias("exec_id"),
        _id("ORD", F.shiftright(number, 2)).alias("order_id"),
        F.col("event_type").alias("contract_series"),
        F.when((number * 7919) % 100 < buys, "BUY").otherwise("SELL").alias("side"),
        (props_number() + 1).alias("quantity"),
        F.col("value").cast("decimal(18,2)").alias("price"),
        _member(F.col("user_id")).alias("executing_member"),
        _member(F.col("user_id")).alias("clearing_member_id"),
        F.when(F.col("user_id") % 2 == 0, "A1").otherwise("P1").alias("account"),
        F.col("ts").alias("exec_time"),
        F.col("user_id"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills_from(table(spark, sf_dir, "events"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position log of the fills, one snapshot per fill."""
    needed = fills(spark, sf_dir).select(
        "offset", "clearing_member_id", "account", "contract_series", "side", "quantity",
        "exec_time", "user_id",
    )
    return running_positions(needed).select(
        "offset",
        composite_key("clearing_member_id", "account", "contract_series").alias("position_key"),
        "clearing_member_id",
        "account",
        "contract_series",
        "net_quantity",
        (F.col("exec_time") + F.expr("INTERVAL 60 SECONDS")).alias("as_of_time"),
        "user_id",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mirrored reports per fill, and two more an hour later for some.

    Each fill is exploded to small row numbers and the columns are computed from
    those: one scan, and columns nobody asks for are pruned.
    """
    kind = F.col("sent") % 20
    later = F.when(kind == 0, "EROR").when(kind == 1, "TERM").when(kind == 2, "MODI")
    numbers = F.when(kind < 3, F.sequence(F.lit(0), F.lit(3))).otherwise(
        F.sequence(F.lit(0), F.lit(1))
    )
    rows = fills(spark, sf_dir).withColumnRenamed("offset", "sent").withColumn(
        "i", F.explode(numbers)
    )
    first_action, first_side = F.col("i") < 2, F.col("i") % 2 == 0
    action = F.when(first_action, "NEWT").otherwise(later)
    lei = F.concat(F.lit("LEI-"), F.col("clearing_member_id"))
    client = _id("CLIENT", F.col("user_id") % 8)
    wait = F.when(first_action, F.expr("INTERVAL 5 MINUTES")).otherwise(
        F.expr("INTERVAL 65 MINUTES")
    )
    currencies = F.array(F.lit("EUR"), F.lit("USD"), F.lit("GBP"))
    return rows.select(
        (F.col("sent") * 4 + F.col("i")).alias("offset"),
        F.concat(_id("RPT", F.col("sent")), F.lit("-"), F.col("i").cast("string")).alias("report_id"),
        _id("UTI", F.col("sent")).alias("uti"),
        F.when(first_side, lei).otherwise(client).alias("counterparty_1"),
        F.when(first_side, client).otherwise(lei).alias("counterparty_2"),
        "exec_id",
        action.alias("action_type"),
        F.when(action != "EROR", (F.col("price") * F.col("quantity")).cast("decimal(18,2)"))
        .alias("notional"),
        F.element_at(currencies, (F.col("user_id") % 3 + 1).cast("int")).alias("notional_currency"),
        (F.col("exec_time") + wait).alias("reporting_timestamp"),
    )


def clearing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A novation per fill, and a give-up with its take-up by the next member."""
    rows = fills(spark, sf_dir).withColumnRenamed("offset", "sent").withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(2)))
    )
    number, i, user = F.col("sent"), F.col("i"), F.col("user_id")
    transfer = _id("GUP", number)
    event_id = (
        F.when(i == 0, _id("CLR", number))
        .when(i == 1, F.concat(transfer, F.lit("G")))
        .otherwise(F.concat(transfer, F.lit("T")))
    )
    return rows.select(
        (number * 3 + i).alias("offset"),
        event_id.alias("event_id"),
        F.when(i == 0, "NOVATION").when(i == 1, "GIVE_UP").otherwise("TAKE_UP").alias("event_type"),
        F.when(i == 2, _id("EXE", number + 1)).otherwise(F.col("exec_id")).alias("exec_id"),
        _member(F.when(i == 2, user + 1).otherwise(user)).alias("clearing_member_id"),
        "account",
        (F.col("exec_time") + F.expr("INTERVAL 30 SECONDS")).alias("event_time"),
    )


def refdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract reference data in two versions; the first has a wrong multiplier."""
    rows = table(spark, sf_dir, "part").withColumn(
        "version", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    )
    size = F.col("p_size").cast("long")
    return rows.select(
        _id("P", F.col("p_partkey")).alias("contract_series"),
        F.when(size % 2 == 0, "FUTURE").otherwise("OPTION").alias("product_type"),
        F.col("p_brand").alias("underlying"),
        F.when(F.col("version") == 1, size + 1).otherwise(size).alias("contract_multiplier"),
        F.lit("2026-09-18").cast("date").alias("expiry_date"),
        "version",
    )


def line_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        _id("P", F.col("l_partkey")).alias("contract_series"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_shipdate").alias("exec_time"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").alias("submitted_at"),
    )


def position_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position snapshots with partition and offset as a log would number them.

    The partition is a function of the key alone.
    """
    snapshots = positions(spark, sf_dir).withColumnRenamed("offset", "sent")
    by_key = F.col("user_id") % 10 % 3
    return assign_offsets(snapshots, "position_key", "sent", partition=by_key)


def topic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five topics as one log of envelopes."""
    meta = F.struct(
        F.lit(0).alias("partition"),
        F.col("offset").alias("offset"),
        F.col("sent_at").alias("timestamp"),
    )

    def sent(df: DataFrame, time: str, *drop: str) -> DataFrame:
        stamped = df.withColumn("sent_at", F.col(time).cast("timestamp_ntz"))
        return stamped.withColumn("_meta", meta).drop("offset", "sent_at", *drop)

    executions = sent(fills(spark, sf_dir), "exec_time", "user_id", "clearing_member_id", "account")
    clearing = sent(clearing_events(spark, sf_dir), "event_time")
    snapshots = position_log(spark, sf_dir).withColumn(
        "_meta",
        F.struct("partition", "offset", F.col("as_of_time").cast("timestamp_ntz").alias("timestamp")),
    ).drop("partition", "offset", "sent", "user_id")
    reported = sent(reports(spark, sf_dir), "reporting_timestamp")
    reference = refdata(spark, sf_dir).withColumn("offset", F.col("version"))
    return (
        to_topic(executions, "etd.executions", ["exec_id"], "_meta")
        .unionByName(to_topic(clearing, "etd.clearing-events", ["event_id"], "_meta"))
        .unionByName(to_topic(snapshots, "etd.positions", ["position_key"], "_meta"))
        .unionByName(to_topic(reported, "emir.trade-reports", ["report_id"], "_meta"))
        .unionByName(
            to_topic(
                sent(reference, "expiry_date"), "refdata.contracts", ["contract_series"], "_meta"
            )
        )
    )
