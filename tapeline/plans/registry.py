"""Named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.fields import key_part
from tapeline.functions.texts import numbers_in
from tapeline.operators import (
    audits, positions, questions, records, scoring, sketches, state, trades,
)
from tapeline.plans import prefix
from tapeline.plans.shared import fresh_path
from tapeline.sources import tables, topics
from tapeline.sources.contracts import CONTRACTS_REF, EXECUTIONS, POSITIONS, text_schema
from tapeline.streaming import continuous, state as stream_state, tables as sinks

Query = Callable[[SparkSession, str], DataFrame]

# The "now" of the queries that ask about this week.
AS_OF = datetime(2024, 1, 20, 12, 0)
TRADE_DATE = "2024-01-15"
SERIES = "purchase"
POSITION_KEY = list(state.POSITION_KEY)

DOCUMENT_RULES = {
    "en": scoring.TextRule(good=(r"the (and|with)", r"with the"), bad=(r"http", r"copyright")),
    "de": scoring.TextRule(good=(r"der ", r"die "), trap=r"http", trap_unless=r"und "),
    "fr": scoring.SenseRule(right=("le ", "ou"), wrong=("http", "license")),
    "es": scoring.SenseRule(right=("el ",), wrong=("los ", "@")),
}
CANDIDATES = ("latest", "history_sum", "history_abs_sum")
# Kinds of answers: right, known wrong, both, neither, without rows, not executed.
ANSWERS = ("right", "wrong", "both", "none", "bare", "silent")
QUERY_TEXTS = (
    "SELECT COUNT(*) FROM f",
    "SELECT count( DISTINCT  order_id ) FROM f",
    "SELECT COUNT(order_id), COUNT(DISTINCT uti) FROM r",
    "SELECT uti FROM r WHERE action NOT IN ('EROR', 'TERM')",
    "SELECT SUM(ABS(net_quantity)) FROM p",
    "SELECT SUM(net_quantity) FROM p WHERE _meta.offset = 3",
    "SELECT counterparty_1 FROM `emir.trade-reports`",
    "SELECT clearing_member_id FROM `etd.clearing-events` JOIN `emir.trade-reports` ON counterparty_1 = 1",
    "SELECT m FROM p WHERE net_quantity < 0 AND side = 'SELL'",
    "SELECT m FROM f WHERE side = 'SELL' AND _meta.timestamp > 1",
    "SELECT 1 FROM f WHERE exec_time > 1 -- COUNT(*)",
    "SELECT clearing_member_id, row_number() OVER w FROM p",
    None,
)


def _fills(q) -> Query:
    return lambda spark, sf: q(tables.fills(spark, sf))


def _reports(q) -> Query:
    return lambda spark, sf: q(tables.reports(spark, sf))


def _positions(q) -> Query:
    return lambda spark, sf: q(tables.positions(spark, sf))


def _lines(q) -> Query:
    return lambda spark, sf: q(tables.line_fills(spark, sf))


def _stored_log(spark, sf) -> str:
    """Where all topics lie as a log."""
    path = fresh_path(spark, "log")
    topics.write_log(tables.topic_log(spark, sf), path)
    return path


# --- records ----------------------------------------------------------------------

def topic_snapshot(spark, sf):
    """The position topic as read from a stored log, decoded, with its metadata."""
    stored = topics.read_topic(spark, _stored_log(spark, sf), POSITIONS.topic)
    decoded = topics.decode_topic(stored, POSITIONS)
    return decoded.select(
        "_key",
        F.col("_meta.partition").cast("long").alias("log_partition"),
        F.col("_meta.offset").alias("log_offset"),
        F.col("net_quantity").cast("long").alias("net_quantity"),
        "as_of_time",
    )


def decode_json_props(spark, sf):
    parsed = F.from_json("props", "k int").getField("k").cast("long")
    return tables.table(spark, sf, "events").select("event_id", parsed.alias("k"))


def _raw_fills(spark, sf) -> DataFrame:
    """Events as untyped payload fields, some of them broken or unknown."""
    number = F.col("event_id")
    return tables.table(spark, sf, "events").select(
        number.cast("string").alias("exec_id"),
        F.when(number % 70 == 0, "other").otherwise(F.col("event_type")).alias("series"),
        F.when(number % 50 == 0, "bad").otherwise(F.col("value").cast("string")).alias("price"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("exec_time"),
        F.col("props").alias("unregistered"),
    )


_RAW_SCHEMA = "exec_id bigint, series string, price decimal(18,2), exec_time timestamp_ntz, venue string"


def conform_fills(spark, sf):
    raw = _raw_fills(spark, sf)
    schema = spark.createDataFrame([], _RAW_SCHEMA).schema
    return records.conform_topic(raw, schema)


def conformance(spark, sf):
    raw = _raw_fills(spark, sf)
    schema = spark.createDataFrame([], _RAW_SCHEMA).schema
    enums = {"series": ("view", "click", "purchase", "signup", "error")}
    return records.conformance_report(raw, schema, enums)


def flatten_nested(spark, sf):
    nested = tables.table(spark, sf, "events").select(
        "event_id",
        F.struct(
            F.col("event_type").alias("type"),
            F.struct("value", tables.props_number().alias("k")).alias("measure"),
        ).alias("body"),
    )
    return records.flatten(nested)


def encode_collections(spark, sf):
    """Array and map columns derived row by row from the pages."""
    pages = tables.table(spark, sf, "pages").select(
        "page_id",
        F.split("url", "/").alias("parts"),
        F.create_map(F.lit("size"), F.length("html")).alias("facts"),
    )
    return records.encode_collections(pages)


def topic_counts(spark, sf):
    """Each topic of the log by itself."""
    counted = [
        envelopes.agg(
            F.lit(topic).alias("topic"), F.count("*").alias("n_records"),
            F.count_distinct("_key").alias("n_keys"),
        )
        for topic, envelopes in topics.split_topics(tables.topic_log(spark, sf)).items()
    ]
    return reduce(DataFrame.unionByName, counted)


def fields_as_text(spark, sf):
    """A number, an array and a map column, as fields that arrive in several types."""
    pages = tables.table(spark, sf, "pages").select(
        "page_id",
        F.length("html").cast("long").alias("size"),
        F.split("url", "/").alias("parts"),
        F.create_map(F.lit("size"), F.length("html")).alias("facts"),
    )
    return records.many_types_to_string(pages, ["size", "parts", "facts"])


def topic_sql(spark, sf):
    """Live trades per series, asked in SQL under the topics' own names."""
    topics.register_topics(topics.open_topics(topics.read_log(spark, _stored_log(spark, sf))))
    return spark.sql("""
        WITH acts AS (
          SELECT uti, exec_id, action_type, row_number() OVER (
            PARTITION BY uti ORDER BY reporting_timestamp DESC, _meta.offset DESC) AS back
          FROM `emir.trade-reports`)
        SELECT contract_series, count(*) AS n_live
        FROM acts JOIN `etd.executions` USING (exec_id)
        WHERE back = 1 AND action_type NOT IN ('EROR', 'TERM')
        GROUP BY contract_series""")


def encode_topic(spark, sf):
    """Fills to envelopes and back."""
    source = tables.fills(spark, sf).select(*EXECUTIONS.schema.names)
    envelopes = records.to_topic(source, EXECUTIONS.topic, EXECUTIONS.key)
    back = records.conform_topic(
        topics.decode_json(envelopes, text_schema(EXECUTIONS.schema)), EXECUTIONS.schema, ["_key"]
    )
    return back.select(
        "_key", "order_id", "contract_series", "side",
        F.col("quantity").cast("long").alias("quantity"), "price", "executing_member", "exec_time",
    )


def assign_offsets(spark, sf):
    return tables.position_log(spark, sf).select(
        "position_key",
        "sent",
        F.col("partition").cast("long").alias("log_partition"),
        F.col("offset").alias("log_offset"),
    )


def written_topic(spark, sf):
    """All topics written as a partitioned log and read back."""
    return topics.read_log(spark, _stored_log(spark, sf)).groupBy("topic").agg(
        F.count("*").alias("n_records"),
        F.count_distinct("_key").alias("n_keys"),
        F.max("_meta.offset").alias("last_offset"),
    )


def uti_lookup(spark, sf):
    """The reports of some trades, from a store that skips what cannot hold them."""
    path = fresh_path(spark, "lookup")
    topics.save_for_lookup(tables.reports(spark, sf).drop("reporting_timestamp"), path, "uti")
    wanted = [f"UTI{n}" for n in (7, 20, 21, 999)]
    return topics.lookup(spark, path, "uti", wanted).withColumnRenamed("offset", "log_offset").select(
        "log_offset", "report_id", "uti", "action_type")


def rewritten_log(spark, sf):
    """A log of two runs, one of which is written again: it holds each record once.

    The runs read the topics as stored, so no run derives and encodes the records anew.
    """
    envelopes = topics.read_log(spark, _stored_log(spark, sf))
    log = topics.RunLog(spark, fresh_path(spark, "runs"))
    reference = F.col("topic") == CONTRACTS_REF.topic
    log.write(envelopes.filter(~reference), "daily")
    log.write(envelopes.filter(reference), "reference")
    log.write(envelopes.filter(~reference), "daily")
    return log.read().groupBy("topic").agg(
        F.count("*").alias("n_records"), F.count_distinct("_key").alias("n_keys"))


def field_drift(spark, sf):
    """Reference data as sent, with a field its contract does not know."""
    reference = records.to_topic(tables.refdata(spark, sf), CONTRACTS_REF.topic, CONTRACTS_REF.key)
    return topics.field_drift(reference, CONTRACTS_REF)


def split_position_key(spark, sf):
    keys = tables.positions(spark, sf).select("position_key").distinct()
    return keys.select(
        "position_key",
        key_part("position_key", 1).alias("member"),
        key_part("position_key", 2).alias("account"),
        key_part("position_key", 3).alias("series"),
    )


def _typed_props(spark, sf) -> DataFrame:
    """Events whose field ``k`` arrives as a number, a text, a list, an object, a truth value,
    nothing, or in a text that is not JSON."""
    k, number = tables.props_number(), F.col("event_id")
    text = k.cast("string")
    sent = (
        F.when(number % 7 == 0, F.col("props"))
        .when(number % 7 == 1, F.concat(F.lit('{"k":"'), text, F.lit('"}')))
        .when(number % 7 == 2, F.concat(F.lit('{"k":['), text, F.lit("]}")))
        .when(number % 7 == 3, F.concat(F.lit('{"k":{"a":'), text, F.lit("}}")))
        .when(number % 7 == 4, F.lit('{"k":true}'))
        .when(number % 7 == 5, F.lit('{"other":1}'))
        .otherwise(F.col("event_type"))
    )
    return tables.table(spark, sf, "events").select("event_id", sent.alias("sent"))


def variant_fields(spark, sf):
    """A field of several types, in the type that came and as a number where it is one."""
    sent = _typed_props(spark, sf)
    kept = records.open_variant(sent, "sent", {"k": None}, ["event_id"])
    asked = records.open_variant(sent, "sent", {"k": "bigint"}, ["event_id"])
    numbers = asked.select(F.col("event_id").alias("id"), F.col("k").alias("k_number"))
    whole = kept.select(
        "event_id", "k_kind", F.try_variant_get("k", "$", "string").alias("k_text"))
    return whole.join(numbers, F.col("event_id") == F.col("id")).select(
        "event_id", "k_kind", "k_text",
        F.when(F.col("k_kind").isin("number", "string"), F.col("k_number")).alias("k_number"))


def type_drift(spark, sf):
    """Fills of which some send their quantity as text and some lack their order."""
    number = F.regexp_extract("exec_id", "[0-9]+", 0).cast("long")
    fills = tables.fills(spark, sf).select(*EXECUTIONS.schema.names)
    sent = records.to_topic(fills, EXECUTIONS.topic, EXECUTIONS.key).withColumn(
        "exec_id", F.get_json_object("value", "$.exec_id"))
    as_text = F.regexp_replace("value", '"quantity":([0-9.]+)', '"quantity":"$1"')
    lacking = F.regexp_replace("value", '"order_id":"[^"]*",', "")
    drifted = F.when(number % 100 == 3, as_text).when(number % 100 == 4, lacking).otherwise(F.col("value"))
    return topics.type_drift(sent.withColumn("value", drifted), EXECUTIONS).drop("seen")


def observed_conformance(spark, sf):
    """The report of ``conformance_report``, collected while the rows are written."""
    raw = _raw_fills(spark, sf)
    schema = spark.createDataFrame([], _RAW_SCHEMA).schema
    enums = {"series": ("view", "click", "purchase", "signup", "error")}
    rows, report = records.observe_conformance(raw, schema, enums)
    rows.write.parquet(fresh_path(spark, "conformed"))
    return report()


# --- state ------------------------------------------------------------------------

def latest_per_key(spark, sf):
    """Last snapshot of each position with all its columns."""
    log = tables.positions(spark, sf).drop("user_id")
    return state.latest_per_key(log, POSITION_KEY).withColumnRenamed("offset", "log_offset")


def latest_action(spark, sf):
    return trades.latest_action(tables.reports(spark, sf)).withColumnRenamed("offset", "log_offset")


def running_positions(spark, sf):
    return tables.positions(spark, sf).select(
        F.col("offset").alias("log_offset"), "position_key", "net_quantity"
    )


def positions_as_of(spark, sf):
    """State when half of the log had been sent."""
    last = tables.fills(spark, sf).agg(F.max("offset")).scalar()
    return state.positions_as_of(tables.positions(spark, sf), F.shiftright(last, 1))


# --- joins ------------------------------------------------------------------------

def fills_with_orders(spark, sf):
    return trades.fills_with_orders(tables.line_fills(spark, sf), tables.orders(spark, sf))


def notional_by_underlying(spark, sf):
    """Prices with a tax of a few thousandths on them, so that cents do not hold them."""
    taxed = F.col("price") + (F.col("line") * F.lit(0.0005).cast("decimal(18,6)"))
    fills = tables.line_fills(spark, sf).withColumn("price", taxed.cast("decimal(18,6)"))
    return trades.notional_by_underlying(fills, tables.refdata(spark, sf))


def _micros(time: str) -> F.Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def multiplier_versions(spark, sf) -> DataFrame:
    """New reference data for a series now and then, valid from the instant it was sent; two
    thirds of the series have some."""
    number = F.col("offset")
    return tables.fills(spark, sf).filter((number % 97 < 2) & (F.col("contract_series") != "error")).select(
        "contract_series", _micros("exec_time").alias("valid_from"), number.alias("version"),
        F.when(number % 5 > 0, number % 7 + 1).alias("multiplier"))


def notional_as_of(spark, sf):
    """Lots by the multiplier that was valid when each fill happened."""
    fills = tables.fills(spark, sf).select(
        "contract_series", "quantity", _micros("exec_time").alias("at"))
    met = prefix.as_of(fills, multiplier_versions(spark, sf), ["contract_series"], "at", "valid_from",
                       ["multiplier", "version"], "version")
    return met.groupBy("contract_series").agg(
        F.count("*").alias("n_fills"), F.count("version").alias("n_with_version"),
        F.sum(F.col("quantity") * F.col("multiplier")).alias("lots"),
        F.sum("version").alias("sum_version"))


def reports_with_fills(spark, sf):
    fills = tables.fills(spark, sf).select("exec_id", "side", "quantity", "contract_series")
    reports = tables.reports(spark, sf).select("report_id", "uti", "exec_id", "action_type")
    return trades.reports_with_fills(reports, fills)


def clearing_with_fills(spark, sf):
    fills = tables.fills(spark, sf).select("exec_id", "side", "quantity", "contract_series")
    events = tables.clearing_events(spark, sf).select("event_id", "event_type", "exec_id")
    return trades.clearing_with_fills(events, fills)


# --- audits -----------------------------------------------------------------------

def _shuffled_time(spark, sf) -> DataFrame:
    """Fills whose business time does not follow the log order."""
    moved = F.when(F.col("offset") % 2 == 0, F.col("exec_time") - F.expr("INTERVAL 20 HOURS"))
    return tables.fills(spark, sf).withColumn(
        "business_time", F.coalesce(moved, F.col("exec_time"))
    )


def homonym_audit(spark, sf):
    """Parties against member codes (unlike), members against members (alike)."""
    parties = trades.both_sides(tables.reports(spark, sf))
    fills, log = tables.fills(spark, sf), tables.positions(spark, sf)
    unlike = audits.homonym_audit(parties, "party", fills, "clearing_member_id")
    alike = audits.homonym_audit(log, "clearing_member_id", fills, "executing_member")
    # Execution ids that hold one order id by mistake are still execution ids.
    stray = fills.select(
        F.when(F.col("offset") == 7, "ORD1").otherwise(F.col("exec_id")).alias("exec_id"))
    almost = audits.homonym_audit(fills, "order_id", stray, "exec_id")
    return (
        unlike.withColumn("pair", F.lit("party/member"))
        .unionByName(alike.withColumn("pair", F.lit("member/member")))
        .unionByName(almost.withColumn("pair", F.lit("order/execution")))
    )


def _spread_times(spark, sf) -> DataFrame:
    """Fills whose business time is up to a day before the log time."""
    lag = (F.col("offset") * 7919 % 86_399).cast("int")
    moved = F.col("exec_time") - F.make_dt_interval(secs=lag.cast("decimal(18,6)"))
    return tables.fills(spark, sf).withColumn("business_time", moved)


def lag_sketches(spark, sf):
    """Percentiles of the ingest lag from one stored sketch for each day: of all days, and of
    some; how near they are is held against one exact count."""
    fills = _spread_times(spark, sf)
    path = fresh_path(spark, "lags")
    audits_by_day = sketches.lag_sketches(fills, "business_time", "exec_time")
    audits_by_day.write.parquet(path)
    stored = spark.read.schema(audits_by_day.schema).parquet(path)
    last = F.to_date(F.lit(TRADE_DATE))
    scopes = {
        "all": (stored, fills),
        "until": (stored.filter(F.col("trade_date") <= last),
                  fills.filter(F.to_date("business_time") <= last)),
    }
    return reduce(DataFrame.unionByName, [
        sketches.rank_errors(rows, "business_time", "exec_time", sketches.lag_percentiles(states)).select(
            F.lit(scope).alias("scope"), F.col("p").cast("long").alias("p"), "n_rows",
            (F.col("rank_error") <= sketches.KLL_ERROR).alias("near"))
        for scope, (states, rows) in scopes.items()
    ])


def party_trade_sketches(spark, sf):
    """Trades of each party from one stored state for each party and day, beside the exact
    number: near if it is off by no more than the error of the states."""
    sides = trades.both_sides(tables.reports(spark, sf), "uti", "reporting_timestamp")
    day = F.to_date("reporting_timestamp").alias("day")
    states = sketches.distinct_sketches(sides, "uti", ["party", day])
    path = fresh_path(spark, "trades")
    states.write.parquet(path)
    merged = sketches.distinct_from(spark.read.schema(states.schema).parquet(path), ["party"])
    exact = trades.trades_per_party(tables.reports(spark, sf))
    off = F.abs(F.col("n_distinct") - F.col("n_trades"))
    return merged.join(exact, "party").select(
        "party", "n_rows", "n_trades",
        (off <= F.col("n_trades") * sketches.HLL_ERROR + 1).alias("near"))


def homonym_matrix(spark, sf):
    """All pairs of identifier columns of fills, reports and clearing events."""
    found = sketches.column_sketches({
        "fills": (tables.fills(spark, sf), ["exec_id", "order_id", "executing_member"]),
        "reports": (tables.reports(spark, sf), ["uti", "exec_id", "counterparty_1", "counterparty_2"]),
        "clearing": (tables.clearing_events(spark, sf), ["event_id", "exec_id", "clearing_member_id"]),
    })
    return sketches.homonym_matrix(found).select("left_column", "right_column", "unlike")


def dual_side_audit(spark, sf):
    """Reports of which some lack their mirrored row."""
    return audits.dual_side_audit(tables.reports(spark, sf).filter("offset % 160 <> 21"))


def position_reconcile(spark, sf):
    """The log against fills of which some have a quarter of a lot more."""
    more = F.when(F.col("offset") % 50 == 0, 0.25).otherwise(0).cast("decimal(18,2)")
    fills = tables.fills(spark, sf).withColumn("quantity", F.col("quantity") + more)
    found = audits.position_reconcile(tables.positions(spark, sf), fills)
    return found.withColumn("total_difference", F.col("total_difference").cast("decimal(38,2)"))


# --- scoring ----------------------------------------------------------------------

def _document_runs(spark, sf) -> DataFrame:
    return tables.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("id"), F.col("source").alias("condition"),
        F.col("text").alias("sql"),
    )


def score_text(spark, sf):
    return scoring.score_text(_document_runs(spark, sf), DOCUMENT_RULES).drop("sql")


def _judged_documents(spark, sf) -> DataFrame:
    """Text verdicts of documents combined with the labels they have."""
    texts = score_text(spark, sf)
    labelled = (
        F.when(F.col("toxic") == 1, scoring.FAIL)
        .when(F.col("quality") == 1, scoring.PASS)
        .when(F.col("quality") == 0, scoring.REVIEW)
    )
    results = tables.table(spark, sf, "labels").select(
        "doc_id", labelled.alias("result_verdict"), F.lit("by label").alias("result_detail")
    )
    return scoring.combine_verdicts(texts.join(results, "doc_id", "left"))


def combine_verdicts(spark, sf):
    return _judged_documents(spark, sf).select("doc_id", "id", "condition", "verdict", "detail")


def _candidates(spark, sf, *by: str) -> DataFrame:
    """Per series (and further key parts), three candidate totals as three conditions."""
    per_series = audits.history_inflation(
        tables.positions(spark, sf), by=["contract_series", *by]
    )
    pairs = [
        F.struct(F.lit(c).alias("condition"), F.col(column).alias("value"))
        for c, column in zip(CANDIDATES, ("total_abs_net", "history_sum", "history_abs_sum"))
    ]
    rows = per_series.select(
        *by,
        F.col("contract_series").alias("series"),
        F.col("total_abs_net").alias("truth"),
        F.col("history_sum").alias("distractor"),
        F.inline(F.array(*pairs)),
    )
    return rows


def score_scalar(spark, sf):
    """Each candidate as a one-number answer to its series' question."""
    rows = _candidates(spark, sf)
    runs = rows.select(
        F.col("series").alias("id"),
        "condition",
        numbers_in(F.to_json(F.struct("series", "value"))).alias("numbers"),
    )
    truth = rows.filter(F.col("condition") == "latest").select(
        F.col("series").alias("id"),
        F.col("truth").cast("double").alias("truth"),
        F.array(
            F.struct(F.lit("history_sum").alias("label"), F.col("distractor").cast("double").alias("value"))
        ).alias("distractors"),
    )
    return scoring.score_scalar(runs, truth)


def score_groups(spark, sf):
    """Per account, each candidate as one answer with a row per series."""
    rows = _candidates(spark, sf, "account").withColumnRenamed("account", "id")
    runs = rows.select("id", "condition").distinct()
    answers = rows.select(
        "id", "condition", F.col("series").alias("grp"), F.lit(0).alias("pos"),
        F.array(F.col("value").cast("double")).alias("numbers"),
    )
    truth = rows.filter(F.col("condition") == "latest").select(
        "id", F.col("series").alias("grp"), F.col("truth").cast("double").alias("truth"),
        F.col("distractor").cast("double").alias("distractor"),
    )
    return scoring.score_groups(runs, answers, truth)


def score_members(spark, sf):
    """Sellers, ever-short and now-short members as answers to "who is short".

    One pass over the position log and one over the fills flag what each member is."""
    member = F.col("clearing_member_id").alias("member")
    series = F.col("contract_series").alias("id")
    per_key = tables.positions(spark, sf).groupBy(*POSITION_KEY).agg(
        F.max_by("net_quantity", "offset").alias("last"), F.min("net_quantity").alias("least"))
    no = F.lit(False)
    held = per_key.select(series, member, (F.col("last") < 0).alias("latest"),
                          (F.col("least") < 0).alias("anytime"), no.alias("sell_side"))
    sold = tables.fills(spark, sf).select(
        series, member, no.alias("latest"), no.alias("anytime"), (F.col("side") == "SELL").alias("sell_side"))
    kinds = ("latest", "sell_side", "anytime")
    flags = held.unionByName(sold).groupBy("id", "member").agg(*[F.bool_or(k).alias(k) for k in kinds])
    path = fresh_path(spark, "members")
    flags.write.parquet(path)
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds])))
    answers = spark.read.schema(flags.schema).parquet(path).select("id", "member", named.alias("condition"))
    runs = answers.select("id", "condition").distinct()
    return scoring.score_members(runs, answers, answers.filter(F.col("condition") == "latest"))


def scorecard_matrix(spark, sf):
    card = score_scalar(spark, sf).withColumnRenamed("result_verdict", "verdict")
    return scoring.scorecard_matrix(card, CANDIDATES)


def question_truth(spark, sf):
    """Right and known wrong numbers of the one-number questions."""
    truth = questions.scalar_truth(tables.fills(spark, sf), tables.reports(spark, sf), TRADE_DATE)
    return truth.select(
        "id",
        F.col("truth").cast("long").alias("truth"),
        F.try_element_at("distractors", F.lit(1)).getField("value").cast("long").alias("distractor"),
    )


def _query_text(number) -> F.Column:
    """One of the texts of runs, by a number; the last one is missing."""
    texts = F.array(*[F.lit(t).cast("string") for t in QUERY_TEXTS])
    return F.element_at(texts, (F.pmod(number, F.lit(len(QUERY_TEXTS))) + 1).cast("int"))


def question_text_scores(spark, sf):
    """A query text for each part, judged by the rules of one of the eight questions."""
    ids = F.array(*[F.lit(i) for i in scoring.QUESTION_RULES])
    text = _query_text(F.col("p_partkey") * 7 + F.col("p_size"))
    runs = tables.table(spark, sf, "part").select(
        "p_partkey",
        F.element_at(ids, (F.col("p_partkey") % 8 + 1).cast("int")).alias("id"),
        F.concat(text, F.lit(" -- "), "p_name", F.lit(" exec_time")).alias("sql"),
    )
    return scoring.score_text(runs).drop("sql")


def benchmark_scorecard(spark, sf):
    """A run with answers of every kind, found another way than the truth they are held to."""
    fills, reports, log = (read(spark, sf) for read in (tables.fills, tables.reports, tables.positions))
    scalars = questions.scalar_truth(fills, reports, TRADE_DATE)
    groups, members = questions.group_truth(log), questions.member_truth(log, SERIES)

    by_day = trades.fills_by_date(fills)
    on_day = by_day.filter(F.col("trade_date") == F.to_date(F.lit(TRADE_DATE)))
    counts = {
        "q1_control_count": by_day.agg(F.sum("n_fills").alias("n")),
        "q2_fanout_orders": fills.groupBy("order_id").count().agg(F.count("*").alias("n")),
        "q3_emir_trade_count": trades.count_trades(reports).toDF("n"),
        "q4_live_trades": trades.live_trades_anti(reports).toDF("n"),
        "q8_event_time": on_day.agg(F.coalesce(F.sum("n_fills"), F.lit(0)).alias("n")),
    }
    found = reduce(DataFrame.unionByName, [
        df.select(F.lit(question).alias("id"), F.col("n").cast("double").alias("found"))
        for question, df in counts.items()
    ])
    first = F.try_element_at("distractors", F.lit(1)).getField("value")
    known = found.join(
        scalars.select("id", F.coalesce(first, F.col("truth") + 1).alias("wrong")), "id")

    nets = state.net_from_fills(fills)
    totals = nets.groupBy(F.col("contract_series").alias("grp")).agg(
        F.sum(F.abs("net_quantity")).cast("double").alias("found"))
    history = positions.history_sum(log).select(
        F.col("contract_series").alias("grp"), F.col("history_sum").cast("double").alias("wrong"))

    def answers(df: DataFrame, *keep, **kinds) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("condition"), v.alias("numbers")) for c, v in kinds.items()]
        return df.select(*keep, F.inline(F.array(*pairs)))

    group_id = F.lit(questions.GROUP_ID).alias("id")
    neither = F.array(F.lit(-1.0))
    numbers = answers(
        known, "id", right=F.array("found"), wrong=F.array("wrong"), both=F.array("found", "wrong"),
        none=neither,
    ).unionByName(
        answers(totals.agg(F.sum("found").alias("found")), group_id, bare=F.array("found")))
    mixed = F.when(F.col("grp") == SERIES, F.col("found")).otherwise(F.col("wrong"))
    rows = answers(
        totals.join(history, "grp"), group_id, "grp", right=F.array("found"), wrong=F.array("wrong"),
        both=F.array(mixed), none=neither,
    ).withColumn("pos", F.lit(0))

    per_member = nets.filter(F.col("contract_series") == SERIES).groupBy(
        F.col("clearing_member_id").alias("member")
    ).agg(((F.min("net_quantity") < 0) | (F.sum("net_quantity") < 0)).alias("short"))
    short = per_member.filter("short").select("member")
    sellers = positions.sell_side_members(trades.series_fills(fills, SERIES)).select(
        F.col("clearing_member_id").alias("member"))
    named = reduce(DataFrame.unionByName, [
        df.select(F.lit(questions.MEMBER_ID).alias("id"), F.lit(c).alias("condition"), "member")
        for c, df in (("right", short), ("wrong", sellers), ("both", short.union(sellers)))
    ])

    asked = F.posexplode(F.array(*[F.lit(q) for q in scoring.QUESTION_RULES])).alias("q", "id")
    kinds = F.posexplode(F.array(*[F.lit(c) for c in ANSWERS])).alias("c", "condition")
    cells = fills.agg((F.count("*") > 0).alias("any")).select("any", asked).select("*", kinds)
    runs = cells.select(
        "id", "condition", _query_text(F.col("q") * len(ANSWERS) + F.col("c")).alias("sql"),
        (F.col("any") & (F.col("condition") != "silent")).alias("executed"),
    )
    return questions.judge(runs, numbers, rows, named, scalars, groups, members)


# --- streams ----------------------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of them."""
    return spark.readStream.schema(tables.SCHEMAS["events"]).parquet(f"{sf}/events.parquet*")


def stream_latest(spark, sf):
    events = _event_stream(spark, sf)
    latest = continuous.latest_stream(events, ["user_id"], ["event_type", "ts"], "event_id")
    return sinks.current_table(spark, latest, ["user_id"], "stream-latest")


def stream_topic_positions(spark, sf):
    """Current positions from the stored log's envelopes, read as a stream."""
    envelopes = topics.stream_log(spark, _stored_log(spark, sf))
    decoded = topics.decode_topic(envelopes.filter(F.col("topic") == POSITIONS.topic), POSITIONS)
    snapshots = decoded.select("_key", F.col("_meta.offset").alias("offset"), "net_quantity")
    latest = continuous.latest_stream(snapshots, ["_key"], ["net_quantity"])
    current = sinks.current_table(spark, latest, ["_key"], "stream-topic", drop_deleted="net_quantity")
    return current.select("_key", F.col("net_quantity").cast("long").alias("net_quantity"))


def stream_net_positions(spark, sf):
    net = continuous.net_positions_stream(tables.fills_from(_event_stream(spark, sf)))
    return sinks.current_table(spark, net, POSITION_KEY, "stream-net").drop("offset")


def stream_fills_by_date(spark, sf):
    counts = continuous.fills_by_date_stream(tables.fills_from(_event_stream(spark, sf)))
    return sinks.complete_table(spark, counts, "stream-dates")


def stream_dedup(spark, sf):
    """Every fill sent twice; each is kept once."""
    fills = tables.fills_from(_event_stream(spark, sf))
    sent_twice = fills.select("exec_id", "exec_time", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    once = continuous.dedup_stream(sent_twice, ["exec_id"], spread_by="copy")
    return sinks.append_table(spark, once, "stream-dedup").select("exec_id", "exec_time")


def stream_state_positions(spark, sf):
    """Net positions as the state of a stopped stream holds them; nothing of its output is read."""
    net = continuous.net_positions_stream(tables.fills_from(_event_stream(spark, sf)))
    checkpoint = fresh_path(spark, "stream-state")
    sinks.run_available(net, lambda batch, _: batch.write.format("noop").mode("overwrite").save(),
                        "update", checkpoint)
    return stream_state.state_rows(spark, checkpoint).select(
        *POSITION_KEY, F.col("sum").alias("net_quantity"))


def stream_log_dedup(spark, sf):
    """The stored log's executions, each sent again a minute later, and once more at once: kept
    once. Keys are forgotten an hour after they were logged."""
    sent = tables.topic_log(spark, sf).filter(F.col("topic") == EXECUTIONS.topic)
    again = F.explode(F.array(*[F.expr(f"INTERVAL {s} SECONDS") for s in (0, 0, 60)])).alias("wait")
    meta = F.struct("_meta.partition", "_meta.offset", (F.col("_meta.timestamp") + F.col("wait")).alias("timestamp"))
    path = fresh_path(spark, "resent")
    topics.write_log(sent.select("topic", "_key", "value", "_meta", again).select(
        "topic", "_key", "value", meta.alias("_meta")), path)
    log = topics.stream_log(spark, path).select(
        "_key", F.col("_meta.timestamp").alias("logged"), F.col("_meta.offset").alias("offset"))
    once = continuous.dedup_stream(log, ["_key"], log_time="logged", lateness="1 hour", spread_by="offset")
    return sinks.append_table(spark, once, "stream-log-dedup").groupBy("_key").agg(F.count("*").alias("n"))


def stream_state_table(spark, sf):
    """Last fill of each position key, upserted into a table."""
    base = fresh_path(spark, "state")
    schema = ("clearing_member_id string, account string, contract_series string, "
              "exec_id string, offset bigint")
    held = sinks.StateTable(spark, f"{base}/table", schema, POSITION_KEY)
    held.create()
    fills = tables.fills_from(_event_stream(spark, sf)).select(*POSITION_KEY, "exec_id", "offset")
    held.follow(fills, f"{base}/checkpoint")
    return held.read().withColumnRenamed("offset", "log_offset")


QUERIES: dict[str, Query] = {
    # sources, schema work, sinks
    "topic_snapshot": topic_snapshot,
    "decode_json_props": decode_json_props,
    "conform_fills": conform_fills,
    "flatten_nested": flatten_nested,
    "conformance_report": conformance,
    "encode_collections": encode_collections,
    "topic_counts": topic_counts,
    "fields_as_text": fields_as_text,
    "topic_sql": topic_sql,
    "encode_topic": encode_topic,
    "assign_offsets": assign_offsets,
    "written_topic": written_topic,
    "rewritten_log": rewritten_log,
    "uti_lookup": uti_lookup,
    "field_drift": field_drift,
    "type_drift": type_drift,
    "variant_fields": variant_fields,
    "observed_conformance": observed_conformance,
    "split_position_key": split_position_key,
    # projections and filters
    "both_sides": _reports(lambda r: trades.both_sides(r, "report_id", "uti")),
    "series_fills": _fills(
        lambda f: trades.series_fills(f, SERIES).select("exec_id", "contract_series", "side", "quantity")
    ),
    "fills_on_date": _fills(lambda f: trades.fills_on_date(f, TRADE_DATE)),
    "default_filtered_reports": _reports(
        lambda r: trades.with_default_filters(
            r, ["action_type <> 'EROR'", "notional_currency <> 'GBP'"]
        ).select("report_id", "action_type", "notional")
    ),
    # counts
    "count_fills": _fills(trades.count_fills),
    "count_orders": _lines(trades.count_orders),
    "count_trades": _reports(trades.count_trades),
    "count_reports": _reports(trades.count_reports),
    "live_trades": _reports(trades.live_trades),
    "live_trades_anti": _reports(trades.live_trades_anti),
    "live_trades_semi": _reports(trades.live_trades_semi),
    "all_utis_distractor": _reports(trades.all_utis_distractor),
    "fills_by_date": _fills(trades.fills_by_date),
    # positions
    "total_abs_net": _positions(positions.total_abs_net),
    "open_interest": _positions(positions.open_interest),
    "history_sum": _positions(positions.history_sum),
    "history_abs_sum": _positions(positions.history_abs_sum),
    "short_members_net": _positions(positions.short_members_net),
    "short_members_any": _positions(positions.short_members_any),
    "short_anytime_members": _positions(positions.short_anytime_members),
    "short_members_either": _positions(positions.short_members_either),
    "sell_side_members": _fills(positions.sell_side_members),
    "sell_not_short": lambda spark, sf: positions.sell_not_short(
        tables.fills(spark, sf), tables.positions(spark, sf)
    ),
    "sell_and_short": lambda spark, sf: positions.sell_and_short(
        tables.fills(spark, sf), tables.positions(spark, sf)
    ),
    "current_net_positions": _positions(state.current_net_positions),
    "net_from_fills": _fills(state.net_from_fills),
    # state
    "latest_per_key": latest_per_key,
    "latest_action": latest_action,
    "running_positions": running_positions,
    "positions_as_of": positions_as_of,
    # parties
    "trades_per_party": _reports(trades.trades_per_party),
    "live_trades_per_party": _reports(trades.live_trades_per_party),
    "party_activity": _reports(trades.party_activity),
    "top_parties": _reports(lambda r: trades.top_parties(r, 10)),
    "week_top_parties": _reports(lambda r: trades.week_top_parties(r, AS_OF, 10)),
    "last7d_top_parties": _reports(lambda r: trades.last_days_top_parties(r, AS_OF, 7, 10)),
    # joins
    "fills_with_orders": fills_with_orders,
    "notional_by_underlying": notional_by_underlying,
    "notional_as_of": notional_as_of,
    "reports_with_fills": reports_with_fills,
    "clearing_with_fills": clearing_with_fills,
    "pair_transfers": lambda spark, sf: trades.pair_transfers(tables.clearing_events(spark, sf)),
    # audits
    "grain_audit": _lines(lambda f: audits.grain_audit(f, ["order_id", "line"])),
    "fanout_audit": lambda spark, sf: audits.fanout_audit(
        tables.orders(spark, sf), tables.line_fills(spark, sf), "order_id"
    ),
    "homonym_audit": homonym_audit,
    "homonym_matrix": homonym_matrix,
    "lag_sketches": lag_sketches,
    "party_trade_sketches": party_trade_sketches,
    "dual_side_audit": dual_side_audit,
    "order_audit": lambda spark, sf: audits.order_audit(
        _shuffled_time(spark, sf), POSITION_KEY, "business_time"
    ),
    "history_inflation": _positions(audits.history_inflation),
    "position_reconcile": position_reconcile,
    "ingest_skew": lambda spark, sf: audits.ingest_skew(
        _shuffled_time(spark, sf), "business_time", "exec_time"
    ),
    # scoring
    "score_text": score_text,
    "score_scalar": score_scalar,
    "score_groups": score_groups,
    "score_members": score_members,
    "combine_verdicts": combine_verdicts,
    "pass_rates": lambda spark, sf: scoring.pass_rates(_judged_documents(spark, sf)),
    "content_effect": lambda spark, sf: scoring.content_effect(
        _judged_documents(spark, sf), "src1", "src2"
    ),
    "scorecard_matrix": scorecard_matrix,
    "question_truth": question_truth,
    "question_text_scores": question_text_scores,
    "benchmark_scorecard": benchmark_scorecard,
    # streams
    "stream_latest": stream_latest,
    "stream_net_positions": stream_net_positions,
    "stream_topic_positions": stream_topic_positions,
    "stream_state_positions": stream_state_positions,
    "stream_fills_by_date": stream_fills_by_date,
    "stream_dedup": stream_dedup,
    "stream_log_dedup": stream_log_dedup,
    "stream_state_table": stream_state_table,
}
