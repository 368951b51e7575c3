"""The eight benchmark questions: right answers, known wrong ones, and the scorecard.

Truth is computed from the topics themselves; one row per question, group or member,
so the scoring joins stay small whatever the size of the topics.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.fields import on_date
from tapeline.operators import audits, positions, scoring, trades

# Question ids that are answered with one number, per group, by members.
SCALAR_IDS = ("q1_control_count", "q2_fanout_orders", "q3_emir_trade_count", "q4_live_trades",
              "q8_event_time")
GROUP_ID = "q5_open_interest"
MEMBER_ID = "q7_side_vs_direction"


def _answer(question: str, truth: str, **wrong: str) -> Column:
    pairs = [
        F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("value"))
        for label, c in wrong.items()
    ]
    empty = F.array().cast("array<struct<label:string,value:double>>")
    return F.struct(
        F.lit(question).alias("id"),
        F.col(truth).cast("double").alias("truth"),
        (F.array(*pairs) if pairs else empty).alias("distractors"),
    )


def scalar_truth(fills: DataFrame, reports: DataFrame, day: date | str) -> DataFrame:
    """Truth and distractors of the one-number questions.

    Fills and reports are each aggregated once, every count in the same pass.
    """
    of_fills = fills.agg(
        F.count("*").alias("fills"),
        F.count_distinct("order_id").alias("orders"),
        F.count_if(on_date("exec_time", day)).alias("on_day"),
    ).select(
        F.inline(
            F.array(
                _answer("q1_control_count", "fills"),
                _answer("q2_fanout_orders", "orders", count_star_fills="fills"),
                _answer("q8_event_time", "on_day"),
            )
        )
    )
    # One row per trade carries its last action and its number of report rows.
    per_trade = trades.latest_action(reports).select(
        F.lit(0).cast("long").alias("rows"),
        F.lit(1).cast("long").alias("trades"),
        F.coalesce(trades.is_live(), F.lit(False)).cast("long").alias("live"),
    )
    rows = reports.select(
        F.lit(1).cast("long").alias("rows"),
        F.lit(0).cast("long").alias("trades"),
        F.lit(0).cast("long").alias("live"),
    )
    of_reports = per_trade.unionByName(rows).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "trades", "live")]
    ).select(
        F.inline(
            F.array(
                _answer("q3_emir_trade_count", "trades", report_record_count="rows"),
                _answer("q4_live_trades", "live", all_utis="trades"),
            )
        )
    )
    return of_fills.unionByName(of_reports)


def group_truth(log: DataFrame) -> DataFrame:
    """Truth and distractor of the per-series question."""
    return audits.history_inflation(log).select(
        F.lit(GROUP_ID).alias("id"),
        F.col("contract_series").alias("grp"),
        F.col("total_abs_net").cast("double").alias("truth"),
        F.col("history_sum").cast("double").alias("distractor"),
    )


def member_truth(log: DataFrame, series: str) -> DataFrame:
    """Members that are short in one series under either reading."""
    one_series = log.filter(F.col("contract_series") == series)
    return positions.short_members_either(one_series).select(
        F.lit(MEMBER_ID).alias("id"), F.col("clearing_member_id").alias("member")
    )


def judge(
    runs: DataFrame,
    numbers: DataFrame,
    rows: DataFrame,
    named: DataFrame,
    scalars: DataFrame,
    groups: DataFrame,
    members: DataFrame,
) -> DataFrame:
    """The scorecard of a run whose answers are tables already.

    ``runs``: id, condition, sql, ``executed``; ``numbers``: id, condition, numbers (also
    of a grouped answer, for the case that it has no rows);
    ``rows``: id, condition, grp, pos, numbers; ``named``: id, condition, member.
    """
    done = runs.filter("executed").select("id", "condition")
    grouped = done.filter(F.col("id") == GROUP_ID).join(
        numbers.filter(F.col("id") == GROUP_ID), ["id", "condition"], "left")
    results = (
        scoring.score_scalar(numbers, scalars)
        .unionByName(scoring.score_groups(grouped, rows, groups))
        .unionByName(scoring.score_members(done.filter(F.col("id") == MEMBER_ID), named, members))
    )
    texts = scoring.score_text(runs).select("id", "condition", "text_verdict", "text_detail")
    return scoring.combine_verdicts(texts.join(results, ["id", "condition"], "left")).select(
        "id", "condition", "verdict", "detail", "text_verdict", "text_detail", "result_verdict",
        "result_detail",
    )


def score_runs(
    runs: DataFrame,
    scalars: DataFrame,
    groups: DataFrame,
    members: DataFrame,
    codes: DataFrame,
    group_field: str = "contract_series",
    measure: str | None = None,
) -> DataFrame:
    """The scorecard of a run as it is stored.

    ``runs``: id, condition, sql, result (array of JSON texts, null if not executed).
    ``codes`` has all member codes there are, in column ``member``.
    """
    answered = runs.filter(F.col("result").isNotNull())
    return judge(
        runs.withColumn("executed", F.col("result").isNotNull()),
        scoring.answer_numbers(answered.filter(F.col("id").isin(*SCALAR_IDS, GROUP_ID))),
        scoring.answer_rows(answered.filter(F.col("id") == GROUP_ID), group_field, measure),
        scoring.answer_members(answered.filter(F.col("id") == MEMBER_ID), codes),
        scalars,
        groups,
        members,
    )
