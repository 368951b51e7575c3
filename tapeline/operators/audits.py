"""Measurements of the classic mistakes on the data itself.

Audits that compare two sides are written as a union of flagged rows and one
aggregate rather than as a full outer join: the aggregate combines map-side, so a
hot key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.functions.fields import micros_between, signed_quantity
from tapeline.operators.state import POSITION_KEY, current_net_positions

# A percentile is looked for in cells of 2**40 microseconds (13 days), of 2**20 (1 second),
# and of one microsecond.
CELL_BITS = 20


def grain_audit(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Is ``key`` a key? Rows, distinct keys, repeated keys and rows of the largest."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_rows_per_key"),
    )


def fanout_audit(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children per parent, parents without a child, children without a parent."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    flagged = parents.select(key, one.alias("p"), none.alias("c")).unionByName(
        children.select(key, none.alias("p"), one.alias("c"))
    )
    sizes = flagged.groupBy(key).agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    is_parent = (F.col("p") > 0) & F.col(key).isNotNull()
    zero = F.lit(0)
    return sizes.agg(
        F.count_if(is_parent).alias("n_parents"),
        F.coalesce(F.sum("c"), zero).cast("long").alias("n_children"),
        F.count_if(is_parent & (F.col("c") == 0)).alias("n_childless_parents"),
        F.coalesce(F.sum(F.when(~is_parent, F.col("c"))), zero).cast("long").alias("n_orphans"),
        F.coalesce(F.max(F.when(is_parent, F.col("c"))), zero).cast("long").alias("max_children"),
    )


def homonym_audit(
    left: DataFrame, left_column: str, right: DataFrame, right_column: str,
    least_share: float = 0.01,
) -> DataFrame:
    """Do two columns hold the same identifiers?

    Distinct values of each side, values in common, their share of the smaller side's
    values (null if a side has none), and ``unlike`` when the share is below
    ``least_share``: joining such columns joins two different things, whatever stray value
    they have in common.
    """
    flagged = left.select(
        F.col(left_column).cast("string").alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")
    ).unionByName(
        right.select(
            F.col(right_column).cast("string").alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")
        )
    )
    values = flagged.filter(F.col("v").isNotNull()).groupBy("v").agg(
        F.max("l").alias("l"), F.max("r").alias("r")
    )
    common = (F.col("l") == 1) & (F.col("r") == 1)
    smaller = F.least(F.count_if(F.col("l") == 1), F.count_if(F.col("r") == 1))
    share = F.try_divide(F.count_if(common).cast("double"), smaller)
    return values.agg(
        F.count_if(F.col("l") == 1).alias("n_left"),
        F.count_if(F.col("r") == 1).alias("n_right"),
        F.count_if(common).alias("n_common"),
        share.alias("share"),
        F.coalesce(share < least_share, F.lit(True)).alias("unlike"),
    )


def dual_side_audit(reports: DataFrame) -> DataFrame:
    """Per action: trades reported by exactly two mirrored rows, and the others.

    Counted in two steps, first per party pair, so that the inner aggregate keeps to
    plain counters.
    """
    a, b = F.col("counterparty_1"), F.col("counterparty_2")
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    pairs = reports.groupBy("uti", "action_type", low, high).agg(
        F.count("*").alias("n"),
        F.count_if(a == F.least(a, b)).alias("n_low_first"),
        F.count_if(b == F.least(a, b)).alias("n_low_second"),
        F.count_if(a.isNull() | b.isNull()).alias("n_partial"),
    )
    per_action = pairs.groupBy("uti", "action_type").agg(
        F.count("*").alias("n_pairs"),
        F.sum("n").alias("n"),
        F.sum("n_low_first").alias("n_low_first"),
        F.sum("n_low_second").alias("n_low_second"),
        F.sum("n_partial").alias("n_partial"),
    )
    mirrored = (
        (F.col("n_pairs") == 1)
        & (F.col("n") == 2)
        & (F.col("n_low_first") == F.col("n_low_second"))
        & (F.col("n_partial") == 0)
    )
    return per_action.groupBy("action_type").agg(
        F.count("*").alias("n_groups"),
        F.count_if(mirrored).alias("n_mirrored"),
        F.count_if(~mirrored).alias("n_unmirrored"),
    )


def order_audit_keys(
    log: DataFrame, keys: Sequence[str], business_time: str, order: str = "offset"
) -> DataFrame:
    """Per key: time of the last record, latest time of any record, do they differ.

    The last record by time (ties to the higher offset) is the last by offset exactly
    when the latter carries the latest time, so two fixed-width maxima suffice.
    """
    return (
        log.groupBy(*keys)
        .agg(
            F.max_by(business_time, order).alias("time_of_last"),
            F.max(business_time).alias("latest_time"),
        )
        .withColumn("out_of_order", F.col("time_of_last") != F.col("latest_time"))
    )


def order_audit(
    log: DataFrame, keys: Sequence[str], business_time: str, order: str = "offset"
) -> DataFrame:
    """Keys whose last record by business time is not the last by offset."""
    return order_audit_keys(log, keys, business_time, order).agg(
        F.count("*").alias("n_keys"),
        F.count_if("out_of_order").alias("n_out_of_order"),
    )


def history_inflation(
    positions: DataFrame, order: str = "offset", by: Sequence[str] = ("contract_series",)
) -> DataFrame:
    """Right total, signed history sum and absolute history sum, per series.

    ``by`` may be other parts of the position key. One aggregate per key carries all
    three sums; nothing is joined.
    """
    per_key = positions.groupBy(*POSITION_KEY).agg(
        F.max_by("net_quantity", order).alias("last"),
        F.sum("net_quantity").alias("signed"),
        F.sum(F.abs("net_quantity")).alias("absolute"),
    )
    return per_key.groupBy(*by).agg(
        F.sum(F.abs("last")).alias("total_abs_net"),
        F.sum("signed").alias("history_sum"),
        F.sum("absolute").alias("history_abs_sum"),
    )


def position_reconcile(positions: DataFrame, fills: DataFrame, order: str = "offset") -> DataFrame:
    """Last snapshot against the signed sum of fills, over all keys of either."""
    current = current_net_positions(positions, order=order)
    none = F.lit(0).cast(current.schema["net_quantity"].dataType)
    both = current.select(
        *POSITION_KEY, F.col("net_quantity").alias("snapshot"), none.alias("filled")
    ).unionByName(
        fills.select(*POSITION_KEY, none.alias("snapshot"), signed_quantity().alias("filled"))
    )
    per_key = both.groupBy(*POSITION_KEY).agg(
        (F.sum("snapshot") - F.sum("filled")).alias("difference")
    )
    return per_key.agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("difference") != 0).alias("n_different"),
        F.coalesce(F.sum(F.abs("difference")), F.lit(0)).alias("total_difference"),
    )


def _cells_of(counted: DataFrame) -> DataFrame:
    """Per percentile, the first cell in which it is reached, and the rows before that cell.

    ``counted``: ``p``, ``cell``, ``n``, ``before`` (rows before all these cells), ``total``.
    """
    up_to = W.partitionBy("p").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = counted.withColumn("covered", F.col("before") + F.sum("n").over(up_to))
    reached = covered.filter(F.col("covered") * 100 >= F.col("total") * F.col("p"))
    first = F.min(F.struct("cell", (F.col("covered") - F.col("n")).alias("before"), "total"))
    return reached.groupBy("p").agg(first.alias("f")).select("p", "f.*")


def exact_percentiles(rows: DataFrame, value: str, percents: Sequence[int]) -> DataFrame:
    """``p`` and ``value``: the smallest value that covers at least ``p`` % of the rows.

    By three histograms, each combined map-side: of coarse cells, of finer ones inside the
    cells that hold a percentile, and of single values inside those. A window sees the
    cells of one percentile, at most ``2**CELL_BITS`` below the coarsest.
    """
    own = F.col(value).cast("long")
    cell = F.shiftright(own, 2 * CELL_BITS).alias("cell")
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("p")
    coarse = rows.groupBy(cell).agg(F.count("*").alias("n")).select("*", asked)
    whole = W.partitionBy("p")
    found = _cells_of(coarse.withColumns(
        {"before": F.lit(0).cast("long"), "total": F.sum("n").over(whole)}))
    for bits in (CELL_BITS, 0):
        # One row for each percentile: the bound of this broadcast.
        parents = F.broadcast(found.withColumnRenamed("cell", "parent"))
        inner = rows.select(
            F.shiftright(own, bits).alias("cell"), F.shiftright(own, bits + CELL_BITS).alias("parent"))
        found = _cells_of(
            inner.join(parents, "parent").groupBy("p", "cell", "before", "total")
            .agg(F.count("*").alias("n")))
    return found.select("p", F.col("cell").alias("value"))


def ingest_skew(
    df: DataFrame,
    business_time: str,
    log_time: str,
    percents: Sequence[int] = (50, 90, 99),
) -> DataFrame:
    """How far log time is from business time, and rows it would date otherwise.

    Percentiles are exact: the smallest lag that covers at least p % of the rows.
    """
    lags = df.select(
        micros_between(F.col(business_time), F.col(log_time)).alias("lag_us"),
        (F.to_date(business_time) != F.to_date(log_time)).alias("other_date"),
    ).filter(F.col("lag_us").isNotNull())
    weighted = F.sum(F.col("lag_us").cast("decimal(20,0)"))
    whole = lags.agg(
        F.count("*").alias("n_rows"),
        F.count_if("other_date").alias("n_other_date"),
        F.floor(weighted / F.count("*")).cast("long").alias("avg_lag_us"),
        F.max("lag_us").alias("max_lag_us"),
    )
    reached = exact_percentiles(lags, "lag_us", percents).agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}_lag_us") for p in percents
    ])
    # Both are one row; together they are two half-empty ones.
    both = whole.unionByName(reached, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
