"""Answers from small states that are stored once and merged at will.

A state is a binary column of a few kilobytes. Rows are read once to make the states of a
day (or of any other group); a question over any range of groups then merges states and
reads no row. All three kinds combine map-side, so a hot group costs one state per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.fields import micros_between

# Rank error of a quantile sketch of k = 200, two-sided, at 99 % confidence, with room for
# merging. Twice the error for single ranks.
KLL_K, KLL_ERROR = 400, 0.02
# Relative error of a distinct count with 2**12 registers: 1.6 % at one standard deviation.
HLL_LG_K, HLL_ERROR = 12, 0.07
# Entries of a theta sketch: 2**14, an error of 0.8 % of the union.
THETA_LG_NOMINAL, THETA_ERROR = 14, 0.04


# --- percentiles ------------------------------------------------------------------

def lag_sketches(
    df: DataFrame, business_time: str, log_time: str, by: Mapping[str, Column] | None = None,
    k: int = KLL_K,
) -> DataFrame:
    """For each group (by default each business date): rows with both times, and a KLL sketch
    of their lags in microseconds."""
    groups = by or {"trade_date": F.to_date(business_time)}
    lag = micros_between(F.col(business_time), F.col(log_time))
    return (
        df.select(*[c.alias(n) for n, c in groups.items()], lag.alias("lag_us"))
        .filter(F.col("lag_us").isNotNull())
        .groupBy(*groups)
        .agg(F.count("*").alias("n_rows"), F.kll_sketch_agg_bigint("lag_us", F.lit(k)).alias("lags"))
    )


def lag_percentiles(
    sketches: DataFrame, percents: Sequence[int] = (50, 90, 99), by: Sequence[str] = ()
) -> DataFrame:
    """``p``, ``n_rows`` and ``lag_us``: about the smallest lag that covers ``p`` % of the rows,
    from merged sketches. Each group of ``by`` (or all sketches) merges into one state."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.kll_merge_agg_bigint("lags").alias("lags"))
    quantiles = [F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_bigint(
        "lags", F.lit(p / 100.0)).alias("lag_us")) for p in percents]
    return merged.filter(F.col("n_rows") > 0).select(*by, "n_rows", F.inline(F.array(*quantiles)))


def rank_errors(
    df: DataFrame, business_time: str, log_time: str, estimates: DataFrame
) -> DataFrame:
    """The share of rows by which each estimate (``p``, ``lag_us``) misses its percentile, by
    one exact count. ``estimates`` has a row for each percentile; they become constants."""
    lag = micros_between(F.col(business_time), F.col(log_time))
    asked = [(r["p"], r["lag_us"]) for r in estimates.select("p", "lag_us").collect()]
    total = F.count("lag_us")
    counts = df.select(lag.alias("lag_us")).agg(total.alias("n_rows"), *[
        c.alias(f"{name}{i}") for i, (_, value) in enumerate(asked) for name, c in (
            ("below", F.count_if(F.col("lag_us") < value)), ("up_to", F.count_if(F.col("lag_us") <= value)))])
    lines = []
    for i, (p, value) in enumerate(asked):
        low, high = F.col(f"below{i}") / F.col("n_rows"), F.col(f"up_to{i}") / F.col("n_rows")
        missed = F.greatest(low - p / 100.0, p / 100.0 - high, F.lit(0.0))
        lines.append(F.struct(F.lit(p).alias("p"), F.col("n_rows"), F.lit(value).alias("lag_us"),
                              missed.alias("rank_error")))
    shape = "array<struct<p:int, n_rows:bigint, lag_us:bigint, rank_error:double>>"
    return counts.select(F.inline(F.array(*lines).cast(shape)))


# --- distinct counts ----------------------------------------------------------------

def distinct_sketches(
    df: DataFrame, value: str, by: Sequence[str | Column], lg_k: int = HLL_LG_K
) -> DataFrame:
    """For each group, its rows and a HyperLogLog state of the distinct values."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg(value, F.lit(lg_k)).alias("values"))


def distinct_from(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and about the number of distinct values of each coarser group, from merged states:
    values that several groups share count once."""
    return sketches.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("n_distinct"))


# --- common values ------------------------------------------------------------------

def column_sketches(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], lg_nominal: int = THETA_LG_NOMINAL
) -> DataFrame:
    """``name`` (table.column) and a theta sketch of the values of each named column, as text.

    A table is read once for all its columns, and no value is shuffled.
    """
    found = None
    for table, (df, columns) in tables.items():
        states = df.agg(*[
            F.theta_sketch_agg(F.col(c).cast("string"), F.lit(lg_nominal)).alias(f"s{i}")
            for i, c in enumerate(columns)])
        rows = states.select(F.inline(F.array(*[
            F.struct(F.lit(f"{table}.{c}").alias("name"), F.col(f"s{i}").alias("values"))
            for i, c in enumerate(columns)])))
        found = rows if found is None else found.unionByName(rows)
    return found


def homonym_matrix(sketches: DataFrame, least_share: float = 0.01) -> DataFrame:
    """All pairs of columns: about their distinct values and those in common, the share of the
    smaller column's values that is common (null if a column has none), and ``unlike`` when
    it is below ``least_share``.

    ``sketches`` has a row for each named column, so all of them fit into one array.
    """
    held = sketches.agg(F.sort_array(F.collect_list(F.struct("name", "values"))).alias("all"))
    first = held.select("all", F.posexplode("all").alias("i", "left"))
    pairs = first.select(
        "left", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("right"))
    common = F.theta_sketch_estimate(F.theta_intersection("left.values", "right.values"))
    counted = pairs.select(
        F.col("left.name").alias("left_column"), F.col("right.name").alias("right_column"),
        F.theta_sketch_estimate("left.values").alias("n_left"),
        F.theta_sketch_estimate("right.values").alias("n_right"), common.alias("n_common"))
    share = F.try_divide(F.col("n_common").cast("double"), F.least("n_left", "n_right"))
    return counted.withColumn("share", share).withColumn(
        "unlike", F.coalesce(F.col("share") < least_share, F.lit(True)))
