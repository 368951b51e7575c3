"""Running sums, and values as of a time, that do not put one key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLOCK, _CARRY, _VALUE, _GROUP = "__block", "__carry", "__value", "__group"

# Order values per block, as a power of two. Blocks of 2**14 to 2**18 measure alike.
BLOCK_BITS = 17
# Blocks per group of blocks, as a power of two. A key of 10**12 rows has some 8 million
# blocks of 2**17 rows, but only some 2,000 groups.
GROUP_BITS = 12


def _carries(totals: DataFrame, keys: list[str], total_type) -> DataFrame:
    """What each block starts with: the groups of blocks before its own, and the blocks
    before it in its group. No task sees all blocks of a key."""
    grouped = totals.withColumn(_GROUP, F.shiftright(_BLOCK, GROUP_BITS))
    earlier_groups = W.partitionBy(*keys).orderBy(_GROUP).rowsBetween(W.unboundedPreceding, -1)
    before = grouped.groupBy(*keys, _GROUP).agg(F.sum(_VALUE).alias(_VALUE)).select(
        *keys, _GROUP, F.sum(_VALUE).over(earlier_groups).alias(_VALUE), F.lit(None).alias(_BLOCK)
    ).filter(F.col(_VALUE).isNotNull())
    inside = W.partitionBy(*keys, _GROUP).orderBy(F.col(_BLOCK).asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, -1)
    return (
        grouped.unionByName(before.select(*grouped.columns))
        .withColumn(_CARRY, F.sum(_VALUE).over(inside).cast(total_type))
        .filter(F.col(_BLOCK).isNotNull() & F.col(_CARRY).isNotNull())
        .select(*keys, _BLOCK, F.col(_CARRY).alias(_VALUE), F.lit(0).alias(_CARRY))
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    block_bits: int | None = BLOCK_BITS,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of a key up to this one.

    ``order`` is an integral column, unique inside a key; ``keys`` may not be empty. The
    caller says which kind of log it is, and the answer is the same:

    * ``block_bits=None``: many keys, none with more rows than a task can sort. One window.
    * else few or very hot keys. Each is cut into blocks of ``2**block_bits`` order values,
      which bounds the rows of a block however hot the key is: block totals, combined
      map-side; what each block starts with, summed up in two levels; and that carry joins
      its block as one extra leading row (a union, no join) for a window inside the block.
      Only this last step shuffles the rows themselves, and it shuffles them once.
    """
    if not keys:
        raise ValueError("a running sum needs a key")
    total_type = df.select(F.sum(value).alias("s")).schema["s"].dataType
    keys = list(keys)
    if block_bits is None:
        so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(out, F.sum(F.col(value).cast(total_type)).over(so_far).cast(total_type))
    blocked = df.withColumn(_BLOCK, F.shiftright(F.col(order).cast("long"), block_bits))
    totals = blocked.groupBy(*keys, _BLOCK).agg(F.sum(value).alias(_VALUE))
    carry = _carries(totals, keys, total_type)
    rows = blocked.withColumn(_VALUE, F.col(value).cast(total_type)).withColumn(_CARRY, F.lit(1))
    inside = W.partitionBy(*keys, _BLOCK).orderBy(_CARRY, order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumn(out, F.sum(_VALUE).over(inside).cast(total_type))
        .filter(F.col(_CARRY) == 1)
        .drop(_BLOCK, _CARRY, _VALUE)
    )


def dense_rank_by(
    df: DataFrame, keys: Sequence[str], order: str, out: str, block_bits: int | None = BLOCK_BITS
) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... in ``order`` inside each key, by the same forms."""
    ones = df.withColumn("__one", F.lit(1).cast("long"))
    counted = running_sum(ones, keys, order, "__one", out, block_bits)
    return counted.withColumn(out, F.col(out) - 1).drop("__one")


# Microseconds per block of an as-of carry, as a power of two: some 18 minutes.
TIME_BITS = 30
_AT, _KIND, _SEQ, _KNOWN = "__at", "__kind", "__seq", "__known"


def _known_before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """What is known when each block begins, in two levels as in ``_carries``."""
    grouped = totals.withColumn(_GROUP, F.shiftright(_BLOCK, GROUP_BITS))
    some = F.when(F.col(_KNOWN).isNotNull(), F.col(_BLOCK))
    earlier = W.partitionBy(*keys).orderBy(_GROUP).rowsBetween(W.unboundedPreceding, -1)
    before = grouped.groupBy(*keys, _GROUP).agg(F.max_by(_KNOWN, some).alias(_KNOWN)).select(
        *keys, _GROUP, F.last(_KNOWN, ignorenulls=True).over(earlier).alias(_KNOWN),
        F.lit(None).cast("long").alias(_BLOCK))
    inside = W.partitionBy(*keys, _GROUP).orderBy(F.col(_BLOCK).asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, -1)
    return (
        grouped.unionByName(before)
        .withColumn(_KNOWN, F.last(_KNOWN, ignorenulls=True).over(inside))
        .filter(F.col(_BLOCK).isNotNull() & F.col(_KNOWN).isNotNull())
        .select(*keys, _BLOCK, _KNOWN)
    )


def as_of(
    rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, valid_from: str,
    values: Sequence[str], order: str, block_bits: int = TIME_BITS,
) -> DataFrame:
    """``rows`` with the ``values`` of the version of their key that was valid at their time:
    the last one whose ``valid_from`` is not after ``at``, of equal ones that of the highest
    ``order``. Null values are values; without a version all are null.

    ``at`` and ``valid_from`` are longs, such as microseconds. No range join: both are cut
    into blocks of time, the last version of each block is carried over the blocks after it,
    and enters them as one leading row of a window inside the block. So a hot key is as many
    tasks as it has blocks with rows. Rows without a time have no version; ``values``
    replace columns of ``rows`` of the same name.
    """
    keys, own = list(keys), rows.drop(*values)
    known_type = versions.select(F.struct(*values).alias("s")).schema["s"].dataType

    def block(time: str):
        return F.shiftright(F.col(time).cast("long"), block_bits)

    given = versions.filter(F.col(valid_from).isNotNull()).select(
        *keys, block(valid_from).alias(_BLOCK), F.col(valid_from).cast("long").alias(_AT),
        F.lit(1).alias(_KIND), F.col(order).cast("long").alias(_SEQ),
        F.struct(*values).cast(known_type).alias(_KNOWN))
    asking = own.filter(F.col(at).isNotNull()).withColumns({
        _BLOCK: block(at), _AT: F.col(at).cast("long"), _KIND: F.lit(2),
        _SEQ: F.lit(None).cast("long"), _KNOWN: F.lit(None).cast(known_type)})
    # Every block with rows needs what is known before it, also one without a version.
    marks = given.unionByName(asking.select(*keys, _BLOCK, F.lit(None).cast("long").alias(_AT),
                                            _KIND, _SEQ, _KNOWN))
    totals = marks.groupBy(*keys, _BLOCK).agg(F.max_by(_KNOWN, F.struct(_AT, _SEQ)).alias(_KNOWN))
    carry = _known_before(totals, keys).withColumn(_KIND, F.lit(0))
    inside = W.partitionBy(*keys, _BLOCK).orderBy(
        F.col(_KIND) > 0, _AT, _KIND, _SEQ).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = (
        asking.unionByName(given, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
        .withColumn(_KNOWN, F.last(_KNOWN, ignorenulls=True).over(inside))
        .filter(F.col(_KIND) == 2)
    )
    timeless = own.filter(F.col(at).isNull()).withColumn(_KNOWN, F.lit(None).cast(known_type))
    return met.select(*own.columns, _KNOWN).unionByName(timeless).select(
        *own.columns, *[F.col(f"{_KNOWN}.{v}").alias(v) for v in values])
