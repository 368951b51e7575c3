"""Join shapes for many-to-one lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_SPREAD = 1024


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Joins facts to a lookup side.

    No side is hinted: adaptive execution broadcasts the lookup if its bytes, as measured
    after its own stages, are below the session's threshold. Otherwise both sides are
    shuffled on the key, and a hot key of the fact side is split by the skew join.
    """
    return facts.join(lookup, on, how)


def left_lookup(
    facts: DataFrame, lookup: DataFrame, on: str, spread_by: str | None
) -> DataFrame:
    """Left join in which facts without a key do not meet in one task.

    Null keys match nothing but hash alike. They get a second join key from
    ``spread_by`` (a column that varies per row); rows with a key all get 0, as
    does the lookup side, so matches are unchanged. Give ``None`` where both sides are
    bucketed by the key: the join then needs no exchange at all.
    """
    if spread_by is None:
        return facts.join(lookup, on, "left")
    spread = F.when(
        F.col(on).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(NULL_SPREAD)) + 1
    ).otherwise(F.lit(0).cast("long"))
    return (
        facts.withColumn("__spread", spread)
        .join(lookup.withColumn("__spread", F.lit(0).cast("long")), [on, "__spread"], "left")
        .drop("__spread")
    )
