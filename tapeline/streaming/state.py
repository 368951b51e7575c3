"""The state of a stopped stream, read as a table.

The last committed state of a query lies in its checkpoint. Read as rows, it can be held
against the batch answer, and the keys of each state partition show skew before it hurts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_rows(
    spark: SparkSession, checkpoint: str, operator: int = 0, store: str = "default"
) -> DataFrame:
    """Key columns, state columns and ``partition_id`` of one stateful operator, as of the last
    batch. State columns have the names that Spark gives them, such as ``sum`` and ``max``."""
    state = spark.read.format("statestore").option("operatorId", operator).option(
        "storeName", store).load(checkpoint)
    return state.select("key.*", "value.*", "partition_id")


def state_spread(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Keys of each state partition; one without keys has no row."""
    return state_rows(spark, checkpoint, operator).groupBy("partition_id").agg(
        F.count("*").alias("n_keys"))
