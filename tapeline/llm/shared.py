"""Tables written to the shared folder the session names, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else what ``setCheckpointDir`` set, else the warehouse."""
    named = spark.conf.get(SETTING, None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def fresh(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/tapeline-{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back: a lost executor costs a read, not a recomputation,
    and every later use sees the same rows."""
    path = fresh(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
