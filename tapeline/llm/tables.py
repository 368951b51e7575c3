"""The given tables, by path."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import tapeline


# Long texts make a batch of 10,000 rows large on both sides of the Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is on the driver's path only, and
    bounds the batches they get to 4 MB, if the session names no other size."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    root = str(Path(tapeline.__file__).resolve().parents[1])
    settings = spark.sparkContext.environment
    known = settings.get("PYTHONPATH", "")
    if root not in known.split(":"):
        settings["PYTHONPATH"] = f"{known}:{root}".strip(":")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
