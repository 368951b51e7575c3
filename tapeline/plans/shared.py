"""Folders that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_base(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the one given to
    ``setCheckpointDir``, else the warehouse."""
    named = spark.conf.get(SETTING, None)
    if not named:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_base(spark)}/tapeline/{purpose}-{uuid.uuid4().hex}"
