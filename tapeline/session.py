"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the reduce side from real map output, so the initial
# partition count may be generous on a cluster: small shuffles are coalesced.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs a later exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}

# Stream state outside the executor heap.
ROCKSDB_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def cluster_settings(executors: int, cores_per_executor: int) -> dict[str, str]:
    """Settings for a batch job on a cluster: about three reduce tasks per core."""
    parallelism = max(200, executors * cores_per_executor * 3)
    return {
        **ADAPTIVE,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(parallelism),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parallelism),
        "spark.sql.files.maxPartitionBytes": "256m",
        **ROCKSDB_STATE,
    }


def local_session(
    app: str = "tapeline", cpus: str = "8", driver_memory: str = "6g", **extra: str
) -> SparkSession:
    """A single-process session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        # Call-site capture costs several round trips per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    )
    for name, value in {**ADAPTIVE, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
