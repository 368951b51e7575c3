"""Running a stream into tables in the shared folder.

Every batch writes a folder of its own. The folders of a run that is read once it has
ended are named by batch id and overwritten if the batch runs again; those of a table
with readers are new for each attempt, and only a commit makes one visible. So a lost
executor or a restarted query changes nothing. A stream without input gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tapeline.operators.state import latest_per_key
from tapeline.plans.shared import fresh_path

BATCH = "batch_id"


def run_available(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    mode: str,
    checkpoint: str,
) -> None:
    """Processes everything that is there now and stops."""
    query = (
        stream.writeStream.foreachBatch(each_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def changelog_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Update-mode output as a table: the rows each batch changed, with its id."""
    base = fresh_path(spark, name)
    schema = StructType([*stream.schema.fields, StructField(BATCH, LongType())])
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/log/{BATCH}={batch_id}")
        seen.append(batch_id)

    run_available(stream, write, "update", f"{base}/checkpoint")
    if not seen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/log")


def current_table(
    spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str,
    drop_deleted: str | None = None,
) -> DataFrame:
    """Update-mode output folded to the last row of each key.

    ``drop_deleted`` names a payload column whose null in the last record means the key
    was deleted.
    """
    log = changelog_table(spark, stream, name)
    return latest_per_key(log, keys, [BATCH], drop_deleted).drop(BATCH)


def complete_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Complete-mode output: the whole result of the last batch."""
    base = fresh_path(spark, name)
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result/{BATCH}={batch_id}")
        seen.append(batch_id)

    run_available(stream, write, "complete", f"{base}/checkpoint")
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/result/{BATCH}={max(seen)}")


def append_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Append-mode output through the exactly-once file sink."""
    base = fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


class StateTable:
    """The current state of a compacted topic, kept up to date by a stream.

    A batch writes only its own last record per key, as a delta; every
    ``merge_every``-th batch merges state and deltas into a new full version, so the
    cost of a batch does not grow with the state.

    Every attempt of a batch writes a new folder and then a commit, which lists all
    folders that make up the table from then on: at most one full version and
    ``merge_every`` deltas. A repeated batch touches nothing that a reader may be
    reading. Commits lie in a folder for each merge period; a merge removes those of the
    periods before the last, so their number stays bounded.

    ``drop_deleted`` names a payload column whose null in a key's last record means that
    the key was deleted. The marker stays stored, so that an older record that comes late
    does not bring the key back, and is left out on reading.
    """

    def __init__(
        self, spark: SparkSession, base: str, schema: str, keys: Sequence[str],
        order: str = "offset", merge_every: int = 16, drop_deleted: str | None = None,
    ):
        self.spark, self.base, self.schema = spark, base, schema
        self.keys, self.order, self.merge_every = list(keys), order, merge_every
        self.drop_deleted = drop_deleted

    def create(self) -> None:
        self._write(self.spark.createDataFrame([], self.schema), -1, whole=True)

    def _write(self, rows: DataFrame, batch_id: int, whole: bool) -> None:
        folder = f"{self.base}/batches/{batch_id}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        folders = [folder] if whole else [*self._visible(batch_id), folder]
        period = (batch_id + 1) // self.merge_every
        self.spark.range(1).select(
            F.lit(batch_id).cast("long").alias(BATCH),
            F.array(*[F.lit(f) for f in folders]).alias("folders"),
        ).write.mode("append").parquet(f"{self.base}/commits/period={period}")
        if whole:
            self._forget(period - 1)

    def _forget(self, before: int) -> None:
        """Removes the commits of periods below ``before``; tables they list stay."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/commits")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in system.listStatus(path):
            period = status.getPath().getName().partition("=")[2]
            if period and int(period) < before:
                system.delete(status.getPath(), True)

    def _visible(self, below: int | None) -> list[str]:
        """The folders of the newest commit, or of the newest below a batch."""
        commits = self.spark.read.schema(
            f"{BATCH} long, folders array<string>, period long"
        ).parquet(f"{self.base}/commits")
        if below is not None:
            commits = commits.filter(F.col(BATCH) < below)
        # Attempts of one batch hold the same rows: either may be the newest.
        return commits.agg(F.max(F.struct(BATCH, "folders")).alias("c")).first()["c"]["folders"]

    def _stored(self, below: int | None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*self._visible(below))
        return latest_per_key(rows, self.keys, [self.order])

    def read(self, below: int | None = None) -> DataFrame:
        rows = self._stored(below)
        return rows.filter(F.col(self.drop_deleted).isNotNull()) if self.drop_deleted else rows

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        news = latest_per_key(batch, self.keys, [self.order])
        whole = (batch_id + 1) % self.merge_every == 0
        if whole:
            news = latest_per_key(
                self._stored(batch_id).unionByName(news), self.keys, [self.order]
            )
        self._write(news, batch_id, whole)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Applies everything the stream holds now."""
        run_available(stream, self.upsert, "append", checkpoint)
