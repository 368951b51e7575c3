"""Reading and writing keyed topics.

A topic record is an envelope row: ``topic``, ``_key``, ``value`` (JSON text) and
``_meta`` (partition, offset, log timestamp). Stored logs are partitioned by topic,
so reading one topic prunes the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeline.operators.records import conform_topic
from tapeline.sources.contracts import CONTRACTS, Contract, text_schema

ENVELOPE = (
    "topic string, _key string, value string, "
    "_meta struct<partition:int, offset:bigint, timestamp:timestamp_ntz>"
)


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored log of envelopes (Parquet or JSON lines) as a snapshot."""
    log = spark.read.schema(ENVELOPE).format(fmt).load(path)
    return log.select("topic", "_key", "value", "_meta")


def read_topic(spark: SparkSession, path: str, topic: str, fmt: str = "parquet") -> DataFrame:
    """The envelopes of one topic of a stored log."""
    return read_log(spark, path, fmt).filter(F.col("topic") == topic)


def stream_log(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A stored log as a stream; new files arrive as new records."""
    return spark.readStream.schema(ENVELOPE).format(fmt).options(**options).load(path)


def kafka_options(servers: str, topics: Iterable[str], **options: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), **options}


def from_kafka_rows(rows: DataFrame) -> DataFrame:
    """Envelopes from the rows of Spark's Kafka source."""
    return rows.select(
        "topic",
        F.col("key").cast("string").alias("_key"),
        F.col("value").cast("string").alias("value"),
        F.struct(
            F.col("partition").cast("int").alias("partition"),
            F.col("offset").cast("long").alias("offset"),
            F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        ).alias("_meta"),
    )


def to_kafka_rows(envelopes: DataFrame) -> DataFrame:
    """Rows for Spark's Kafka sink, which assigns partitions and offsets itself."""
    return envelopes.select(
        "topic",
        F.col("_key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
    )


def read_kafka(
    spark: SparkSession,
    servers: str,
    topics: Iterable[str],
    starting: str = "earliest",
    ending: str = "latest",
) -> DataFrame:
    """A bounded snapshot of Kafka topics; needs the Kafka source on the class path."""
    options = kafka_options(servers, topics, startingOffsets=starting, endingOffsets=ending)
    return from_kafka_rows(spark.read.format("kafka").options(**options).load())


def stream_kafka(
    spark: SparkSession, servers: str, topics: Iterable[str], starting: str = "earliest"
) -> DataFrame:
    options = kafka_options(servers, topics, startingOffsets=starting)
    return from_kafka_rows(spark.readStream.format("kafka").options(**options).load())


def write_kafka(envelopes: DataFrame, servers: str) -> None:
    rows = to_kafka_rows(envelopes)
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def decode_json(envelopes: DataFrame, schema: StructType) -> DataFrame:
    """Payload fields beside ``_key`` and ``_meta``; unknown fields are ignored.

    A record that is not JSON yields nulls in every field, not a failed job.
    """
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return envelopes.select("_key", "_meta", parsed.alias("v")).select("_key", "_meta", "v.*")


def decode_topic(envelopes: DataFrame, contract: Contract) -> DataFrame:
    """Envelopes of one topic as declared columns.

    Payloads are parsed as text first and then cast, so one bad field is null and
    its neighbours survive.
    """
    raw = decode_json(envelopes, text_schema(contract.schema))
    return conform_topic(raw, contract.schema, keep=("_key", "_meta"))


def split_topics(log: DataFrame, topics: Iterable[str] = tuple(CONTRACTS)) -> dict[str, DataFrame]:
    """One envelope DataFrame per topic; each is a pruned read of the same log."""
    return {t: log.filter(F.col("topic") == t) for t in topics}


def write_log(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """Stores envelopes partitioned by topic."""
    envelopes.write.mode(mode).partitionBy("topic").parquet(path)


class RunLog:
    """A stored log that runs may write again: a rerun replaces what it wrote before.

    Every write makes a folder of its own, partitioned by topic, and then a commit that names
    the run and the folder. Readers follow the last commit of each run, so a failed or
    repeated run, or a lost executor, neither doubles the log nor disturbs a reader. Folders
    that no commit names are left; remove them outside of running jobs.
    """

    COMMIT = "run string, folder string, number bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, envelopes: DataFrame, run: str) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        envelopes.write.partitionBy("topic").parquet(f"{self.path}/{folder}")
        # Runs write one after the other; a commit's number is one more than the last.
        last = max((r["number"] for r in self._commits().values()), default=0)
        commit = self.spark.createDataFrame([(run, folder, last + 1)], self.COMMIT)
        commit.coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def _commits(self) -> dict[str, Row]:
        """The last commit of each run: as many rows as there were writes."""
        try:
            rows = self.spark.read.schema(self.COMMIT).json(f"{self.path}/commits").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return {r["run"]: r for r in sorted(rows, key=lambda r: r["number"])}

    def folders(self) -> list[str]:
        return [f"{self.path}/{r['folder']}" for r in self._commits().values()]

    def read(self) -> DataFrame:
        """The envelopes of the last write of every run."""
        found = None
        for folder in self.folders():
            own = read_log(self.spark, folder)
            found = own if found is None else found.unionByName(own)
        return self.spark.createDataFrame([], ENVELOPE) if found is None else found


def save_bucketed(
    df: DataFrame, table: str, path: str, key: str, buckets: int, files_per_bucket: int = 4
) -> None:
    """A decoded topic as a table bucketed and sorted by a join key.

    Two tables with equal buckets join on that key without a shuffle, as often as
    they are joined. Rows are sent to ``files_per_bucket`` tasks for each bucket, so a hot
    or null key is written by several tasks. Such a join cannot be split, though: join a
    table with a very hot key unbucketed, where the adaptive skew join applies.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind]
    part = F.pmod(F.xxhash64(*hashed), F.lit(files_per_bucket))
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    (
        df.repartition(buckets * files_per_bucket, bucket, part)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(table)
    )


def save_for_lookup(
    df: DataFrame, path: str, key: str, most_keys: int = 1_000_000, group_bytes: int = 16 << 20
) -> None:
    """A decoded topic, stored to be asked for single keys.

    Rows are dealt to files by ranges of the key and sorted, so a file's limits rule most
    files out; a Bloom filter in each row group rules out groups whose limits span a key that
    they do not hold. ``most_keys`` is the number of keys of a row group the filter is sized
    for. The rows of a key that has very many are dealt to several files.
    """
    (
        df.repartitionByRange(F.col(key), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]))
        .sortWithinPartitions(key)
        .write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(most_keys))
        .option("parquet.block.size", str(group_bytes))
        .parquet(path)
    )


def lookup(spark: SparkSession, path: str, key: str, wanted: Sequence[str]) -> DataFrame:
    """The rows of some keys. Row groups that cannot hold one of them are not read. Lists
    longer than ``spark.sql.parquet.pushdown.inFilterThreshold`` are pushed as limits only."""
    return spark.read.parquet(path).filter(F.col(key).isin(list(wanted)))


def field_drift(envelopes: DataFrame, contract: Contract) -> DataFrame:
    """Payload fields against the declared ones, over all records of a topic.

    One row per field with the number of records that carry it. A field nobody
    declared has ``declared`` false; a declared field nobody sends has zero records.
    """
    seen = envelopes.select(
        F.explode(F.json_object_keys("value")).alias("field"),
        F.lit(1).cast("long").alias("n"),
        F.lit(False).alias("d"),
    )
    names = F.array(*[F.lit(n) for n in contract.schema.names])
    declared = envelopes.sparkSession.range(1).select(
        F.explode(names).alias("field"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("d")
    )
    return (
        seen.unionByName(declared)
        .groupBy("field")
        .agg(F.sum("n").alias("n_records"), F.bool_or("d").alias("declared"))
    )


def type_drift(envelopes: DataFrame, contract: Contract) -> DataFrame:
    """The types in which payload fields arrive, over all records of a topic.

    One row per field that was sent or declared: records that carry it, whether it is
    declared, its type over all records as JSON knows types (``seen``, null if it was never
    sent), and ``mixed`` if no one type holds what was sent: the same field as text and as
    a number, say. Numbers of different precision are one type. Nulls have none.
    """
    whole = envelopes.select(F.try_parse_json("value").alias("v")).filter(
        F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    fields = whole.lateralJoin(
        envelopes.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", "value")
    found = fields.groupBy(F.col("key").alias("field")).agg(
        F.count("*").alias("n_records"), F.schema_of_variant_agg("value").alias("seen"))
    names = F.array(*[F.lit(n) for n in contract.schema.names])
    declared = envelopes.sparkSession.range(1).select(
        F.explode(names).alias("field"), F.lit(0).cast("long").alias("n_records"),
        F.lit(None).cast("string").alias("seen"))
    # A field has a row of each kind at most.
    return (
        found.withColumn("d", F.lit(False)).unionByName(declared.withColumn("d", F.lit(True)))
        .groupBy("field")
        .agg(F.sum("n_records").alias("n_records"), F.bool_or("d").alias("declared"),
             F.max("seen").alias("seen"))
        .withColumn("mixed", F.coalesce(F.col("seen").contains("VARIANT"), F.lit(False)))
    )


def register_topics(topics: Mapping[str, DataFrame]) -> None:
    """Makes decoded topics queryable under their own names.

    ``spark.sql("SELECT count(*) FROM `etd.executions`")`` then works, with the
    ``_key`` and ``_meta`` columns in reach.
    """
    for name, df in topics.items():
        df.createOrReplaceTempView(f"`{name}`")


def open_topics(log: DataFrame) -> dict[str, DataFrame]:
    """Every declared topic of a log, decoded."""
    return {
        topic: decode_topic(envelopes, CONTRACTS[topic])
        for topic, envelopes in split_topics(log).items()
    }
