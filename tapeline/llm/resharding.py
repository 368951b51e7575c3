"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block
transfers that move the fewest bytes, and a rewrite of the affected files only.

The old shards are the files of a table; file ``i`` in the order of names belongs to new
shard ``i`` modulo the number of shards and costs nothing there. Files of the same home
have the same costs, so they are one source of the flow, and the flow has at most as many
sources and sinks as there are shards. Within a home, rows stand in the order of file and
row; the flow cuts that line into one stretch for each shard, by cumulative bytes, the
stretch that stays at home first. A row goes where its middle byte lies, so sizes differ
from the capacities by the rows at a few cuts only.

Nothing grows in one task or on the driver: bytes are summed by blocks of consecutive rows,
then by files; the driver sees one number for each home. The plan is a list of row ranges
of files. Files whose rows all stay at home are left as they are; the other files' rows are
written into their shards' folders, without a shuffle.

Null texts count as empty. Repeated rows and ids are placed row by row, as every row has
its own place. An empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.shared import fresh, written

BLOCK_ROWS = 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each source to each sink that ships all supply at the least cost.

    Successive shortest paths with residual arcs. ``sum(supply) <= sum(capacity)``.
    """
    sources, sinks = len(supply), len(capacity)
    flow = [[0] * sinks for _ in supply]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford over sources (0..) and sinks; parents give the path.
        far = [0 if s else float("inf") for s in left] + [float("inf")] * sinks
        parent = [-1] * (sources + sinks)
        changed = True
        while changed:
            changed = False
            for i in range(sources):
                for j in range(sinks):
                    if far[i] + cost[i][j] < far[sources + j]:
                        far[sources + j], parent[sources + j] = far[i] + cost[i][j], i
                        changed = True
                    if flow[i][j] and far[sources + j] - cost[i][j] < far[i]:
                        far[i], parent[i] = far[sources + j] - cost[i][j], sources + j
                        changed = True
        end = min((j for j in range(sinks) if room[j]), key=lambda j: far[sources + j])
        path, node = [], sources + end
        while parent[node] >= 0:
            path.append((parent[node], node))
            node = parent[node]
        amount = min([left[node], room[end],
                      *(flow[b][a - sources] for a, b in path if a >= sources)])
        for a, b in path:
            if a < sources:
                flow[a][b - sources] += amount
            else:
                flow[b][a - sources] -= amount
        left[node] -= amount
        room[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan(rows: DataFrame, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """Row ranges. ``rows`` has ``file``, ``row`` (its number in the file, from 0) and ``size``.

    Returns ``file``, ``home``, ``from_row``, ``rows``, ``bytes``, ``shard`` and
    ``first_slot`` (the slot of the range's first row in its shard).
    """
    rows = rows.withColumn("block", F.expr(f"row div {BLOCK_ROWS}"))
    blocks = written(rows.groupBy("file", "block").agg(F.sum("size").alias("bytes")), "blocks")
    # One row for each file: what a listing of the table holds as well.
    files = blocks.groupBy("file").agg(F.sum("bytes").alias("bytes"))
    files = written(
        files.withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)
        .withColumn("home", (F.col("number") % shards).cast("int"))
        .withColumn("file_start", F.sum("bytes").over(
            Window.partitionBy("home").orderBy("number")) - F.col("bytes")), "files")
    supply = [0] * shards
    for r in files.groupBy("home").agg(F.sum("bytes").alias("bytes")).collect():
        supply[r["home"]] = r["bytes"]
    capacities = capacities or even_capacities(sum(supply), shards)
    cost = [[0 if i == j else 1 for j in range(shards)] for i in range(shards)]
    flow = min_cost_flow(supply, capacities, cost)
    cuts = []
    for home in range(shards):
        at = 0
        for shard in sorted(range(shards), key=lambda j: (j != home, j)):
            if flow[home][shard]:
                cuts.append((home, at, at + flow[home][shard], shard))
                at += flow[home][shard]
    # At most shards * shards stretches: they become one expression.
    middle = F.col("start") * 2 + F.col("size")
    shard = F.lit(None).cast("int")
    for home, low, high, to in reversed(cuts):
        shard = F.when((F.col("home") == home) & (middle >= 2 * low) & (middle < 2 * high),
                       F.lit(to)).otherwise(shard)
    starts = blocks.join(files, "file").select(
        "file", "block", "home", "number",
        (F.col("file_start") + F.sum(blocks["bytes"]).over(
            Window.partitionBy("file").orderBy("block")) - blocks["bytes"]).alias("block_start"))
    in_block = Window.partitionBy("file", "block").orderBy("row")
    placed = (
        rows.join(starts, ["file", "block"])
        .withColumn("start", F.col("block_start") + F.sum("size").over(in_block) - F.col("size"))
        .withColumn("shard", shard)
    )
    ranges = written(
        placed.groupBy("file", "home", "number", "shard").agg(
            F.min("row").alias("from_row"), F.count("*").alias("rows"),
            F.sum("size").alias("bytes")), "ranges")
    in_shard = Window.partitionBy("shard").orderBy("home", "number")
    return ranges.withColumn("first_slot", F.sum("rows").over(in_shard) - F.col("rows")).drop("number")


def affected(ranges: DataFrame) -> DataFrame:
    """Files that have rows to move."""
    return ranges.filter("shard <> home").select("file").distinct()


def reshard(
    spark: SparkSession, path: str, shards: int, columns: list[str], size, target: str,
) -> DataFrame:
    """Plans and rewrites a Parquet table at ``path``; returns its rows in their new places.

    Rows of affected files are written to ``target/shard=K`` with ``slot``; the result reads
    those and, from the old place, the files that stay.
    """
    table = spark.read.parquet(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    ranges = written(plan(table.select(*place, size.cast("long").alias("size")), shards), "plan")
    moved = affected(ranges)
    # The caller's columns go along as one, so that no name of theirs meets one of ours.
    rows = table.select(F.struct(*columns).alias("own"), *place)
    found = rows.join(ranges.select("file", "shard", "from_row", "first_slot", "rows"), "file").filter(
        "row >= from_row and row < from_row + rows"
    ).select("own", "file", "shard", (F.col("first_slot") + F.col("row") - F.col("from_row")).alias("slot"))
    found.join(moved, "file", "left_semi").select("own", "slot", "shard").write.partitionBy(
        "shard").parquet(target)
    kept = found.join(moved, "file", "left_anti").select("own", "slot", "shard")
    back = spark.read.schema(kept.schema).parquet(target)
    whole = back.select("own", "slot", "shard").union(kept)
    return whole.select(*[F.col("own").getField(c).alias(c) for c in columns], "slot", "shard")


def placement(spark: SparkSession, path: str, shards: int = 8) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of all rows after resharding."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    done = reshard(spark, path, shards, ["doc_id", "text"], size, fresh(spark, "shards"))
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return done.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
