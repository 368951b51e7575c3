"""Approximate nearest neighbours by cross-polytope hashing.

A table turns vectors by three rounds of random signs and a fast Hadamard transform and
puts each into the cell of its nearest signed axis. A query looks into the cells of its
``probes`` nearest signed axes in every table. Candidates of a cell are scored exactly, in
double precision on the original vectors, and each cell gives its best ``k`` for a query;
the best ``k`` over all cells are the answer. The measure is the inner product; vectors are
scaled to unit length only for hashing.

A query that meets fewer than ``k`` candidates in its cells, although there are more, is
compared with all rows instead, exactly.

Cells with many vectors are cut into blocks, on both sides, so no cell is one task. What
leaves a task are at most ``k`` rows for each query of a block, of ``k`` different ids.

Every width of vector has rotations of its own; candidates have the width of the query.
Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id. Rows with the query's id are never its candidates. Of several rows with one
id the best score counts, once. Ties go to the smaller id. An empty table, and a query
without candidates, give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.batches import vectors_of
from tapeline.llm.cap_filters import by_width, unit_rows, usable
from tapeline.llm.shared import written


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    rows, n = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        x = x.reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


class Rotations:
    """Pseudo-rotations of ``tables`` tables. Cell ``a`` is axis ``a``, cell ``a + n`` the
    opposite one."""

    def __init__(self, dims: int, tables: int, seed: int) -> None:
        self.size = 1 << max(1, (dims - 1).bit_length())
        signs = np.random.default_rng(seed).integers(0, 2, size=(tables, 3, self.size))
        self.signs = signs * 2.0 - 1

    def scores(self, unit: np.ndarray, table: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs[table]:
            x = hadamard(x * signs)
        return np.concatenate([x, -x], axis=1)


@lru_cache(maxsize=64)
def rotations_of(dims: int, tables: int, seed: int) -> Rotations:
    """The pseudo-rotations for vectors of one width."""
    return Rotations(dims, tables, seed)


def _cells(tables: int, seed: int, probes: int) -> Callable:
    """Rows of (table, cell, number) for the ``probes`` nearest signed axes. Tables of all
    widths are numbered one after the other."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for width, part in by_width(batch.slice(at, 2048)):
                    rotations = rotations_of(width, tables, seed)
                    unit = unit_rows(vectors_of(part.column("vector")))
                    for table in range(tables):
                        scores = rotations.scores(unit, table)
                        cells = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                        rows = np.repeat(np.arange(len(unit)), cells.shape[1])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(rows), width * tables + table), pa.int32()),
                            pa.array(cells.ravel(), pa.int32()),
                            *(part.column(c).take(pa.array(rows)) for c in ("number", "id", "vector")),
                        ], ["table", "cell", "number", "id", "vector"])

    return run


def _best(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        vectors = vectors_of(table.column("vector"))
        order = np.argsort(ids, kind="stable")
        base = order[~asks[order]]
        base_ids, base_vectors = ids[base], vectors[base]
        each_id, first = np.unique(base_ids, return_index=True)
        out = [[], [], []]
        for at in range(0, int(asks.sum()) if len(base) else 0, 256):
            rows = np.flatnonzero(asks)[at : at + 256]
            near = vectors[rows] @ base_vectors.T
            for row, scores in zip(rows.tolist(), near):
                scores[base_ids == ids[row]] = -np.inf
                if len(each_id) > k:
                    # The k-th best id, not row: copies of one id take one place.
                    of_id = np.maximum.reduceat(scores, first)
                    last = np.partition(of_id, len(of_id) - k)[len(of_id) - k]
                    at_least = last - 1e-9 * max(1.0, abs(last)) if np.isfinite(last) else last
                    chosen = np.flatnonzero(scores >= at_least)
                else:
                    chosen = np.arange(len(scores))
                chosen = chosen[np.isfinite(scores[chosen])]
                # Row by row, so that equal vectors have exactly equal scores.
                exact = (base_vectors[chosen] * vectors[row]).sum(axis=1)
                best = chosen[np.argsort(-exact, kind="stable")]
                exact = -np.sort(-exact, kind="stable")
                _, once = np.unique(base_ids[best], return_index=True)
                once = np.sort(once)[:k]
                out[0].append(np.full(len(once), ids[row]))
                out[1].append(base_ids[best[once]])
                out[2].append(exact[once])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table(dict(zip(
            ("query_id", "vec_id", "score"),
            (np.concatenate([np.empty(0, t), *x]) for t, x in zip(kinds, out)))))

    return run


def nearest(
    table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding",
    k: int = 20, tables: int = 16, probes: int = 8,
    block_rows: int = 1024, block_queries: int = 512, seed: int = 11,
    exact_rows: int = 8192, exact_queries: int = 2048,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each row
    that ``queries`` holds for, searched in all rows; fewer only if there are no more
    candidates. ``exact_rows`` and ``exact_queries`` are the blocks of the exact search."""
    rows = written(
        table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"),
                     F.coalesce(queries, F.lit(False)).alias("asks"))
        .filter(usable("vector") & F.col("id").isNotNull())
        .groupBy("id", "vector").agg(F.max("asks").alias("asks"))
        .withColumn("number", F.monotonically_increasing_id()), "ann-rows")
    element = rows.schema["vector"].dataType.elementType.simpleString()
    schema = f"table int, cell int, number bigint, id bigint, vector array<{element}>"
    base = rows.select("number", "id", "vector").mapInArrow(_cells(tables, seed, 1), schema)
    asked = rows.filter("asks").select("number", "id", "vector")
    asked = asked.mapInArrow(_cells(tables, seed, probes), schema)
    # A row for each table and cell, 2 * width * tables at most for each width: broadcast only
    # while their written size is small.
    blocks = lambda side, name, size: written(
        side.groupBy("table", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name)), "ann-sizes")
    sizes = [blocks(base, "bases", block_rows), blocks(asked, "askers", block_queries)]

    def placed(side: DataFrame, own: str, other: str, ask: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("number"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        side = side.withColumn(own + "_at", mine).withColumn(other + "_at", each)
        return side.select("table", "cell", "bases_at", "askers_at", F.lit(ask).alias("ask"),
                           "id", "vector")

    def compared(base: DataFrame, asked: DataFrame) -> DataFrame:
        found = (
            placed(base, "bases", "askers", False).union(placed(asked, "askers", "bases", True))
            .groupBy("table", "cell", "bases_at", "askers_at")
            .applyInArrow(_best(k), "query_id bigint, vec_id bigint, score double")
        )
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    sized = lambda side: side.join(sizes[0], ["table", "cell"]).join(sizes[1], ["table", "cell"])
    found = written(compared(sized(base), sized(asked)), "ann-found")
    width = F.size("vector").alias("width")
    held = written(rows.groupBy(width).agg(
        F.count_distinct("id").alias("ids"), F.count("*").alias("vectors")), "ann-widths")
    # A query's own id is among the ids.
    met = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("met"))
    few = written(
        rows.filter("asks").select("number", "id", "vector", width).join(held, "width").join(met, "id", "left")
        .filter(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.col("ids") - 1))
        .select("number", "id", "vector", "width"), "ann-few")
    if few.limit(1).count():
        askers = few.groupBy("width").agg(F.ceil(F.count("*") / exact_queries).cast("int").alias("askers"))
        bases = held.select("width", F.ceil(F.col("vectors") / exact_rows).cast("int").alias("bases"))
        # All rows of a width are one cell, cut into blocks.
        sizes_of = bases.join(askers, "width")
        cut = lambda side: side.join(sizes_of, "width").select(
            (-F.col("width")).alias("table"), F.lit(0).alias("cell"), "number", "id", "vector",
            "bases", "askers")
        rows = rows.select("number", "id", "vector", width)
        whole = compared(cut(rows), cut(few))
        found = found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id",
                           "left_anti").union(whole)
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
