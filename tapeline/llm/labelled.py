"""Bounded samples of labelled rows, and the single task that fits a model on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.batches import texts_of


def remainder(key: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def sample(
    docs: DataFrame, labels: DataFrame, label: str, fold, most: int, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``text`` and ``label`` of at most ``most`` labelled rows for each of the two labels.

    ``fold`` says which ids may be learned from. Of several labels for an id the largest
    counts; null labels and ids count as none. The choice is by a hash of the id, the same
    on every run.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & fold)
        .groupBy(key).agg(F.max(label).cast("int").alias("label"))
        .join(docs.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")
    )
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # 2 * most ids and labels: the bound of this broadcast.
    return (
        docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), key)
        .groupBy(key).agg(F.min("text").alias("text"), F.first("label").alias("label"))
        .select("text", "label")
    )


def fitted(rows: DataFrame, column: str, fit: Callable[[list, list[int]], bytes]) -> bytes:
    """What ``fit`` makes of ``column`` and ``label`` of the bounded sample, in one task on an
    executor, in an order that depends on the rows alone. Lists come as arrays, which are
    views of the batches that the task gets, so the sample is in memory once."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels = [], []
        for batch in batches:
            own += _values(batch, column)
            labels += batch.column("label").to_pylist()
        if own:
            order = _order(own, labels)
            model = fit([own[k] for k in order], [labels[k] for k in order])
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = rows.select(column, "label").repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit([], [])


def _values(batch: pa.RecordBatch, name: str) -> list:
    column = batch.column(name)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return texts_of(batch, name)
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def _order(own: list, labels: list[int]) -> list[int]:
    """Row numbers by bytes, then by label. Whole rows are only compared where their
    beginnings are equal."""
    begin = lambda k: _sortable(own[k][:64])
    return [k for _, alike in groupby(sorted(range(len(own)), key=begin), begin)
            for k in sorted(alike, key=lambda k: (_sortable(own[k]), labels[k]))]


def _sortable(value) -> bytes:
    return value.encode("utf-8", "replace") if isinstance(value, str) else value.tobytes()
