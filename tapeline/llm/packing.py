"""Packing by powers of two.

The ids of a document, with the closing id, are cut into pieces of the largest size and
then into the powers of two of what is left. Every piece is a sequence of its own, so no
sequence crosses documents and none is padded. Sequences of equal length form a bucket:
their ids lie in one range, and ``write_buckets`` puts them into one folder.

Ids are those of the library without special tokens around a text; the string of an added
token inside a text is that token, as the library has it. Null and empty texts give the
closing id alone, one piece of length 1. Repeated rows are packed row by row. Texts are
packed whole; memory grows with the longest. An empty table gives an empty result. Columns
other than the key and the text are ignored, whatever their names. No row is moved: the plan
has no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.batches import slices, texts_of
from tapeline.llm.pieces import AddedTokens, file_encoder, packed_classes

# 2^33 rows in a partition, below them; 2^25 partitions; the bucket above both.
BUCKET_SHIFT = 58


@lru_cache(maxsize=4)
def encoder(path: str, classes: bytes) -> AddedTokens:
    """One encoder for each file and Python worker."""
    return AddedTokens(path, file_encoder(path, classes))


def decompose(total: int, largest: int) -> list[int]:
    """Piece lengths of a document: full pieces, then falling powers of two."""
    rest = total % largest
    return [largest] * (total // largest) + [
        1 << k for k in range(largest.bit_length() - 1, -1, -1) if rest >> k & 1
    ]


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    largest: int = 1024, closing: int = 0, with_ids: bool = True,
) -> DataFrame:
    """A row for each piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``ids`` (if asked for), ``bucket`` (log2 of the length), ``sequence_id`` and ``offset``.

    ``largest`` must be a power of two.
    """
    if largest & (largest - 1) or largest < 1:
        raise ValueError("the largest piece must be a power of two")
    classes = packed_classes()
    longs = ("start", "length", "ids_crc32", "doc_tokens")
    fields = [docs.schema[key], *(T.StructField(n, T.LongType(), False) for n in longs)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False), False))
    schema = T.StructType(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids, ends = encoder(tokenizer, classes).encode_texts(texts_of(part, text))
            row, start, length, crc, total, cuts = [], [], [], [], [], []
            first = 0
            for k, end in enumerate(ends.tolist()):
                own = np.append(ids[first:end], closing).astype("<u4")
                first, at = end, 0
                for n in decompose(len(own), largest):
                    row.append(k)
                    start.append(at)
                    length.append(n)
                    total.append(len(own))
                    crc.append(zlib.crc32(own[at : at + n]))
                    if with_ids:
                        cuts.append(own[at : at + n].astype(np.int32))
                    at += n
            columns = [part.column(key).take(pa.array(row, pa.int64())),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array(cuts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    bucket = F.log2("length").cast("int")
    return (
        docs.select(key, text).mapInArrow(run, schema)
        .withColumn("bucket", bucket)
        .withColumn("sequence_id", F.shiftleft(bucket.cast("long"), BUCKET_SHIFT)
                    + F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences of equal length into one folder each, ``bucket=K``.

    Each task writes its own file to each folder: nothing is shuffled, and a bucket with
    most of the rows is as many files as there are tasks.
    """
    packed.write.partitionBy("bucket").parquet(path)
