"""Byte-level BPE encoding and decoding over Arrow batches.

``ranks`` is a file of byte strings and their ranks. The library works on text, so bytes
are written as characters (the byte table), the merges are recovered from the ranks, and
decoding reverses the byte table. Texts are cut by the public pattern first; every piece
is encoded alone, whole pieces of the vocabulary by their own id.

Null and empty texts have no tokens. Repeated rows and ids are encoded row by row. Texts
are processed whole; a text is one row of one batch, and memory grows with the longest. An
empty table gives an empty result. Columns other than the key and the text are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.batches import slices, texts_of
from tapeline.llm.pieces import (
    PieceEncoder, byte_names, packed_classes, serial_library, unpacked,
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens whose joined bytes are a token, by the joined token's rank."""
    found = []
    for token in sorted(ranks, key=ranks.get):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                found.append((token[:i], token[i:]))
    return found


class Codec:
    """Encodes and decodes lists of texts with the ranks of one file."""

    def __init__(self, path: str, classes: bytes) -> None:
        serial_library()
        from tokenizers import Tokenizer, decoders, models

        ranks = read_ranks(path)
        table = byte_names()
        shown = {t: "".join(table[b] for b in t) for t in ranks}
        model = models.BPE(
            vocab={shown[t]: r for t, r in ranks.items()},
            merges=[(shown[a], shown[b]) for a, b in merges_of(ranks)],
            ignore_merges=True,
        )
        self.tokenizer = Tokenizer(model)
        self.tokenizer.decoder = decoders.ByteLevel()
        self.byte_of = {c: b for b, c in enumerate(table)}
        to_table = str.maketrans({chr(b): c for b, c in enumerate(table)})

        def encode(pieces: list[str]) -> list[list[int]]:
            written = [p.encode("utf-8").decode("latin-1").translate(to_table) for p in pieces]
            return [e.ids for e in
                    self.tokenizer.encode_batch_fast(written, add_special_tokens=False)]

        self.pieces = PieceEncoder(encode, unpacked(classes))
        size = max(ranks.values()) + 1
        self.bytes_of = np.empty(size, dtype=object)
        self.decimal = np.array([str(i).encode() for i in range(size)], dtype=object)
        for name, rank in self.tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(self.byte_of[c] for c in name)
        self.length = np.array([len(b or b"") for b in self.bytes_of], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.pieces.encode_texts(texts)
        return np.split(ids, ends[:-1]) if len(texts) else []

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. A token may hold a part of a character."""
        return b"".join(self.bytes_of[ids].tolist())

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids. Parts of a character wait for the rest of it; bytes that
        never become a character are shown as U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        parts = [reader.decode(b) for b in self.bytes_of[ids].tolist()]
        return "".join(parts) + reader.decode(b"", final=True)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token. Tokens that share a split
        character all cover it."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        if not len(ids):
            return starts, ends
        return character[starts], character[ends - 1] + 1


@lru_cache(maxsize=4)
def codec(path: str, classes: bytes) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path, classes)


def encode(
    docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", offsets: bool = True
) -> DataFrame:
    """``key``, ``ids`` and, if asked for, the character offsets ``starts`` and ``ends``."""
    ints = T.ArrayType(T.IntegerType(), False)
    classes = packed_classes()
    names = ("ids", "starts", "ends") if offsets else ("ids",)
    schema = T.StructType([docs.schema[key], *(T.StructField(n, ints, False) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            own, texts = codec(ranks, classes), texts_of(part, text)
            ids = own.encode(texts)
            lists = [ids]
            if offsets:
                lists += zip(*(own.offsets(t, i) for t, i in zip(texts, ids)))
            columns = [pa.array([a.astype(np.int32) for a in x], pa.list_(pa.int32()))
                       for x in lists]
            yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, *names])

    return docs.select(key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` from lists of ids; null lists give null texts."""
    classes = packed_classes()
    schema = T.StructType([encoded.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(ranks, classes)
            found = [None if i is None else own.decode(np.asarray(i, dtype=np.int64))
                     for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())],
                                             [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encodes, decodes, and returns digests instead of the ids and bytes, so that neither
    leaves the task: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    classes = packed_classes()
    schema = T.StructType([
        docs.schema[key],
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            own = codec(ranks, classes)
            ids = own.encode(texts_of(part, text))
            listed = [hashlib.sha256(b",".join(own.decimal[i].tolist())).hexdigest() for i in ids]
            decoded = [hashlib.sha256(own.decode_bytes(i)).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(map(len, ids), pa.int64()),
                 pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                schema.fieldNames(),
            )

    return docs.select(key, F.col(text)).mapInArrow(run, schema)
