"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A text is encoded twice, by a byte-level BPE file of ``tokenizers`` (A) and by a
``sentencepiece`` model (B), both over a space and the text. A byte offset where a token of
each ends is a shared cut. An interval of tokens is divided at a shared cut near its middle:
the middle end of A is looked for among the ends of B by bisection, then its neighbours to
the left and right in turn, and both halves are divided again. An interval without a shared
cut inside is a leaf, a group. All intervals of one depth are divided together, on arrays.

Between two neighbouring ends of either side lies exactly one overlapping pair of tokens, a
link. How often an id pair is linked is counted over all texts: a block of texts reports
each of its distinct pairs once, so the counting shuffle does not carry every link, and a
block gets the counts of its own pairs back. A block is bounded by bytes of text; one longer
text is a block of its own, and memory grows with the longest text. No pair is held by the
driver; the highest count for each id of B, at most as many rows as B's vocabulary, is the
only broadcast.

Null and empty texts, and texts whose tokens do not spell the space and the text again, have
no tokens: zeros and an empty digest. Repeated rows and ids are rows of their own and count
each time. Ties for the highest count are all highest. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.batches import slices, texts_of
from tapeline.llm.pieces import (
    CODE_POINTS, END, PieceEncoder, byte_names, file_encoder, packed_classes, serial_library,
)
from tapeline.llm.shared import written

BLOCK_BYTES = 3 << 19
MOST_PIECES = 400_000


def before_blanks(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of pieces that ``sentencepiece`` never merges across: a blank after anything
    else. Its pieces hold blanks at their start only (``blanks_lead`` tests the model)."""
    blank = points == 0x20
    start = classes == END
    start[1:] |= classes[:-1] == END
    start[1:] |= blank[1:] & ~blank[:-1]
    start[0] = True
    return np.flatnonzero(start)


def blanks_lead(names: list[str]) -> bool:
    """Whether no piece of a vocabulary holds a blank after another character."""
    return not any("▁" in name.lstrip("▁") for name in names)


def _marked(encode: Callable, spelled: list[bytes]) -> Callable:
    """``encode``, but a piece that its tokens do not spell again has the one token -1."""
    def run(pieces: list[str]) -> list[list[int]]:
        found = encode(pieces)
        if b"".join([spelled[i] for ids in found for i in ids]) == "".join(pieces).encode("utf-8", "replace"):
            return found
        return [ids if b"".join([spelled[i] for i in ids]) == piece.encode("utf-8", "replace") else [-1]
                for piece, ids in zip(pieces, found)]

    return run


def piece_encoder(path: str) -> tuple[PieceEncoder, list[bytes]]:
    """An encoder for a ``sentencepiece`` BPE model that adds a blank to the text, and the
    bytes of each id. The texts it is given start with that blank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    alone = [model.piece_to_id("▁")]

    def encode(pieces: list[str]) -> list[list[int]]:
        # The library puts the first blank back, but to an empty text.
        found = model.encode([p[1:] for p in pieces], num_threads=1)
        return [ids if len(p) > 1 else alone for p, ids in zip(pieces, found)]

    def whole(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(classes == END)
        return np.unique(np.concatenate([[0], ends, ends[:-1] + 1]))

    spelled = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace("▁", " ").encode()
               for i in range(len(names))]
    cut = before_blanks if blanks_lead(names) else whole
    no_classes = np.zeros(CODE_POINTS, np.uint8)
    return PieceEncoder(_marked(encode, spelled), no_classes, MOST_PIECES, cut), spelled


def byte_encoder(path: str, classes: bytes) -> tuple[PieceEncoder, list[bytes]]:
    """An encoder for a file of byte-level BPE, and the bytes of each id."""
    serial_library()
    from tokenizers import Tokenizer

    byte_of = {c: b for b, c in enumerate(byte_names())}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    spelled = [b""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        if all(c in byte_of for c in name):
            spelled[i] = bytes(byte_of[c] for c in name)
    encoder = file_encoder(path, classes)
    encoder.encode, encoder.most_pieces = _marked(encoder.encode, spelled), MOST_PIECES
    return encoder, spelled


def shared_cuts(
    a_ends: np.ndarray, b_ends: np.ndarray,
    a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, in tokens of A and of B.

    ``a_ends`` and ``b_ends`` are rising byte offsets; the intervals, of one token or more on
    either side, end at shared cuts.
    """
    leaves: list[tuple[np.ndarray, np.ndarray]] = [(a_to[:0], b_to[:0])]
    while len(a_from):
        at, met = _near_middle(a_ends, b_ends, a_from, a_to, b_from, b_to)
        cut = at >= 0
        leaves.append((a_to[~cut], b_to[~cut]))
        at, met = at[cut] + 1, met[cut] + 1
        a_from, a_to = (np.stack(x, axis=1).ravel() for x in ((a_from[cut], at), (at, a_to[cut])))
        b_from, b_to = (np.stack(x, axis=1).ravel() for x in ((b_from[cut], met), (met, b_to[cut])))
    return tuple(np.sort(np.concatenate(side)) for side in zip(*leaves))


def _near_middle(a_ends, b_ends, a_from, a_to, b_from, b_to) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and B that end at a shared cut inside each interval, the one nearest
    to the middle token of A; -1 if there is none."""
    at, met = np.full(len(a_from), -1), np.full(len(a_from), -1)
    first, last = a_from, a_to - 2  # the last token ends with the interval
    middle = (a_from + a_to - 1) // 2
    open_ = np.flatnonzero((last >= first) & (b_to - b_from > 1))
    away = 0
    while len(open_):
        for side in (-away, away) if away else (0,):
            probe = middle[open_] + side
            k = np.flatnonzero((probe >= first[open_]) & (probe <= last[open_]) & (at[open_] < 0))
            probe, own = probe[k], open_[k]
            place = np.searchsorted(b_ends, a_ends[probe])
            hit = b_ends[place] == a_ends[probe]
            at[own[hit]], met[own[hit]] = probe[hit], place[hit]
        away += 1
        open_ = open_[(at[open_] < 0) & ((middle[open_] - away >= first[open_])
                                         | (middle[open_] + away <= last[open_]))]
    return at, met


class Aligned(NamedTuple):
    """Texts in a row. ``*_text``, ``*_cut``: ends of texts and of groups, in tokens."""

    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    groups: np.ndarray  # number of groups before the end of each text
    link_text: np.ndarray  # the text of each link
    link_a: np.ndarray  # its token of A, as a place in ``a``
    link_b: np.ndarray


class Aligner:
    """Both encoders of one Python worker."""

    def __init__(self, a_path: str, b_path: str, classes: bytes) -> None:
        self.a, self.a_bytes = byte_encoder(a_path, classes)
        self.b, self.b_bytes = piece_encoder(b_path)
        self.a_length, self.b_length = (np.array([len(x) for x in side], dtype=np.int64)
                                        for side in (self.a_bytes, self.b_bytes))
        # Decimal digits of each id, and room for what follows them.
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = np.array([list(str(i).ljust(len(str(most)) + 1).encode()) for i in range(most)],
                               dtype=np.uint8)
        self.digit_count = (self.digits != 0x20).sum(axis=1)

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or not spelled again by both sides, have no tokens."""
        shown = [" " + t for t in texts]
        a, a_text = self.a.encode_texts(shown)
        b, b_text = self.b.encode_texts(shown)
        a_size, b_size = np.diff(a_text, prepend=0), np.diff(b_text, prepend=0)
        good = np.array([t != "" for t in texts], dtype=bool)
        for ids, ends in ((a, a_text), (b, b_text)):
            good[np.searchsorted(ends, np.flatnonzero(ids < 0), "right")] = False
        if not good.all():
            a, b = a[np.repeat(good, a_size)], b[np.repeat(good, b_size)]
            a_size, b_size = a_size * good, b_size * good
            a_text, b_text = np.cumsum(a_size), np.cumsum(b_size)
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_cut, b_cut = shared_cuts(
            a_ends, b_ends, (a_text - a_size)[good], a_text[good],
            (b_text - b_size)[good], b_text[good])
        groups = np.searchsorted(a_cut, a_text, "right")
        # A link ends where a token of either side does.
        by_byte = np.zeros((2, int(a_ends[-1]) + 1 if len(a_ends) else 0), dtype=bool)
        by_byte[0, a_ends] = by_byte[1, b_ends] = True
        link_a, link_b = (np.cumsum(x) - x for x in by_byte[:, by_byte.any(axis=0)])
        links = a_size + b_size - np.diff(groups, prepend=0)
        return Aligned(a, b, a_text, b_text, a_cut, b_cut, groups,
                       np.repeat(np.arange(len(texts)), links), link_a, link_b)

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        ids = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        mark = np.full(len(ids), ord(","), dtype=np.uint8)
        a_at = np.arange(len(x.a)) + np.repeat(np.append(0, x.b_cut)[:-1], np.diff(x.a_cut, prepend=0))
        b_at = np.arange(len(x.b)) + np.repeat(x.a_cut, np.diff(x.b_cut, prepend=0))
        ids[a_at], ids[b_at] = x.a, x.b
        mark[a_at[x.a_cut - 1]], mark[b_at[x.b_cut - 1]] = ord("|"), ord(";")
        shown, count = self.digits[ids], self.digit_count[ids]
        shown[np.arange(len(ids)), count] = mark
        line = memoryview(shown[np.arange(shown.shape[1]) <= count[:, None]])
        ends = np.append(0, np.cumsum(count + 1))[x.a_text + x.b_text].tolist()
        return [hashlib.sha256(line[i : j - 1]).hexdigest() if j > i else ""
                for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, classes: bytes) -> Aligner:
    """One aligner for each pair of files and Python worker."""
    return Aligner(a_path, b_path, classes)


def groups(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, the ids ``a`` and ``b`` of each text, and ``a_cut`` and ``b_cut``, where its
    groups end, in tokens of either side."""
    classes = packed_classes()
    names = ("a", "b", "a_cut", "b_cut")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType),
                           *(T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = aligner(a_path, b_path, classes).align(texts_of(part, "text"))
            lists = [np.split(v, ends[:-1]) for v, ends in (
                (x.a, x.a_text), (x.b, x.b_text), (x.a_cut, x.groups), (x.b_cut, x.groups))]
            for cuts, ends in ((lists[2], x.a_text), (lists[3], x.b_text)):
                cuts[:] = [c - first for c, first in zip(cuts, [0, *ends.tolist()])]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), *(pa.array([v.astype(np.int32) for v in x], pa.list_(pa.int32()))
                                       for x in lists)], ["key", *names])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _blocks(a_path: str, b_path: str, classes: bytes, key_type: pa.DataType):
    """Rows of texts, with their distinct pairs as rising places (differences) in their
    block's list and how often each is linked; then a row for the block with that list."""
    def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, kind))

    def of(part: pa.RecordBatch, own: Aligner, block: int) -> list[pa.RecordBatch]:
        x = own.align(texts_of(part, "text"))
        size = part.num_rows
        codes, pairs = pd.factorize(x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b])
        held, times = np.unique(x.link_text * max(1, len(pairs)) + codes, return_counts=True)
        holder, place = np.divmod(held, max(1, len(pairs)))
        ends = np.searchsorted(holder, np.arange(size), "right")
        steps = np.diff(place, prepend=0)
        first = np.append(True, holder[1:] != holder[:-1])[: len(holder)]
        steps[first] = place[first]
        rows = pa.RecordBatch.from_arrays([
            pa.array(np.full(size, block)), part.column("key"),
            pa.array(np.diff(x.a_text, prepend=0), pa.int64()),
            pa.array(np.diff(x.b_text, prepend=0), pa.int64()),
            pa.array(np.diff(x.groups, prepend=0), pa.int64()),
            pa.array(np.bincount(x.link_text, minlength=size), pa.int64()),
            pa.array(own.digests(x), pa.string()),
            lists(steps, ends, pa.int32()), lists(times, ends, pa.int32()),
            pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.list_(pa.int64())),
        ], _COLUMNS)
        none = [pa.nulls(1, k) for k in (
            key_type, *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 2)]
        return [rows, pa.RecordBatch.from_arrays([
            pa.array([block]), *none, lists(pairs, np.array([len(pairs)]), pa.int64()),
            lists(np.bincount(codes, minlength=len(pairs)), np.array([len(pairs)]), pa.int64())], _COLUMNS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path, classes)
        block = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", BLOCK_BYTES):
            # The arrays of a block are gone before those of the next are made.
            yield from of(part, own, block)
            block += 1

    return run


_COLUMNS = ["block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times",
            "pairs", "links"]


def linked(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """The blocks, written: see ``_blocks``."""
    kind = docs.schema[key].dataType
    longs = [T.StructField(n, T.LongType()) for n in _COLUMNS[2:6]]
    ints, many = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False)
    schema = T.StructType([
        T.StructField("block", T.LongType(), False), T.StructField("key", kind), *longs,
        T.StructField("groups_sha256", T.StringType()), T.StructField("steps", ints),
        T.StructField("times", ints), T.StructField("pairs", many), T.StructField("links", many)])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    run = _blocks(a_path, b_path, packed_classes(), to_arrow_type(kind))
    return written(rows.mapInArrow(run, schema), "alignment")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a``, ``b``, ``pair`` (both in one long), ``links`` over all texts, and whether that is
    the highest for the id of B."""
    pair = F.col("pair")
    counts = written(
        _exploded(blocks).groupBy(pair).agg(F.sum("links").alias("links")), "pairs"
    ).select(F.shiftright(pair, 32).cast("int").alias("a"),
             pair.bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), pair, "links")
    # A row for each id of B's vocabulary at most: the bound of this broadcast.
    highest = counts.groupBy("b").agg(F.max("links").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select(
        "a", "b", "pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def _exploded(blocks: DataFrame) -> DataFrame:
    return blocks.filter("pairs is not null").select(
        "block", F.posexplode(F.arrays_zip("pairs", "links")).alias("place", "x")
    ).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))


def _weigh(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over each text's links from the counts of its block's pairs."""
    size = pairs.num_rows
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = pairs.column("place").to_numpy()
    count[place] = pairs.column("links").to_numpy()
    best[place] = pairs.column("best").to_numpy().astype(np.int64)
    steps = rows.column("steps").combine_chunks()
    ends = np.asarray(steps.offsets)[1:] - steps.offsets[0].as_py()
    moved = np.asarray(steps.flatten(), dtype=np.int64)
    times = np.asarray(rows.column("times").combine_chunks().flatten(), dtype=np.int64)
    run = np.cumsum(moved)
    starts = np.append(0, ends[:-1])
    before = np.append(0, run)[starts]
    held = run - np.repeat(before, ends - starts)

    def sums(values: np.ndarray) -> pa.Array:
        total = np.append(0, np.cumsum(values[held] * times))
        return pa.array(total[ends] - total[starts])

    kept = [rows.column(c) for c in ("key", *_COLUMNS[2:6])]
    return pa.table([*kept, sums(best), sums(count), rows.column("groups_sha256")], names=_RESULT)


_RESULT = ["key", *_COLUMNS[2:6], "n_best", "count_sum", "groups_sha256"]


def aligned(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the
    highest count of its id of B), ``count_sum`` (the counts of all links) and the digest of
    the groups, for every row."""
    blocks = linked(docs, a_path, b_path, key, text)
    weighed = pair_counts(blocks).select("pair", "links", "best")
    back = _exploded(blocks).drop("links").join(weighed, "pair").select(
        "block", "place", "links", "best")
    rows = blocks.filter("pairs is null").select(F.col("block").alias("of"), *_COLUMNS[1:9])
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType),
        *(T.StructField(n, T.LongType()) for n in _RESULT[1:-1]),
        T.StructField("groups_sha256", T.StringType())])
    return rows.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(
        _weigh, schema).withColumnRenamed("key", key)
