"""SimHash fingerprints and exact near-duplicate groups by vantage-point trees.

Two fingerprints within 3 bits have a 32-bit half within 1 bit. For each half a
vantage-point tree is fixed from a bounded sample of fingerprints: every level has a
vantage point, and a node sends a half to its near side if its Hamming distance is at most
the node's median. A fingerprint is stored in one leaf of each tree. As a query it visits
every leaf whose region its ball of radius 1 touches: by the triangle inequality the far
side can be pruned unless the distance is within 1 of the median. The leaves are the shards
of the search; those with many rows are cut into blocks, and every block pair is compared
in full width, so the pairs are exact.

Equal fingerprints are searched once. Out of a task come edges that connect what its pairs
connect, never all pairs.

Null and empty texts, and texts without words, have fingerprint 0, which links as any
other. Repeated rows get the same fingerprint. A null id is carried but is never the
smallest id of a group unless it has no other. Texts are taken whole, in parts of 2 ** 16
shingles, so the memory of a long one is that of its words. An empty table gives an empty
result. Other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.batches import slices, texts_of
from tapeline.llm.components import components, stars
from tapeline.llm.shared import written

SEED = 42
# Levels of a tree: its medians take 2 ** DEEPEST bytes and go along with the tasks.
DEEPEST = 22


def fingerprint(text: str, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, dtype=np.int64)
    total, most = len(words) - width + 1, 1 << 16
    parts = []
    for shingle in shingles:
        parts.append(digest(shingle, SEED))
        if len(parts) == most:
            ones += _ones(parts)
            parts = []
    if parts:
        ones += _ones(parts)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _ones(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8)).reshape(-1, 64)
    # Sums of bytes first: eight shares of at most 255 rows each fit a byte.
    whole = len(bits) // 255 * 255
    sums = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``key`` and ``bits``, the fingerprint as a signed long, and the columns of ``carry``."""
    schema = T.StructType([docs.schema[key], T.StructField("bits", T.LongType(), False),
                           *(docs.schema[c] for c in carry)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = np.fromiter(map(fingerprint, texts_of(part, text)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(found.view(np.int64)), *map(part.column, carry)],
                [key, "bits", *carry])

    return docs.select(key, text, *carry).mapInArrow(run, schema)


class VantageTree:
    """A tree over 32-bit values. All nodes of a level share a vantage point; each node has
    its own median, taken from the sample that reaches it."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        pool = sample if len(sample) else np.zeros(1, dtype=np.uint32)
        self.points = rng.choice(pool, size=depth).astype(np.uint32)
        self.medians: list[np.ndarray] = []
        at = np.zeros(len(pool), dtype=np.int64)
        for level, point in enumerate(self.points):
            far = np.bitwise_count(pool ^ point).astype(np.int64)
            medians = np.full(1 << level, 16, dtype=np.int8)
            order = np.lexsort((far, at))
            nodes, first = np.unique(at[order], return_index=True)
            last = np.append(first[1:], len(order))
            medians[nodes] = far[order[(first + last - 1) // 2]]
            self.medians.append(medians)
            at = 2 * at + (far > medians[at])

    def leaves(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves that the balls around the values touch."""
        rows, at = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
        for point, medians in zip(self.points, self.medians):
            far = np.bitwise_count(values[rows] ^ point).astype(np.int64)
            middle = medians[at]
            near_side, far_side = far - radius <= middle, far + radius > middle
            rows = np.concatenate([rows[near_side], rows[far_side]])
            at = np.concatenate([2 * at[near_side], 2 * at[far_side] + 1])
        return rows, at


def halves(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = bits.view(np.uint64)
    return (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)


def _shards(trees: list[VantageTree], radius: int) -> Callable:
    """Rows of (leaf, visits, bits): the leaf a fingerprint is stored in and those that it
    visits as a query. Leaves are numbered over both trees."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                bits = batch.column("bits").slice(at, 4096).to_numpy(zero_copy_only=False)
                for t, (tree, half) in enumerate(zip(trees, halves(bits))):
                    own = np.empty(len(bits), dtype=np.int64)
                    rows, leaves = tree.leaves(half, 0)
                    own[rows] = leaves
                    rows, leaves = tree.leaves(half, radius)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(leaves * len(trees) + t, pa.int32()),
                        pa.array(leaves != own[rows]),
                        pa.array(bits[rows]),
                    ], ["leaf", "visits", "bits"])

    return run


def _compare(most: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        bits = table.column("bits").to_numpy().view(np.uint64)
        stored = table.column("stored").to_numpy(zero_copy_only=False)
        asking = table.column("asking").to_numpy(zero_copy_only=False)
        base, asks = np.flatnonzero(stored), np.flatnonzero(asking)
        left, right = [], []
        step = max(1, (1 << 21) // max(1, len(base)))
        for at in range(0, len(asks), step):
            part = asks[at : at + step]
            i, j = np.nonzero(np.bitwise_count(bits[part][:, None] ^ bits[base]) <= most)
            left.append(part[i])
            right.append(base[j])
        i = np.concatenate([np.empty(0, np.int64), *left])
        j = np.concatenate([np.empty(0, np.int64), *right])
        values, place = np.unique(bits, return_inverse=True)
        i, j = place[i], place[j]
        u, v = stars(values, i[i != j], j[i != j])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def near_pairs(
    prints: DataFrame, most: int = 3, sample_rows: int = 20_000, leaf_rows: int = 512,
    block_rows: int = 1024, seed: int = 5,
) -> DataFrame:
    """Edges ``u``, ``v`` of different fingerprints (column ``bits``, each once) that connect
    exactly those within ``most`` bits, directly or over others.

    ``sample_rows`` bounds the fingerprints that fix the trees. The depth of the trees grows
    with the number of fingerprints, for leaves of about ``leaf_rows``, up to ``DEEPEST``; below
    the depth that the sample reaches, a node's median is that of 32 random bits.
    """
    total = prints.count()
    depth = max(1, min(DEEPEST, int(np.ceil(np.log2(max(2, total / leaf_rows))))))
    chosen = prints.orderBy(F.xxhash64("bits"), "bits").limit(sample_rows)
    sample = np.array([r["bits"] for r in chosen.collect()], dtype=np.int64)
    trees = [VantageTree(half, depth, seed + t) for t, half in enumerate(halves(sample))]
    shards = written(
        prints.mapInArrow(_shards(trees, most // 2), "leaf int, visits boolean, bits bigint"),
        "shards")
    sizes = shards.groupBy("leaf").agg(
        F.ceil(F.count(F.when(~F.col("visits"), 1)) / block_rows).cast("int").alias("bases"),
        F.ceil(F.count("*") / block_rows).cast("int").alias("askers"))
    # A row for each leaf, some for each leaf_rows fingerprints: broadcast only while its written
    # size is small.
    placed = shards.join(written(sizes.filter("bases > 0"), "leaves"), "leaf")
    mine = lambda n: F.pmod(F.xxhash64("bits"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.select("leaf", every("bases").alias("base"), mine("askers").alias("asker"),
                           "bits", F.lit(False).alias("stored"), F.lit(True).alias("asking"))
    stored = placed.filter("not visits").select(
        "leaf", mine("bases").alias("base"), every("askers").alias("asker"),
        "bits", F.lit(True).alias("stored"), F.lit(False).alias("asking"))
    return (
        asking.union(stored).groupBy("leaf", "base", "asker")
        .applyInArrow(_compare(most), "u bigint, v bigint").distinct()
    )


def _rooted(groups: DataFrame, most: int = 3, **search: int) -> DataFrame:
    """``groups`` (``bits``, each once, and ``id``) with the ``root`` of their component."""
    groups = written(groups, "groups")
    pairs = near_pairs(groups.select("bits"), most, **search)
    rooted = groups.join(components(pairs), F.col("bits") == F.col("node"), "left").select(
        "bits", "id", F.coalesce("component", "bits").alias("root"))
    return written(rooted, "roots")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3, **search: int
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row."""
    prints = written(fingerprints(docs, key, text), "fingerprints")
    rooted = _rooted(prints.groupBy("bits").agg(F.min(key).alias("id")), most, **search)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = rooted.join(least, "root").select("bits", "component_id")
    labels = written(labels, "labels")
    return prints.join(labels, "bits").select(
        key, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each SimHash group: that of the smallest id, then fingerprint,
    then digest of the text. A row without an id stays if no row of its group has one."""
    row = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                      F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    prints = written(fingerprints(row, "id", "text", ("digest",)), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "bits", "digest"))
    groups = _rooted(prints.groupBy("bits").agg(first.alias("id")))
    chosen = written(
        groups.groupBy("root").agg(F.min("id").alias("id")).select(
            "root", F.col("id.id").alias("id"), F.col("id.digest").alias("digest")), "chosen")
    # The caller's columns go along as one, so that no name of theirs meets one of ours. Texts
    # of one digest have one fingerprint, so a row meets one group at most.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("own"),
                       F.sha2(F.col(text).cast("binary"), 256).alias("own_digest"))
    met = rows.join(chosen, F.col("own").eqNullSafe(F.col("id"))
                    & F.col("own_digest").eqNullSafe(F.col("digest")))
    return met.dropDuplicates(["root"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
