"""Spelling variants by Bloom-guided neighbourhoods.

Words of a corpus are counted, and the vocabulary goes into blocked Bloom filters, one shard
for each length, which are broadcast. Every word generates its edits, deletions and
replacements (an insertion is the deletion of the other word; of two words that replace each
other only one asks). An edit is never written to be looked up: its hash follows from the
hash of the word and the place. Only edits that the filter of their length knows become
rows, and an exact join with the vocabulary removes the false ones. So every pair of near
words is found, and found once.

``FILTER_BYTES`` bounds the filters, whatever the vocabulary: they hold ``KEY_BITS`` for each
word as long as that fits and fewer beyond it, which lets more false edits into the join and
changes nothing else. A word has at most as many near words as it has edits.

A form is a near word that is at least ``FACTOR`` times as frequent, so chains of forms rise
and end; they are followed by joins that double the step, some five for any corpus.

Null and empty texts have no words. A null id counts as the empty text in the choice of
deletions. Repeated rows count again. Ties between forms go to the smallest in code-point
order. An empty table gives an empty result. Very long words are words as any other. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.batches import slices, spans, texts_of
from tapeline.llm.shared import written

# The letters of words, A-Z lower-cased.
LETTERS = "".join(map(chr, (*range(0x61, 0x7B), *range(0xC0, 0x100))))
LEAST_LENGTH, LEAST_COUNT, FACTOR, ERASE = 7, 2, 10, 31

FILTER_BYTES, KEY_BITS, LEAST_SHARD = 64 << 20, 24, 1 << 10
LONG = 64  # words of this length or more share a shard
PIECE = 1 << 14  # words of a filter built in one group
TASK_WORDS = 1 << 15  # words whose edits one task generates
MEMORY = 200_000  # words counted in a task before they are sent on

_ODD = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_ODD, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(name: str, text: str, runs: re.Pattern, least: int, erase: int) -> Counter:
    """The words of a text, of ``least`` letters or more, with one letter erased in some."""
    found = Counter(runs.findall(text.encode("utf-8", "replace").lower().decode("utf-8")))
    start = zlib.crc32(f"{name}:".encode())
    counts: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % erase == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            counts[run] += n
    return counts


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, erase: int = ERASE,
) -> DataFrame:
    """``word`` and ``n``: the words of all texts with their occurrences, counted first in
    each task and then over all of them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs never become words: erasing only shortens.
        runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for part in slices(batches, "text"):
            for name, own in zip(part.column("name").to_pylist(), texts_of(part, "text")):
                counts.update(words_of(name, own, runs, least, erase))
                if len(counts) >= MEMORY:
                    yield flush()
                    counts.clear()
        yield flush()

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return (
        docs.select(name.alias("name"), F.col(text).alias("text"))
        .mapInArrow(run, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    )


class Words:
    """Words of a batch as arrays over all their letters."""

    def __init__(self, words: list[str], letters: str) -> None:
        place = np.zeros(max(map(ord, letters)) + 1, dtype=np.int64)
        place[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = _mix(np.arange(1, len(letters) + 1, dtype=np.uint64) * np.uint64(_ODD))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.codes = place[points]
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(points)) - self.first[self.word]
        powers = np.full(int(self.size.max(initial=0)) + 1, _ODD, dtype=np.uint64)
        powers[0] = 1
        self.power = np.cumprod(powers)[self.place]
        self.before = np.append(np.uint64(0), np.cumsum(self.letters[self.codes] * self.power))
        self.total = self.before[self.first + self.size] - self.before[self.first]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters whose deletions are all different texts, and the hashes of these."""
        at = np.flatnonzero((self.place == 0) | (self.codes != np.roll(self.codes, 1)))
        own = self.word[at]
        head = self.before[at] - self.before[self.first[own]]
        return at, head + (self.total[own] - head - self.letters[self.codes[at]] * self.power[at]) * _BACK

    def replacements(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the letters from ``start`` to ``stop``: each with every later letter of the
        alphabet that may take its place, and the hash of that text."""
        codes = self.codes[start:stop]
        count = len(self.letters) - 1 - codes
        at = np.repeat(np.arange(start, stop), count)
        new = spans(codes + 1, count)
        moved = (self.letters[new] - self.letters[self.codes[at]]) * self.power[at]
        return at, new, self.total[self.word[at]] + moved


def _cells(hashes: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each text in the shard of its length and its five bits there."""
    x = _mix(hashes + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    one, mask = np.uint64(1), np.zeros(len(x), dtype=np.uint64)
    for k in range(0, 30, 6):
        mask |= one << (x >> np.uint64(k) & np.uint64(63))
    return (x >> (np.uint64(64) - bits[np.minimum(size, LONG)])).astype(np.int64), mask


class Filters:
    """Shards by length, one after the other: ``bits`` is the logarithm of a shard's cells."""

    def __init__(self, counts: dict[int, int], most_bytes: int, key_bits: int = KEY_BITS) -> None:
        while True:
            cells = {s: 1 << max(LEAST_SHARD.bit_length() - 1, (int(n * key_bits) // 64).bit_length())
                     for s, n in counts.items()}
            if sum(cells.values()) * 8 <= most_bytes or key_bits < 1 / 64:
                break
            key_bits /= 2
        self.bits = np.full(LONG + 1, 1, dtype=np.uint64)
        self.offset = np.full(LONG + 1, -1, dtype=np.int64)
        self.words, self.cells = sum(counts.values()), 0
        for shard in sorted(cells):
            self.bits[shard] = cells[shard].bit_length() - 1
            self.offset[shard] = self.cells
            self.cells += cells[shard]

    def knows(self, filled: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        cell, mask = _cells(hashes, size, self.bits)
        offset = self.offset[np.minimum(size, LONG)]
        return (offset >= 0) & (filled[np.maximum(offset, 0) + cell] & mask == mask)


def filled(vocab: DataFrame, letters: str = LETTERS, most_bytes: int = FILTER_BYTES
           ) -> tuple[Filters, np.ndarray]:
    """The filters of a vocabulary. Bits that share a cell are joined before they are sent,
    groups fill pieces of the filters, and the driver receives at most ``most_bytes``."""
    shard = F.least(F.length("word"), F.lit(LONG))
    counts = {r["shard"]: r["n"] for r in  # LONG rows at most
              vocab.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    filters = Filters(counts, most_bytes)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word"):
            words = Words(part.column("word").to_pylist(), letters)
            cell, mask = _cells(words.total, words.size, filters.bits)
            cell += filters.offset[np.minimum(words.size, LONG)]
            yield pa.RecordBatch.from_pydict({"cell": cell, "mask": mask.view(np.int64)})

    def fill(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        piece = int(cell[0]) // PIECE
        own = np.zeros(PIECE, dtype=np.int64)
        own[cell - piece * PIECE] = table.column("mask").to_numpy()
        return pa.table({"piece": pa.array([piece], pa.int64()), "own": pa.array([own.tobytes()])})

    bits = vocab.select("word").mapInArrow(cells, "cell long, mask long").groupBy("cell").agg(
        F.bit_or("mask").alias("mask"))
    pieces = bits.groupBy(F.floor(F.col("cell") / PIECE)).applyInArrow(fill, "piece long, own binary")
    whole = np.zeros(-(-filters.cells // PIECE) * PIECE, dtype=np.uint64)
    for row in pieces.toLocalIterator():
        at = row["piece"] * PIECE
        whole[at : at + PIECE] = np.frombuffer(row["own"], dtype=np.uint64)
    return filters, whole


def near_words(
    vocab: DataFrame, letters: str = LETTERS, most_bytes: int = FILTER_BYTES
) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: all pairs of words of ``vocab`` (``word``, each
    once, of ``letters``, and ``n``) that differ by one inserted, deleted or replaced letter,
    in both directions."""
    filters, whole = filled(vocab, letters, most_bytes)
    known = vocab.sparkSession.sparkContext.broadcast(whole)
    tasks = max(1, -(-filters.words // TASK_WORDS))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = (1 << 19) // len(letters)
        for part in slices(batches, "word", 1 << 18):
            names = part.column("word").to_pylist()
            words = Words(names, letters)
            at, hashes = words.deletions()
            own = words.word[at]
            hit = np.flatnonzero(filters.knows(known.value, hashes, words.size[own] - 1))
            found = [(at[hit], np.full(len(hit), -1))]
            for start in range(0, len(words.codes), step):
                at, new, hashes = words.replacements(start, min(len(words.codes), start + step))
                hit = np.flatnonzero(filters.knows(known.value, hashes, words.size[words.word[at]]))
                found.append((at[hit], new[hit]))
            for at, new in found:
                rows, place = words.word[at].tolist(), words.place[at].tolist()
                put = ["" if c < 0 else letters[c] for c in new.tolist()]
                near = [names[r][:i] + c + names[r][i + 1 :] for r, i, c in zip(rows, place, put)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(rows, pa.int64())) for c in ("word", "n")),
                     pa.array(near, pa.string())], ["word", "n", "near"])

    asked = vocab.select("word", "n").repartition(tasks, "word").mapInArrow(probe, "word string, n long, near string")
    met = asked.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    one = F.struct("word", "n", "near", "near_n")
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"),
                     F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.select(F.explode(F.array(one, other)).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every word that has a form: ``forms`` holds ``word`` and
    ``form``, without cycles. The step doubles in each round."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR,
    most_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word."""
    vocab = written(vocabulary(docs, key, text), "vocabulary")
    best = near_words(vocab, most_bytes=most_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    risen = -F.col("best.n") >= factor * F.col("n")
    formed = written(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(risen, F.col("best.near")).alias("form"),
        F.when(risen, -F.col("best.n")).alias("form_n")), "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
