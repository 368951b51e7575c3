"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits (in lower case) and of bytes above 127. The
features of a text are its words, its pairs of neighbours and its pairs with one word
between, each hashed into ``2 ** BITS`` coordinates and present or not. The learner
has a rate for each coordinate and an L1 penalty, so most weights are exactly zero, and the
rest are a short list that goes along with the tasks that score.

Training shows ``EXAMPLES`` texts to the learner, round after round of the sample, whatever
its size.

Every text is scored whole, a word of any length as one word. Null and empty texts have no
features and get the score of the bias alone. Without labels the model is empty and every
score is 0.5 less a hair, predicted 0. Repeated rows are scored row by row. An empty table
gives an empty result. Columns of ``docs`` other than the key and the text are carried or
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.batches import slices, texts_of
from tapeline.llm.labelled import fitted, remainder, sample

BITS = 20
CHUNK = 1 << 20
EXAMPLES = 16_000
_ODD = 0x9E3779B97F4A7C15
_SPAN = pow(_ODD, CHUNK, 1 << 64)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[65:91] = True
    word[128:] = True
    return lower, word


_LOWER, _WORD = _byte_classes()
_POWER = np.full(CHUNK + 1, _ODD, dtype=np.uint64)
_BACK = np.full(CHUNK + 1, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
_POWER[0] = _BACK[0] = 1
_POWER, _BACK = np.cumprod(_POWER), np.cumprod(_BACK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _terms(raw: np.ndarray) -> np.ndarray:
    """What each byte adds to the hash of its word, counted from the start of ``raw``."""
    return (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _POWER[: len(raw)]


def _part_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most ``CHUNK`` bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_terms(raw), out=prefix[1:])
    return _mix((prefix[ends] - prefix[starts]) * _BACK[starts]), starts


def _long_word(raw: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, by sums over its parts."""
    total, scale = 0, 1
    for at in range(0, len(raw), CHUNK):
        total += scale * int(_terms(raw[at : at + CHUNK]).sum(dtype=np.uint64))
        scale = scale * _SPAN % (1 << 64)
    return _mix(np.array([total % (1 << 64)], dtype=np.uint64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer. Buffers are taken in parts that end between
    words; a word longer than a part is a part of its own."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        stop = min(len(raw), at + CHUNK)
        if stop < len(raw):
            gaps = np.flatnonzero(~_WORD[raw[at:stop]])
            if not len(gaps):
                while stop < len(raw) and _WORD[raw[stop : stop + CHUNK]].all():
                    stop = min(len(raw), stop + CHUNK)
                stop += int(np.argmin(np.append(_WORD[raw[stop : stop + CHUNK]], False)))
                hashes.append(_long_word(raw[at:stop]))
                starts.append(np.array([at]))
                at = stop
                continue
            stop = at + int(gaps[-1]) + 1
        h, s = _part_words(raw[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(starts)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all texts' features and the text each belongs to."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(encoded), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
    words, starts = word_hashes(raw)
    owner = np.searchsorted(ends, starts, "right")
    shift = np.uint64(64 - BITS)
    found, owners = [words >> shift], [owner]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = owner[:-gap] == owner[gap:]
        joined = _mix(words[:-gap] * np.uint64(salt) + words[gap:])
        found.append(joined[same] >> shift)
        owners.append(owner[gap:][same])
    both = np.sort(np.concatenate(owners) << BITS | np.concatenate(found).astype(np.int64))
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    return both & ((1 << BITS) - 1), both >> BITS


def fit_features(
    rows: list[np.ndarray], labels: list[int], alpha: float = 0.6, beta: float = 1.0,
    l1: float = 15.0, l2: float = 1.0, examples: int = EXAMPLES, seed: int = 3,
) -> bytes:
    """Coordinates and weights other than zero, and the bias, as bytes, learned from the
    coordinates of labelled texts, each seen about as often as the others."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        penalty = np.where(at == bias, 0.0, l1)
        size = np.maximum(np.abs(own) - penalty, 0.0)
        return -np.sign(own) * size / ((beta + np.sqrt(n[at])) / alpha + l2)

    rng = np.random.default_rng(seed)
    share = [len(labels) / (2 * max(1, sum(x == y for x in labels))) for y in (0, 1)]
    order: list[int] = []
    while rows and len(order) < examples:
        order += rng.permutation(len(rows)).tolist()
    for k in order[:examples]:
        at = np.append(rows[k], bias)
        w = weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
        g *= share[labels[k]]
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
        z[at] += g - step * w
        n[at] += g * g
    # Without examples nothing is toxic.
    w = weights(np.arange((1 << BITS) + 1)) if rows else np.zeros((1 << BITS) + 1)
    start = float(w[bias]) if rows else -1e-6
    kept = np.flatnonzero(w[:bias])
    return pickle.dumps((kept.astype(np.int32), w[kept].astype(np.float32), start))


def fit(texts: list[str], labels: list[int], **settings) -> bytes:
    """``fit_features`` of the features of texts."""
    return fit_features(_split(texts), labels, **settings)


def _split(texts: list[str]) -> list[np.ndarray]:
    """The features of each text."""
    found, owner = features(texts)
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    found, owner = features(texts)
    total = np.bincount(owner, weights=weights[found], minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def model(
    docs: DataFrame, labels: DataFrame, most: int = 8000, key: str = "doc_id",
    text: str = "text",
) -> bytes:
    """Learned from at most ``most`` rows of each label, none of the held-out fold. Features
    are made where the texts lie; the one task that learns gets only these."""
    chosen = sample(docs, labels, "toxic", remainder(key, 5) != 0, most, key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = [x.astype(np.int32) for x in _split(texts_of(part, "text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), part.column("label")], ["found", "label"])

    made = chosen.mapInArrow(run, "found array<int>, label int")
    return fitted(made, "found", fit_features)


def score(docs: DataFrame, fitted_model: bytes, key: str = "doc_id", text: str = "text",
          carry: bool = False) -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted``; with ``carry``, instead, all columns
    of ``docs`` for the rows that are not predicted toxic."""
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType(), False)])

    def dense() -> tuple[np.ndarray, float]:
        kept, values, bias = pickle.loads(fitted_model)
        weights = np.zeros(1 << BITS, dtype=np.float32)
        weights[kept] = values
        return weights, bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = dense()
        for part in slices(batches, text, 1 << 20):
            found = scores(texts_of(part, text), weights, bias)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found)], [key, "score"])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = dense()
        for part in slices(batches, text, 1 << 20):
            yield part.filter(pa.array(scores(texts_of(part, text), weights, bias) < 0.5))

    if carry:
        return docs.mapInArrow(keep, docs.schema)
    return docs.select(key, text).mapInArrow(run, schema).select(
        key, (remainder(key, 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
