"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters slide over them, byte by byte. A text is covered
whole by overlapping chunks of ``CHUNK`` bytes, each of which shares more bytes with the next
than a filter is wide, so every window of the text is seen. In a chunk each filter gives its
largest and its mean response, a hidden layer combines them, and each hidden unit keeps its
largest value over all chunks. One logistic unit makes the probability of good quality.

Training takes ``STEPS`` steps of ``BATCH`` texts, whatever the size of the sample.

Chunks are processed in blocks, so a text of any length needs memory for one stretch. Null
and empty texts are one chunk of padding. Repeated rows are scored row by row. Without
labels the weights are the first random ones. An empty table gives an empty result. Columns
of ``docs`` other than the key and the text are carried or ignored, whatever their names.
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

CHUNK, STEP = 128, 96
EMBED, WIDTH, FILTERS, HIDDEN = 4, 8, 16, 12
WINDOWS = CHUNK - WIDTH + 1
# Chunks of a block, whose windows fit a core's cache, and of a stretch of a long text.
BLOCK, STRETCH = 64, 2048
STEPS, BATCH = 400, 32


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte values plus one (0 is padding) of all chunks, and the text of each chunk."""
    rows, owners = [], []
    for k, raw in enumerate(texts):
        count = max(1, -(-max(0, len(raw) - (CHUNK - STEP)) // STEP))
        size = (count - 1) * STEP + CHUNK
        line = np.zeros(size, dtype=np.int16)
        line[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        line[: len(raw)] += 1
        rows.append(np.lib.stride_tricks.sliding_window_view(line, CHUNK)[::STEP])
        owners.append(np.full(count, k))
    return np.concatenate(rows), np.concatenate(owners)


def first_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"embed": (257, EMBED), "filters": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,),
             "mix": (2 * FILTERS, HIDDEN), "mix_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
    scale = {"embed": 0.5, "filters": 0.3, "mix": 0.3, "out": 0.3}
    return {k: (rng.normal(size=s) * scale.get(k, 0)).astype(np.float32) for k, s in shape.items()}


def _windows(w: dict, rows: np.ndarray) -> np.ndarray:
    """Embedded windows of chunks, a row each."""
    embedded = w["embed"][rows].reshape(len(rows), CHUNK * EMBED)
    view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)
    return view[:, ::EMBED].reshape(len(rows) * WINDOWS, WIDTH * EMBED)


def forward(w: dict, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows, responses (a row for each filter), their largest and mean, and hidden values."""
    windows = _windows(w, rows)
    response = (w["filters"].T @ windows.T).reshape(FILTERS, len(rows), WINDOWS)
    response += w["bias"][:, None, None]
    np.maximum(response, 0, out=response)
    pooled = np.concatenate([response.max(axis=2), response.sum(axis=2) / np.float32(WINDOWS)]).T
    return windows, response, pooled, pooled @ w["mix"] + w["mix_bias"]


def _hidden(w: dict, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([forward(w, rows[at : at + BLOCK])[3] for at in range(0, len(rows), BLOCK)])


def _tops(hidden: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    """Largest hidden values over each text's chunks."""
    starts = np.searchsorted(owners, np.arange(count))
    return np.maximum.reduceat(hidden, starts, axis=0)


def probability(w: dict, texts: list[bytes]) -> np.ndarray:
    """The probability of good quality of each text."""
    # Long texts are taken in stretches that begin at a chunk, so memory stays one block.
    top = np.full((len(texts), HIDDEN), -np.inf, dtype=np.float32)
    stretch = STEP * STRETCH
    parts, owners, size = [], [], 0

    def flush() -> None:
        rows, owner = chunks(parts)
        own = _tops(_hidden(w, rows), owner, len(parts))
        np.maximum.at(top, np.array(owners), own)

    for k, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - (CHUNK - STEP)), stretch):
            parts.append(raw[at : at + stretch + CHUNK - STEP])
            owners.append(k)
            size += len(parts[-1]) + CHUNK
            if size >= stretch:
                flush()
                parts, owners, size = [], [], 0
    if parts:
        flush()
    total = np.maximum(top, 0) @ w["out"] + w["out_bias"][0]
    return 1 / (1 + np.exp(-np.clip(total.astype(np.float64), -35, 35)))


def fit(
    texts: list[str], labels: list[int], steps: int = STEPS, batch: int = BATCH,
    rate: float = 0.01, seed: int = 2,
) -> bytes:
    """Trained weights as bytes: logistic loss, Adam, in a fixed order, round after round of
    the sample. The last third of the steps is shorter."""
    w = first_weights(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    raws = [t.encode("utf-8", "replace") for t in texts]
    rng = np.random.default_rng(seed)
    weight = [len(labels) / (2 * max(1, sum(x == value for x in labels))) for value in (0, 1)]
    order = np.empty(0, dtype=np.int64)
    for step in range(1, steps + 1 if raws else 1):
        while len(order) < batch:
            order = np.append(order, rng.permutation(len(raws)))
        chosen, order = order[:batch].tolist(), order[batch:]
        rows, owners = chunks([raws[k] for k in chosen])
        truth = np.array([labels[k] for k in chosen], dtype=np.float32)
        shares = np.array([weight[labels[k]] for k in chosen], dtype=np.float32)
        grad = gradient(w, rows, owners, truth, shares)
        for name, g in grad.items():
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[name] -= (rate if 3 * step <= 2 * steps else 0.3 * rate) * move
    return pickle.dumps(w)


def gradient(
    w: dict, rows: np.ndarray, owners: np.ndarray, truth: np.ndarray, weight: np.ndarray
) -> dict[str, np.ndarray]:
    """The gradient of the mean weighted loss of the texts ``owners`` of the chunks ``rows``."""
    count = len(truth)
    hidden = _hidden(w, rows)
    top = _tops(hidden, owners, count)
    total = np.maximum(top, 0) @ w["out"] + w["out_bias"][0]
    error = (1 / (1 + np.exp(-np.clip(total, -35, 35))) - truth) * weight / count
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["out"] = np.maximum(top, 0).T @ error
    grad["out_bias"][0] = error.sum()
    back = error[:, None] * w["out"] * (top > 0)
    # Only the chunks that give a text's largest value of some unit have a gradient.
    hits = (hidden == top[owners]) & (back[owners] != 0)
    live = np.flatnonzero(hits.any(axis=1))
    for at in range(0, len(live), BLOCK):
        k = live[at : at + BLOCK]
        windows, response, pooled, _ = forward(w, rows[k])
        h = back[owners[k]] * hits[k]
        grad["mix"] += pooled.T @ h
        grad["mix_bias"] += h.sum(axis=0)
        p = (h @ w["mix"].T).T
        r = np.repeat(p[FILTERS:, :, None] / np.float32(WINDOWS), WINDOWS, axis=2)
        best = response.argmax(axis=2)
        r[np.arange(FILTERS)[:, None], np.arange(len(k)), best] += p[:FILTERS]
        r = (r * (response > 0)).reshape(FILTERS, -1)
        grad["filters"] += (r @ windows).T
        grad["bias"] += r.sum(axis=1)
        e = (r.T @ w["filters"].T).reshape(len(k), WINDOWS, WIDTH, EMBED)
        # Sums for each byte of a chunk over the windows it lies in, then for each value.
        place = np.zeros((len(k), CHUNK, EMBED), dtype=e.dtype)
        for shift in range(WIDTH):
            place[:, shift : shift + WINDOWS] += e[:, :, shift]
        values = rows[k].ravel()
        for d in range(EMBED):
            grad["embed"][:, d] += np.bincount(values, place[..., d].ravel(), minlength=257)
    return grad


def model(
    docs: DataFrame, labels: DataFrame, most: int = 3000, key: str = "doc_id",
    text: str = "text",
) -> bytes:
    """Learned from at most ``most`` rows of each label, none of the held-out fold."""
    return fitted(
        sample(docs, labels, "quality", remainder(key, 4) != 2, most, key, text), "text", fit)


def score(docs: DataFrame, fitted_model: bytes, key: str = "doc_id", text: str = "text",
          carry: bool = False) -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted``; with ``carry``, instead, all columns
    of ``docs`` for the rows predicted good."""
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType(), False)])

    def of(part: pa.RecordBatch, w: dict) -> np.ndarray:
        return probability(w, [t.encode("utf-8", "replace") for t in texts_of(part, text)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = pickle.loads(fitted_model)
        for part in slices(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(of(part, w))], [key, "score"])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = pickle.loads(fitted_model)
        for part in slices(batches, text, 1 << 20):
            yield part.filter(pa.array(of(part, w) >= 0.7))

    if carry:
        return docs.mapInArrow(keep, docs.schema)
    return docs.select(key, text).mapInArrow(run, schema).select(
        key, (remainder(key, 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
