"""Secret scans by grammar inference.

Base rules find credentials by their surroundings or alphabet: ``assign`` (a value assigned
to a telling name), ``access`` (key ids that start with AKIA) and ``hex``. What they find
are labelled credentials. From a bounded sample of the distinct ones of each kind a prefix
tree is built, and states whose continuations are statistically compatible are merged into a
probabilistic automaton, one for each kind; one more is learned in the same way from
ordinary candidates, those that no base rule touches. Then every candidate of every text, a
maximal run of ``LEAST_CANDIDATE`` or more credential characters that no base span touches,
is scored by all of them: it is a span of kind ``format`` if, for each character, it is as
likely by some automaton as the examples of that kind are, and likelier than by the ordinary
one by ``MARGIN``. Base spans always stay.

A base span is the whole match, for ``assign`` with its name. Positions count code points,
ends are exclusive. Spans may overlap across kinds, never within one.

The sample is bounded by ``most`` strings of at most ``LONGEST`` characters for each kind;
everything else reads all texts whole. Null and empty texts have no spans; repeated rows and
ids are rows of their own. Very long candidates are scored whole. Without enough labelled
credentials of a kind (``LEAST_EXAMPLES``) it has no automaton; without any automaton, or
without ordinary candidates to tell them from, only base spans remain. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.batches import slices, texts_of
from tapeline.llm.shared import written

# The base rules, least lengths, and the order of kinds.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

LEAST_CANDIDATE = 12
LONGEST, LEAST_EXAMPLES, MARGIN, SLACK = 256, 20, 0.5, 0.2

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# A run that is too short fails at each of its places, so the least length may be asked for
# at once.
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
_HEX = re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")
_CANDIDATE = re.compile(f"[A-Za-z0-9+/_.=-]{{{LEAST_CANDIDATE},}}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, kind (as a place in ``KINDS``), end and credential of each base span, in order."""
    found = []
    lower = text.encode("utf-8", "replace").lower()
    if any(name.encode() in lower for name in NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Start and characters of the runs that no base span touches."""
    runs = [(m.start(), m[0]) for m in _CANDIDATE.finditer(text)]
    if not base:
        return runs
    kept, k, reach = [], 0, 0
    for start, run in runs:
        while k < len(base) and base[k][0] < start + len(run):
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            kept.append((start, run))
    return kept


class _State:
    __slots__ = ("count", "ends", "next", "seen")

    def __init__(self) -> None:
        self.seen, self.ends = 0, 0
        self.count: dict[int, int] = {}
        self.next: dict[int, _State] = {}


def _tree(strings: list[str]) -> _State:
    root = _State()
    for string in strings:
        at = root
        at.seen += 1
        for letter in map(LETTERS.index, string):
            at.count[letter] = at.count.get(letter, 0) + 1
            at = at.next.setdefault(letter, _State())
            at.seen += 1
        at.ends += 1
    return root


def _agreement(red: _State, blue: _State, room: float) -> float | None:
    """None if some continuation of the two is too unlike for their counts (Hoeffding bound);
    else the log-likelihood of what follows ``blue``, a tree, if it were ``red``."""
    total, pairs = 0.0, [(red, blue)]
    while pairs:
        r, b = pairs.pop()
        bound = room * (1 / sqrt(r.seen) + 1 / sqrt(b.seen))
        if abs(r.ends / r.seen - b.ends / b.seen) > bound:
            return None
        for letter in r.count.keys() | b.count.keys():
            if abs(r.count.get(letter, 0) / r.seen - b.count.get(letter, 0) / b.seen) > bound:
                return None
        total += b.ends * log((r.ends + 0.1) / (r.seen + 1))
        for letter, n in b.count.items():
            total += n * log((r.count.get(letter, 0) + 0.1) / (r.seen + 1))
            if letter in r.next:
                pairs.append((r.next[letter], b.next[letter]))
    return total


def _fold(red: _State, blue: _State) -> None:
    """Adds ``blue`` and the tree below it to ``red``."""
    pairs = [(red, blue)]
    while pairs:
        r, b = pairs.pop()
        r.seen += b.seen
        r.ends += b.ends
        for letter, n in b.count.items():
            r.count[letter] = r.count.get(letter, 0) + n
            if letter in r.next:
                pairs.append((r.next[letter], b.next[letter]))
            else:
                r.next[letter] = b.next[letter]


def infer(strings: list[str], confidence: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """An automaton: the next state after each letter, and the log-probability of each letter
    (and, last, of the end), in each state; state 0 starts.

    States are taken from the start outwards, the most frequent first. One that is compatible
    with a kept state is merged into the one that makes it most likely, else it is kept.
    """
    red, room = [_tree(strings)], sqrt(0.5 * log(2 / confidence))
    while True:
        kept = {id(s) for s in red}
        blue = [(child.seen, -k, -letter) for k, r in enumerate(red)
                for letter, child in r.next.items() if id(child) not in kept]
        if not blue:
            break
        _, k, letter = max(blue)
        parent, letter = red[-k], -letter
        state = parent.next[letter]
        scores = [(s, -k) for k, r in enumerate(red)
                  if (s := _agreement(r, state, room)) is not None]
        if not scores:
            red.append(state)
            continue
        target = red[-max(scores)[1]]
        parent.next[letter] = target
        _fold(target, state)
    place = {id(s): k for k, s in enumerate(red)}
    # A letter that was never seen in a state leaves it where it is.
    move = np.repeat(np.arange(len(red), dtype=np.int32)[:, None], len(LETTERS), axis=1)
    count = np.full((len(red), len(LETTERS) + 1), 0.05)
    for k, state in enumerate(red):
        for letter, n in state.count.items():
            move[k, letter] = place[id(state.next[letter])]
            count[k, letter] += n
        count[k, -1] += state.ends
    return move, np.log(count / count.sum(axis=1, keepdims=True))


def likelihoods(automaton: tuple[np.ndarray, np.ndarray], strings: list[str]) -> np.ndarray:
    """Log-likelihood of each string; all strings of a block take a step at a time."""
    move, logs = automaton
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    total = np.empty(len(strings))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # Blocks of about a million letters, of strings of like length.
        stop = at + max(1, int(np.searchsorted(
            size[order[at:]] * np.arange(1, len(order) - at + 1), 1 << 20, "right")))
        own = order[at:stop]
        codes = _CODE[np.frombuffer("".join(strings[k] for k in own.tolist()).encode(), np.uint8)]
        first = np.cumsum(size[own]) - size[own]
        state, gain, open_ = np.zeros(len(own), np.int32), np.zeros(len(own)), 0
        for step in range(int(size[own[-1]])):
            open_ += int(np.searchsorted(size[own[open_:]], step, "right"))
            letter = codes[first[open_:] + step]
            gain[open_:] += logs[state[open_:], letter]
            state[open_:] = move[state[open_:], letter]
        total[own] = gain + logs[state, -1]
        at = stop
    return total


_CODE = np.zeros(256, dtype=np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def learn(labelled: dict[str, list[str]], ordinary: list[str]) -> dict:
    """An automaton and a least likelihood for each kind of credential with enough examples,
    and the automaton of ordinary strings. The least likelihood, for each letter and the end,
    is that of all but the least likely hundredth of the examples, less ``SLACK``."""
    formats = {}
    for kind, strings in sorted(labelled.items()):
        if len(strings) >= LEAST_EXAMPLES:
            automaton = infer(strings)
            formats[kind] = automaton, float(np.quantile(_for_each(automaton, strings), 0.01)) - SLACK
    return {"formats": formats, "ordinary": infer(ordinary) if ordinary else None}


def _for_each(automaton: tuple[np.ndarray, np.ndarray], strings: list[str]) -> np.ndarray:
    return likelihoods(automaton, strings) / np.fromiter((len(s) + 1 for s in strings), float, len(strings))


def credential_like(model: dict, strings: list[str], margin: float) -> np.ndarray:
    """Which strings have the format of some kind of credential: they are as likely by its
    automaton as its examples are, and likelier than by the ordinary one, by ``margin``."""
    like = np.zeros(len(strings), dtype=bool)
    if model["formats"] and model["ordinary"] and strings:
        plain = _for_each(model["ordinary"], strings)
        for automaton, least in model["formats"].values():
            own = _for_each(automaton, strings)
            like |= (own >= least) & (own - plain > margin)
    return like


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base spans and the candidates of every text: ``key``, ``kind``, ``start``, ``end`` and
    ``credential`` of the former, ``run_start`` and ``run`` of the latter, as lists."""
    ints, strings = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.StringType(), False)
    kinds = {"kind": ints, "start": ints, "end": ints, "credential": strings, "run_start": ints, "run": strings}
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType),
                           *(T.StructField(n, k, False) for n, k in kinds.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows: dict[str, list] = {n: [] for n in kinds}
            for own in texts_of(part, "text"):
                base = base_spans(own)
                runs = candidates(own, base)
                rows["start"].append([x[0] for x in base])
                rows["kind"].append([x[1] for x in base])
                rows["end"].append([x[2] for x in base])
                rows["credential"].append([x[3] for x in base])
                rows["run_start"].append([x[0] for x in runs])
                rows["run"].append([x[1] for x in runs])
            lists = [pa.array(rows[n], pa.list_(pa.int32() if k is ints else pa.string()))
                     for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([part.column("key"), *lists], schema.fieldNames())

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def model(scanned: DataFrame, most: int = 1000) -> bytes:
    """What ``learn`` makes of at most ``most`` distinct credentials of each kind and as many
    ordinary candidates, chosen by a hash, in one task on an executor."""
    known = scanned.select(F.explode(F.arrays_zip("kind", "credential")).alias("x")).select(
        F.col("x.kind").alias("kind"), F.col("x.credential").alias("string"))
    plain = scanned.select(F.explode("run").alias("string"))
    rows = None
    for kind in range(len(KINDS)):
        own = plain if KINDS[kind] == "format" else known.filter(F.col("kind") == kind).select("string")
        own = own.filter(F.length("string") <= LONGEST).distinct().orderBy(
            F.xxhash64("string"), "string").limit(most).select(F.lit(kind).alias("kind"), "string")
        rows = own if rows is None else rows.union(own)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = {k: sorted(frame["string"][frame["kind"] == n]) for n, k in enumerate(KINDS)}
        ordinary = own.pop("format")
        return pd.DataFrame({"model": [pickle.dumps(learn(own, ordinary))]})

    learned = rows.groupBy().applyInPandas(run, "model binary").collect()
    return bytes(learned[0]["model"]) if learned else pickle.dumps(learn({}, []))


def _shown(rows: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(rows))


def scored(scanned: DataFrame, learned: bytes, margin: float = MARGIN) -> DataFrame:
    """``key``, the numbers of base spans by kind, the digest of all base spans, all spans, and
    the number of added ones."""
    longs = [f"n_{kind}" for kind in KINDS[:3]]
    schema = T.StructType([
        scanned.schema["key"], *(T.StructField(n, T.LongType(), False) for n in longs),
        T.StructField("base_sha256", T.StringType(), False),
        T.StructField("spans", T.StringType(), False), T.StructField("n_added", T.LongType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(learned)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("run")
                coded = lists.flatten().dictionary_encode()
                strings, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                like = credential_like(own, strings, margin)[place]
                starts = part.column("run_start").flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                added: dict[int, list] = {}
                for k in np.flatnonzero(like).tolist():
                    start = int(starts[k])
                    added.setdefault(int(owner[k]), []).append(
                        (start, len(KINDS) - 1, start + len(strings[place[k]])))
                out: list[list] = [[] for _ in range(6)]
                base = zip(*(part.column(c).to_pylist() for c in ("start", "kind", "end")))
                for k, (first, kinds, last) in enumerate(base):
                    spans_ = list(zip(first, kinds, last))
                    more = added.get(k, [])
                    for n in range(3):
                        out[n].append(kinds.count(n))
                    out[3].append(hashlib.sha256(_shown(spans_).encode()).hexdigest())
                    out[4].append(_shown(spans_ + more))
                    out[5].append(len(more))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *(pa.array(x, pa.string() if n in (3, 4) else pa.int64())
                                           for n, x in enumerate(out))], schema.fieldNames())

    return scanned.mapInArrow(run, schema)


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1000,
    margin: float = MARGIN,
) -> DataFrame:
    """``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_added`` for
    every row. Texts are scanned once; what is found is written and read for the rest."""
    scanned = written(found(docs, key, text), "secrets")
    return scored(scanned, model(scanned, most), margin).withColumnRenamed("key", key)
