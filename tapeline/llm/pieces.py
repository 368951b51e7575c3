"""Byte-level BPE by pieces: whole buffers are cut into pieces at once, and each distinct
piece is encoded once by the ``tokenizers`` library and then looked up.

The cut is the one of the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, done on arrays of code points. The letter, number
and space classes are asked from the library itself, so that its Unicode version holds.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from tapeline.llm.batches import spans

OTHER, LETTER, NUMBER, SPACE, END = range(5)
CODE_POINTS = 0x110000
_ODD = 0x9E3779B97F4A7C15

# Endings that the pattern keeps with their apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def class_table(members: Callable[[str, str], str]) -> np.ndarray:
    """Class of each code point. ``members(pattern, text)`` gives the matching characters."""
    everything = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, CODE_POINTS)))
    table = np.zeros(CODE_POINTS, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = members(pattern, everything)
        table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return table


def library_members(pattern: str, text: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern + "+"), behavior="removed", invert=True)
    return "".join(run for run, _ in split.pre_tokenize_str(text))


@lru_cache(maxsize=1)
def packed_classes() -> bytes:
    """The library's classes, made once in the driver and sent along with the tasks."""
    return zlib.compress(class_table(library_members).tobytes())


def unpacked(classes: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(classes), dtype=np.uint8)


def cut(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where a piece starts. A code point of class END is a piece of its own."""
    size = len(points)
    before = np.empty_like(classes)
    before[0], before[1:] = END, classes[:-1]
    after = np.empty_like(classes)
    after[-1], after[:-1] = END, classes[1:]
    space = classes == SPACE
    blank = points == 0x20
    # A blank before anything but white space and the end belongs to what follows.
    led = np.zeros(size, dtype=bool)
    led[1:] = blank[:-1]
    start = np.where(
        space,
        (before != SPACE) | ((after != SPACE) & (after != END)),
        (classes != before) & ~(led & (classes != END)),
    )
    start |= classes == END
    for i in np.flatnonzero((points == 0x27) & start & (after == LETTER)).tolist():
        follow = points[i + 1 : i + 3]
        for ending in ENDINGS:
            n = len(ending)
            if len(follow) >= n and all(follow[k] == ord(ending[k]) for k in range(n)):
                start[i + 1] = False
                if i + n + 1 < size and classes[i + n + 1] == LETTER:
                    start[i + n + 1] = True
                break
    return np.flatnonzero(start)


class _Hashes:
    """64-bit polynomial hashes of any span of a buffer, from one prefix sum."""

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            x = np.arange(1, CODE_POINTS + 1, dtype=np.uint64) * np.uint64(_ODD)
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
        self.mixed = x
        self.inverse = np.uint64(pow(_ODD, -1, 1 << 64))
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def of(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = len(points) + 1
        if len(self.power) < size:
            steps = np.full(size, _ODD, dtype=np.uint64)
            back = np.full(size, self.inverse, dtype=np.uint64)
            steps[0] = back[0] = 1
            self.power, self.back = np.cumprod(steps), np.cumprod(back)
        prefix = np.zeros(size, dtype=np.uint64)
        np.cumsum(self.mixed[points] * self.power[: size - 1], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * self.back[starts]


class PieceEncoder:
    """Encodes texts piece by piece.

    Pieces are found again by a 64-bit hash, and then compared character by character, so
    that pieces of one hash never get each other's ids. ``most_pieces`` bounds the memory of
    looked-up pieces; beyond it the memory is emptied and filled again, with the same result.
    They are held in arrays, some 100 bytes each. Pieces longer than ``LONG`` characters are
    always encoded by the library and never held. Texts are worked on ``AT_ONCE`` characters
    at a time, or one by one if they are longer, which bounds the arrays beside the ids.
    ``cut`` gives the positions where pieces start; a code point of class END is one.
    """

    LONG = 64
    AT_ONCE = 1 << 18

    def __init__(
        self, encode: Callable[[list[str]], list[list[int]]], table: np.ndarray,
        most_pieces: int = 500_000,
        cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = cut,
    ) -> None:
        self.encode, self.table, self.most_pieces, self.cut = encode, table, most_pieces, cut
        self.hashes = _Hashes()
        self._forget()

    def _forget(self) -> None:
        # The hashes of held pieces, rising, and their slots.
        self.known, self.slot = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.first = np.empty(1 << 14, dtype=np.int64)
        self.count = np.empty(1 << 14, dtype=np.int32)
        self.slots = self.used = 0
        # The characters of held pieces, and where they start and how many they are by slot.
        self.points = np.empty(1 << 16, dtype=np.uint32)
        self.at = np.empty(1 << 14, dtype=np.int64)
        self.size = np.empty(1 << 14, dtype=np.int32)
        self.spelled = 0

    def _ids_of(self, pieces: list[str]) -> np.ndarray:
        """New slots for the ids of pieces."""
        encoded = self.encode(pieces)
        counts = np.fromiter(map(len, encoded), dtype=np.int32, count=len(encoded))
        total, new = int(counts.sum()), np.arange(self.slots, self.slots + len(encoded))
        self.flat = _room(self.flat, self.used + total)
        self.first = _room(self.first, self.slots + len(encoded))
        self.count = _room(self.count, self.slots + len(encoded))
        self.flat[self.used : self.used + total] = np.fromiter(
            chain.from_iterable(encoded), dtype=np.int32, count=total)
        self.first[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.slots, self.used = self.slots + len(encoded), self.used + total
        return new

    def _hold(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
              pieces: list[str]) -> np.ndarray:
        """Slots of pieces of new hashes, each given once."""
        slots = self._ids_of(pieces)
        total = int(lengths.sum())
        self.points = _room(self.points, self.spelled + total)
        self.points[self.spelled : self.spelled + total] = points[spans(starts, lengths)]
        self.at, self.size = _room(self.at, self.slots), _room(self.size, self.slots)
        self.at[slots], self.size[slots] = self.spelled + np.cumsum(lengths) - lengths, lengths
        self.spelled += total
        order = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, place, hashes[order])
        self.slot = np.insert(self.slot, place, slots[order])
        return slots

    def _look_up(
        self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pieces between ``starts`` and ``ends``, and which of them are another
        piece of the same hash."""
        lengths = ends - starts
        codes, distinct = pd.factorize(self.hashes.of(points, starts, ends))
        place = np.searchsorted(self.known, distinct)
        slot = np.full(len(distinct), -1)
        if len(self.known):
            met = self.known.take(place, mode="clip") == distinct
            slot[met] = self.slot[place[met]]
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            sample = np.empty(len(distinct), dtype=np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
            new = sample[missing]
            pieces = [joined[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            slot[missing] = self._hold(distinct[missing], points, starts[new], lengths[new], pieces)
        found = slot[codes]
        odd = lengths != self.size[found]
        shown = np.where(odd, 0, lengths)
        differ = np.flatnonzero(points[spans(starts, shown)] != self.points[spans(self.at[found], shown)])
        odd[np.searchsorted(np.cumsum(shown), differ, "right")] = True
        return found, odd

    def _encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.slots > self.most_pieces:
            self._forget()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        marks = np.cumsum(lengths + 1) - 1
        classes = self.table[points]
        classes[marks] = END
        starts = self.cut(points, classes)
        ends = np.append(starts[1:], len(points))
        text_end = np.searchsorted(starts, marks)
        of_piece = np.empty(len(starts), dtype=np.int64)
        alone = ends - starts > self.LONG
        short = np.flatnonzero(~alone)
        of_piece[short], alone[short] = self._look_up(joined, points, starts[short], ends[short])
        held = self.slots, self.used
        for i in np.flatnonzero(alone).tolist():
            of_piece[i] = self._ids_of([joined[starts[i] : ends[i]]])[0]
        counts = self.count[of_piece]
        counts[text_end] = 0
        ids = self.flat[spans(self.first[of_piece], counts)]
        # What is never looked up again is not held.
        self.slots, self.used = held
        return ids, np.cumsum(counts)[text_end]

    def encode_texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        part = (np.cumsum(lengths + 1) - 1) // self.AT_ONCE
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(texts)).tolist()
        ids, ends, before = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)], 0
        for i, j in zip(cuts, cuts[1:]):
            own, own_ends = self._encode(texts[i:j])
            ids.append(own)
            ends.append(own_ends + before)
            before += len(own)
        return np.concatenate(ids), np.concatenate(ends)


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` or more, by half as much again."""
    if len(values) >= size:
        return values
    more = np.empty(max(size, len(values) * 3 // 2), dtype=values.dtype)
    more[: len(values)] = values
    return more


def serial_library() -> None:
    """One thread for the library: Spark already runs a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def byte_names() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others are counted up from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def file_encoder(path: str, classes: bytes) -> PieceEncoder:
    """An encoder for a ``tokenizers`` file of byte-level BPE with the public pattern. Added
    tokens in a text are ordinary text."""
    serial_library()
    from tokenizers import Tokenizer, pre_tokenizers

    # Pieces are cut already: the model takes them line by line. As characters of the byte
    # table they hold no line ends of their own.
    tokenizer = Tokenizer(Tokenizer.from_file(path).model)
    tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    shown = str.maketrans({chr(b): c for b, c in enumerate(byte_names())})
    vocabulary = tokenizer.get_vocab()
    length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    length[list(vocabulary.values())] = list(map(len, vocabulary))

    def encode(pieces: list[str]) -> list[list[int]]:
        lines = [p.encode("utf-8", "replace").decode("latin-1").translate(shown) for p in pieces]
        ids = tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids
        ends = np.cumsum(length[ids])
        wanted = np.cumsum([len(line) for line in lines])
        # Where the ids of each line end, if they spell it.
        at = np.searchsorted(ends, wanted) + 1
        if len(ids) and at[-1] == len(ids) and (ends[at - 1] == wanted).all():
            return [ids[i:j] for i, j in zip([0, *at.tolist()], at.tolist())]
        return [e.ids for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    return PieceEncoder(encode, unpacked(classes))


class AddedTokens:
    """An encoder before which the added tokens of its file are taken out of the texts, as the
    library does: each is one id, and what lies between is encoded as texts of its own."""

    def __init__(self, path: str, encoder: PieceEncoder) -> None:
        from tokenizers import Tokenizer

        self.encoder, self.id_of = encoder, {}
        for i, token in Tokenizer.from_file(path).get_added_tokens_decoder().items():
            if token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"added tokens that take their surroundings are not known: {token}")
            self.id_of[token.content] = i
        names = sorted(map(re.escape, self.id_of), key=len, reverse=True)
        self.split = re.compile("|".join(names) or "(?!)")

    def encode_texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        found = [list(self.split.finditer(t)) if any(n in t for n in self.id_of) else [] for t in texts]
        if not any(found):
            return self.encoder.encode_texts(texts)
        parts, owner, closing = [], [], []
        for k, (text, tokens) in enumerate(zip(texts, found)):
            at = 0
            for token in [*tokens, None]:
                parts.append(text[at : token.start() if token else len(text)])
                owner.append(k)
                closing.append([self.id_of[token[0]]] if token else [])
                at = token.end() if token else at
        ids, ends = self.encoder.encode_texts(parts)
        lists, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for own, k, more in zip(np.split(ids, ends[:-1]), owner, closing):
            lists += [own, np.array(more, dtype=ids.dtype)]
            sizes[k] += len(own) + len(more)
        return np.concatenate(lists), np.cumsum(sizes)
