"""Alignment of two tokenizers against the libraries and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tapeline.llm import alignment
from tapeline.llm.pieces import file_encoder, packed_classes

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_names() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def tokens_of(libraries, text):
    """Ids and byte ranges of both sides, by the libraries alone."""
    a, b = libraries
    if not text:
        return [], []
    want, names = (" " + text).encode(), byte_names()
    sides = []
    spelled = [[(i, bytes(names[c] for c in a.id_to_token(i)))
                for i in a.encode(" " + text, add_special_tokens=False).ids],
               [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                 else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]]
    for side in spelled:
        if b"".join(x for _, x in side) != want:
            return [], []
        at, found = 0, []
        for i, raw in side:
            found.append((i, at, at + len(raw)))
            at += len(raw)
        sides.append(found)
    return sides


def links_of(a, b):
    return [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]


def brute(libraries, texts):
    tokens = [tokens_of(libraries, t) for t in texts]
    links = [links_of(*x) for x in tokens]
    count = Counter(pair for each in links for pair in each)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    rows = []
    for (a, b), own in zip(tokens, links):
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        shown, start = [], 0
        for cut in cuts:
            shown.append("|".join(",".join(str(i) for i, s, _ in side if start <= s < cut)
                                  for side in (a, b)))
            start = cut
        rows.append((len(a), len(b), len(cuts), len(own),
                     sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own),
                     hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""))
    return rows


def random_texts(count):
    rng = random.Random(9)
    letters = "aabbcs tred'’v m l  \t\n　é漢字1½!?.##  ==--ß😀▁<>/"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(count)]


ODD = [None, "", " ", "  ", "a ", "  a  b ", "<s> </s> <unk> <0x41>", "<|endoftext|> a", "▁a", "a▁b",
       "\u0000nul", "twin text", "twin text", "naïve 日本語 😀😀 x", "a" * 300, "=-" * 150, "b3f" * 90]


def test_rows_equal_the_plain_loops(spark, libraries):
    texts = ODD + random_texts(150)
    docs = spark.createDataFrame(
        [(i // 2, t, 1, 2.0, "x") for i, t in enumerate(texts)],
        "doc_id long, text string, block int, key double, pair string")
    got = alignment.aligned(docs.repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    want = [(i // 2, *row) for i, row in enumerate(brute(libraries, texts))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_blocks_give_the_same(spark, libraries, monkeypatch):
    texts = ODD + random_texts(60)
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, words string")
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 64)
    got = alignment.aligned(docs.repartition(2), A, B, "name", "words")
    want = [(str(i), *row) for i, row in enumerate(brute(libraries, texts))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_groups_spell_the_text(spark):
    own = alignment.aligner(A, B, packed_classes())
    texts = ODD + random_texts(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in alignment.groups(docs, A, B).collect():
        a = b"".join(own.a_bytes[i] for i in row.a)
        if not row.a:
            assert not (row.b or row.a_cut or row.b_cut)
            continue
        assert a == (" " + texts[row.doc_id]).encode()
        starts = zip([0, *row.a_cut], row.a_cut, [0, *row.b_cut], row.b_cut)
        for i, j, k, m in starts:
            left = b"".join(own.a_bytes[x] for x in row.a[i:j])
            assert left and left == b"".join(own.b_bytes[x] for x in row.b[k:m])


def test_cuts_of_random_ends():
    """Intervals with many, few and no shared cuts; cuts far from the middle."""
    rng = np.random.default_rng(1)
    for trial in range(200):
        total = int(rng.integers(2, 60))
        share = rng.random() * 0.9 + 0.05
        a, b = (np.append(1 + np.flatnonzero(rng.random(total - 1) < s), total)
                for s in (share, rng.random()))
        got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]),
                                    np.array([0]), np.array([len(b)]))
        want = np.intersect1d(a, b)
        assert a[got[0] - 1].tolist() == b[got[1] - 1].tolist() == want.tolist()


def test_pieces_of_one_hash_keep_their_own_ids(libraries, monkeypatch):
    """With a hash that tells nothing apart, every piece still gets its ids."""
    encoder = file_encoder(A, packed_classes())
    monkeypatch.setattr(type(encoder.hashes), "of",
                        lambda self, points, starts, ends: (points[starts] % 3).astype(np.uint64))
    for texts in (ODD[1:], random_texts(80), random_texts(80)):
        ids, ends = encoder.encode_texts(texts)
        for own, text in zip(np.split(ids, ends[:-1]), texts):
            assert own.tolist() == libraries[0].encode(text, add_special_tokens=False).ids
