"""Encoding, decoding and packing against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tapeline.llm import byte_bpe, packing, pieces


@pytest.fixture(scope="module")
def tiktoken_own(ranks_path):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def random_texts(count: int) -> list[str]:
    rng = random.Random(4)
    letters = "aabbcs tred'’v m l  \t\n 　é漢字1２½!?.##  ==--üß😀"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(count)]


def test_codec_equals_tiktoken(ranks_path, tiktoken_own, odd_texts):
    own = byte_bpe.codec(ranks_path, pieces.packed_classes())
    texts = random_texts(3000) + [t or "" for t in odd_texts]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == tiktoken_own.encode_ordinary(text)
        assert own.decode_bytes(ids) == text.encode()
        assert own.decode(ids) == text


def test_offsets_cover_split_characters(ranks_path):
    own = byte_bpe.codec(ranks_path, pieces.packed_classes())
    text = "a😀é漢 b"
    ids = own.encode([text])[0]
    starts, ends = own.offsets(text, ids)
    raw, at = text.encode(), 0
    for i, s, e in zip(ids, starts, ends):
        token = own.bytes_of[i]
        assert raw[at : at + len(token)] == token
        assert token in text[s:e].encode()
        at += len(token)
    assert starts[0] == 0 and ends[-1] == len(text)


def test_forgetting_pieces_changes_nothing(tokenizer_path):
    classes = pieces.packed_classes()
    small = pieces.file_encoder(tokenizer_path, classes)
    small.most_pieces = 3
    large = packing.encoder(tokenizer_path, classes)
    for at in range(0, 200, 20):
        part = random_texts(200)[at : at + 20]
        assert small.encode_texts(part)[0].tolist() == large.encode_texts(part)[0].tolist()


def test_round_trip_of_documents(documents, odd_texts, ranks_path, tiktoken_own):
    rows = {r["doc_id"]: r for r in byte_bpe.round_trip(documents, ranks_path).collect()}
    assert len(rows) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = tiktoken_own.encode_ordinary(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_as_tables(documents, odd_texts, ranks_path):
    encoded = byte_bpe.encode(documents, ranks_path)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(encoded, ranks_path).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd_texts)}


def test_empty_tables(no_documents, ranks_path, tokenizer_path):
    assert byte_bpe.round_trip(no_documents, ranks_path).count() == 0
    assert packing.pack(no_documents, tokenizer_path).count() == 0


def test_decompose():
    assert packing.decompose(1, 1024) == [1]
    assert packing.decompose(2048 + 7, 1024) == [1024, 1024, 4, 2, 1]
    for total in range(1, 3000, 37):
        parts = packing.decompose(total, 256)
        assert sum(parts) == total and all(p & (p - 1) == 0 and p <= 256 for p in parts)


def test_packing_against_the_library(documents, odd_texts, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    rows = packing.pack(documents, tokenizer_path).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert {r["offset"] for r in rows} == {0}
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
        at = 0
        for r in own:
            assert (r["start"], r["length"], r["doc_tokens"]) == (at, len(r["ids"]), len(ids))
            assert 1 << r["bucket"] == r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
            at += r["length"]
    lengths = {}
    for r in rows:
        lengths.setdefault(r["bucket"], []).append(r["sequence_id"])
    order = sorted(lengths)
    for low, high in zip(order, order[1:]):
        assert max(lengths[low]) < min(lengths[high])


def test_added_tokens_in_a_text_are_the_library_s(tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    own = packing.encoder(tokenizer_path, pieces.packed_classes())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}  y", f"{end}\n", "", f"don't{end}'s", "<|endoftext|",
             "plain text", f" {end}é"]
    for some in (texts, texts[:1], texts[5:6], texts[7:9]):
        ids, ends = own.encode_texts(some)
        for text, found in zip(some, np.split(ids, ends[:-1])):
            assert found.tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_pipeline_writes_token_ids(spark, documents, tokenizer_path):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["packing"]
    rows = {r["sequence_id"]: r for r in stage(spark, documents, "").collect()}
    want = {r["sequence_id"]: r for r in packing.pack(documents, tokenizer_path).collect()}
    assert rows == want
    for r in rows.values():
        assert len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())


def test_buckets_are_folders(spark, documents, tokenizer_path, tmp_path):
    packing.write_buckets(packing.pack(documents, tokenizer_path), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("length <> shiftleft(1, bucket)").count() == 0
    assert back.count() == packing.pack(documents, tokenizer_path).count()


def test_held_pieces_take_little_memory(tokenizer_path):
    """Short pieces take arrays alone, and long ones are not held."""
    import tracemalloc

    encoder = pieces.file_encoder(tokenizer_path, pieces.packed_classes())
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(1000)) for _ in range(20)]
    encoder.encode_texts(["a " * 100_000])  # the arrays that last, by length
    tracemalloc.start()
    try:
        encoder.encode_texts(texts)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert encoder.slots > 15_000 and held < 150 * encoder.slots
    before = encoder.slots, encoder.used
    long = ["".join(rng.choices("abcdefgh", k=900)) for _ in range(20)]
    assert len(encoder.encode_texts(long)[1]) == 20 and (encoder.slots, encoder.used) == before


def test_texts_are_encoded_in_bounded_parts(tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    encoder, seen, cut = pieces.file_encoder(tokenizer_path, pieces.packed_classes()), [], pieces.cut
    monkeypatch.setattr(pieces.PieceEncoder, "AT_ONCE", 100, raising=False)
    encoder.cut = lambda points, classes: seen.append(len(points)) or cut(points, classes)
    texts = random_texts(200)
    ids, ends = encoder.encode_texts(texts)
    assert max(seen) < 100 + 62 and len(seen) > 20
    for text, own in zip(texts, np.split(ids, ends[:-1])):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in encoder.encode_texts([])] == [0, 0]
