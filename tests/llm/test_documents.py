"""Toxicity, quality and SimHash groups of documents."""

from __future__ import annotations

import pickle
import random
import zlib

import numpy as np
import pytest
import xxhash

from tapeline.llm import byte_cnn, components, simhash, toxicity
from tapeline.llm.tables import read

SF = "/root/testdata/sf0.1"


def own_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints: list[int]) -> list[int]:
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
        if new == label:
            return label
        label = new


def test_fingerprints_and_groups(documents, odd_texts):
    prints = [own_fingerprint(t) for t in odd_texts]
    label = groups_of(prints)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    for i in range(len(odd_texts)):
        assert found[i]["fingerprint"] == format(prints[i], "016x"), i
        assert found[i]["component_id"] == label[i], i


def test_pairs_of_fingerprints(spark):
    """Clusters around centres, at every distance to 6 bits, in small leaves and blocks."""
    rng = random.Random(6)
    prints = set()
    for _ in range(150):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for bits in range(1, 7):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), bits)))
    hot = rng.getrandbits(64)
    prints |= {hot ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    prints = sorted(prints)
    label = groups_of(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "bits long")
    edges = simhash.near_pairs(table, sample_rows=100, leaf_rows=16, block_rows=40).collect()
    place = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        a, b = root(place[e["u"]]), root(place[e["v"]])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(prints))] == label


def test_one_of_each(spark, documents, odd_texts):
    label = groups_of([own_fingerprint(t) for t in odd_texts])
    kept = simhash.one_of_each(documents.union(documents.limit(5)))
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_ids_may_be_null_or_repeated(spark):
    rows = [(None, "one two three four"), (3, "one two three four"), (3, "other words are here now"),
            (1, "other words are here now"), (None, "all alone in this small table")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(table).collect()
    assert len(found) == 5
    # Rows are linked by their texts, not by their ids.
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [
        (0, 0), (0, 3), (1, 1), (3, 1), (3, 3)]
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows are chosen, not ids: ids may be repeated or null."""
    a, b, c = "one two three four", "other words are here now", "all alone in this small table"

    def kept(rows):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(table).collect())

    assert kept([(3, a), (3, b), (1, b)]) == [(1, b), (3, a)]
    assert kept([(7, a), (7, b), (7, a)]) == [(7, a), (7, b)]
    assert kept([(None, a), (None, a), (None, b), (5, b), (None, c), (2, None), (4, "")]) == [
        (0, c), (0, a), (2, None), (5, b)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 400)]
    table = spark.createDataFrame(edges + edges[:5], "u long, v long")
    found = {r["node"]: r["component"] for r in components.components(table).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {500: 400}
    assert found == want
    assert components.components(table.limit(0)).count() == 0


def check_scores(found, odd_texts, modulus, held, threshold):
    assert len(found) == len(odd_texts)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)


@pytest.mark.parametrize("which, modulus, held, threshold, least", [
    ("toxic", 5, 0, 0.5, 0.97), ("quality", 4, 2, 0.7, 0.97)])
def test_held_out_accuracy(spark, documents, odd_texts, no_documents, which, modulus, held,
                           threshold, least):
    own = toxicity if which == "toxic" else byte_cnn
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = own.model(docs, labels)
    truth = {r["doc_id"]: r[which] for r in labels.collect()}
    found = own.score(docs, model).filter("held_out").collect()
    right = [r["predicted"] == truth[r["doc_id"]] for r in found if r["doc_id"] in truth]
    assert len(right) > 500 and np.mean(right) >= least
    check_scores(own.score(documents, model).collect(), odd_texts, modulus, held, threshold)
    assert own.score(no_documents, model).count() == 0
    kept = own.score(documents, model, carry=True)
    assert kept.columns == documents.columns
    passed = {r["doc_id"] for r in own.score(documents, model).collect()
              if r["predicted"] == (0 if which == "toxic" else 1)}
    assert {r["doc_id"] for r in kept.collect()} == passed
    # The held-out labels have no part in the model.
    others = labels.filter("false").union(
        labels.filter(f"crc32(cast(doc_id as string)) % {modulus} <> {held}"))
    small = read(spark, "/root/testdata/sf0.01", "documents")
    assert own.model(small, others, most=40) == own.model(small, labels, most=40)


def test_without_labels_nothing_is_toxic(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.score(documents, toxicity.model(documents, labels)).collect()
    assert {r["predicted"] for r in found} == {0}
    assert byte_cnn.score(documents, byte_cnn.model(documents, labels)).count() == documents.count()


def test_word_features():
    texts = ["Alpha beta, ALPHA", "", "beta alpha", "x" * (1 << 20) + " tail words"]
    coordinates, owner = toxicity.features(texts)
    count = np.bincount(owner, minlength=4).tolist()
    assert count == [5, 0, 3, 6]
    whole, _ = toxicity.word_hashes(np.frombuffer(b"ab cd " * 200_000, dtype=np.uint8))
    assert len(whole) == 400_000 and len(set(whole.tolist())) == 2


def test_network_sees_the_whole_text():
    """A long text is the same in one stretch or many, and its end counts."""
    w = byte_cnn.first_weights(1)
    rng = np.random.default_rng(1)
    raw = rng.integers(32, 127, size=500_000).astype(np.uint8).tobytes()
    rows, owners = byte_cnn.chunks([raw])
    assert len(rows) * byte_cnn.STEP >= len(raw) - byte_cnn.CHUNK
    hidden = np.concatenate([byte_cnn.forward(w, rows[i : i + 500])[3] for i in range(0, len(rows), 500)])
    total = np.maximum(hidden.max(axis=0), 0) @ w["out"] + w["out_bias"][0]
    want = 1 / (1 + np.exp(-float(total)))
    assert abs(byte_cnn.probability(w, [b"", raw, b"x"])[1] - want) < 1e-6
    assert bytes((rows[-1][rows[-1] > 0] - 1).astype(np.uint8)) == raw[-int((rows[-1] > 0).sum()):]


def plain_forward(w, raw: bytes) -> float:
    """The network by plain loops over every window of every chunk."""
    line = [b + 1 for b in raw]
    count = max(1, -(-max(0, len(raw) - (byte_cnn.CHUNK - byte_cnn.STEP)) // byte_cnn.STEP))
    line += [0] * ((count - 1) * byte_cnn.STEP + byte_cnn.CHUNK - len(line))
    top = [-np.inf] * byte_cnn.HIDDEN
    for c in range(count):
        own = line[c * byte_cnn.STEP : c * byte_cnn.STEP + byte_cnn.CHUNK]
        largest, total = [0.0] * byte_cnn.FILTERS, [0.0] * byte_cnn.FILTERS
        windows = byte_cnn.CHUNK - byte_cnn.WIDTH + 1
        for at in range(windows):
            window = np.concatenate([w["embed"][own[at + k]] for k in range(byte_cnn.WIDTH)])
            for f in range(byte_cnn.FILTERS):
                r = max(0.0, float(window @ w["filters"][:, f] + w["bias"][f]))
                largest[f], total[f] = max(largest[f], r), total[f] + r
        pooled = np.array(largest + [t / windows for t in total])
        for h in range(byte_cnn.HIDDEN):
            top[h] = max(top[h], float(pooled @ w["mix"][:, h] + w["mix_bias"][h]))
    score = sum(max(0.0, t) * float(o) for t, o in zip(top, w["out"])) + float(w["out_bias"][0])
    return 1 / (1 + np.exp(-score))


def test_network_equals_plain_loops():
    w = byte_cnn.first_weights(3)
    w["bias"] += 0.05
    w["mix_bias"] -= 0.02
    texts = [b"", b"x", b"some words, 12", bytes(range(256)), b"abc " * 70]
    got = byte_cnn.probability(w, texts)
    assert np.allclose(got, [plain_forward(w, t) for t in texts], atol=1e-5)


def test_every_window_is_seen():
    """A pattern that one filter answers is found at every place of a text."""
    w = {k: np.zeros_like(v) for k, v in byte_cnn.first_weights(1).items()}
    w["embed"][ord("!") + 1, 0] = 1
    w["filters"][:: byte_cnn.EMBED, 0] = 1
    w["bias"][0] = -7.5
    w["mix"][0, 0] = w["out"][0] = 10
    for at in (*range(0, 20), 119, 120, 121, 127, 128, 300, 491, 492):
        text = b"." * at + b"!" * 8 + b"." * (492 - at)
        assert byte_cnn.probability(w, [text, b"." * 500])[0] > 0.9, at


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float64) + (0.03 if v.ndim == 1 else 0) for k, v in byte_cnn.first_weights(2).items()}
    raws = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 30, 300, 700)]
    rows, owners = byte_cnn.chunks(raws)
    truth, weight = np.array([0.0, 1, 1, 0]), np.array([1.0, 0.5, 2, 1])

    def loss():
        hidden = np.concatenate([byte_cnn.forward(w, rows[i : i + 64])[3] for i in range(0, len(rows), 64)])
        top = np.stack([hidden[owners == k].max(axis=0) for k in range(4)])
        p = 1 / (1 + np.exp(-(np.maximum(top, 0) @ w["out"] + w["out_bias"][0])))
        return -(weight * (truth * np.log(p) + (1 - truth) * np.log(1 - p))).mean()

    grad = byte_cnn.gradient(w, rows, owners, truth, weight)
    for name, g in grad.items():
        places = np.argsort(-np.abs(g).ravel())[:3].tolist() + rng.integers(0, g.size, 3).tolist()
        for at in places:
            spot, step = np.unravel_index(at, g.shape), 1e-6
            w[name][spot] += step
            high = loss()
            w[name][spot] -= 2 * step
            low = loss()
            w[name][spot] += step
            assert abs((high - low) / (2 * step) - g[spot]) < 1e-5 + 1e-3 * abs(g[spot]), name


def test_network_learns():
    texts = ["clean words here " * 20, "bad*** words&&& here### " * 20] * 10
    w = pickle.loads(byte_cnn.fit(texts, [1, 0] * 10, steps=40, batch=20))
    scores = byte_cnn.probability(w, [t.encode() for t in texts[:2]])
    assert scores[0] > 0.9 and scores[1] < 0.1


def plain_features(text: str) -> set:
    """Words, pairs and pairs over one word, by plain loops."""
    raw, words, at = text.encode(), [], 0
    lower = raw.lower()
    is_word = [b >= 128 or chr(b).isalnum() for b in raw]
    while at < len(raw):
        end = at
        while end < len(raw) and is_word[end]:
            end += 1
        if end > at:
            words.append(lower[at:end])
        at = max(end, at + 1)
    found = {(w,) for w in words}
    found |= {(1, a, b) for a, b in zip(words, words[1:])}
    return found | {(2, a, b) for a, b in zip(words, words[2:])}


def test_features_equal_plain_loops():
    """The same number of features, equal where and only where the plain ones are."""
    rng = random.Random(7)
    names = ["Alpha", "beta", "ALPHA", "é", "x1", "-", "..", "日本", "a" * 50]
    texts = [" ".join(rng.choice(names) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [
        "", "-", "y" * (3 << 20), "y" * (3 << 20) + " tail", ("z" * 1500 + " ") * 1500]
    coordinates, owner = toxicity.features(texts)
    plain = [plain_features(t) for t in texts]
    own = [set(coordinates[owner == k].tolist()) for k in range(len(texts))]
    assert [len(x) for x in own] == [len(x) for x in plain]
    for i in range(0, 200, 3):
        for j in range(i + 1, 200, 17):
            assert len(own[i] & own[j]) == len(plain[i] & plain[j])


def test_ftrl_equals_plain_loops():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(6)) + (" foul word" if i % 3 == 0 else "")
             for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    kept, weights, bias = pickle.loads(toxicity.fit(texts, labels, l1=0.5, examples=150, seed=3))
    z, n, top = {}, {}, 1 << toxicity.BITS
    examples = [sorted(set(toxicity.features([t])[0].tolist())) + [top] for t in texts]

    def weight(i):
        size = max(abs(z.get(i, 0.0)) - (0.0 if i == top else 0.5), 0.0)
        return -np.sign(z.get(i, 0.0)) * size / ((1.0 + n.get(i, 0.0) ** 0.5) / 0.6 + 1.0)

    order = np.random.default_rng(3)
    seen, share = [], [60 / (2 * labels.count(y)) for y in (0, 1)]
    while len(seen) < 150:
        seen += order.permutation(60).tolist()
    for k in seen[:150]:
        w = {i: weight(i) for i in examples[k]}
        g = (1 / (1 + np.exp(-sum(w.values()))) - labels[k]) * share[labels[k]]
        for i in examples[k]:
            step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.6
            z[i] = z.get(i, 0.0) + g - step * w[i]
            n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != top and weight(i)}
    assert dict(zip(kept.tolist(), weights.tolist())).keys() == want.keys()
    assert all(abs(want[i] - v) < 1e-6 for i, v in zip(kept.tolist(), weights.tolist()))
    assert abs(bias - weight(top)) < 1e-9


def test_one_of_each_group_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, "x", 2.0, 3), (2, "a b c d e f", 1, "y", 2.0, 3), (3, "other words here", 1, "z", 2.0, 3),
            (None, None, 1, "n", 2.0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, digest string, root double, bits int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["digest"] for r in kept.collect()) == ["n", "x", "z"]


def test_deep_vantage_trees_find_every_pair(spark):
    """Leaves far below what the sample fixes."""
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for p in prints]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    found = simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "bits long"),
                               sample_rows=20, leaf_rows=1)
    got = components.components(found)
    roots = {p: p for p in prints} | {r["node"]: r["component"] for r in got.collect()}
    mask = (1 << 64) - 1
    want = {p: p for p in prints}
    near = [(p, q) for i, p in enumerate(prints) for q in prints[:i] if ((p ^ q) & mask).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for p, q in near:
            low = min(want[p], want[q])
            changed |= want[p] != low or want[q] != low
            want[p] = want[q] = low
    assert roots == want and len(near) > 200


def test_batches_of_long_texts_are_bounded_by_bytes(spark, tmp_path):
    """A worker never gets many long texts at once."""
    import pyarrow as pa

    from tapeline.llm import tables

    spark.range(3000).selectExpr("id AS doc_id", "repeat('some text ', 1000) AS text").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    sizes = tables.read(spark, str(tmp_path), "documents").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches),
        "n long")
    found = [r["n"] for r in sizes.collect()]
    assert sum(found) > 30_000_000 and max(found) < 6_000_000


def test_learning_does_not_copy_the_features_of_the_sample():
    import tracemalloc

    import numpy as np

    from tapeline.llm import toxicity

    own = np.arange(2000, dtype=np.int32)
    tracemalloc.start()
    try:
        toxicity.fit_features([own] * 20_000, [0, 1] * 10_000, examples=10)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120_000_000


def test_the_sample_is_learned_from_in_an_order_of_its_rows(spark):
    """Also where long rows begin alike; lists come as arrays, of several batches."""
    import pickle
    import random

    from tapeline.llm.labelled import fitted

    texts = ["é" * 70 + end for end in ("", "b", "a", "a")] + ["é", "", "z" * 200, "z" * 64]
    rows = [(t, [ord(c) for c in t], k % 2) for k, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    made = spark.createDataFrame(rows, "text string, found array<int>, label int").repartition(3)
    show = lambda own, labels: pickle.dumps(
        [(x if isinstance(x, str) else "".join(map(chr, x)), y) for x, y in zip(own, labels)])
    by_text = sorted(((t, y) for t, _, y in rows), key=lambda r: (r[0].encode(), r[1]))
    assert pickle.loads(fitted(made, "text", show)) == by_text
    by_array = sorted(((t, y) for t, _, y in rows), key=lambda r: (r[0].encode("utf-32-le"), r[1]))
    assert pickle.loads(fitted(made, "found", show)) == by_array
    assert pickle.loads(fitted(made.limit(0), "text", show)) == []
