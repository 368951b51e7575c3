"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeline.llm import spelling
from tapeline.llm.tables import read


def own_words(rows) -> Counter:
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return Counter({w: n for w, n in counts.items() if n >= 2})


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts, out = own_words(rows), []
    forms = {}
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, others in found.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        form = forms[w]
        out.append((w, form, root, n, len(found[w]), counts[form] if form else None))
    return sorted(out, key=lambda r: r[0])


def texts():
    rng = random.Random(6)
    base = ["abcdefg", "wordword", "naïveté-", "ÿÀ×÷aaab", "zzzzzzz", "unhappily"]
    base = [re.sub("[^a-zà-ÿÀ-ß]", "", b) + "tion" for b in base] + ["zzzzzzz", "abcdefg", "ABCDEFG"]
    words = []
    for b in base:
        for _ in range(30):
            w = b
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abzÿé×") + w[i:],
                                w[:i] + rng.choice("abzÿé×") + w[i + 1 :]])
            words += [w] * rng.choice([1, 2, 2, 3, 25, 300])
    # A chain of forms, each ten times as frequent.
    for k, w in enumerate(("chainaaa", "chainaab", "chainabb", "chainbbb")):
        words += [w] * 2 * 10**k
    rng.shuffle(words)
    out = [(i, " ".join(words[i::60])) for i in range(60)]
    long = "q" * 3000
    out += [(None, "abcdefg zzzzzzz"), (3, None), (4, ""), (5, " , "), (6, long), (6, long + " " + long + "r"),
            (7, f"{long}r {long[1:]} {long[1:]}"), (7, "aaaaaaa aaaaaaaa aaaaaaaaa " * 2)]
    return out


@pytest.mark.parametrize("budget", [spelling.FILTER_BYTES, 1])
def test_rows_equal_all_pairs(spark, budget):
    """Also with filters that have no room and know nearly everything."""
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                 "doc_id long, text string, word string, n int, near string")
    got = spelling.variants(docs.repartition(3), most_bytes=budget)
    want = brute(rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(r[1] != r[2] and r[1] is not None for r in want)


def test_given_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(rows)


def test_roots_of_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(19)] + [(f"v{i}", "w4") for i in range(50)]
    got = spelling.roots(spark.createDataFrame(forms, "word string, form string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, "w19") for w, _ in forms)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counting_in_parts_changes_nothing(spark, monkeypatch):
    rows = texts()[:20]
    monkeypatch.setattr(spelling, "MEMORY", 5)
    got = spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.word: r.n for r in got.collect()} == dict(own_words(rows))


def test_edits_have_the_hashes_of_their_texts():
    letters = spelling.LETTERS
    words = ["aabcaa", "ÿ", "zzzzzz", "éabé"]
    w = spelling.Words(words, letters)

    def total(text):
        return spelling.Words([text], letters).total[0]

    at, hashes = w.deletions()
    made = set()
    for a, h in zip(at, hashes):
        own, i = words[w.word[a]], w.place[a]
        text = own[:i] + own[i + 1 :]
        made.add((w.word[a], text))
        assert h == (total(text) if text else 0)
    assert len(made) == len(at) == sum(len({x[:i] + x[i + 1 :] for i in range(len(x))}) for x in words)
    at, new, hashes = w.replacements(0, len(w.codes))
    for a, c, h in list(zip(at, new, hashes))[::7]:
        own, i = words[w.word[a]], w.place[a]
        assert letters[c] > own[i] and h == total(own[:i] + letters[c] + own[i + 1 :])
    assert len(at) == sum(letters[::-1].index(c) for x in words for c in x)


def test_filters_know_their_words_and_little_else(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([7, 8, 9, 70])))
    known = sorted({make() for _ in range(3000)})
    filters, whole = spelling.filled(spark.createDataFrame([(w,) for w in known], "word string"))
    asked = spelling.Words(known, spelling.LETTERS)
    assert filters.knows(whole, asked.total, asked.size).all()
    others = sorted({make() for _ in range(20000)} - set(known))
    asked = spelling.Words(others, spelling.LETTERS)
    assert filters.knows(whole, asked.total, asked.size).mean() < 0.01
    assert len(whole) * 8 < 1 << 20 and np.any(whole)
