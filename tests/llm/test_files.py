"""Resharding, archives, preference pairs, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import itertools

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tapeline.llm import preferences, queries, resharding, warc

SF = "/root/testdata/sf0.01"


def test_flow_is_the_cheapest():
    supply, capacity = [5, 3, 4], [4, 4, 4]
    cost = [[0, 2, 1], [3, 0, 1], [1, 2, 0]]
    flow = resharding.min_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply
    assert all(sum(c) <= 4 for c in zip(*flow))
    spent = sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr))
    places = [[0, 1, 2]] * 12
    owner = [i for i, s in enumerate(supply) for _ in range(s)]
    best = min(
        sum(cost[owner[u]][s] for u, s in enumerate(way))
        for way in itertools.product(*places) if all(way.count(s) == 4 for s in range(3)))
    assert spent == best


def test_resharding_of_several_files(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    rows = [(i % 90, None if i % 17 == 0 else "x" * (i % 50), "mine") for i in range(5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for k, share in enumerate((0.5, 0.3, 0.1, 0.05, 0.05)):
        low, high = [int(5000 * sum((0.5, 0.3, 0.1, 0.05, 0.05)[:j])) for j in (k, k + 1)]
        spark.createDataFrame(rows[low:high], table.schema).coalesce(1).write.mode("append").parquet(path)
    out = resharding.placement(spark, path, 4)
    found = out.collect()
    assert len(found) == 5000
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted(
        (i, len(t or "") + 1) for i, t, _ in rows)
    sizes = []
    for s in range(4):
        own = [r for r in found if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes.append(sum(r["size"] for r in own))
    assert max(sizes) - min(sizes) <= 200
    # The fewest bytes: every shard keeps what it has, up to its capacity.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    ranges = resharding.plan(spark.read.parquet(path).select(*place, size), 4)
    homes = {r["home"]: r["b"] for r in ranges.groupBy("home").agg(F.sum("bytes").alias("b")).collect()}
    total = sum(homes.values())
    stays = sum(min(b, total / 4) for b in homes.values())
    moved = ranges.filter("shard <> home").agg(F.sum("bytes")).first()[0]
    assert abs(moved - (total - stays)) <= 200


def test_resharding_leaves_balanced_files(spark, tmp_path):
    path = str(tmp_path / "even.parquet")
    for k in range(4):
        spark.createDataFrame([(k * 10 + i, "abc") for i in range(10)], "doc_id long, text string"
                              ).coalesce(1).write.mode("append").parquet(path)
    target = str(tmp_path / "target")
    out = resharding.reshard(spark, path, 4, ["doc_id", "text"], F.octet_length("text"), target)
    assert out.count() == 40
    assert spark.read.schema("doc_id long, shard int").parquet(target).count() == 0


def test_resharding_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert resharding.placement(spark, path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert differences(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) is None


TURNS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello there"),
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"), (1, 3, "user", None),
    (2, 0, "user", "x"), (3, 0, "user", "y"),
    (4, 0, "user", "same"), (5, 0, "user", "same"),
    (6, 0, "user", None), (7, 0, "user", ""), (9, 0, "user", "alone"), (None, 0, "user", "lost"),
]


def test_preference_pairs(spark):
    table = spark.createDataFrame([(*t, 1) for t in TURNS],
                                  "conv_id long, turn long, role string, text string, place int")
    rows = preferences.paired(table, preferences.neighbours(table)).collect()
    of = lambda pair, part: sorted(
        (r["place"], r["role"], r["trained"]) for r in rows if (r["pair_id"], r["part"]) == (pair, part))
    assert of(0, "prompt") == [(0, "system", 0), (1, "user", 0)]
    assert of(0, "chosen") == [(2, "assistant", 1)]
    assert of(0, "rejected") == [(2, "assistant", 1), (3, "user", 0)]
    assert of(1, "prompt") == [] and len(of(1, "chosen")) == len(of(1, "rejected")) == 1
    assert len(of(2, "prompt")) == 1 and of(2, "chosen") == of(2, "rejected") == []
    assert of(3, "prompt") == [] and len(of(3, "chosen")) == 1
    assert {r["pair_id"] for r in rows} == {0, 1, 2, 3}
    text = [r["rendered"] for r in rows if r["pair_id"] == 0 and r["part"] == "chosen"]
    assert text == ["<|im_start|>assistant\nhello there<|im_end|>\n"]
    assert preferences.paired(table.limit(0), preferences.neighbours(table.limit(0))).count() == 0


def test_replies_are_exchanged(spark):
    table = spark.createDataFrame(
        TURNS[:7] + [(2, 0, "user", "ask"), (2, 1, "assistant", "short"), (2, 2, "user", "bye"),
                     (3, 0, "user", "other"), (3, 1, "assistant", "a longer reply")],
        "conv_id long, turn long, role string, text string")
    rows = preferences.all_pairs(table).collect()

    def of(kind, pair, part):
        return [r["rendered"].split("\n")[1].removesuffix("<|im_end|>") for r in sorted(
            (r for r in rows if (r["kind"], r["pair_id"], r["part"]) == (kind, pair, part)),
            key=lambda r: r["place"])]

    own, other = preferences.OWN, preferences.OTHER
    assert [of(own, 0, part) for part in ("prompt", "chosen", "rejected")] == [
        ["be kind", "hi"], ["hello there"], ["no"]]
    assert [of(other, 0, part) for part in ("prompt", "chosen", "rejected")] == [
        ["be kind", "hi"], ["hello there"], ["no"]]
    assert [of(own, 1, part) for part in ("prompt", "chosen", "rejected")] == [
        ["other"], ["a longer reply"], ["short"]]
    assert [of(other, 1, part) for part in ("prompt", "chosen", "rejected")] == [
        ["ask"], ["a longer reply"], ["short"]]
    assert all(r["trained"] == (r["part"] != "prompt") for r in rows if r["kind"] != preferences.WHOLE)
    # Whole conversations beside them.
    whole = {tuple(r)[1:] for r in rows if r["kind"] == preferences.WHOLE}
    assert whole == set(map(tuple, preferences.paired(table, preferences.neighbours(table, alone=True)).collect()))


def test_all_turns_reach_the_operator(spark):
    """Every turn of the given table is in a whole pair, and prompts are there."""
    from tapeline.llm.tables import read

    turns = read(spark, "/root/testdata/sf0.01", "conversations")
    rows = preferences.all_pairs(turns)
    whole = rows.filter("kind = 'whole'")
    assert whole.filter("part <> 'prompt'").count() + 2 * whole.filter("part = 'prompt'").count() == \
        turns.filter("conv_id is not null").count()
    assert rows.filter("part = 'prompt' and trained = 0").count() > 0


def test_every_turn_of_the_conversations_is_formatted(spark, tmp_path):
    turns = [
        (0, 0, "user", "same"), (0, 1, "assistant", "a longer reply"), (0, 2, "user", "trailing"),
        (1, 0, "user", "same"), (1, 1, "user", "only here"), (1, 2, "assistant", "short"),
        (4, 0, "user", "no reply"), (5, 0, "user", "none"), (5, 1, "assistant", "one"),
        (7, 0, "user", "alone"), (7, 1, "assistant", "no neighbour"), (8, 0, "user", "alone too"),
        (None, 0, "user", "of no conversation")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    rows = queries.op5_whole_conversations(spark, str(tmp_path)).collect()
    found = sorted((r["pair_id"], r["part"], r["place"],
                    r["rendered"].split("\n")[1].removesuffix("<|im_end|>"), r["trained"]) for r in rows)
    assert found == [
        (0, "chosen", 1, "a longer reply", 1), (0, "chosen", 2, "trailing", 0),
        (0, "prompt", 0, "same", 0),
        (0, "rejected", 1, "only here", 0), (0, "rejected", 2, "short", 1),
        (2, "chosen", 0, "none", 0), (2, "chosen", 1, "one", 1), (2, "rejected", 0, "no reply", 0),
        (3, "chosen", 0, "alone", 0), (3, "chosen", 1, "no neighbour", 1),
        (4, "chosen", 0, "alone too", 0)]


def test_places_of_long_conversations(spark):
    rows = [(1, t, "user", str(t)) for t in range(5000, 0, -1)] + [(1, 7, "user", "7b"), (1, None, "a", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = preferences.places(table).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(5002))
    assert [r["text"] for r in found[:10]] == ["z", "1", "2", "3", "4", "5", "6", "7", "7b", "8"]


PAGES = [
    (1, "http://a", "same " * 300), (2, "http://b", "same " * 300), (9, "http://c\nd", "same " * 300),
    (3, None, "small"), (4, "http://e", "small"), (5, "http://f", None), (6, "http://g", ""),
    (7, "http://h", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\né漢" * 100), (8, "http://i", "x" * 3_000_000),
    (None, "http://j", "same " * 300), (None, "http://k", "other " * 300), (4, "http://e", "small"),
]


def test_archive_of_pages(spark):
    table = spark.createDataFrame([(*p, "mine") for p in PAGES],
                                  "page_id long, url string, html string, digest string")
    found = warc.page_round_trip(table).collect()
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        first = max(same) if len(raw) >= 1000 and same else page
        revisit = first != page
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(),
                     "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert warc.page_round_trip(table.limit(0)).count() == 0


def test_predicates_skip_payloads(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.archive(warc.as_records(table), path)
    for test in ("record_type = 'revisit'", "payload_length > 1000", "target_uri like 'http://%'",
                 "refers_to is not null", "record_id in ('urn:page:8', 'urn:page:3')",
                 "record_id = 'urn:page:8' or payload_length < 3", "target_uri is null"):
        got = warc.read(spark, path).filter(test)
        want = [
            r for r in warc.read(spark, path).withColumn("hit", F.expr(test)).collect() if r["hit"]]
        assert sorted(r["record_id"] or "" for r in got.collect()) == sorted(
            r["record_id"] or "" for r in want)
    plan = warc.read(spark, path).filter("record_type = 'revisit'")._jdf.queryExecution().toString()
    assert "Filter" not in plan.split("== Physical Plan ==")[1].split("BatchScan")[0] or "PushedFilters" in plan


def test_reader_skips_by_header():
    import io

    first = warc.record_bytes({"record_type": "response", "record_id": "a", "payload": b"x" * 100})
    second = warc.record_bytes({"record_type": "revisit", "record_id": "b", "refers_to": "a"})
    source = io.BytesIO(first + second)
    reader = warc.WarcReader("p", __import__("pyspark").sql.types.StructType.fromDDL(warc.SCHEMA))
    rows = list(reader._records(io.BufferedReader(warc._Raw(source)), [lambda r: r["record_type"] == "revisit"]))
    assert [(r["record_id"], r["refers_to"], r["payload"]) for r in rows] == [("b", "a", b"")]


def test_compressed_archives_and_foreign_records(spark, tmp_path):
    folder = tmp_path / "foreign"
    folder.mkdir()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 9\r\n\r\nsoftware\n\r\n\r\n"
    page = warc.record_bytes({"record_type": "response", "record_id": "a", "payload": b"hello"})
    with open(folder / "x.warc.gz", "wb") as file:
        file.write(gzip.compress(info) + gzip.compress(page))
    (folder / "y.txt").write_text("no archive")
    rows = warc.read(spark, str(folder)).collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [
        ("warcinfo", b"software\n"), ("response", b"hello")]
    only = warc.read(spark, str(folder), payload=False).filter("record_type = 'response'").collect()
    assert [r["record_id"] for r in only] == ["a"]


def test_files_are_rolled_and_listed(spark, tmp_path):
    path = tmp_path / "rolled"
    table = spark.createDataFrame([(i, "u", "x" * 2000) for i in range(40)],
                                  "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    warc.as_records(table).coalesce(1).write.format("warc").mode("append").option(
        "filebytes", 10_000).save(str(path))
    assert len(list(path.glob("*.warc"))) > 1
    (path / "part-left-by-a-lost-task.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n")
    assert warc.read(spark, str(path)).count() == 40


def test_later_writes_add_or_replace(spark, tmp_path):
    path = str(tmp_path / "twice")
    part = lambda n: warc.as_records(spark.createDataFrame(
        [(i, "u", f"text {i}") for i in range(n, n + 5)], "page_id long, url string, html string"))
    ids = lambda: sorted(int(r["record_id"].split(":")[-1]) for r in warc.read(spark, path).collect())
    warc.archive(part(0), path)
    warc.archive(part(10), path)
    assert ids() == [*range(5), *range(10, 15)]
    warc.archive(part(0).limit(0), path)
    assert len(ids()) == 10
    warc.archive(part(20), path, "overwrite")
    assert ids() == [*range(20, 25)]
    warc.archive(part(30), path)
    assert ids() == [*range(20, 25), *range(30, 35)]
    assert warc.read(spark, path).filter("record_id = 'urn:page:3'").count() == 0


def test_pipeline_stages(spark, monkeypatch):
    import corpus_pipeline
    from tapeline.llm import byte_cnn, simhash, toxicity
    from tapeline.llm.tables import read

    # Each stage's model is learned once in this test.
    for own in (byte_cnn, toxicity):
        models = {}

        def once(docs, labels, learn=own.model, models=models):
            if "model" not in models:
                models["model"] = learn(docs, labels)
            return models["model"]

        monkeypatch.setattr(own, "model", once)
    docs = read(spark, SF, "documents")
    columns = docs.columns
    labels = read(spark, SF, "labels")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, SF)
    assert calm.columns == columns
    scored = toxicity.score(docs, toxicity.model(docs, labels))
    assert ids(calm) == ids(scored.filter("predicted = 0"))
    calm = calm.cache()
    good = stages["quality"](spark, calm, SF).cache()
    assert good.columns == columns
    assert ids(good) == ids(byte_cnn.score(calm, byte_cnn.model(calm, labels)).filter("predicted = 1"))
    single = stages["simhash"](spark, good, SF).cache()
    assert single.columns == columns
    found = simhash.near_duplicates(good).collect()
    assert ids(single) == {r["component_id"] for r in found}
    packed = corpus_pipeline.run(spark, SF)
    assert ids(packed) == ids(single)
    for frame in (calm, good, single):
        frame.unpersist()


def test_resharding_with_clashing_names(spark, tmp_path):
    rows = [(i, "x" * i, i, "f", 1, 2, 3) for i in range(40)]
    names = "doc_id long, text string, row int, file string, home int, rows int, from_row int"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "in"))
    columns = [c.split()[0] for c in names.split(", ")]
    done = resharding.reshard(spark, str(tmp_path / "in"), 4, columns, F.length("text") + 1, str(tmp_path / "out"))
    assert sorted(tuple(r)[:7] for r in done.select(*columns).collect()) == rows
    assert sorted(r["slot"] for r in done.collect() if r["shard"] == 0) == list(range(done.filter("shard = 0").count()))
