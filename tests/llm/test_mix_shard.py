"""Mixing and sharding against plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, mix, queries, shard


def words(text):
    return len((text or "").split()) if "\x1c" not in (text or "") else None


def fill(sizes, weights, cap):
    """Reshare the excess until nothing is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_plan(docs, rows):
    source_of = {}
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += words(r["text"])
        source_of.setdefault((r["doc_id"], words(r["text"])), r["source"])
    want = fill(sizes, (1, 2, 3), 3)
    taken = defaultdict(int)
    for r in rows:
        source = source_of[r["doc_id"], r["size"]]
        assert abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert r["source_size"] == sizes[source] and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source, n in taken.items():
        assert want[source] - 4 < n <= want[source] + 1e-6


def test_mix_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    check_plan(docs, rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.mix_plan(docs.repartition(5)).collect()))


def test_mix_plan_odd(odd_docs, no_docs):
    rows = mix.mix_plan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check_plan(odd_docs, rows)
    assert mix.mix_plan(no_docs).collect() == []


def test_mixed_rows_follow_the_plan(odd_docs):
    plan = Counter()
    for r in mix.mix_plan(odd_docs).collect():
        plan[r["doc_id"]] += r["taken"]
    got = Counter()
    mixed = mix.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    texts = {r["text"] for r in odd_docs.collect()}
    for r in mixed.collect():
        got[r["doc_id"]] += words(r["text"])
        assert r["text"] in texts or any((t or "").startswith(r["text"]) and r["n_chars"] == len(r["text"]) for t in texts)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in plan.items() if v}


def check_shards(rows, n_shards, n):
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == n and set(counts) <= set(range(n_shards))
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(n_shards)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_shard_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shard.shard_plan(docs, bucket_bytes=1000).collect()
    check_shards(rows, 24, docs.count())
    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, shard.shard_plan(docs.repartition(7), bucket_bytes=1000).collect()))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def by_place(rows):
    return {(r["shard"], r["slot"]): (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows}


def test_plan_tells_of_the_texts_that_were_moved(spark, sf_dir, odd_docs):
    """Each row of the query describes the whole row that the operator put there: texts are shuffled, not ids alone."""
    want = by_place(shard.shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
    plan = queries.op3_shard(spark, sf_dir)
    assert {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in plan.collect()} == want
    odd = {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in shard.shard_plan(odd_docs).collect()}
    assert odd == by_place(shard.shard(odd_docs).collect()) and len(odd) == odd_docs.count()


def test_buckets_of_null_texts_stay_small(spark):
    """Rows without text count for their own bytes, so that many of them aren't one bucket."""
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(null as string) as text", "'a' as source")
    rows = shard.shard(docs, bucket_bytes=8 * 1000).withColumn("part", F.spark_partition_id()).collect()
    check_shards(rows, 24, 4000)
    assert max(Counter(r["part"] for r in rows).values()) < 1000


def test_shard_odd(odd_docs, no_docs):
    check_shards(shard.shard_plan(odd_docs).collect(), 24, odd_docs.count())
    assert shard.shard_plan(no_docs).collect() == []
    rows = shard.shard(odd_docs, n_shards=4)
    assert rows.columns == [*[c for c in odd_docs.columns if c != "shard"], "shard", "slot"]
    rows = rows.collect()
    check_shards(rows, 4, odd_docs.count())
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in odd_docs.collect())


def test_equal_rows_scatter(spark):
    docs = spark.range(5000).selectExpr("7L as doc_id", "'same' as text")
    rows = shard.shard_plan(docs, bucket_bytes=64 * 100)
    check_shards(rows.collect(), 24, 5000)


def test_equal_whole_rows_scatter(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, null, concat('text ', id)) as text", "'a' as source")
    rows = shard.shard(docs, bucket_bytes=2000).collect()
    check_shards(rows, 24, 3000)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    places = [at for at, r in enumerate(sorted(rows, key=lambda r: (r["shard"], r["slot"]))) if r["text"] is None]
    assert len(places) == 1000 and places[-1] - places[0] > 2700
    again = shard.shard(docs.repartition(5), bucket_bytes=2000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_written_shards_hold_the_rows_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame([(i % 700, f"text {i % 300}", {"a": i % 3, "b": 1}) for i in range(2000)], "doc_id long, text string, m map<string,int>")
    shard.write_shards(docs, str(tmp_path / "out"), n_shards=5, bucket_bytes=4096)
    rows = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name()).collect()
    count = lambda rs: Counter((r["doc_id"], r["text"], tuple(sorted(r["m"].items()))) for r in rs)
    assert count(rows) == count(docs.collect())
    by_shard, by_file = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_file.setdefault(r["file"], []).append(r["slot"])
    assert sorted(by_shard) == [0, 1, 2, 3, 4] and all(sorted(s) == list(range(400)) for s in by_shard.values())
    assert all(s == sorted(s) for s in by_file.values())


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 10)
    rows = spark.createDataFrame([("a", 1), ("b", 10), ("c", 11), ("d", 95), ("e", 0)], "k string, n long")
    got = Counter((r["k"], r["copy"]) for r in common.with_copies(rows, "n", "copy").collect())
    assert got == Counter((k, i + 1) for k, n in (("a", 1), ("b", 10), ("c", 11), ("d", 95)) for i in range(n))


@pytest.mark.parametrize("broadcast", [0, 300_000])
def test_shards_of_rows_a_third_of_which_are_equal(spark, monkeypatch, broadcast):
    """Equal rows scatter like others, whether repeated rows are few or too many to be named to every task; maps inside of others are carried."""
    monkeypatch.setattr(shard, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(common, "COPIES", 50)
    kind = "doc_id long, text string, s struct<m:map<string,int>,l:array<map<int,string>>>, n map<string,map<string,int>>"
    rows = [(None, "the same", ({"b": 1, "a": 2}, [{1: "x"}, None]), {"o": {"q": 1, "p": 2}}) if i % 3 == 0 else (i, f"text {i}", ({"k": i}, []) if i % 5 else None, None if i % 7 else {"o": {"p": i}})
            for i in range(1500)]
    docs = spark.createDataFrame(rows, kind).repartition(4).cache()
    out = shard.shard(docs, n_shards=7, bucket_bytes=4096)
    assert out.schema.simpleString() == docs.schema.simpleString()[:-1] + ",shard:int,slot:bigint>"
    got = out.collect()
    check_shards(got, 7, 1500)
    told = lambda r: repr((r["doc_id"], r["text"], r["s"] and (sorted(r["s"]["m"].items()), r["s"]["l"]), r["n"] and sorted((k, sorted(v.items())) for k, v in r["n"].items())))
    assert Counter(map(told, got)) == Counter(map(told, docs.collect()))
    places = [at for at, r in enumerate(sorted(got, key=lambda r: (r["shard"], r["slot"]))) if r["doc_id"] is None]
    assert len(places) == 500 and places[-1] - places[0] > 1300
    assert sorted((told(r), r["shard"], r["slot"]) for r in got) == sorted((told(r), r["shard"], r["slot"]) for r in shard.shard(docs.repartition(6), n_shards=7, bucket_bytes=4096).collect())
