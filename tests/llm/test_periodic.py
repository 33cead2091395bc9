"""Runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np

from tidewatch.llm import periodic


def brute(words, least):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def samples(rng, n):
    for _ in range(n):
        size, letters = rng.randrange(60), rng.choice([1, 2, 2, 3, 4])
        words = [rng.choice("abcd"[:letters]) for _ in range(size)]
        if size and rng.random() < 0.4:
            a = rng.randrange(size)
            p = rng.randrange(1, size - a + 1)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        yield words + words[:rng.randrange(size + 1)] + words if rng.random() < 0.3 else words


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(7)
    for least in (2, 5, 12):
        for together in (1, 100, 1 << 14):
            monkeypatch.setattr(periodic, "_TOGETHER", together)
            texts = list(samples(rng, 300))
            assert list(periodic.runs_of_each(texts, least)) == [brute(t, least) for t in texts]


def test_runs_inside_a_block_are_copied():
    inner = ["x"] * 20
    words = ["a", *inner, "b", "c", *inner, "d", "a", *inner, "b", "c", *inner, "d", "e"]
    assert periodic.find_runs(np.unique(words, return_inverse=True)[1]) == brute(words, 12)
    # a block that reaches into itself
    words = (["p", *["y"] * 15, "q"] * 5)[:-3]
    assert periodic.find_runs(np.unique(words, return_inverse=True)[1]) == brute(words, 12)


def test_pairs_are_extended_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = list(samples(rng, 60))
    monkeypatch.setattr(periodic, "_PAIRS", 7)
    assert list(periodic.runs_of_each(texts, 2)) == [brute(t, 2) for t in texts]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digests_of_a_table(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words) if i % 11 else " \t".join(words) + "\n") for i, words in enumerate(samples(rng, 400))]
    rows += [(None, "z " * 30), (None, None), (-20, "one two " * 9), (-20, "one two " * 9), (500, ""), (501, " \n"), (502, "a b " * 14), (503, "\x1c \x85 " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, periodic.run_digests(docs).collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 10_000]
    got = {tuple(r) for r in periodic.run_digests(odd_docs).collect()}
    assert {expected(*r) for r in rows} <= got and len(got) <= odd_docs.count()
    assert periodic.run_digests(no_docs).count() == 0
    kept = periodic.collapse_repetitions(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert {r["text"] for r in kept.where("doc_id <= 3").collect()} == {r["text"] for r in odd_docs.where("doc_id <= 3").collect()}
    assert periodic.collapse_repetitions(no_docs).count() == 0 and periodic.list_runs(no_docs).count() == 0


def test_collapsing_and_listing(spark):
    docs = spark.createDataFrame([(1, "start " + "ping pong " * 10 + "stop", "text x"), (2, None, None), (3, "plain  text", "b")], "id long, text string, `a b` string")
    out = {r["id"]: r for r in periodic.collapse_repetitions(docs).collect()}
    assert out[1]["text"] == "start ping pong stop" and out[1]["a b"] == "text x" and out[2]["text"] is None and out[3]["text"] == "plain  text"
    assert [tuple(r) for r in periodic.list_runs(docs.withColumnRenamed("id", "doc_id")).collect()] == [(1, 1, 20, 2)]


def test_a_very_long_text(spark):
    rng = random.Random(2)
    body = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    words = body[:30_000] + ["loop", "again", "now"] * 5000 + body[30_000:] + body
    runs = periodic.find_runs(np.unique(words, return_inverse=True)[1])
    assert (30_000, 15_000, 3) in runs and all(words[s + i] == words[s + p + i] for s, n, p in runs for i in range(n - p))
