"""Near duplicates, decontamination and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewatch.llm import ann, decontam, decontam_join, neardup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def variants(rng, n, words=60):
    """A group of edited copies that straddles the threshold."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_of_edited_groups(spark, width):
    rng = random.Random(width)
    texts = [t for n in (90, 12, 5, 2, 1, 1) for t in variants(rng, n)] + ["a b", "A  b", "b a", "a"]
    texts += texts[:6]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in neardup.components(df, width).collect())
    assert got == brute_components(rows, width)


def test_blocks_join_what_the_centre_misses():
    rng = random.Random(5)
    sets = [neardup.shingle_set(t.encode(), 2) for t in variants(rng, 40)]
    rows = [(i, i, neardup.odd_sketch(neardup.signature(s)), s) for i, s in enumerate(sets)]
    links = neardup.joining_links(rows[:20], rows[20:], 80)
    linked = {(i, j) for i in range(20) for j in range(20, 40)
              if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    assert set(links) <= linked and len(links) < 40

    def groups(pairs):
        parent = list(range(40))
        root = lambda x: x if parent[x] == x else root(parent[x])
        for a, b in pairs:
            parent[root(a)] = root(b)
        return [root(x) == root(y) for x in range(40) for y in range(x)]

    assert groups(links) == groups(linked)


def test_odd_sketch_estimates_high_similarity():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(1000)]
    one, two = (np.unique(np.array(base[:950] + [rng.getrandbits(64) for _ in range(50)], np.uint64)) for _ in range(2))
    a, b = (neardup.odd_sketch(neardup.signature(s)).view(np.uint64) for s in (one, two))
    apart = int(np.bitwise_count(a ^ b).sum())
    estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * apart / neardup.SKETCH_BITS)
    assert abs(estimate - 950 / 1050) < 0.15


def test_near_duplicates_odd(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = neardup.components(odd_docs, 2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.deduplicate(odd_docs, 2)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    want = sorted({(str(r["doc_id"]), str(r["text_md5"])) for r in got if r["kept"]})
    assert ids == [d for d, _ in want]
    assert neardup.components(no_docs, 2).collect() == [] and neardup.deduplicate(no_docs).collect() == []


# --- decontamination ---


def brute_find(text, items, width=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, found = set(), set()
    for item_id, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(item))
        n = min(width, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for s in range(len(words) - n + 1) if windows else ():
            if tuple(words[s:s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add("" if item_id is None else str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"b{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 5, 13, 14, 40])))) for i in range(30)]
    rows += [(100, None), (101, " .. "), (None, "Été à LA mer, b1 b2"), (3, rows[3][1]), (10, rows[4][1])]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, spans string")


@pytest.mark.parametrize("block_bytes", [2 << 20, 700])
def test_decontamination(spark, items, odd_docs, block_bytes):
    rng = random.Random(3)
    held = [(r["item_id"], r["text"]) for r in items.collect()]
    docs = [(None, None), (1, ""), (2, "ÉTÉ À LA MER B1 B2"), (2, "été à la mer b1")]
    for i in range(60):
        parts = [" ".join(f"{rng.choice('bd')}{rng.randrange(90)}" for _ in range(rng.randrange(60)))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(2), rng.choice(held)[1] or "")
        docs.append((i, ", ".join(parts)))
    docs += docs[-2:]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontam.judged(decontam.find(df, items, block_bytes=block_bytes)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r["contaminated"]) for r in found)
    assert got == sorted((str(d), *brute_find(t, held)) for d, t in docs)
    kept = decontam.decontaminate(df, items, block_bytes=block_bytes).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in df.collect() if not brute_find(r["text"], held)[4])


def test_decontamination_odd(odd_docs, no_docs, items):
    held = [(r["item_id"], r["text"]) for r in items.collect()]
    got = decontam.decontamination_report(odd_docs, items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in got) == sorted((str(r["doc_id"]), *brute_find(r["text"], held)[:2]) for r in odd_docs.collect())
    assert decontam.decontaminate(odd_docs, items).columns == odd_docs.columns
    assert decontam.decontamination_report(no_docs, items).collect() == []
    assert {r["n_hit"] for r in decontam.decontamination_report(odd_docs, items.limit(0)).collect()} == {0}


def test_decontamination_by_shuffle_odd(odd_docs, no_docs, items):
    """The join by shuffle on odd rows, on no documents, and on items that hold no word."""
    held = [(r["item_id"], r["text"]) for r in items.collect()]
    got = decontam.find(odd_docs, items, block_bytes=1)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in decontam.judged(got).collect()) == sorted((str(r["doc_id"]), *brute_find(r["text"], held)[:2]) for r in odd_docs.collect())
    kept = decontam.decontaminate(odd_docs, items, block_bytes=1)
    assert kept.columns == odd_docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in odd_docs.collect() if not brute_find(r["text"], held)[4])
    assert decontam.find(no_docs, items, block_bytes=1).collect() == []
    wordless = items.where("item_id = 101")
    assert wordless.count() == 1 and {len(r["items"]) for r in decontam.find(odd_docs, wordless, block_bytes=1).collect()} == {0}


@pytest.mark.parametrize("hot, bits", [(40, 28), (100_000, 16)])
def test_decontamination_by_shuffle_hot_passage(spark, monkeypatch, hot, bits):
    """A third of all documents hold one passage, and many items share it: its windows are dealt out in parts; with small bit sets
    more places are candidates, and the finds stay the same."""
    monkeypatch.setattr(decontam_join, "HOT", hot)
    monkeypatch.setattr(decontam_join, "SIEVE_BITS", bits)
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randrange(40)}" for _ in range(30))
    held = [(i, f"{passage} tail{i} of {i}") for i in range(40)] + [(100 + i, " ".join(f"q{rng.randrange(300)}" for _ in range(rng.choice([3, 13, 25])))) for i in range(400)]
    docs = []
    for i in range(300):
        words = " ".join(f"q{rng.randrange(300)}" for _ in range(rng.randrange(40)))
        docs.append((i % 150, f"{words} {passage} {words} {passage}" if i % 3 == 0 else f"{words}, {rng.choice(held)[1].upper()}"))
    docs += docs[:90]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = decontam.judged(decontam.find(df, spark.createDataFrame(held, "item_id long, text string"), block_bytes=1)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r["contaminated"]) for r in found)
    assert got == sorted((str(d), *brute_find(t, held)) for d, t in docs)


def test_window_keys_tell_windows_apart():
    """Keys of a window and of a prefix are the same wherever it stands, and differ for other words, orders, offsets and lengths."""
    words = [b"a", b"b", b"c", b"a", b"b", b"c", b"b", b"a"]
    hashed = decontam_join.hashes(words)
    by_length = dict(decontam_join.window_keys(hashed, [2, 3]))
    for n, keys in by_length.items():
        texts = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        assert len(keys) == len(texts) and len(set(keys.tolist())) == len(set(texts))
    keys = {(w, o, n): int(decontam_join.prefix_keys(decontam_join.hashes([w]), np.array([o]), n)[0]) for w in (b"a", b"b") for o in range(13) for n in range(1, 14)}
    assert len(set(keys.values())) == len(keys)


# --- nearest neighbours ---


def brute_nearest(rows, k=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    queries = {}
    for i, v in sorted(good, key=lambda x: (x[0], x[1].tolist())):
        if i % 100 == 0:
            queries.setdefault(i, v)
    return {q: sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))[:k] for q, v in queries.items()}


def test_nearest_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    recall = sum(len({v for _, v, _ in got[q]} & {i for _, i in best}) for q, best in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.95
    for q, rows in got.items():
        assert [n for n, _, _ in sorted(rows)] == list(range(1, 11))
        assert [(round(s, 9), v) for _, v, s in sorted(rows)] == sorted((round(s, 9), v) for _, v, s in rows)


def test_nearest_neighbours_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)] + [(300 + i, [1.0] * 16) for i in range(60)]
    rows += [(400, None), (500, [0.0] * 16), (600, [1.0, None] + [0.0] * 14), (700, [float("nan")] * 16), (None, [1.0] * 16), (800, [1.0, 2.0]), (801, [1.0, 3.0]),
             (900, []), (5, rows[5][1]), (100, [9.0] * 16)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(4)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
    want = {q: [(round(s, 9), i) for s, i in best] for q, best in brute_nearest(rows).items()}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert ann.search(df.limit(0)).collect() == []


def test_a_rare_dimension_among_many_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(1, 9001)] + [(d * 10_000 + i, rng.standard_normal(d).tolist()) for d in range(5, 12) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id % 100 <> 0 or size(embedding) > 4")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["vec_id"]))
    rare = [r for r in rows if len(r[1]) > 4]
    assert {q: sorted(v) for q, v in got.items()} == {q: [(round(s, 9), i) for s, i in best] for q, best in brute_nearest(rare).items()}
    assert set(ann.centers(df.selectExpr("vec_id", "embedding as v"))) == set(range(4, 12))


def test_centres_of_very_many_vectors(spark):
    vectors = spark.range(9_000_000).selectExpr("id as vec_id", "array(cast(id % 2 as double), 3D) as v")
    center = ann.centers(vectors)[2]
    assert abs(center[0] - 0.5) < 0.1 and center[1] == 3


def test_neighbours_of_very_large_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 16)) * 1e39)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(df).collect()}
    v = np.array([r[1] for r in rows])
    for q in (0, 100):
        far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        assert [got[q, k] for k in range(1, 11)] == list(np.argsort(far)[:10])


@pytest.mark.parametrize("few", [0, 300_000])
def test_heavy_star_is_one_component(spark, few, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_KEYS", few)
    pairs = [(5000, i) for i in range(2500)] + [(9000, 9001), (9001, 9002), (7, 8000)]
    got = {r["node"]: r["comp"] for r in neardup.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got) == {x for p in pairs for x in p}
    assert all(got[x] == 0 for x in (*range(2500), 5000, 8000)) and all(got[x] == 9000 for x in (9000, 9001, 9002))


def test_one_row_of_each_component_whatever_the_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    a, b = " ".join(base), " ".join(near)
    rows = [(7, None), (7, None), (1, a), (1, b), (None, a), (None, b), (2, a), (2, a), (3, "quite another text of its own"), (3, "quite another text of its own"), (4, ""), (4, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    first = min((a, b), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == sorted([(7, None), (7, None), (1, first), (3, "quite another text of its own"), (4, ""), (4, "")], key=str)


def test_benchmark_of_several_blocks_is_read_block_by_block(spark):
    items = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(30)] * 2, "item_id long, text string")
    docs = spark.createDataFrame([(i, "some words before " + " ".join(f"b{i}x{j}" for j in range(3, 18)) + " and after") for i in range(30)], "doc_id long, text string")
    one, many = ({r["doc_id"]: (r["n_words"], r["items"], [tuple(s) for s in r["spans"]]) for r in decontam.find(docs, items, block_bytes=n).collect()} for n in (1 << 20, 1000))
    assert one == many and all(v[1] == [str(k)] for k, v in one.items())


@pytest.mark.parametrize("ids", ["one", "none", "few"])
def test_many_texts_under_one_id(spark, ids):
    """Two thousand texts, half of them near copies of one other: confirmed by id and text, not each with each."""
    rng = random.Random(11)
    texts = []
    for i in range(1000):
        words = [f"w{rng.randrange(5000)}" for _ in range(40)]
        texts += [" ".join(words), " ".join([*words[:-1], f"y{i}"])]
    id_of = {"one": lambda i: 7, "none": lambda i: None, "few": lambda i: i % 3}[ids]
    rows = [(id_of(i), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.components(docs, width=2)
    least = {t: min(filter(lambda x: x is not None, (rows[i][0], rows[i ^ 1][0])), default=None) for i, t in enumerate(texts)}
    digest = {hashlib.md5(t.encode()).hexdigest(): t for t in texts}
    assert sorted((digest[r["text_md5"]], str(r["component_id"])) for r in got.collect()) == sorted((t, str(least[t])) for t in texts)
    assert neardup.deduplicate(docs, width=2).count() == 1000


def test_rows_of_one_id_and_text_keep_the_same_one(spark):
    rows = [(1, "a text of some words", f"s{i % 5}", {"k": i % 5}) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    kept = [neardup.deduplicate(docs.repartition(n), width=2).collect() for n in (1, 3, 7)]
    assert [[tuple(r) for r in k] for k in kept] == [[(1, "a text of some words", "s0", {"k": 0})]] * 3
