"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest

from tidewatch.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(("".join(level[i // 3 * 3:i]), "".join(level[i + 1:i // 3 * 3 + 3])))
        i //= 3
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of every row, sorted."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, digest(r))) for s in sources]
    trees = [tree([digest(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (group, levels) in enumerate(zip(groups, trees)):
        for i, r in enumerate(group):
            steps = path(levels, i) + path(top, k)
            h = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            fold = digest({**r, "text": r["text"].replace("\n", "") if h and r["text"] is not None else r["text"]})
            for left, right in steps:
                fold = sha(left + fold + right)
            out.append((r["doc_id"], digest(r), levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def compare(docs):
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.manifest_digests(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("leaves,paths", [(3, 0), (17, 10_000)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, leaves, paths):
    """Sources of one to two hundred rows over many partitions; upper paths by shuffle and by broadcast."""
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "BROADCAST_PATHS", paths)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 9, "zz": 10, "z": 28, None: 82, "hot": 200, "": 5}
    rows, n = [], 0
    for source, size in sizes.items():
        for i in range(size):
            n += 1
            rows.append((n * 7 % 1009, f"text {n}\nwith lines\n" if n % 3 else f"text {n}", "en" if n % 5 else None, source, n))
    compare(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_equal_rows_spread_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 8)
    rows = [(1, "same\n", "en", "a", 5)] * 70 + [(i, f"{i}\n", "en", "a", 1) for i in range(40)] + [(None, None, None, None, None)] * 20
    compare(spark.createDataFrame(rows, SCHEMA).repartition(3))
    largest = merkle._tree(spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce('s' || source, 'n') AS _g", "doc_id AS key", "sha2(coalesce(text, ''), 256) AS leaf", "'' AS seen"))[0]
    assert largest.count() == len(rows)


def test_many_sources_share_batches(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_ROWS", 7)
    monkeypatch.setattr(merkle, "LEAVES", 90)
    compare(spark.createDataFrame([(i, f"{i}\n", None, f"source {i % 150}", i) for i in range(400)], SCHEMA))


def test_one_leaf_and_one_source(spark):
    one = spark.createDataFrame([(4, "a\nb", "en", "s", 3)], SCHEMA)
    compare(one)
    row = merkle.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == [] and row["source"] == "s"
    compare(spark.createDataFrame([(4, "a\nb", "en", "s", 3), (5, "", "", "s", 0)], SCHEMA))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    compare(odd_docs)
    assert merkle.manifest_digests(no_docs).count() == 0
    assert [r["source"] for r in merkle.manifest(odd_docs).select("source").distinct().orderBy("source").collect()] == [None, "a", "b", "c", "d"]
