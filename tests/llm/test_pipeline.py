"""A second computation of every stage of the pipeline, by brute force, on the stage's own input."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

import corpus_pipeline
from tidewatch.llm import quality
from tidewatch.llm.common import table

from test_mix_shard import check_shards, fill
from test_search_dedup import lowered, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(docs, model):
    """Plain sums of the fitted weights over a text's features, and the chance of the best grade."""
    kept = []
    for r in docs:
        text = r["text"] or ""
        found = re.findall(r"\w+|[^\w\s]+", text.lower())
        own = set(found)
        marks = (f" distinct {10 * len(own) // (len(found) or 1)}", f" size {(len(found) or 1).bit_length()}", f" upper {10 * len(regex.findall(r'\p{Lu}', text)) // (len(text) or 1)}")
        features = [p for t in own for p in {t, "^" + t[:4], "^" + t[:5]}] + list(marks)
        s = math.fsum(model.weights[zlib.crc32(p.encode()) % quality.BUCKETS] for p in features) if text else 0.0
        if 1 / (1 + math.exp(model.thresholds[quality.GOOD - 1] - s)) >= quality.KEEP:
            kept.append(r)
    return kept


def one_of_each_group(docs):
    """All pairs by their five-word shingles; of what is linked the first by id stays."""
    sets = [shingles(r["text"], 5) for r in docs]
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    group[root(i)] = root(j)
    best = {}
    for i, r in enumerate(docs):
        if sets[i]:
            best[root(i)] = min(best.get(root(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(docs) if not sets[i] or best[root(i)] == r["doc_id"]]


def clean(docs, items):
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    windows = {tuple(w[i:i + 13]) for w in (split(r["text"]) for r in items) if w for i in range(max(1, len(w) - 12))}
    kept = []
    for r in docs:
        words = split(r["text"])
        hit = {k for n in {len(w) for w in windows} for i in range(len(words) - n + 1) if tuple(words[i:i + n]) in windows for k in range(i, i + n)}
        if not hit or 20 * len(hit) < len(words):
            kept.append(r)
    return kept


def mixed(docs):
    """(doc_id, text) as often as the mix takes it: each source in the order of its keys, round after round, up to its budget."""
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sources = defaultdict(list)
    for r in docs:
        sources[r["source"]].append(r)
    targets = fill({s: sum(map(size, rs)) for s, rs in sources.items()}, (1, 2, 3), 3)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = Counter()
    for source, rows in sources.items():
        rows.sort(key=lambda r: md5(f"17:{r['doc_id']}:{md5(r['text']) if r['text'] is not None else 'null'}"))
        left, total = math.floor(targets[source] + 1e-9), sum(map(size, rows))
        while total and left >= total:
            out.update((r["doc_id"], r["text"]) for r in rows if size(r))
            left -= total
        for r in rows:
            n = min(size(r), left)
            if n:
                ends = [m.end() for m in WORD.finditer(r["text"])]
                out[r["doc_id"], r["text"] if n == size(r) else r["text"][:ends[n - 1]]] += 1
            left -= n
    return out


def test_every_stage_twice(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda rs: sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rs)
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    again = [("quality classifier", lambda rs: good(rs, model)), ("near-duplicate removal", one_of_each_group),
             ("benchmark decontamination", lambda rs: clean(rs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))]
    for name, plain in again:
        held = docs.collect()
        docs = spark.createDataFrame(stages[name](spark, docs, sf_dir).collect(), docs.schema)
        want = plain(held)
        assert key(docs.collect()) == key(want) and len(want) < len(held)
    want = mixed(docs.collect())
    out = stages["source mixing"](spark, docs, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out if WORD.search(r["text"] or "")) == want
    docs = spark.createDataFrame(out, docs.schema)
    rows = stages["sharding"](spark, docs, sf_dir).collect()
    check_shards(rows, 24, len(out))
    assert key(rows) == key(out)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in whole) == Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows)
