"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ``width`` consecutive words (a shorter item is one window).
A window must be contained whole, so of its words, ordered by rarity in the corpus, the first one is a
sufficient prefix: a document can hold the window only where it holds that rarest word. A first pass
counts in how many documents each benchmark word occurs; a second pass joins document words with the
prefix words, bounds the window's place by the word's offset and the window's length by the document's
end, and verifies the words one by one.

Items of at most ``block_bytes`` of text travel by broadcast. Larger benchmarks are joined by shuffle
(``decontam_join``), with the same finds and as few scans of the documents.

Defined results
* null or empty text: no words, no hits; items without words have no window;
* null item_id: reported as the empty string; repeated items count once per item_id;
* repeated documents: a row each; null doc_id: kept as null;
* very long texts are scanned whole; an empty documents or benchmark table gives empty finds;
* extra columns are ignored by ``find`` and carried through by ``decontaminate``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import decontam_join
from tidewatch.llm.common import item_words, ship_package

WIDTH = 13
BLOCK_BYTES = 2 << 20

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def item_windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


class WindowIndex:
    """prefix word -> (offset, length) -> window -> item ids."""

    def __init__(self, items: list[tuple[str, bytes]], frequency: dict[bytes, int], width: int):
        self.prefix: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], set[str]]]] = {}
        for item_id, text in items:
            for window in item_windows(item_words(text), width):
                offset = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i], i))
                at = self.prefix.setdefault(window[offset], {}).setdefault((offset, len(window)), {})
                at.setdefault(window, set()).add(item_id)
        self.words = frozenset(self.prefix)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words, in order, and the items found."""
        shared = self.words.intersection(words)
        spans: list[list[int]] = []
        found: set[str] = set()
        if shared:
            hits = []
            for i, word in enumerate(words):
                if word in shared:
                    for (offset, length), windows in self.prefix[word].items():
                        start = i - offset
                        if start >= 0 and start + length <= len(words):
                            ids = windows.get(tuple(words[start:start + length]))
                            if ids:
                                hits.append((start, start + length))
                                found |= ids
            for start, end in sorted(hits):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
        return [tuple(s) for s in spans], found


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the (bounded) vocabulary occurs."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = held.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(known.intersection(item_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _index_source(docs: DataFrame, items: list[tuple[str, bytes]]):
    """Broadcast of the items and the corpus frequency of their words."""
    ship_package(docs.sparkSession)
    vocabulary = frozenset(w for _, text in items for w in item_words(text))
    frequency = document_frequency(docs, vocabulary) if vocabulary else {}
    return docs.sparkSession.sparkContext.broadcast((items, frequency))


def _find_by_broadcast(docs: DataFrame, items: list[tuple[str, bytes]], width: int) -> DataFrame:
    held = _index_source(docs, items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or WindowIndex(*held.value, width)
            rows = []
            for text in batch.column(1).to_pylist():
                words = item_words(text)
                spans, found = index.find(words)
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], _FOUND.field(i + 1).type) for i in range(3)), batch.column(2)],
                [*_FOUND.names, "_digest"])

    return docs.mapInArrow(scan, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, _digest string")


def is_contaminated(n_hit: int, n_words: int) -> bool:
    """At least one hit word, and hits are 5 % of the words or more."""
    return n_hit > 0 and 20 * n_hit >= n_words


def covered(spans: Column) -> Column:
    """Number of words under any span; spans may overlap."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["upto"], s["end"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def distinct_items(items: DataFrame) -> DataFrame:
    """(item_id string, text binary) of the items with a text, each once."""
    held = items.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    return held.select("item_id", F.col("text").cast("binary").alias("text"))


def _small(items: DataFrame, block_bytes: int) -> list[tuple[str, bytes]] | None:
    """Distinct items for a broadcast; None if their texts are over block_bytes."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return sorted((r["item_id"], bytes(r["text"])) for r in items.collect()) if total <= block_bytes else None


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _rows(docs: DataFrame, digest: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), digest.alias("_digest"))


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, spans of hit words, items (ids of items with occurring windows)."""
    items = distinct_items(items)
    small = _small(items, block_bytes)
    if small is None:
        return decontam_join.find(_rows(docs, _digest()), items, width).drop("_digest")
    return _find_by_broadcast(_rows(docs, F.lit("")), small, width).drop("_digest")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated (the rule of ``is_contaminated``)."""
    return (found.withColumn("n_hit", covered(F.col("spans")))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct("items"))
    return judged(find(docs, items)).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns as they are.

    Where the items travel by broadcast rows are dropped where they stand, without a shuffle; else they are
    dropped by doc_id and text digest.
    """
    items = distinct_items(items)
    small = _small(items, block_bytes)
    if small is None:
        found = decontam_join.find(_rows(docs, _digest()), items, width, with_items=False)
        bad = judged(found).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("_digest").alias("_bad")).distinct()
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), _digest().alias("_text"))
        return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_text") == F.col("_bad")), "left_anti").select("_row.*")
    held = _index_source(docs.select(F.col("text").cast("binary")), small)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or WindowIndex(*held.value, width)
            clean = []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                words = item_words(text)
                hit = sum(b - a for a, b in index.find(words)[0])
                clean.append(not is_contaminated(hit, len(words)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


DECONTAM_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[s:s + least(13, len(words)) - 1], ' ') AS win
  FROM i, unnest(generate_series(1, greatest(1, len(words) - 12))) AS t(s) WHERE len(words) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, s, array_to_string(words[s:s + n - 1], ' ') AS win
  FROM w, lengths, unnest(generate_series(1, len(words) - n + 1)) AS t(s)),
found AS (SELECT doc_id, s, n, item_id FROM starts JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.words) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
