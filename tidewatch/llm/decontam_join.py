"""The prefix-filtered join of decontamination by shuffle, for benchmarks too large to broadcast.

Whatever the size of the benchmark, the documents are scanned twice: once for how rare words are, once for candidates.

* Rarity: in how many documents a word occurs, in a table of ``SLOTS`` counters by the word's hash. Words that share a counter look
  more common than they are, which costs candidates and loses none: any order of words is a right one.
* Windows: each with its rarest word, the necessary prefix, and that word's offset.
* Candidates: two bit sets of bounded size, one of (prefix word, offset, length), one of windows alone and with their prefix, travel by broadcast. A place of a
  document is a candidate where both hold it, the prefix word stands at its offset and the window ends inside the text. Beyond the
  bound the sets let more places through, and lose none.
* Verification: candidates meet windows on prefix word, offset, length and window, and word by word. A window that more than ``HOT``
  candidates ask for is dealt out over parts, candidates by their document and place.
* Only what was found is brought together: spans by document, then items by document and distinct set of items. A document's list
  of items is as long as what it holds; nothing is cut from it.

Defined results are those of ``decontam``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import by_broadcast_if_small, cut, item_words, ship_package, with_copies

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: A bit set holds 32 bits a key, from 2**16 up to 2**SIEVE_BITS bits (32 MB).
SIEVE_BITS = 28
_BLOCK_BITS = 21
HOT = 100_000
#: Texts are looked through together until they hold so many words.
GROUP_WORDS = 100_000

_STEP, _A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CANDIDATE = pa.struct([("prefix", pa.int64()), ("window", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.binary())])


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def prefix_keys(word: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """One number for a prefix word, its offset in the window and the window's length."""
    return mixed(word + (offset.astype(np.uint64) * np.uint64(1 << 16) + np.uint64(length)) * _STEP)


def pair_keys(prefix: np.ndarray, window: np.ndarray) -> np.ndarray:
    """One number for a window told by its prefix."""
    return mixed(prefix ^ (window * _STEP))


def window_keys(word: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length in order, a number for every window of so many words."""
    power, total = np.ones(1, np.uint64), np.zeros(len(word), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        if n > len(word):
            return
        total = total[:len(word) - n + 1] + word[n - 1:] * power
        power = power * _STEP
        if n in lengths:
            yield n, mixed(total)


class Sieve:
    """A bit for each key's high bits."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.shift = packed, np.uint64(64 - bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def sieve(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """The packed bits of a column of keys and their number in powers of two. Executors pack blocks of 2**21 bits; the driver joins
    them, 32 MB at most."""
    n = keys.select(column).distinct().count()
    bits = min(SIEVE_BITS, max(16, (32 * n).bit_length()))
    size = min(bits, _BLOCK_BITS)
    at = keys.select(F.shiftrightunsigned(column, 64 - bits).alias("at")).distinct().withColumn("block", F.shiftright("at", size))

    def pack(held: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << size, np.uint8)
        flags[held["at"].to_numpy() & ((1 << size) - 1)] = 1
        return pd.DataFrame({"block": held["block"].iloc[:1], "packed": [np.packbits(flags, bitorder="little").tobytes()]})

    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in at.groupBy("block").applyInPandas(pack, "block long, packed binary").toLocalIterator():
        packed[r["block"] << (size - 3):(r["block"] + 1) << (size - 3)] = np.frombuffer(r["packed"], np.uint8)
    return packed, bits


def rarity(docs: DataFrame) -> np.ndarray:
    """In how many documents the words of each slot occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[np.unique(hashes(list(set(item_words(text)))) >> np.uint64(64 - SLOT_BITS))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["slot", "n"])

    held = docs.select(F.col("text").cast("binary")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[held["slot"].to_numpy()] = held["n"].to_numpy()
    return counts


def windows(items: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """(prefix, window, pair, length, words, item_id): every window of the items, once an item. items: item_id string, text binary."""
    held = items.sparkSession.sparkContext.broadcast(counts)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = item_words(text)
                if not words:
                    continue
                n, word = min(width, len(words)), hashes(words)
                common = dict(zip(words, held.value[word >> np.uint64(64 - SLOT_BITS)].tolist()))
                rank = {w: i for i, w in enumerate(sorted(common, key=lambda w: (common[w], w)))}
                ranks = np.fromiter((rank[w] for w in words), np.int64, len(words))
                offset = np.lib.stride_tricks.sliding_window_view(ranks, n).argmin(axis=1)
                prefix = prefix_keys(word[np.arange(len(offset)) + offset], offset, n).view(np.int64)
                window = next(window_keys(word, [n]))[1]
                pair = pair_keys(prefix.view(np.uint64), window).view(np.int64)
                window = window.view(np.int64)
                for i in range(0, len(offset), 4096):
                    some = range(i, min(i + 4096, len(offset)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(prefix[i:i + 4096]), pa.array(window[i:i + 4096]), pa.array(pair[i:i + 4096]), pa.array([n] * len(some), pa.int32()),
                         pa.array([b" ".join(words[s:s + n]) for s in some], pa.binary()), pa.array([item_id] * len(some), pa.string())],
                        ["prefix", "window", "pair", "length", "words", "item_id"])

    return items.select("item_id", "text").mapInArrow(slide, "prefix long, window long, pair long, length int, words binary, item_id string").distinct()


def candidates(texts: list[list[bytes]], lengths: list[int], prefixes: Sieve, held: Sieve) -> list[list[dict]]:
    """For each text, given as its words, the places where a window may stand."""
    out: list[list[dict]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    words = [w for t in texts for w in t]
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    end = (begin + sizes)[doc]
    word = hashes(words)
    for n, keys in window_keys(word, lengths):
        at = np.flatnonzero(held.holds(keys) & (np.arange(len(keys)) + n <= end[:len(keys)]))
        for o in range(n):
            prefix = prefix_keys(word[at + o], np.full(len(at), o), n)
            # common words are prefixes at many offsets; the window's own is the one it is held with
            for k in np.flatnonzero(prefixes.holds(prefix) & held.holds(pair_keys(prefix, keys[at]))):
                s, d = int(at[k]), int(doc[at[k]])
                first = s - int(begin[d])
                out[d].append({"prefix": int(prefix[k].view(np.int64)), "window": int(keys[s].view(np.int64)), "start": first, "end": first + n,
                               "words": b" ".join(words[s:s + n])})
    return out


def scan(docs: DataFrame, lengths: list[int], prefixes: tuple[np.ndarray, int], held: tuple[np.ndarray, int]) -> DataFrame:
    """docs: doc_id long, text binary, _digest string. A row each: doc_id, _digest, n_words, candidates."""
    shared = docs.sparkSession.sparkContext.broadcast((prefixes, held))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = None
        for batch in batches:
            sieves = sieves or [Sieve(*s) for s in shared.value]
            first, group, n = 0, [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                group.append(item_words(text))
                n += len(group[-1])
                if n >= GROUP_WORDS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(group)), batch.column(2).slice(first, len(group)), pa.array(map(len, group), pa.int64()),
                         pa.array(candidates(group, lengths, *sieves), pa.list_(_CANDIDATE))], ["doc_id", "_digest", "n_words", "candidates"])
                    first, group, n = i + 1, [], 0

    return docs.select("doc_id", "text", "_digest").mapInArrow(
        look, "doc_id long, _digest string, n_words long, candidates array<struct<prefix:long,window:long,start:int,end:int,words:binary>>")


def dealt(rows: DataFrame, known: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows joined with the known ones on keys. Keys that more than HOT rows ask for are dealt out over parts, rows by the columns
    ``by``, the known ones to each part."""
    hot = by_broadcast_if_small(rows.groupBy(keys[0]).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).selectExpr(keys[0], f"_n div {HOT} + 1 AS _parts"))
    rows = rows.join(hot, keys[0], "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    known = known.join(hot, keys[0], "left").withColumn("_part", F.explode(F.expr("sequence(0L, coalesce(_parts, 1L) - 1)"))).drop("_parts")
    return rows.join(known, [*keys, "_part"]).drop("_part")


def item_sets(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefix, window, words, set_id) and (set_id, item_id): windows of the same items, as those of a passage that many items share,
    have one set, told by its size and two sums of hashes, and listed once."""
    summed = lambda salt: F.hex(F.bit_xor(F.xxhash64(F.lit(salt), "item_id")))
    sets = cut(known.groupBy("prefix", "window", "words").agg(F.concat_ws(":", F.count("*").cast("string"), summed(1), summed(2)).alias("set_id")))
    one = sets.groupBy("set_id").agg(F.min(F.struct("prefix", "window", "words")).alias("w")).select("set_id", "w.*")
    return sets, one.join(known.select("prefix", "window", "words", "item_id"), ["prefix", "window", "words"]).select("set_id", "item_id")


def _spans(confirmed: DataFrame) -> DataFrame:
    """(doc_id, _digest, spans): disjoint spans in order; a document's are merged by one pass over them in order."""
    doc = Window.partitionBy("doc_id", "_digest").orderBy("start", "end")
    upto = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = confirmed.select("doc_id", "_digest", "start", "end").distinct().withColumn("_new", F.when(F.col("start") <= upto, 0).otherwise(1))
    rows = rows.withColumn("_span", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("doc_id", "_digest", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.groupBy("doc_id", "_digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find(docs: DataFrame, items: DataFrame, width: int, with_items: bool = True) -> DataFrame:
    """docs: doc_id long, text binary, _digest string; items: item_id string, text binary, each once. A row per document: doc_id,
    n_words, spans, items (none without ``with_items``), _digest."""
    ship_package(docs.sparkSession)
    known = cut(windows(items, rarity(docs), width))
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # at most ``width`` of them
    held = known.select(F.explode(F.array("window", "pair")).alias("key"))
    rows = cut(scan(docs, lengths, sieve(known, "prefix"), sieve(held, "key")))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a._digest") == F.col("b._digest")]
    # rows equal in id and text have equal candidates; they are looked at once and dealt out again at the end
    once = rows.where("size(candidates) > 0").groupBy("doc_id", "_digest").agg(F.first("candidates").alias("candidates"))
    places = cut(once.select("doc_id", "_digest", F.explode("candidates").alias("c")).select("doc_id", "_digest", "c.*"))
    sets, members = item_sets(known)
    confirmed = cut(dealt(places, sets, ["window", "prefix", "words"], ["doc_id", "_digest", "start"]).select("doc_id", "_digest", "start", "end", "set_id"))
    out = rows.groupBy("doc_id", "_digest", "n_words").agg(F.count("*").alias("_n"))
    found = _spans(confirmed)
    none = F.array().cast("array<string>")
    if with_items:
        holds = dealt(cut(confirmed.select("doc_id", "_digest", "set_id").distinct()), members, ["set_id"], ["doc_id", "_digest"])
        own = holds.groupBy("doc_id", "_digest").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        found = found.alias("a").join(own.alias("b"), same).select("a.*", "items")
    else:
        found = found.withColumn("items", none)
    out = out.alias("a").join(found.alias("b"), same, "left").select(
        "a.doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", none).alias("items"), "a._digest", "_n")
    return with_copies(cut(out), "_n", "_copy").drop("_copy", "_n")
