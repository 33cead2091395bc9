"""Runs (maximal repetitions) among the words of a text, from its longest previous factors.

1. Prefix doubling numbers the factors of 1, 2, 4, ... words; the last numbering orders the suffixes (suffix array),
   and the tables of numbers answer how far two places agree, to the right or to the left.
2. The longest previous factor of a place is the longer of its agreements with the next places to either side in
   the suffix array that lie earlier in the text. Going from factor to factor gives the LZ blocks.
3. Main's extension: a run that touches the boundary between two blocks has a period of at most both lengths
   together, so all (boundary, period) pairs, fewer than two a word, are extended to both sides at once.
4. A run strictly inside a block is a copy of one inside the block's source: runs are held in buckets by their start,
   and what a block's source holds is copied over.

The smallest period is the least one found for a stretch: a repetition with a multiple of its period covers the same stretch.

A text is one record and so one task's; texts are dealt by Spark in batches of Arrow. Time is n log n in its words.

Defined results
* null, empty or white-space texts: no words, no runs, four nulls, digest of nothing;
* null doc_id: hashes to null, so its words are left as they are (``damaged_words``);
* repeated rows: each its own row; empty table: empty result; extra columns are ignored by ``run_digests`` and
  carried by ``collapse_repetitions``, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship_package

#: A run has at least so many words, and at least two periods.
LEAST_WORDS = 12
#: So many (boundary, period) pairs are extended at once.
_PAIRS = 1 << 19
#: Texts of so many words together are looked through at once, longer ones alone.
_TOGETHER = 1 << 14


class _Factors:
    """Numbers of the factors of 2^k words at every place, and agreements read from them."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.n, self.tables = n, [rank]
        width = 1
        while width < n and rank.max() < n - 1:
            after = np.zeros(n, np.int64)  # 0: the text has ended
            after[:n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.tables.append(rank)
            width *= 2
        self.tables = [t.astype(np.int32) for t in self.tables]
        self.order = np.argsort(rank)  # the suffix array: all ranks differ

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in which the texts from i and from j on agree; i < j."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            table = self.tables[k]
            at = np.flatnonzero(j + far < self.n)
            same = at[table[i[at] + far[at]] == table[j[at] + far[at]]]
            far[same] += 1 << k
        return far

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in which the texts up to i and up to j (both excluded) agree; i < j."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            table = self.tables[k]
            at = np.flatnonzero(i - far >= 1 << k)
            same = at[table[i[at] - far[at] - (1 << k)] == table[j[at] - far[at] - (1 << k)]]
            far[same] += 1 << k
        return far


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if none: pointers jump over what is larger."""
    out = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        to = out[open_]
        larger = to >= 0
        larger[larger] = values[to[larger]] > values[open_[larger]]
        open_ = open_[larger]
        out[open_] = out[out[open_]]
    return out


def longest_previous_factors(factors: _Factors) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest factor that also begins earlier, and where it begins (-1: nowhere)."""
    order, n = factors.order, factors.n
    before = _nearest_smaller(order)
    after = n - 1 - _nearest_smaller(order[::-1])[::-1]
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (before, after):
        have = np.flatnonzero((near >= 0) & (near < n))
        place, earlier = order[have], order[near[have]]
        agree = factors.right(earlier, place)
        better = agree > length[place]
        length[place[better]], source[place[better]] = agree[better], earlier[better]
    return length, source


def lz_blocks(length: np.ndarray) -> list[int]:
    """Starts of the blocks, each a longest previous factor or a word not seen before, and the end of the text."""
    lengths, starts, at = length.tolist(), [], 0
    while at < len(lengths):
        starts.append(at)
        at += max(1, lengths[at])
    return [*starts, len(lengths)]


def _at_boundaries(words: np.ndarray, factors: _Factors, edges: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """Repetitions (start, end) -> period that touch a boundary of blocks."""
    sizes = np.diff(edges)
    bounds = edges[1:]  # a boundary, the block before it and the block after it
    pairs = sizes + np.append(sizes[1:], 0)
    found: dict[tuple[int, int], int] = {}
    upto = np.cumsum(pairs)
    first = 0
    while first < len(bounds):
        # whole boundaries, some pairs at a time
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _PAIRS)))
        count = pairs[first:last]
        b = np.repeat(bounds[first:last], count)
        p = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + 1
        first = last
        for i, j in ((b, b + p), (b - p, b)):  # a period to the right, or to the left, of the boundary
            ok = np.flatnonzero((i >= 0) & (j <= factors.n))
            i, j, q = i[ok], j[ok], p[ok]
            touch = np.zeros(len(i), bool)
            inner = np.flatnonzero(j < factors.n)
            touch[inner] = words[i[inner]] == words[j[inner]]
            inner = np.flatnonzero(i > 0)
            touch[inner] |= words[i[inner] - 1] == words[j[inner] - 1]
            i, j, q = i[touch], j[touch], q[touch]
            back, on = factors.left(i, j), factors.right(i, j)
            long = (back + on >= q) & (back + on + q >= least)
            for s, e, q in zip((i - back)[long].tolist(), (j + on)[long].tolist(), q[long].tolist()):
                if q < found.get((s, e), e):
                    found[s, e] = q
    return found


def find_runs(words: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of at least ``least`` words, by start, then period."""
    if len(words) < max(2, least):
        return []
    factors = _Factors(words)
    length, source = longest_previous_factors(factors)
    starts = np.array(lz_blocks(length))
    found = _at_boundaries(words, factors, starts, least)
    buckets = sorted(found)  # by start
    if buckets:
        # blocks that can hold a run strictly inside; words not seen before have no source
        wide = np.flatnonzero(np.diff(starts) >= least + 2)
        for b, end in zip(starts[wide].tolist(), starts[wide + 1].tolist()):
            src = int(source[b])
            shift = b - src
            for s, e in buckets[bisect_right(buckets, (src + 1, -1)):bisect_right(buckets, (b, factors.n + 1))]:
                period = found[s, e]
                # on and on where a block's source reaches into the block
                while e + shift < end and (s + shift, e + shift) not in found:
                    s, e = s + shift, e + shift
                    found[s, e] = period
                    insort(buckets, (s, e))
    return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_of_each(texts: list[list[str]], least: int = LEAST_WORDS) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each of several texts (lists of words). Short texts are looked through together: no number stands
    for words of two texts, so that no factor or run reaches from one into another."""
    at = 0
    while at < len(texts):
        numbers: list[int] = []
        ends, seen = [], 0
        for words in texts[at:]:
            known: dict[str, int] = {}
            numbers += [known.setdefault(w, seen + len(known)) for w in words]
            seen += len(known)
            ends.append(len(numbers))
            if len(numbers) >= _TOGETHER:
                break
        runs = find_runs(np.array(numbers, np.int64), least)
        low = begin = 0
        for end in ends:
            high = bisect_right(runs, (end - 1, len(numbers)), low)
            yield [(s - begin, n, p) for s, n, p in runs[low:high]]
            low, begin = high, end
        at += len(ends)


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words any run contains after its first period."""
    out = np.zeros(n, bool)
    for start, length, period in runs:
        out[start + period:start + length] = True
    return out


_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")


def words_of(text: str | None) -> list[str]:
    return [w for w in text.translate(_SPACES).split(" ") if w] if text else []


def damaged_words(words: list[str], doc_id: int | None) -> list[str]:
    """The words, those of every tenth document (by hash) made periodic from some place on."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
            "collapsed_sha256 string")


def run_digests(docs: DataFrame) -> DataFrame:
    """A row per document: number of runs, the longest one, digests of all runs and of the text without its repeats.
    Words are those of ``damaged_words``."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column(0).to_pylist()
            texts = [damaged_words(words_of(text.as_py()), doc_id) for doc_id, text in zip(ids, batch.column(1))]
            for doc_id, words, runs in zip(ids, texts, runs_of_each(texts)):
                top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                milli = 1000 * top[1] // top[2] if runs else None
                gone = repeated(len(words), runs)
                told = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
                kept = " ".join(w for w, g in zip(words, gone.tolist()) if not g) if runs else " ".join(words)
                rows.append((doc_id, len(runs), *top, milli, told.hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [f.split()[0] for f in _DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _DIGESTS)


def collapse_repetitions(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents, all columns as they are, without words that repeat a run's first period. A text without runs is unchanged
    to the byte; in others the words that stay are joined by single spaces. Null stays null."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def collapsed(texts: pd.Series) -> pd.Series:
        words = [words_of(text) for text in texts]
        return pd.Series([" ".join(w for w, g in zip(own, repeated(len(own), runs).tolist()) if not g) if runs else text
                          for text, own, runs in zip(texts, words, runs_of_each(words, least))], dtype=object)

    return docs.select(*[(collapsed(F.col("`text`")) if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def list_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """A row per run: doc_id, start, length, period (word numbers from 0, in the text as it is)."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = runs_of_each([words_of(text.as_py()) for text in batch.column(1)], least)
            rows = [(doc_id, *run) for doc_id, runs in zip(batch.column(0).to_pylist(), found) for run in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 4)], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, start long, length long, period long")


#: crc32 of a decimal number by the usual table of 256 steps: (doc_id, h), for distinct ids.
CRC_SQL = r"""
bits AS (SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) t(b)
         UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                       lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
        FROM (SELECT DISTINCT doc_id FROM documents) d, steps)
"""

#: Brute force: words that are alike at a distance q in a row are found by their stretches of six (a run of twelve words and
#: two periods has at least six of them), then each stretch keeps its least distance.
PERIODIC_SQL = "WITH RECURSIVE " + CRC_SQL + r""",
plain AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
spot AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM plain LEFT JOIN crc USING (doc_id)),
d AS (SELECT row_number() OVER () AS r, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0
        THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM spot),
six AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS s FROM d, unnest(range(n - 5)) t(i) WHERE n >= 12),
twice AS (SELECT r, s, list(i) AS held FROM six GROUP BY r, s HAVING count(*) > 1),
alike AS (SELECT a.r, a.i, b.i - a.i AS q FROM (SELECT r, s, unnest(held) AS i FROM twice) a JOIN (SELECT r, s, unnest(held) AS i FROM twice) b ON a.r = b.r AND a.s = b.s AND a.i < b.i),
rows_of AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM alike) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM rows_of WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS top FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT r, w, unnest(range(n)) AS i FROM d) x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = x.r AND gone.i = x.i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
       CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
