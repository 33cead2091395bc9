"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are centred on the mean of a bounded sample, rotated by a seeded random orthogonal matrix and kept
as the signs of their coordinates (one bit each, in 64-bit words) with two scalars: the distance from the centre
and the inner product of the unit vector with its code. A query's components are quantised into bit planes, so its
inner product with a code is a few ANDs and population counts; it estimates the inner product with the vector, with
an error bound that shrinks with the dimension. Vectors whose lower bound beats the k-th best distance so far, and
those whose bound is not finite, are ranked again by their exact distance.

The query set is read in blocks of at most ``QUERY_BLOCK`` vectors, each broadcast (that is its bound) to one
pass over the codes. A task keeps the k best per query and gives them out at its end; they meet in one
ranked grouping by query. Codes and vectors are never shuffled.

Defined results
* vectors that are null, empty, zero, or hold null or non-finite components take no part, nor rows
  without a vec_id; vectors of other dimensions than a query's are no candidates of it;
* repeated candidate rows count each; of query rows with one vec_id the smallest vector asks;
* ties go to the smaller vec_id; fewer candidates than k: all of them; empty table: empty result;
* extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import by_broadcast_if_small, cut, ship_package

#: Vectors of the sample whose mean is the centre, by dimension (a top-k that Spark limits before it shuffles).
SAMPLE = 1000
QUERY_BLOCK = 8192
#: Up to so many dimensions are joined by broadcast.
DIMENSIONS = 10_000
#: Width of the error bound in the units of the estimator's deviation; 1.9 is usual, more reranks more.
EPSILON = 3.0
#: Steps of a quantised query component, a power of two.
LEVELS = 32
_ROWS_AT_ONCE, _QUERIES_AT_ONCE = 2048, 64
NOBODY = np.iinfo(np.int64).max


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words; the last word is filled up with zeros."""
    wide = np.zeros((bits.shape[0], -(-bits.shape[1] // 64) * 64), bool)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(vectors: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits in 64-bit words, distance from the centre and inner product of unit vector and code."""
    with np.errstate(over="ignore", invalid="ignore"):
        turned = (vectors - center) @ turn
        norm = np.linalg.norm(turned, axis=1)
        aligned = np.abs(turned).sum(axis=1) / (math.sqrt(vectors.shape[1]) * np.where(norm > 0, norm, 1.0))
    return packed_bits(turned > 0), norm, np.where(norm > 0, aligned, 1.0)


class Asked:
    """Turned queries, quantised to LEVELS: bit planes of 64-bit words and the scalars that undo the quantising."""

    def __init__(self, turned: np.ndarray):
        self.dim = turned.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.linalg.norm(turned, axis=1)
            low, high = turned.min(axis=1), turned.max(axis=1)
            self.step = np.where(high > low, (high - low) / (LEVELS - 1), 1.0)
            self.low = low
            level = np.nan_to_num(np.rint((turned - low[:, None]) / self.step[:, None])).astype(np.int64)
            # what quantising loses, as the signs of a code could add it up
            self.lost = np.linalg.norm(turned - (low[:, None] + level * self.step[:, None]), axis=1)
        self.planes = [packed_bits((level >> b) & 1 > 0) for b in range(LEVELS.bit_length() - 1)]
        self.total = level.sum(axis=1)


def bounds(codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray, asked: Asked, part: slice) -> np.ndarray:
    """Lower bounds of squared distances, queries by rows, from population counts of packed codes and query planes.

    The sum of a query's levels where a code's bit is set gives its inner product with the code; a bound that isn't
    finite says nothing, so its row has to be ranked exactly.
    """
    dim, ones = asked.dim, np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    picked = np.zeros((len(range(*part.indices(len(asked.norm)))), len(codes)), np.int64)
    for b, plane in enumerate(asked.planes):
        for word in range(codes.shape[1]):
            picked += np.bitwise_count(plane[part, word][:, None] & codes[None, :, word]).astype(np.int64) << b
    step, low, q_norm = asked.step[part, None], asked.low[part, None], asked.norm[part, None]
    with np.errstate(over="ignore", invalid="ignore"):
        # signs are +1 where the bit is set, else -1
        signed = step * (2 * picked - asked.total[part, None]) + low * (2 * ones[None, :] - dim)
        estimate = signed / math.sqrt(dim) / aligned
        error = EPSILON * (np.sqrt(np.maximum(0, 1 - aligned**2)) / math.sqrt(max(1, dim - 1)) * q_norm + asked.lost[part, None] / math.sqrt(dim)) / aligned
        out = norm**2 + q_norm**2 - 2 * norm * (estimate + error) - 1e-9 * (norm**2 + q_norm**2)
    return np.where(np.isfinite(out), out, -np.inf)


class Best:
    """The k nearest candidates of each query of a block, so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, center: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.queries, self.k = query_ids, queries, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.asked = Asked((queries - center) @ turn)
        self.far = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), NOBODY)

    def see(self, vec_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray) -> None:
        for a in range(0, len(vectors), _ROWS_AT_ONCE):
            rows = slice(a, a + _ROWS_AT_ONCE)
            ids, block = vec_ids[rows], vectors[rows]
            for b in range(0, len(self.queries), _QUERIES_AT_ONCE):
                part = slice(b, b + _QUERIES_AT_ONCE)
                low = bounds(codes[rows], norm[rows], aligned[rows], self.asked, part)
                own = self.ids[part][:, None] == ids[None, :]
                for i in range(low.shape[0]):
                    self._rerank(b + i, low[i], ~own[i], ids, block)

    def _rerank(self, i: int, low: np.ndarray, open_: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        if self.who[i, -1] == NOBODY and len(low) > 4 * self.k:  # a first bound from the most promising rows
            first = np.argpartition(np.where(open_, low, np.inf), 2 * self.k)[:2 * self.k]
            self._take(i, first[open_[first]], ids, block)
            open_ = open_.copy()
            open_[first] = False
        worst = self.far[i, -1]
        with np.errstate(over="ignore"):
            near = open_ if self.who[i, -1] == NOBODY else open_ & (low <= worst * worst)
        self._take(i, np.nonzero(near)[0], ids, block)

    def _take(self, i: int, picked: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        if not len(picked):
            return
        with np.errstate(over="ignore"):
            apart = block[picked] - self.queries[i]
            far = np.concatenate([self.far[i], np.sqrt((apart * apart).sum(axis=1))])
        who = np.concatenate([self.who[i], ids[picked]])
        order = np.lexsort((who, far))[:self.k]
        self.far[i], self.who[i] = far[order], who[order]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def centers(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean of a bounded sample (by hash of the id) for each dimension."""
    sized = vectors.select("vec_id", "v", F.size("v").alias("_dim"))
    counts = sized.groupBy("_dim").agg(F.count("*").alias("_n"))
    # divided, not multiplied: the product of hash and count passes the range of long
    few = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(4.0 * SAMPLE * (1 << 40)) / F.col("_n")
    sample = sized.join(by_broadcast_if_small(counts, DIMENSIONS), "_dim").where(few)
    sample = sample.withColumn("_r", F.row_number().over(Window.partitionBy("_dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v")))
    held = defaultdict(list)
    for row in sample.where(F.col("_r") <= SAMPLE).select("v").collect():
        held[len(row["v"])].append(row["v"])
    return {dim: np.mean(np.array(rows, np.float64), axis=0) for dim, rows in held.items()}



def build_index(vectors: DataFrame, seed: int = 31) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Every usable vector with its code: vec_id, v, code, norm, aligned; and the centres."""
    ship_package(vectors.sparkSession)
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where(_usable(F.col("v")) & F.col("vec_id").isNotNull())
    center = centers(usable)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            n, vs = batch.num_rows, batch.column(1)
            codes, norm, aligned = [b""] * n, np.zeros(n), np.ones(n)
            dims = vs.value_lengths().to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(dims)):
                rows = np.nonzero(dims == dim)[0]
                if dim not in turns:
                    turns[dim] = rotation(dim, seed)
                packed, norm[rows], aligned[rows] = encode(_matrix(vs, rows, dim), center.get(dim, np.zeros(dim)), turns[dim])
                for r, code in zip(rows, packed):
                    codes[r] = code.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), vs, pa.array(codes, pa.binary()), pa.array(norm), pa.array(aligned)],
                                             ["vec_id", "v", "code", "norm", "aligned"])

    kind = usable.schema["v"].dataType.simpleString()
    return usable.mapInArrow(work, f"vec_id long, v {kind}, code binary, norm double, aligned double"), center


def _pass(index: DataFrame, held, seed: int, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(ids, queries, center, rotation(dim, seed), k) for dim, (ids, queries, center) in held.value.items()}
        for batch in batches:
            vs = batch.column(1)
            ids, norm, aligned = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            dims = vs.value_lengths().to_numpy(zero_copy_only=False)
            for dim, found in best.items():
                rows = np.nonzero(dims == dim)[0]
                if len(rows):
                    codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)
                    found.see(ids[rows], _matrix(vs, rows, dim), codes, norm[rows], aligned[rows])
        for found in best.values():
            some = found.who != NOBODY
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(found.ids, some.sum(axis=1))), pa.array(found.who[some]), pa.array(found.far[some])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(work, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 100, k: int = 10, seed: int = 31) -> DataFrame:
    """For each vector whose id is divisible by ``every``: query_id, rank, vec_id, score of its k nearest found."""
    index, center = build_index(vectors, seed)
    index = cut(index)
    asking = cut(index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, math.ceil(asking.count() / QUERY_BLOCK))
    spark, found = vectors.sparkSession, None
    for b in range(blocks):
        held = defaultdict(list)
        for row in asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            held[len(row["v"])].append(row)
        block = {dim: (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64), center.get(int(dim), np.zeros(dim))) for dim, rows in held.items()}
        one = _pass(index, spark.sparkContext.broadcast(block), seed, k)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ANN_SQL = """
WITH e AS (
  SELECT vec_id, embedding AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(qv, v), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS score
      FROM q JOIN e ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
