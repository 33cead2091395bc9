"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades in order (0 toxic, 1 poor, 2 good). One weight per hashed token is shared by all grades; the
sum s of a text's weights meets ordered thresholds: P(grade <= g) = logistic(threshold[g] - s). From these come
the expected grade and the tail probability P(grade >= ``GOOD``), by which documents are selected.

Weights are fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` by hash of their id, features made on
the executors) by full-batch gradient steps; every whole text is scored on the executors.

Defined results
* null or empty text: no features, so the thresholds alone decide;
* labels without a grade (both ratings null) are not learned from; a doc_id labelled twice takes its lowest grade;
* no labels or one grade only: nothing can be learned, every document is kept (tail_prob 1);
* null doc_id: scored like any other; repeated rows: a row each; empty table: empty result;
* extra columns are ignored by ``score`` and carried through by ``select``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, hash_sample, ship_package

TRAIN_ROWS = 6000
BUCKETS = 1 << 18
GRADES = 3
#: The grade from which a document counts as good, and the tail probability from which it is kept.
GOOD, KEEP = 2, 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Capitals of any script.
_CAPITAL = regex.compile(r"\p{Lu}")
_NO_CAPITALS = dict.fromkeys(range(ord("A"), ord("Z") + 1))
_REMEMBERED = 200_000


def tokens(text: str) -> list[str]:
    """The distinct tokens of a text, and marks (beginning with a blank) of its shape as a whole."""
    found = _TOKEN.findall(text.lower())
    out = set(found)
    n = len(found) or 1
    upper = len(_CAPITAL.findall(text)) if not text.isascii() else len(text) - len(text.translate(_NO_CAPITALS))
    marks = (f" distinct {10 * len(out) // n}", f" size {n.bit_length()}", f" upper {10 * upper // (len(text) or 1)}")
    return [*out, *marks]


def buckets(token: str) -> list[int]:
    """Hashed features of a token: itself and how it begins, so that inflected forms share weights."""
    parts = {token} if token[0] == " " else {token, "^" + token[:4], "^" + token[:5]}
    return [zlib.crc32(p.encode()) & (BUCKETS - 1) for p in sorted(parts)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score, as columns."""
        return _sigmoid(s[:, None] - self.thresholds[None, :])


def fit(lengths: np.ndarray, feature: np.ndarray, grades: np.ndarray, steps: int = 120, rate: float = 0.05, l2: float = 5e-4) -> Model | None:
    """Maximise the cumulative-link likelihood with adaptive full-batch steps.

    Rows have ``lengths`` features each, one after the other in ``feature``; repeats of a feature in a row add up.
    """
    if len(set(grades.tolist())) < 2:
        return None
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    seen, feature = np.unique(feature, return_inverse=True)
    feature = feature.astype(np.int32)
    n = len(lengths)
    w = np.zeros(len(seen))
    upto = np.clip(np.array([(grades <= g).mean() for g in range(GRADES - 1)]), 1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(np.log(upto / (1 - upto)) + 1e-3 * np.arange(GRADES - 1))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    edge = lambda p: np.concatenate([np.zeros((n, 1)), p, np.ones((n, 1))], axis=1)
    at = np.arange(n)
    for step in range(1, steps + 1):
        s = np.bincount(owner, w[feature], minlength=n)
        cum = edge(_sigmoid(t[None, :] - s[:, None]))
        slope = cum * (1 - cum)
        hi, lo = cum[at, grades + 1], cum[at, grades]
        p = np.maximum(hi - lo, 1e-9)
        ds = (slope[at, grades + 1] - slope[at, grades]) / p / n  # of minus log likelihood, by s
        gw = np.bincount(feature, ds[owner], minlength=len(w)) + l2 * w
        gt = np.zeros_like(t)
        for g in range(GRADES - 1):
            gt[g] = (np.where(grades == g, -slope[:, g + 1] / p, 0) + np.where(grades == g + 1, slope[:, g + 1] / p, 0)).mean()
        for x, grad, m, v in ((w, gw, mw, vw), (t, gt, mt, vt)):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        t = np.maximum.accumulate(t + 1e-6 * np.arange(GRADES - 1))
    weights = np.zeros(BUCKETS)
    weights[seen] = w
    return Model(weights, t)


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 2)
    rows = labels.select(F.col("doc_id").alias("_id"), grade.alias("grade")).where("grade is not null and _id is not null")
    return rows.groupBy("_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    ship_package(docs.sparkSession)
    sample = hash_sample(cut(graded(labels)), "_id", rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sorted(b for t in tokens(text) for b in buckets(t)) if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "features", "grade"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "grade")
    made = cut(joined.mapInArrow(work, "doc_id long, features array<int>, grade int").dropDuplicates(["doc_id", "features"]))
    # what one or two documents hold can't be told from those documents: it stays on the executors
    often = made.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").count().where("count > 2").select("f")
    often = np.sort(often.toArrow().column("f").to_numpy())
    held = docs.sparkSession.sparkContext.broadcast(often)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x[np.isin(x, held.value, assume_unique=False)] for x in (np.asarray(v.values, np.int32) for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "features", "grade"])

    found = made.mapInArrow(known, "doc_id long, features array<int>, grade int").orderBy("doc_id", "features").limit(rows).toArrow()
    if not found.num_rows:
        return None
    features = found.column("features").combine_chunks()
    return fit(np.diff(features.offsets.to_numpy()), features.flatten().to_numpy(), found.column("grade").to_numpy().astype(np.int64))


class _Weights(dict):
    """Weight of each token seen so far."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.by_bucket = weights

    def __missing__(self, token: str) -> float:
        w = float(self.by_bucket[buckets(token)].sum())
        if len(self) > _REMEMBERED:
            self.clear()
        if len(token) <= 64:
            self[token] = w
        return w


def scores(texts: list[str | None], weights: _Weights) -> np.ndarray:
    """Sum of the weights of a text's distinct tokens and marks."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text:
            out[i] = sum(map(weights.__getitem__, tokens(text)))
    return out


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """A row per document: doc_id, expected_grade, tail_prob, kept."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        weights = _Weights(model.weights) if model else None
        for batch in batches:
            if model:
                tails = model.tails(scores(batch.column(1).to_pylist(), weights))
                expected, tail = tails.sum(axis=1), tails[:, GOOD - 1]
            else:
                expected, tail = np.full(batch.num_rows, GRADES - 1.0), np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= keep)],
                                             ["doc_id", "expected_grade", "tail_prob", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, expected_grade double, tail_prob double, kept boolean")


def select(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, all columns as they are, in one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        weights = _Weights(model.weights) if model else None
        for batch in batches:
            if model:
                tail = model.tails(scores(batch.column(at).to_pylist(), weights))[:, GOOD - 1]
                batch = batch.filter(pa.array(tail >= keep))
            yield batch

    return docs.mapInArrow(work, docs.schema)
