"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into phrases,
each the longest match with the language's text; the fewer phrases, weighted by the log of the length of the
labelled text, the closer the language (the cross-parsing estimate of relative entropy). The parse runs over the whole
text, its words joined by single blanks, and phrases go on across words.

The automata are fitted on a bounded sample of labelled rows (``DOCS_PER_LANGUAGE`` rows by hash of their
id, ``CHARS_PER_LANGUAGE`` characters); every whole text is parsed.

Defined results
* null text or a text without a letter: ``und`` with score 0; no labelled row at all: ``und`` for all;
* null lang: not learned from; null doc_id: not learned from, held_out false;
* ties between languages go to the first by code point; repeated rows: a row each;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import by_broadcast_if_small, ship_package

DOCS_PER_LANGUAGE = 200
CHARS_PER_LANGUAGE = 60_000
#: Up to so many labels are joined by broadcast.
LANGUAGES = 10_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def suffix_automaton(text: str) -> dict:
    """The start state; a state is a dict from character to state, and every path from the start spells a substring."""
    start: dict = {}
    step, link, length = [start], [-1], [0]
    last = 0
    for c in text:
        here = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = here
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 != length[q]:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[here] = q
        last = here
    for state in step:  # numbers become the states themselves
        for c, to in state.items():
            state[c] = step[to]
    return start


def phrases(start: dict, text: str) -> int:
    """Number of longest matches that a greedy parse of the text needs; a character never seen is one by itself."""
    n, state = 0, start
    for c in text:
        to = state.get(c)  # phrases are short: raising at each end would cost more than asking each time
        if to is None:
            n += state is not start
            to = start.get(c)
            if to is None:
                n += 1
                to = start
        state = to
    return n + (state is not start)


class Model:
    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.weight = [math.log2(max(2, len(texts[lang]))) for lang in self.languages]
        self.starts = [suffix_automaton(texts[lang]) for lang in self.languages]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letters(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        joined = f" {' '.join(words)} "
        cost = sorted((w * phrases(start, joined), lang) for w, start, lang in zip(self.weight, self.starts, self.languages))
        return cost[0][1], 1.0 if len(cost) == 1 else 1.0 - cost[0][0] / cost[1][0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_texts(docs: DataFrame) -> dict[str, str]:
    """A bounded sample of labelled text per language, as words between spaces."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # about four times the rows needed pass a bound on the hash, so that no language sends more to one task;
    # divided, not multiplied: the product of hash and count passes the range of long
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    hashed = labelled.select("lang", "text", "doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("_h"))
    few = hashed.join(by_broadcast_if_small(counts, LANGUAGES), "lang").where(F.col("_h") < F.lit(4.0 * DOCS_PER_LANGUAGE * (1 << 40)) / F.col("_n"))
    # equal rows hash alike: one of them will do
    few = few.groupBy("lang", "doc_id", "_h").agg(F.first("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    rows = few.withColumn("_r", order).where(F.col("_r") <= DOCS_PER_LANGUAGE).orderBy("lang", "_r").select("lang", F.substring("text", 1, CHARS_PER_LANGUAGE).alias("text"))
    out: dict[str, str] = {}
    for row in rows.toLocalIterator():
        held = out.get(row["lang"], " ")
        if len(held) < CHARS_PER_LANGUAGE and (words := letters(row["text"])):
            out[row["lang"]] = (held + " ".join(words) + " ")[:CHARS_PER_LANGUAGE]
    return {lang: text for lang, text in out.items() if len(text) > 1}


_MODELS: dict[tuple, Model] = {}


def _model(texts: dict[str, str]) -> Model:
    """One model per worker process, so that automata and words stay from task to task."""
    key = tuple(sorted(texts.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


def identify(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (by how much the best parse is shorter than the next)."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(training_texts(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")
