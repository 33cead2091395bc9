"""Mixing sources to target weights.

Every row gets a hash-random key. Keys are uniform, so their leading hex digits are ranges of equal
size: word counts are summed per (source, range), prefix sums over the ranges find the one range in
which a source's budget ends, and only that range is sorted row by row. The result is one cut key per
source; a document is taken by comparing its key with the cut, so texts are never shuffled.

Defined results
* null or empty text: size 0, nothing taken;
* null source: a source of its own, ranked last;
* null doc_id: keyed by the text alone;
* rows equal in doc_id and text share one key; if the cut falls among them, each takes the same share;
* empty table: empty result; a corpus without words: every target is 0;
* extra columns are ignored by ``mix_plan`` and carried through by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, word_count

#: Up to so many sources are joined by broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"),
                          F.coalesce(F.md5(text), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """From (source, source_size): targets by weight, stopped at cap times the size, the excess reshared.

    Sources fill up in the order of cap / weight, so one sorted pass with prefix sums finds the level
    at which the rest share what is left. The table holds a row per source.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("rank", F.row_number().over(ranked)).withColumn("weight", weight)
    rows = rows.withColumn("limit", F.col("source_size") * cap)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    rows = (rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), zero))
            .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
            .withColumn("full", F.col("limit") * F.col("left_weight") < F.col("left") * F.col("weight")))
    level = F.first(F.when(~F.col("full"), F.struct("left", "left_weight")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        (level["left"] * F.col("weight")).cast("double") / level["left_weight"].cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def source_cuts(sized: DataFrame, weights: tuple[int, ...], cap: int, digits: int) -> DataFrame:
    """From (source, size, key): per source its size, target, whole epochs, cut key and share at the cut."""
    cells = sized.groupBy("source", F.substring("key", 1, digits).alias("cell")).agg(F.sum("size").alias("cell_size"))
    cells = cut(cells)
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, cap)
    budget = F.floor("target")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
                                 .otherwise(0).cast("long"))
    targets = cut(targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    running = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")
                                      .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = (cells.withColumn("upto", running).alias("c")
            .join(targets.select("source", "rest").alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
            .where((F.col("upto") - F.col("cell_size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
            .select("c.source", "cell", (F.col("rest") - F.col("upto") + F.col("cell_size")).alias("room")))
    near = (sized.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source"))
                                  & (F.substring("s.key", 1, digits) == F.col("e.cell")))
            .groupBy("s.source", "s.key", "room").agg(F.sum("size").alias("held"), F.count("*").alias("rows")))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("key")
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = (near.withColumn("upto", upto)
          .where((F.col("upto") - F.col("held") <= F.col("room")) & (F.col("room") < F.col("upto")))
          .select("source", F.col("key").alias("cut_key"),
                  F.floor((F.col("room") - F.col("upto") + F.col("held")) / F.col("rows")).alias("cut_share")))
    return (targets.alias("t").join(at.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")), "left")
            .select("t.source", "source_size", "target", "epochs", "cut_key", "cut_share"))


def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds a struct ``_mix`` (source_size, target, epochs, part) to rows that have source, size and key as _source, _size, _key."""
    cuts = cut(cuts.select(F.struct(*cuts.columns).alias("_cut")))
    small = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(cuts) if small else cuts, F.col("_source").eqNullSafe(F.col("_cut.source")))
    key, at = F.col("_key"), F.col("_cut.cut_key")
    part = F.when(key < at, F.col("_size")).when(key == at, F.col("_cut.cut_share")).otherwise(0).cast("long")
    empty_part = (F.col("_size") == 0) & F.coalesce(key < at, F.lit(False))
    return joined.withColumn("_mix", F.struct("_cut.source_size", "_cut.target", "_cut.epochs", part.alias("part"),
                                              empty_part.alias("empty_part"))).drop("_cut")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"_source": F.col("source"), "_size": word_count(F.col("text")),
                             "_key": mix_key(F.col("doc_id"), F.col("text"), seed)})


def cell_digits(sized: DataFrame) -> int:
    """Hexadecimal digits of a key that name its range, so that a range holds some 10,000 rows of all."""
    return min(8, max(3, math.ceil(math.log(max(1, sized.count() / 10_000), 16))))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, digits: int | None = None) -> DataFrame:
    """A row per document: doc_id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    sized = cut(_keyed(docs.select("doc_id", "text", "source"), seed).select("doc_id", "_source", "_size", "_key"))
    cuts = source_cuts(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")),
                       weights, cap, digits or cell_digits(sized))
    return with_cuts(sized, cuts).select(
        "doc_id", F.col("_size").alias("size"), "_mix.source_size", "_mix.target",
        (F.col("_mix.epochs") * F.col("_size") + F.col("_mix.part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    parts = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1)
    ends = F.filter(F.transform(parts, lambda x, i: F.when(x != "", i + 1)), lambda x: x.isNotNull())
    kept = F.slice(parts, F.lit(1), F.element_at(ends, n.cast("int")))
    return F.substring(text, F.lit(1), F.length(F.array_join(kept, " ")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, digits: int | None = None) -> DataFrame:
    """The mixed rows: each document once per whole epoch and, before the cut, once more.

    The document at the cut appears with its first words only, n_chars following. Columns as in docs.
    """
    sized = cut(_keyed(docs.select("doc_id", "text", "source"), seed).select("_source", "_size", "_key"))
    cuts = source_cuts(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")),
                       weights, cap, digits or cell_digits(sized))
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = with_cuts(_keyed(packed, seed), cuts)
    whole, part, size = F.col("_mix.epochs"), F.col("_mix.part"), F.col("_size")
    copies = F.array_repeat(size, whole.cast("int"))
    last = F.when((part > 0) | F.col("_mix.empty_part"), F.array(part)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_take", F.explode(F.concat(copies, last)))
    short = F.col("_take") < size
    out = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == "text":
            value = F.when(short, first_words(value, F.col("_take"))).otherwise(value)
        elif c == "n_chars":
            value = F.when(short, F.length(first_words(F.col("_row.text"), F.col("_take"))).cast("long")).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS lim FROM sized GROUP BY source),
weighted AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk,
                    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sources),
filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER f, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS rest_w
  FROM weighted WINDOW f AS (ORDER BY lim / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, lim * rest_w < rest * w AS filled FROM filling),
level AS (SELECT rest AS l_rest, rest_w AS l_w FROM marked WHERE NOT filled ORDER BY lim / w, rk LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN filled THEN CAST(lim AS DOUBLE) ELSE CAST(l_rest * w AS DOUBLE) / CAST(l_w AS DOUBLE) END AS target
  FROM marked CROSS JOIN level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM targets),
peers AS (
  SELECT source, key, count(*) AS n, sum(size) AS held FROM sized GROUP BY source, key),
placed AS (
  SELECT p.*, sum(held) OVER (PARTITION BY source ORDER BY key) - held AS start FROM peers p)
SELECT s.doc_id, s.size, b.source_size, b.target,
       CAST(b.epochs * s.size + CASE
         WHEN p.start + p.held <= CAST(floor(target) AS BIGINT) - epochs * source_size THEN s.size
         WHEN p.start >= CAST(floor(target) AS BIGINT) - epochs * source_size THEN 0
         ELSE (CAST(floor(target) AS BIGINT) - epochs * source_size - p.start) // p.n END AS BIGINT) AS taken
FROM sized s
JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN placed p ON s.source IS NOT DISTINCT FROM p.source AND s.key = p.key
"""
