"""Sharding: a two-pass external shuffle with DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets that fit in memory; pass two runs the built-in
Fisher-Yates ``shuffle`` on each bucket. Bucket offsets (prefix sums over bucket counts) turn the place
in a bucket into a global place, and equal runs of places are the shards, so shard counts differ by one
at most (law ``rows``).

The random numbers of ``shuffle`` follow the seed and the partition; buckets are dealt by an explicit
repartition and ordered within partitions and their rows are sorted first, so reruns agree.

Defined results
* null text: no bytes (size 8, crc32 of nothing); null doc_id: hashed as null;
* rows equal in every column are numbered first, and so scatter as well;
* maps, those inside of structs, arrays and maps too, are carried as sorted entries and given back as maps;
* empty table: empty result; columns of any name are carried in one struct, so no name clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import BROADCAST_KEYS, cut, with_copies

#: Cells of the hash space from which buckets are made: whole neighbouring cells, so the number of
#: buckets can follow the bytes counted without hashing twice.
CELLS = 1 << 20
#: Bytes a row counts for in a bucket beside its text, so that a bucket of very many short or null texts fits in memory too.
ROW_BYTES = 64


def _shuffled(rows: DataFrame, cells: DataFrame, n_shards: int, bucket_bytes: int, seed: int) -> DataFrame:
    """rows: _cell, _row (a sortable struct); cells: _cell, n, bytes. Adds shard and slot to _row."""
    cells = cut(cells)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    n, buckets = total["n"], min(CELLS, max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total["b"] / bucket_bytes)))

    def bucket(cell: Column) -> Column:
        return F.floor(cell * buckets / CELLS).cast("int")

    counts = cells.groupBy(bucket(F.col("_cell")).alias("_bucket")).agg(F.sum("n").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_bucket", start.alias("_start"))
    dealt = rows.select(bucket(F.col("_cell")).alias("_bucket"), "_row").repartition(buckets, "_bucket")
    arrays = dealt.groupBy("_bucket").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    arrays = arrays.sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    placed = (arrays.join(starts, "_bucket")
              .select("_start", F.posexplode("_rows").alias("_at", "_row"))
              .withColumn("_place", F.col("_start") + F.col("_at")))
    shard = F.floor(F.col("_place") * n_shards / max(n, 1))
    placed = placed.withColumn("_shard", shard)
    # floor over doubles may round up at an edge far out; integer bounds settle it
    low = F.expr(f"(_shard * {n} + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("_shard", F.when(F.col("_place") < low, F.col("_shard") - 1).otherwise(F.col("_shard")))
    return placed.select("_row", F.col("_shard").cast("int").alias("shard"), (F.col("_place") - low).cast("long").alias("slot"))


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _has_map(kind: T.DataType) -> bool:
    return (isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)
            or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields))


def _entries(c: Column, kind: T.DataType) -> Column:
    """The value with sorted entries instead of maps, which have no order and can't be compared."""
    if not _has_map(kind):
        return c
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_entries(e["key"], kind.keyType).alias("key"), _entries(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _entries(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[_entries(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))


def _maps(c: Column, kind: T.DataType) -> Column:
    """The inverse of ``_entries``."""
    if not _has_map(kind):
        return c
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(_maps(e["key"], kind.keyType).alias("key"), _maps(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _maps(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[_maps(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))


def shard(docs: DataFrame, n_shards: int = 24, bucket_bytes: int = 16 << 20, seed: int = 23) -> DataFrame:
    """Whole rows with shard and slot added (input columns of those names are replaced).

    ``docs`` is read three times (for repeated rows, for the sizes of buckets, for the scatter), so it should be stored. A row
    whose hash is no other's is scattered as it is, by the only shuffle of whole rows; repeated rows are counted first, then
    numbered, so that a large group of them scatters like any others. Only where very many rows are repeated are all counted."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    kinds = {c: docs.schema[c].dataType for c in keep}
    rows = docs.select(F.struct(*[_entries(F.col(f"`{c}`"), kinds[c]).alias(c) for c in keep]).alias("_row"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_row"))
    twice = cut(rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_hash").alias("_twice")))
    if twice.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(twice), F.col("_hash") == F.col("_twice"), "left")
        once, often = marked.where("_twice is null").select("_row", F.lit(1).cast("long").alias("_copy")), marked.where("_twice is not null")
    else:
        once, often = None, rows
    counted = cut(often.groupBy("_row").agg(F.count("*").alias("_n")))
    numbered = with_copies(counted, "_n", "_copy").select("_row", "_copy")
    numbered = numbered if once is None else once.unionByName(numbered)
    scattered = numbered.select(F.pmod(F.xxhash64(F.lit(seed), "_row", "_copy"), F.lit(CELLS)).alias("_cell"), "_row")
    cells = (scattered.select("_cell", byte_size(F.col("_row").getField("text")).alias("size")).groupBy("_cell")
             .agg(F.count("*").alias("n"), F.sum(F.col("size") + ROW_BYTES).alias("bytes")))
    out = _shuffled(scattered, cells, n_shards, bucket_bytes, seed)
    return out.select(*[_maps(F.col("_row").getField(c), kinds[c]).alias(c) for c in keep], "shard", "slot")


def shard_plan(docs: DataFrame, n_shards: int = 24, **options) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law). Size and checksum
    are those of the text that ``shard`` brought to that place."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return shard(docs, n_shards, **options).select("doc_id", byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                                                   F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **options) -> None:
    """Pass two writes what it shuffled: each shard is a folder shard=K of Parquet files, a file for each bucket that
    reaches into it, rows in slot order. A bucket's rows are neighbours, so it has rows of a shard or a few."""
    shard(docs, n_shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
