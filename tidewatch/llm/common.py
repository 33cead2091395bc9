"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the plain kind: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z, over UTF-8 bytes.
ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The columns of ``documents``; stages carry these and no others.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many keys (about 40 bytes each) travel by broadcast; more are joined by shuffle.
BROADCAST_KEYS = 300_000


def item_words(text: bytes | None) -> list[bytes]:
    return ITEM_WORD.findall(text.lower()) if text else []


def word_count(text: Column) -> Column:
    """Number of WORDs as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder named by spark.checkpoint.dir; only a local session may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidewatch-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read from the shared folder afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def by_broadcast_if_small(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The stored keys, marked for broadcast only if there are at most ``limit`` of them."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


#: Copies of a row that one row is made into at once.
COPIES = 10_000


def with_copies(rows: DataFrame, n: str, copy: str) -> DataFrame:
    """Each row n times, numbered from 1 in ``copy``; rows must be cheap to read twice. What is to be copied very often is dealt
    out in blocks first, so that neither an array nor a task holds all copies of a row."""
    few = rows.where(F.col(n).between(1, COPIES)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    many = rows.where(F.col(n) > COPIES).withColumn("_block", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {COPIES})")))
    many = many.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64("_block", n))
    many = many.withColumn(copy, F.explode(F.expr(f"sequence(_block * {COPIES} + 1, least(_block * {COPIES} + {COPIES}, CAST({n} AS BIGINT)))"))).drop("_block")
    return few.unionByName(many)


def hash_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows (all, if fewer) whose key hashes lowest, for fitting on a bounded sample.

    Rows are first cut to about 4 k by a bound on the hash, so the top-k step gets few rows from each of any
    number of partitions.
    """
    n = rows.count()
    if n > 4 * k:
        bound = int(4 * k / n * (1 << 40)) or 1
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < bound)
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(k)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidewatch-")  # on the driver, which serves it to the executors
    held = Path(folder, "src", package.name)
    shutil.copytree(package, held, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tidewatch"), "zip", held.parent))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
