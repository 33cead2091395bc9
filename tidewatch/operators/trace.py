"""What an explanation lists: releases around now with their state, closed days between them, clamp notes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import shift, ts

MAX_GAP_DAYS = 10


def around_now(releases: DataFrame, now: datetime, before: int = 3, after: int = 2) -> DataFrame:
    """The latest ``before`` releases at or before now and the first ``after`` later ones, per source."""
    future = F.col("instant") > ts(now)
    by = Window.partitionBy("source_id", "future")
    rows = releases.withColumn("future", future)
    late = F.row_number().over(by.orderBy(F.desc("instant")))
    early = F.row_number().over(by.orderBy("instant"))
    rows = rows.withColumns({"_late": late, "_early": early})
    return rows.where((~F.col("future") & (F.col("_late") <= before)) | (F.col("future") & (F.col("_early") <= after))).drop("_late", "_early")


def release_state(now: datetime, observed: Column, deadline_text: Column | None = None) -> Column:
    """arrived, future (the first one being the next expected arrival), or occurred with its deadline passed or not."""
    at, deadline = ts(now), shift(F.col("instant"), F.col("grace_us"))
    first = F.row_number().over(Window.partitionBy("source_id", "future").orderBy("instant")) == 1
    named = F.lit("") if deadline_text is None else F.concat(deadline_text, F.lit(" "))
    occurred = F.concat(F.lit("occurred, not arrived; deadline "), named, F.when(deadline < at, "passed").otherwise("not passed"))
    return (F.when(observed >= F.col("instant"), "arrived").when(F.col("future") & first, "future (next expected arrival)").when(F.col("future"), "future")
            .otherwise(occurred))


def closed_days_between(listed: DataFrame, days: DataFrame) -> DataFrame:
    """The closed days strictly between one listed release and the one before, at most ten per pair, with reasons.

    listed: source_id, calendar_id, local (wall time of the release).
    """
    before = F.lag("local").over(Window.partitionBy("source_id").orderBy("local"))
    pairs = listed.select("source_id", "calendar_id", before.cast("date").alias("from_date"), F.col("local").cast("date").alias("to_date")).where("from_date is not null")
    spine = pairs.where("datediff(to_date, from_date) > 1").withColumn("date", F.explode(F.sequence(F.date_add("from_date", 1), F.date_sub("to_date", 1))))
    closed = spine.join(days.where("not is_bd").select("calendar_id", "date", "reason"), ["calendar_id", "date"])
    n = F.row_number().over(Window.partitionBy("source_id", "to_date").orderBy("date"))
    return closed.withColumn("_n", n).where(F.col("_n") <= MAX_GAP_DAYS).select("source_id", "to_date", "date", "reason")


def clamp_text(local: Column, business_days: Column) -> Column:
    """``clamped: February 2026 has only 20 business days``."""
    names = F.array(*[F.lit(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")])
    return F.concat(F.lit("clamped: "), F.element_at(names, F.month(local)), F.lit(" "), F.year(local).cast("string"), F.lit(" has only "),
                    business_days.cast("string"), F.lit(" business days"))


def business_days_per_month(days: DataFrame) -> DataFrame:
    return days.groupBy("calendar_id", F.trunc("date", "MM").alias("month")).agg(F.count_if("is_bd").alias("n"))
