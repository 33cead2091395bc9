"""Business calendars as a dimension: a row per calendar and date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROLL_DAYS = 31
CALENDARS = "calendar_id string, weekend array<int>, valid_until date, label string"
OVERRIDES = "calendar_id string, date date, is_working boolean"
REFS = "calendar_id string, ref_label string, ord int"
HOLIDAYS = "ref_label string, date date, name string"


def date_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row per date, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))


def holiday_union(refs: DataFrame, holidays: DataFrame) -> DataFrame:
    """(calendar_id, date, name, ref_label): each holiday of a calendar once, named by its first reference."""
    joined = refs.join(holidays, "ref_label")
    return joined.groupBy("calendar_id", "date").agg(F.min_by(F.struct("name", "ref_label"), "ord").alias("h")).select(
        "calendar_id", "date", "h.name", "h.ref_label")


def override_conflicts(overrides: DataFrame) -> DataFrame:
    """Dates that are both working and non-working (E403), first per calendar."""
    working = overrides.where("is_working").select("calendar_id", "date")
    resting = overrides.where("not is_working").select("calendar_id", "date")
    return working.intersect(resting).groupBy("calendar_id").agg(F.min("date").alias("date"))


def is_business_day(day: Column, weekend: Column, working: Column, resting: Column, holiday: Column) -> Column:
    """Precedence: working override, non-working override, weekend, holiday."""
    return (F.when(working, True).when(resting, False).when(F.array_contains(weekend, F.weekday(day)), False).otherwise(~holiday))


def business_day_reason(day: Column, weekend: Column, working: Column, resting: Column, name: Column, label: Column) -> Column:
    """Why a date is no business day; null if it is one."""
    return (F.when(working, None).when(resting, "override: non-working day").when(F.array_contains(weekend, F.weekday(day)), "weekend")
            .when(name.isNotNull(), F.concat(F.lit("holiday: "), name, F.lit(" ("), label, F.lit(")"))))


def calendar_days(calendars: DataFrame, overrides: DataFrame, refs: DataFrame, holidays: DataFrame, first: date, last: date,
                  ranges: DataFrame | None = None) -> DataFrame:
    """calendar_id, date, is_bd, reason, prev_bd, next_bd (strictly before and after, within 31 days) and the
    place of a business day in its month: rank, rank from the end, number in the month.

    ranges (ref_label, first_year, last_year) says for which years the holidays are known: ``unknown`` marks days
    that would have to be looked up outside of it (neither overridden nor weekend). The spine is padded so that the asked-for range has its neighbours and whole months.
    """
    days = calendars.select("calendar_id", "weekend", F.explode(F.sequence(
        F.date_sub(F.trunc(F.lit(first), "MM"), MAX_ROLL_DAYS + 1), F.date_add(F.last_day(F.lit(last)), MAX_ROLL_DAYS + 1))).alias("date"))
    marks = overrides.groupBy("calendar_id", "date").agg(F.max("is_working").alias("working"), F.max(~F.col("is_working")).alias("resting"))
    days = days.join(marks, ["calendar_id", "date"], "left").join(holiday_union(refs, holidays), ["calendar_id", "date"], "left")
    working, resting = (F.coalesce(F.col(c), F.lit(False)) for c in ("working", "resting"))
    args = (F.col("date"), F.col("weekend"), working, resting)
    days = days.select("calendar_id", "date", is_business_day(*args, F.col("name").isNotNull()).alias("is_bd"),
                       business_day_reason(*args, F.col("name"), F.col("ref_label")).alias("reason"),
                       (working | resting).alias("overridden"))
    if ranges is None:
        days = days.withColumn("unknown", F.lit(False))
    else:
        known = refs.join(ranges, "ref_label").groupBy("calendar_id").agg(F.max("first_year").alias("first_year"), F.min("last_year").alias("last_year"))
        outside = (F.year("date") < F.col("first_year")) | (F.year("date") > F.col("last_year"))
        looked_up = F.col("reason").isNull() & ~F.coalesce(F.col("overridden"), F.lit(False))
        days = days.join(known, "calendar_id", "left").withColumn("unknown", F.coalesce(outside & looked_up, F.lit(False)))
    days = days.select("calendar_id", "date", "is_bd", "reason", "unknown")
    own = F.when(F.col("is_bd"), F.col("date"))
    by_date = Window.partitionBy("calendar_id").orderBy("date")
    month = F.trunc("date", "MM")
    in_month = Window.partitionBy("calendar_id", month, "is_bd")
    days = days.select(
        "*", F.last(own, ignorenulls=True).over(by_date.rowsBetween(-MAX_ROLL_DAYS, -1)).alias("prev_bd"),
        F.first(own, ignorenulls=True).over(by_date.rowsBetween(1, MAX_ROLL_DAYS)).alias("next_bd"),
        F.row_number().over(in_month.orderBy("date")).alias("rank"), F.row_number().over(in_month.orderBy(F.desc("date"))).alias("rank_end"),
        F.count("*").over(in_month).cast("int").alias("in_month"))
    return days.where(F.col("date").between(F.lit(first), F.lit(last)))
