"""Verdicts of many rules at many instants by a sweep over change points.

A verdict changes only at a release, at a deadline or at a load. Rules that share a schedule share its releases: these are made
once for each distinct schedule and numbered in time order, so that what ``evaluate`` looks for is arithmetic on numbers:

* releases up to an instant, up to a load, before a floor or past their deadline are counts, read from one sweep over releases and
  the instants asked for, dealt by schedule and block of time (``carried``);
* the latest, the next and the first release that has not arrived are those of a number, found by equality.

So the work grows with the releases of distinct schedules, the loads and the grid, not with rules times searches; no calendar travels
with a rule, and no schedule, source or block of time is one task's whole.

Rules and instants that counts can't settle (load times beyond the horizon of 1830 days, rules that begin long after the grid, days whose
holidays aren't known, days that roll nowhere) are left to ``evaluate``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.stored import stored
from tidewatch.functions.timeutil import ts
from tidewatch.operators import evaluate as ev
from tidewatch.operators.backtest import carried, loads_as_of
from tidewatch.operators.releases import FLOOR, HORIZON_DAYS, calendar_flags, each_once, kept, schedule_days, times_on

#: What makes a schedule; rules that agree in all of it share one.
SCHEDULE = ("kind", "cron_text", "at_minute", "business_day", "tz", "policy", "calendar_id")
COLUMNS = ("source_id", "evaluated_at", "status", "release", "deadline", "observed_at", "next_expected_arrival", "missed_count", "pending_count")
NEAR = timedelta(days=45)
HORIZON = timedelta(days=HORIZON_DAYS)


def with_schedule(rules: DataFrame) -> DataFrame:
    """The rules with schedule_id, equal for rules of one schedule."""
    return rules.withColumn("schedule_id", F.md5(F.to_json(F.struct(*SCHEDULE), {"ignoreNullFields": "false"})))


def shared_schedules(rules: DataFrame) -> DataFrame:
    """A row per distinct schedule of the rules (with schedule_id)."""
    return rules.groupBy("schedule_id").agg(*[F.first(c).alias(c) for c in ("kind", "cron", "at_minute", "business_day", "tz", "policy", "calendar_id")])


def schedule_releases(schedules: DataFrame, days: DataFrame) -> DataFrame:
    """schedules: with the instants lo and hi. (schedule_id, at, uncertain): its releases from lo to hi, and whether any day around
    could not be decided; a schedule without releases has a row with a null instant."""
    rows = schedules.join(calendar_flags(days), "calendar_id", "left")
    local = lambda c: f"CAST(convert_timezone('UTC', tz, {c}) AS DATE)"
    rows = rows.withColumn("held", F.expr(schedule_days(f"date_sub({local('lo')}, 2)", f"date_add({local('hi')}, 2)")))
    rows = rows.select("schedule_id", "lo", "hi", F.expr(f"transform({each_once(times_on(kept('held')))}, r -> r.instant)").alias("instants"),
                       F.expr("exists(held, x -> x.final IS NULL OR x.unknown)").alias("uncertain"))
    return rows.select("schedule_id", F.explode_outer(F.expr("filter(instants, r -> r BETWEEN lo AND hi)")).alias("at"), "uncertain")


def _releases(schedules: DataFrame, days: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """schedules: with lo, the first instant that matters. All releases from 45 days before it to 45 days after the end, the nearest one
    before and after where these hold none, each with its number in time order."""
    near = schedules.withColumns({"first": F.col("lo"), "lo": F.col("lo") - F.expr("INTERVAL 45 DAYS"), "hi": ts(end + NEAR)})
    found = schedule_releases(near, days)
    ends = found.groupBy("schedule_id").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    held = near.join(ends, "schedule_id", "left")
    # a schedule with nothing in 45 days is thin: its next and last releases are looked for through the horizon
    ahead = held.where(F.col("most").isNull() | (F.col("most") <= ts(end))).withColumns({"lo": ts(end + NEAR), "hi": ts(end + HORIZON)})
    back = held.where(F.col("least").isNull() | (F.col("least") > F.col("first"))).withColumns({"hi": F.col("lo"), "lo": ts(start - HORIZON)}).where("lo < hi")
    least = schedule_releases(ahead, days).groupBy("schedule_id").agg(F.min("at").alias("at"), F.max("uncertain").alias("uncertain"))
    most = schedule_releases(back, days).groupBy("schedule_id").agg(F.max("at").alias("at"), F.max("uncertain").alias("uncertain"))
    return stored(found.unionByName(least).unionByName(most).groupBy("schedule_id", "at").agg(F.max("uncertain").alias("uncertain")))


def verdicts(rules: DataFrame, loads: DataFrame, days: DataFrame, calendars: DataFrame, grid: list[datetime]) -> DataFrame:
    """Verdicts of every rule at the instants of a grid: COLUMNS, as ``evaluate`` gives them.

    loads: source_id, loaded_at and, if they are not all wall times of observed_tz, naive. At each instant a rule sees its latest load so
    far. Neither side is collected; the grid is the driver's."""
    if "naive" not in loads.columns:
        loads = loads.withColumn("naive", F.lit(True))
    start, end = min(grid), max(grid)
    rules = with_schedule(rules).withColumn("floor", F.expr(FLOOR))
    slim = rules.select("source_id", "schedule_id", "grace_us", "observed_tz", "tz", "calendar_id", "active_from", "floor")
    seen = loads.join(slim.select("source_id", "observed_tz"), "source_id").select(
        "source_id", F.expr("CASE WHEN NOT naive THEN loaded_at WHEN observed_tz IS NULL THEN NULL ELSE convert_timezone(observed_tz, 'UTC', loaded_at) END").alias("loaded_at"),
        (F.col("naive") & F.col("observed_tz").isNull()).alias("unplaced"))
    unplaced = seen.where("unplaced").select("source_id").distinct().withColumn("unplaced", F.lit(True))
    instants = F.explode(F.array(*[ts(t) for t in sorted(set(grid))]))
    asked = slim.select("source_id", instants.alias("at"))
    rows = loads_as_of(asked, seen.where("loaded_at is not null").select("source_id", "loaded_at")).withColumnRenamed("last_load", "obs")
    rows = rows.join(slim, "source_id").join(unplaced, "source_id", "left").join(calendars.select("calendar_id", "valid_until"), "calendar_id", "left")
    # a load time beyond the horizon, or a floor that stands for one, and rules that begin long after the grid
    begun = F.coalesce(F.col("obs"), F.when(F.col("floor") <= F.col("at"), F.col("floor")))
    far = (begun < F.col("at") - F.expr(f"INTERVAL {HORIZON_DAYS} DAYS"), F.col("floor") > ts(end + NEAR / 2))
    rows = stored(rows.withColumns({"special": F.coalesce(far[0], F.lit(False)) | F.coalesce(far[1], F.lit(False)),
                                    "due": F.expr("timestampadd(MICROSECOND, -grace_us, at)"), "unplaced": F.coalesce("unplaced", F.lit(False))}))
    first = F.least(F.min(F.least(F.coalesce("obs", "at"), "due")), F.min("floor"), ts(start))
    lows = rows.where("not special").groupBy("schedule_id").agg(F.greatest(first, ts(start - HORIZON)).alias("lo"))
    schedules = shared_schedules(rules).join(lows, "schedule_id", "left").withColumn("lo", F.coalesce("lo", ts(start)))
    releases = _releases(schedules, days, start, end)
    uncertain = releases.where("uncertain").select("schedule_id").distinct().withColumn("uncertain", F.lit(True))
    rows = rows.join(uncertain, "schedule_id", "left").withColumn("special", F.col("special") | F.coalesce("uncertain", F.lit(False)))
    rest = rows.where("special")
    some = rest.limit(1).count()
    rows = rows.where("not special").drop("special", "uncertain")
    releases = releases.where("at is not null").select("schedule_id", "at")

    # counts: releases up to an instant (0) or before it (-2), each asked for once
    up_to, before = F.lit(0), F.lit(-2)
    want = [rows.select("schedule_id", "at", up_to.alias("place")), rows.where("obs is not null").select("schedule_id", F.col("obs").alias("at"), up_to.alias("place")),
            rows.select("schedule_id", F.col("due").alias("at"), before.alias("place")), slim.where("floor is not null").select("schedule_id", F.col("floor").alias("at"), before.alias("place"))]
    asks = want[0].unionByName(want[1]).unionByName(want[2]).unionByName(want[3]).distinct()
    events = releases.select("schedule_id", "at", F.lit(-1).alias("place"), F.lit(1).cast("long").alias("step")).unionByName(asks.withColumn("step", F.lit(0).cast("long")))
    counted = stored(carried(events, "schedule_id", "step", "sum", ("at", "place"), block_minutes=1440).select("schedule_id", "at", "place", F.col("_run").alias("n")))
    numbered = counted.where("place = -1").select(F.col("schedule_id").alias("_s"), F.col("n").alias("_n"), F.col("at").alias("_r"))

    def count(to: DataFrame, at: str, place: int, name: str) -> DataFrame:
        side = counted.where(F.col("place") == place).select(F.col("schedule_id").alias("_s"), F.col("at").alias("_at"), F.col("n").alias(name))
        return to.join(side, (F.col("schedule_id") == F.col("_s")) & (F.col(at) == F.col("_at")), "left").drop("_s", "_at")

    def release(to: DataFrame, number: str, name: str) -> DataFrame:
        return to.join(numbered.withColumnRenamed("_r", name), (F.col("schedule_id") == F.col("_s")) & (F.col(number) == F.col("_n")), "left").drop("_s", "_n")

    out = rows
    for at, place, name in (("at", 0, "c_at"), ("obs", 0, "c_obs"), ("due", -2, "c_due"), ("floor", -2, "c_floor")):
        out = count(out, at, place, name)
    out = out.withColumn("c_floor", F.coalesce("c_floor", F.lit(0))).withColumn("base", F.greatest(F.coalesce("c_obs", "c_floor"), "c_floor"))
    out = out.withColumns({"open_n": F.when(F.col("obs").isNull() & F.col("floor").isNull(), 0).otherwise(F.greatest(F.col("c_at") - F.col("base"), F.lit(0))),
                           "late_n": F.when(F.col("obs").isNull() & F.col("floor").isNull(), 0).otherwise(F.greatest(F.least("c_due", "c_at") - F.col("base"), F.lit(0)))})
    out = out.withColumns({"k_first": F.when(F.col("open_n") > 0, F.col("base") + 1), "k_last": F.when(F.col("c_at") > F.col("c_floor"), F.col("c_at")), "k_next": F.greatest("c_at", "c_floor") + 1})
    for number, name in (("k_first", "first"), ("k_last", "last"), ("k_next", "next")):
        out = release(out, number, name)
    out = out.withColumns({"last": F.expr(f"CASE WHEN last >= timestampadd(DAY, -{HORIZON_DAYS}, at) THEN last END"), "next": F.expr(f"CASE WHEN next <= timestampadd(DAY, {HORIZON_DAYS}, at) THEN next END")})
    broken = "(CAST(convert_timezone('UTC', tz, at) AS DATE) > valid_until OR unplaced OR (last IS NULL AND next IS NULL))"
    status = (f"CASE WHEN coalesce({broken}, false) THEN 'CONFIG_ERROR' WHEN obs IS NULL AND active_from IS NULL THEN 'NO_DATA' WHEN open_n = 0 THEN 'ON_TIME' "
              "WHEN late_n > 0 THEN 'OVERDUE' ELSE 'NOT_DUE' END")
    plain = out.withColumn("status", F.expr(status))
    if_fine = lambda value: f"CASE WHEN status <> 'CONFIG_ERROR' THEN {value} END"
    cap = lambda n: f"least({n}, {ev.MAX_COUNTED}L)"
    plain = plain.withColumn("release", F.expr(if_fine("CASE WHEN status IN ('OVERDUE', 'NOT_DUE') THEN first ELSE last END"))).selectExpr(
        "source_id", "at AS evaluated_at", "status", "release", "timestampadd(MICROSECOND, grace_us, release) AS deadline", f"{if_fine('obs')} AS observed_at",
        f"{if_fine('next')} AS next_expected_arrival", f"CAST(CASE WHEN status = 'OVERDUE' THEN {cap('late_n')} ELSE 0 END AS BIGINT) AS missed_count",
        f"CAST(CASE WHEN status IN ('OVERDUE', 'NOT_DUE') THEN {cap('open_n')} - {cap('late_n')} ELSE 0 END AS BIGINT) AS pending_count")
    if not some:
        return plain
    rest = rest.select("source_id", "at", "obs")
    key = F.concat(F.col("source_id"), F.lit("@"), F.col("at").cast("string"))
    searched = rules.drop("schedule_id", "floor").join(rest, "source_id").withColumns({"source_id": key, "now": F.col("at")}).drop("at", "obs")
    observed = rest.select(key.alias("source_id"), F.col("obs").alias("observed"), F.lit(False).alias("naive"))
    found = ev.evaluate(searched, observed, days, calendars, None).select(*COLUMNS)
    return plain.unionByName(found.withColumn("source_id", F.regexp_replace("source_id", "@[^@]*$", "")))


def replay(rules: DataFrame, loads: DataFrame, days: DataFrame, calendars: DataFrame, start: datetime, end: datetime, step_minutes: int) -> DataFrame:
    """Verdicts of every rule on a grid of instants from start to end."""
    return verdicts(rules, loads, days, calendars, [start + timedelta(minutes=step_minutes * i) for i in range(int((end - start).total_seconds() // 60 // step_minutes) + 1)])
