"""Schedules to releases: days that match, rolled by policy, times of day, instants.

A calendar travels with its rules as two arrays of flags (a byte per day), so the days of a schedule are an
array expression of its own row: no rule meets a table of days, nothing is shuffled or sorted across rules, and a
search looks only as far as it has to.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.frames import local_frame
from tidewatch.functions.cron import CRON_TYPE, parse_cron
from tidewatch.functions.timeutil import classify_local, ts

#: One row per source. Times of day are minutes; instants TIMESTAMP_NTZ in UTC; grace in microseconds.
RULES = (f"source_id string, origin string, kind string, cron_text string, cron struct<{','.join(f.strip().replace(' ', ':', 1) for f in CRON_TYPE.split(', '))}>, "
         "at_minute int, business_day int, tz string, policy string, calendar_id string, grace_us bigint, relation string, "
         "loaded_at_field string, filter string, observed_tz string, active_from date")
ROLLING = ("following", "preceding")
ROLL_DAYS, HORIZON_DAYS = 31, 1830
#: A day of a schedule. ``final`` is null where no business day was found to roll to.
DAY = "struct<final:date,nominal:date,clamped:boolean,unknown:boolean>"


def rule(source_id: str, *, cron: str | None = None, business_days: str | None = None, monthly: tuple[int, str] | None = None,
         tz: str = "UTC", policy: str = "none", calendar_id: str = "default", grace_minutes: int = 0, relation: str = "",
         loaded_at_field: str = "loaded_at", filter: str | None = None, observed_tz: str | None = None, active_from=None, origin: str = "config") -> tuple:
    """A row of RULES from one of the three kinds of schedule."""
    minute = lambda s: int(s[:2]) * 60 + int(s[3:])
    kind = "cron" if cron else "business_days" if business_days else "monthly_business_day"
    at = None if cron else minute(business_days or monthly[1])
    return (source_id, origin, kind, cron, parse_cron(cron).row() if cron else None, at, monthly[0] if monthly else None, tz, policy, calendar_id,
            grace_minutes * 60_000_000, relation, loaded_at_field, filter, observed_tz, active_from)


def rules_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_frame(spark, rows, RULES)


# Long expressions are SQL texts: a text is parsed in one call, where columns built one by one take thousands.

CONSULTS_CALENDAR = "(kind <> 'cron' OR policy <> 'none')"
TIMES_OF_DAY = "(CASE WHEN kind = 'cron' THEN cron.times ELSE array(at_minute) END)"
#: The instant from which a rule is active, or null.
FLOOR = "convert_timezone(tz, 'UTC', CAST(active_from AS TIMESTAMP_NTZ))"


def let(name: str, value: str, body: str) -> str:
    """The body with a name for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def local_day(instant: str) -> str:
    return f"CAST(convert_timezone('UTC', tz, {instant}) AS DATE)"


def days_off(instant: str, days: int) -> str:
    return f"timestampadd(DAY, {days}, {instant})"


def cron_day_matches(d: str) -> str:
    """Day of month and day of week, either one if both are restricted."""
    dom = f"(array_contains(cron.doms, dayofmonth({d})) OR (cron.dom_last AND {d} = last_day({d})))"
    dow = f"(array_contains(cron.dows, weekday({d})) OR exists(cron.nths, o -> o.dow = weekday({d}) AND o.n = CAST(ceil(dayofmonth({d}) / 7) AS INT)))"
    return f"(array_contains(cron.months, month({d})) AND CASE WHEN cron.dom_any OR cron.dow_any THEN {dom} AND {dow} ELSE {dom} OR {dow} END)"


def calendar_flags(days: DataFrame) -> DataFrame:
    """(calendar_id, cal_first, bd, unknown): business days of a calendar and days whose holidays aren't known, from
    ``cal_first`` on, a flag per day. ``days`` has every date of a calendar's span once, as ``calendar_days`` makes it."""
    held = days.groupBy("calendar_id").agg(F.array_sort(F.collect_list(F.struct("date", "is_bd", "unknown"))).alias("held"))
    return held.selectExpr("calendar_id", "held[0].date AS cal_first", "held.is_bd AS bd", "held.unknown AS unknown")


def with_calendar(rules: DataFrame, days: DataFrame) -> DataFrame:
    """Rules with their calendar's flags; a plain cron rule has no need of any."""
    return rules.join(calendar_flags(days), "calendar_id", "left")


def _flag(name: str, day: str) -> str:
    return f"coalesce(get({name}, datediff({day}, cal_first)), false)"


def _roll(day: str) -> str:
    """The business day a closed day rolls to, at most 31 days away; null if there is none."""
    at = f"datediff({day}, cal_first)"
    span = f"least({at}, {ROLL_DAYS})"
    move = (f"CASE WHEN policy = 'following' THEN array_position(slice(bd, {at} + 2, {ROLL_DAYS}), true) "
            f"ELSE -array_position(reverse(slice(bd, {at} - {span} + 1, {span})), true) END")
    return f"CASE WHEN {at} >= 0 THEN {let('mv', move, f'CASE WHEN mv <> 0 THEN date_add({day}, CAST(mv AS INT)) END')} END"


def schedule_days(first: str, last: str) -> str:
    """Array of DAYs with ``first <= final <= last`` in order, one for each final day (its first nominal day tells of
    it), and days that can't roll. Rolling schedules look 31 days farther, as a nominal day outside may roll in.
    Empty where first is after last."""
    day = lambda final, nominal, clamped, unknown: f"named_struct('final', {final}, 'nominal', {nominal}, 'clamped', {clamped}, 'unknown', {unknown})"
    pad = f"CASE WHEN policy IN {ROLLING} THEN {ROLL_DAYS} ELSE 0 END"
    matching = f"filter(sequence(date_sub({first}, {pad}), date_add({last}, {pad})), d -> {cron_day_matches('d')})"
    plain = f"transform({matching}, d -> {day('d', 'd', 'false', 'false')})"
    open_ = lambda span: f"transform(filter({span}, d -> {_flag('bd', 'd')}), d -> {day('d', 'd', 'false', _flag('unknown', 'd'))})"
    final = f"CASE WHEN {_flag('bd', 'd')} THEN d ELSE {_roll('d')} END"
    rolled = f"filter(transform({matching}, d -> {day(final, 'd', 'false', _flag('unknown', 'd'))}), x -> x.final IS NULL OR x.final BETWEEN {first} AND {last})"
    rolled = let("held", rolled, "filter(held, (x, i) -> x.final IS NULL OR i = 0 OR NOT x.final <=> get(held, i - 1).final)")
    months = f"sequence(CAST(trunc({first}, 'MM') AS DATE), CAST(trunc({last}, 'MM') AS DATE), interval 1 month)"
    nth = "CASE WHEN size(bds) > 0 THEN element_at(bds, CAST(signum(business_day) AS INT) * least(abs(business_day), size(bds))) END"
    spans = f"transform({months}, m -> filter(sequence(m, last_day(m)), d -> {_flag('bd', 'd')}))"
    monthly = f"transform({spans}, bds -> {let('d', nth, day('d', 'd', 'abs(business_day) > size(bds)', f'exists(bds, b -> {_flag('unknown', 'b')})'))})"
    monthly = f"filter({monthly}, x -> x.final BETWEEN {first} AND {last})"
    return (f"CASE WHEN {first} > {last} THEN CAST(array() AS array<{DAY}>) "
            f"WHEN kind = 'business_days' THEN {open_(f'sequence({first}, {last})')} WHEN kind = 'monthly_business_day' THEN {monthly} "
            f"WHEN policy = 'none' THEN {plain} WHEN policy = 'skip' THEN {open_(matching)} ELSE {rolled} END")


def kept(days: str) -> str:
    return f"filter({days}, k -> k.final IS NOT NULL)"


def times_on(days: str) -> str:
    """Array of (instant, nominal, minute, local, adjusted_from, clamped): times of day onto days. In the order of
    structs the first of one instant is the nominal that made it first."""
    wall = "timestampadd(MINUTE, mi, CAST(x.final AS TIMESTAMP_NTZ))"
    made = ("named_struct('instant', convert_timezone(tz, 'UTC', wall), 'nominal', x.nominal, 'minute', mi, 'local', wall, "
            "'adjusted_from', CASE WHEN x.final <> x.nominal THEN x.nominal END, 'clamped', x.clamped)")
    return f"flatten(transform({days}, x -> transform({TIMES_OF_DAY}, mi -> {let('wall', wall, made)})))"


def distinct_instants(times: str) -> str:
    """Number of different instants of an array of ``times_on``."""
    return f"size(array_distinct(transform({times}, r -> r.instant)))"


def each_once(times: str) -> str:
    """Instants in order, each once, told of by the first nominal that made it."""
    return let("all_of", f"array_sort({times})", "filter(all_of, (r, i) -> i = 0 OR r.instant <> get(all_of, i - 1).instant)")


RELEASE = ("instant", "tz", "grace_us", "local", "adjusted_from", "clamped", "dst")


def _described() -> list[Column]:
    return [F.col("r.instant").alias("instant"), F.col("tz"), F.col("grace_us"), F.col("r.local").alias("local"), F.col("r.adjusted_from").alias("adjusted_from"),
            F.col("r.clamped").alias("clamped"), classify_local(F.col("r.local"), F.col("tz")).alias("dst")]


def releases_between(rules: DataFrame, days: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """All releases with start <= instant <= end, both included, of each source: an instant once."""
    rows = with_calendar(rules, days).withColumns({"lo": ts(start), "hi": ts(end), "floor": F.expr(FLOOR)})
    times = times_on(kept(schedule_days(f"date_sub({local_day('lo')}, 2)", f"date_add({local_day('hi')}, 2)")))
    wanted = f"filter({times}, r -> r.instant BETWEEN lo AND hi AND (floor IS NULL OR r.instant >= floor))"
    rows = rows.select("source_id", "calendar_id", "tz", "grace_us", F.explode(F.expr(each_once(wanted))).alias("r"))
    return rows.select("source_id", "calendar_id", *_described())


def next_releases(rules: DataFrame, days: DataFrame, now: datetime, count: int, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """The next ``count`` releases of each source, strictly after now: source_id, position, instant and its description.

    Only the first days after now that can hold them are given times of day.
    """
    rows = with_calendar(rules, days).withColumns({"now": ts(now), "floor": F.expr(FLOOR)}).withColumn("today", F.expr(local_day("now")))
    rows = rows.withColumn("from_day", F.expr("date_sub(greatest(today, coalesce(active_from, today)), 2)"))
    days_of = kept(schedule_days("from_day", f"date_add(today, {horizon_days + 2})"))
    some = f"slice({days_of}, 1, CAST(ceil({count} / size({TIMES_OF_DAY})) AS INT) + 8)"
    times = f"filter({times_on(some)}, r -> r.instant > now AND r.instant <= {days_off('now', horizon_days)} AND (floor IS NULL OR r.instant >= floor))"
    rows = rows.select("source_id", "tz", "grace_us", F.posexplode(F.expr(f"slice({each_once(times)}, 1, {count})")).alias("at", "r"))
    return rows.select("source_id", (F.col("at") + 1).alias("position"), *_described())
