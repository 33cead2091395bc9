"""Time functions over columns. Instants are TIMESTAMP_NTZ in UTC, so no session zone can leak in."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.frames import local_frame

#: Zone names the JVM spells differently; fixed values.
ZONE_ALIASES = {"ROC": "Asia/Taipei"}
DAY_US = 86_400_000_000


def ts(value: datetime) -> Column:
    """A UTC instant as a TIMESTAMP_NTZ literal; naive values are taken as UTC."""
    if value.tzinfo is not None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def resolve_local(local: Column, tz: Column) -> Column:
    """Wall time to UTC: a gap moves forward by its length, an overlap takes the first occurrence."""
    return F.convert_timezone(tz, F.lit("UTC"), local)


def to_local(instant: Column, tz: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), tz, instant)


def shift(instant: Column, microseconds: Column) -> Column:
    """Elapsed-time addition."""
    return F.timestamp_add("MICROSECOND", microseconds, instant)


def classify_local(local: Column, tz: Column) -> Column:
    """normal, gap or ambiguous."""
    utc = resolve_local(local, tz)
    back = to_local(utc, tz)
    later = shift(utc, F.lit(26 * 3_600_000_000))
    offset = F.timestamp_diff("SECOND", utc, back)
    offset_later = F.timestamp_diff("SECOND", later, to_local(later, tz))
    again = F.timestamp_add("SECOND", offset - offset_later, utc)
    return (F.when(back != local, "gap")
            .when((offset > offset_later) & (to_local(again, tz) == local), "ambiguous").otherwise("normal"))


def format_plain(instant: Column) -> Column:
    """``2026-01-31 16:00:00``; microseconds, six digits of them, only if there are any."""
    text = instant.cast("string")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def format_utc(instant: Column) -> Column:
    """ISO with Z; microseconds only if there are any."""
    return F.concat(F.translate(format_plain(instant), " ", "T"), F.lit("Z"))


def format_local(instant: Column, tz: Column, names: Column) -> Column:
    """``Fri 2026-09-25 16:00 CEST``; names: the zone's abbreviations as made by ``zone_names``."""
    local = to_local(instant, tz)
    day = F.element_at(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), F.weekday(local.cast("date")) + 1)
    name = F.element_at(F.filter(names, lambda x: x["since"] <= instant), -1)["name"]
    return F.concat_ws(" ", day, F.substring(local.cast("string"), 1, 16), name)


def format_duration(us: Column) -> Column:
    """``1d 2h``, ``1h 45m``, ``<1m``, ``0m``; a sign in front of negative ones."""
    size = F.abs(us)
    parts = [F.floor(size / DAY_US), F.floor(size / 3_600_000_000) % 24, F.floor(size / 60_000_000) % 60]
    shown = [F.when(p > 0, F.concat(p.cast("string"), F.lit(u))) for p, u in zip(parts, "dhm")]
    text = F.when(size == 0, "0m").when(size < 60_000_000, "<1m").otherwise(F.concat_ws(" ", *shown))
    return F.concat(F.when(us < 0, "-").otherwise(""), text)


@lru_cache(maxsize=None)
def _abbreviations(zone: str, first: int, last: int) -> list[tuple[datetime, str]]:
    tz, out = ZoneInfo(zone), [(datetime(1, 1, 2), ZoneInfo(zone).tzname(datetime(first, 1, 1)) or zone)]
    at, end = datetime(first, 1, 1, tzinfo=UTC), datetime(last, 12, 31, tzinfo=UTC)
    name = at.astimezone(tz).tzname()
    out[0] = (out[0][0], name)
    while at < end:
        nxt = at + timedelta(days=7)
        if (later := nxt.astimezone(tz).tzname()) != name:
            lo, hi = at, nxt
            while hi - lo > timedelta(seconds=1):
                mid = lo + (hi - lo) / 2
                lo, hi = (mid, hi) if mid.astimezone(tz).tzname() == name else (lo, mid)
            out.append((hi.replace(microsecond=0, tzinfo=None), later))
            name = later
        at = nxt
    return out


def zone_names(spark: SparkSession, zones: list[str], first: int = 1850, last: int = 2200) -> DataFrame:
    """(tz, names): for each zone its abbreviations with the instants since when they hold. Before ``first`` the
    earliest holds, after ``last`` the last one."""
    rows = [(z, [(since, name) for since, name in _abbreviations(z, first, last)]) for z in sorted(zones)]
    return local_frame(spark, rows, "tz string, names array<struct<since:timestamp_ntz,name:string>>")
