"""Verdicts for all sources in one plan: rules, release days, times, load times, conditional aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import classify_local, format_duration, format_plain, format_utc, ts, zone_names
from tidewatch.operators.releases import (
    CONSULTS_CALENDAR, DAY, FLOOR, HORIZON_DAYS, TIMES_OF_DAY, days_off, distinct_instants, kept, let, local_day, schedule_days, times_on, with_calendar,
)

MAX_COUNTED, CONSULT_DAYS, NEAR_DAYS = 10_000, 34, 45
FUTURE_SKEW_US = 5 * 60_000_000


def _issue(code: str, *message: str) -> str:
    return f"named_struct('code', '{code}', 'message', concat({', '.join(message)}))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def normalize_observed(rules: DataFrame, observations: DataFrame) -> DataFrame:
    """observations: source_id, observed (TIMESTAMP_NTZ) and naive (is it wall time in observed_tz?). Adds the instant,
    W002 (zone ignored), W003 (future) and E214 (wall time without a zone); ``now`` is a column of the rules. Codes and
    messages are fixed values of the report format."""
    rows = rules.join(observations.select("source_id", "observed", "naive"), "source_id", "left")
    rows = rows.withColumn("observed_at", F.expr("CASE WHEN naive THEN convert_timezone(observed_tz, 'UTC', observed) ELSE observed END"))
    late = F.timestamp_diff("MICROSECOND", F.col("now"), F.col("observed_at"))
    rows = rows.withColumns({"late": late, "late_text": format_duration(late), "utc_text": format_utc(F.col("observed_at")), "plain_text": format_plain(F.col("observed"))})
    e214 = _issue("E214", _q("max("), "loaded_at_field", _q(") returned a timestamp without time zone ("), "plain_text",
                  _q("); set observed_timezone on the source or under defaults (write UTC explicitly if the column stores UTC)"))
    w002 = _issue("W002", _q("observed_timezone '"), "observed_tz", _q("' ignored because the value is timezone-aware"))
    w003 = _issue("W003", _q("observed timestamp "), "utc_text", _q(" is "), "late_text", _q(" after now; check observed_timezone or clock skew"))
    return rows.withColumns({
        "e214": F.expr(f"CASE WHEN observed IS NOT NULL AND naive AND observed_tz IS NULL THEN {e214} END"),
        "noted": F.expr(f"array_compact(array(CASE WHEN observed IS NOT NULL AND NOT naive AND observed_tz IS NOT NULL THEN {w002} END, "
                        f"CASE WHEN late > {FUTURE_SKEW_US} THEN {w003} END))")}).drop("late", "late_text", "plain_text")


#: Days around today that can hold the last or the next release: today and its neighbours, three before and five
#: after. Offsets of one zone differ by at most a day, so a farther day can't come first.
_AROUND = let("held", kept("filter(near, x -> active_from IS NULL OR x.final >= date_sub(active_from, 1))"), let(
    "past", "filter(held, x -> x.final < date_sub(today, 1))",
    "concat(slice(past, greatest(size(past) - 2, 1), 3), filter(held, x -> x.final BETWEEN date_sub(today, 1) AND date_add(today, 1)), "
    "slice(filter(held, x -> x.final > date_add(today, 1)), 1, 5))"))
_ACTIVE = "(floor IS NULL OR r.instant >= floor)"
_PAST = f"r.instant <= now AND r.instant >= oldest AND {_ACTIVE}"
_FUTURE = f"r.instant > now AND r.instant <= {days_off('now', HORIZON_DAYS)} AND {_ACTIVE}"
_LATE = "timestampadd(MICROSECOND, grace_us, r.instant) < now"


def _latest(times: str) -> str:
    """The latest release so far, told of by its first nominal."""
    return let("had", f"filter({times}, r -> {_PAST})", let("top", "array_max(transform(had, r -> r.instant))", "array_min(filter(had, r -> r.instant = top))"))


def in_steps(rows: DataFrame, steps: list[dict[str, str]], at_once: int = 3) -> DataFrame:
    """Columns added step by step, several steps a statement: the plan is analysed once for each statement."""
    for i in range(0, len(steps), at_once):
        text = "SELECT * FROM {rows}"
        for step in steps[i:i + at_once]:
            text = f"SELECT *, {', '.join(f'{value} AS {name}' for name, value in step.items())} FROM ({text})"
        rows = rows.sparkSession.sql(text, rows=rows)
    return rows


def _search() -> list[dict[str, str]]:
    """The steps that add last, next_release, the first of the releases since the load time with their counts, and the days that
    could not be decided.

    A search takes 45 days around now first; the full horizon of 1830 days is looked through only by rules that
    find nothing there, or whose data are older (``CASE`` leaves the rest unevaluated)."""
    steps: list[dict[str, str]] = []
    steps.append(dict(today=local_day("now"), first_day=local_day("start"), oldest=days_off("now", -HORIZON_DAYS)))
    steps.append(dict(near=schedule_days(f"date_sub(today, {NEAR_DAYS})", f"date_add(today, {NEAR_DAYS})")))
    steps.append(dict(around=times_on(_AROUND)))
    steps.append(dict(last_near=_latest("around"), next_near=f"array_min(filter(around, r -> {_FUTURE}))"))
    # farther days are asked for by their spans, so that the text of a schedule's days stands here once for all of them
    begin = f"date_sub(today, {HORIZON_DAYS + 2})"
    span = lambda first, last: f"named_struct('a', {first}, 'b', {last})"
    back = span(f"greatest({begin}, date_sub(coalesce(active_from, {begin}), 1))", f"date_sub(today, {NEAR_DAYS - 2})")
    ahead = span(f"greatest(date_add(today, {NEAR_DAYS - 2}), date_sub(coalesce(active_from, today), 1))", f"date_add(today, {HORIZON_DAYS + 2})")
    whole, recent = span("date_sub(first_day, 2)", "date_add(today, 2)"), span(begin, "date_add(today, 2)")
    steps.append(dict(spans=f"array(CASE WHEN last_near IS NULL AND (floor IS NULL OR floor <= now) THEN {back} END, CASE WHEN next_near IS NULL THEN {ahead} END, "
                            f"CASE WHEN stale THEN {recent} WHEN first_day < date_sub(today, {NEAR_DAYS - 4}) THEN {whole} END)"))
    steps.append(dict(far=f"transform(spans, s -> CASE WHEN s IS NOT NULL THEN {schedule_days('s.a', 's.b')} END)"))
    # counting: as many days from the load time on as reach the cap
    steps.append(dict(far_back="far[0]", far_ahead="far[1]", since_days=f"CASE WHEN start IS NULL THEN NULL WHEN NOT stale AND first_day >= date_sub(today, {NEAR_DAYS - 4}) "
                      f"THEN filter(near, x -> x.final IS NULL OR x.final BETWEEN date_sub(first_day, 2) AND date_add(today, 2)) ELSE far[2] END"))
    end = let("held", kept("far_back"), "slice(held, greatest(size(held) - 3, 1), 4)")
    steps.append(dict(last=f"coalesce(last_near, CASE WHEN far_back IS NOT NULL THEN {_latest(times_on(end))} END)",
                        next_release=f"coalesce(next_near, CASE WHEN far_ahead IS NOT NULL THEN array_min(filter({times_on(f'slice({kept("far_ahead")}, 1, 5)')}, r -> {_FUTURE})) END)"))
    after_start = "CASE WHEN inclusive THEN r.instant >= start ELSE r.instant > start END"
    some = lambda days: times_on(f"slice({kept(days)}, 1, CAST(ceil({MAX_COUNTED} / size({TIMES_OF_DAY})) AS INT) + 8)")
    steps.append(dict(since=f"filter({some('since_days')}, r -> r.instant <= now AND {_ACTIVE} AND CASE WHEN stale THEN r.instant >= oldest ELSE {after_start} END)"))
    steps.append(dict(by_recent=f"coalesce(stale AND exists(since, r -> {_LATE}), false)"))
    steps.append(dict(old_days=f"CASE WHEN stale AND NOT by_recent THEN {schedule_days('date_sub(first_day, 2)', 'date_add(today, 2)')} END"))
    steps.append(dict(counted=f"CASE WHEN old_days IS NOT NULL THEN filter({some('old_days')}, r -> r.instant <= now AND {_ACTIVE} AND {after_start}) ELSE since END"))
    capped = lambda times: f"CAST(least(coalesce({distinct_instants(times)}, 0), {MAX_COUNTED}) AS BIGINT)"
    steps.append(dict(first=f"{let('f', 'array_min(counted)', f'CASE WHEN NOT stale OR by_recent OR f.instant <= {days_off("start", HORIZON_DAYS)} THEN f END')}",
                        n=capped("counted"), missed=capped(f"filter(counted, r -> {_LATE})")))
    # days that can't be decided matter where a search gets to them
    lo, hi = (f"coalesce({a}, {b})" for a, b in (("date_sub(last.nominal, 2)", f"date_sub(today, {HORIZON_DAYS + 40})"),
                                                 ("date_add(next_release.nominal, 2)", f"date_add(today, {HORIZON_DAYS + 40})")))
    parts = [f"coalesce(filter({c}, x -> x.nominal BETWEEN lo.a AND lo.b AND (x.final IS NULL OR x.unknown)), CAST(array() AS array<{DAY}>))" for c in ("near", "far_back", "far_ahead")]
    parts += [f"coalesce(filter({c}, x -> x.nominal <= today AND (x.final IS NULL OR x.unknown)), CAST(array() AS array<{DAY}>))" for c in ("since_days", "old_days")]
    steps.append(dict(touched=let("lo", f"named_struct('a', {lo}, 'b', {hi})", f"concat({', '.join(parts)})")))
    steps.append(dict(roll_failed_on="array_min(transform(filter(touched, x -> x.final IS NULL), x -> x.nominal))",
                      unknown_on="array_min(transform(filter(touched, x -> x.unknown), x -> x.nominal))"))
    return steps


#: ``Fri 2026-09-25 16:00 CEST``, of the instants a sentence speaks of.
_TEXTS = """transform(array(release.instant, timestampadd(MICROSECOND, grace_us, release.instant), next_at, seen_at), t -> CASE WHEN t IS NOT NULL THEN """ + let(
    "wall", "convert_timezone('UTC', tz, t)",
    "concat_ws(' ', substr('MonTueWedThuFriSatSun', weekday(CAST(wall AS DATE)) * 3 + 1, 3), substr(CAST(wall AS STRING), 1, 16), "
    "element_at(filter(names, z -> z.since <= t), -1).name)") + " END)"


def _explanation() -> str:
    """One sentence per verdict. The sentences are fixed values of the report format."""
    text = lambda *parts: f"concat({', '.join(parts)})"
    release, deadline, following, observed = (f"texts[{i}]" for i in range(4))
    then = f"coalesce({text(_q('next release '), following)}, {_q('no next release within 1830 days')})"
    noun = f"CASE WHEN missed_count = 1 THEN {_q(' release missed')} ELSE {_q(' releases missed')} END"
    missed = text(f"CASE WHEN missed_truncated THEN {_q('at least ')} ELSE '' END", "CAST(missed_count AS STRING)", noun)
    pending = f"CASE WHEN pending_count = 1 THEN '' ELSE {text(_q(' ('), 'CAST(pending_count AS STRING)', _q(' releases pending)'))} END"
    on_time = (f"coalesce({text(_q('On time: latest release '), release, _q(' arrived (observed '), observed, _q('); '), then, _q('.'))}, "
               f"{text(_q('On time: no release has occurred yet; '), then, _q('.'))})")
    return (f"CASE WHEN status = 'CONFIG_ERROR' THEN {text(_q('Configuration error: '), 'error.code', _q(' '), 'error.message')} "
            f"WHEN status = 'QUERY_ERROR' THEN {text(_q('Query error: '), 'query_error.code', _q(' '), 'query_error.message')} "
            f"WHEN status = 'NO_DATA' THEN {text(_q('No data: max('), 'loaded_at_field', _q(') returned NULL; latest release '), f'coalesce({release}, {_q("none")})', _q('; '), then, _q('.'))} "
            f"WHEN status = 'ON_TIME' THEN {on_time} "
            f"WHEN status = 'NOT_DUE' THEN {text(_q('Not due: release '), release, _q(' has not arrived yet'), pending, _q('; grace window ends '), deadline, _q('; '), then, _q('.'))} "
            f"ELSE {text(_q('Overdue: release '), release, _q(' missed its deadline '), deadline, _q('; '), missed, _q('; latest data observed '), f'coalesce({observed}, {_q("never")})', _q('.'))} END")


def evaluate(rules: DataFrame, observations: DataFrame, days: DataFrame, calendars: DataFrame, now: datetime | None,
             failed: DataFrame | None = None) -> DataFrame:
    """Verdicts at one instant, or, without one, each rule's at the instant in its column ``now``.

    failed: source_id, query_error of sources whose load time could not be read; these get QUERY_ERROR with the release
    and the next one their schedule gives, whatever their calendar's validity.

    A row per rule: status, release and its description, deadline, observed_at, next_expected_arrival, counts, warnings, error, explanation."""
    if now is not None:
        rules = rules.withColumn("now", ts(now))
    zones = [r["tz"] for r in rules.select("tz").distinct().collect()]
    rows = normalize_observed(rules, observations).join(calendars.select("calendar_id", "valid_until", "label"), "calendar_id", "left")
    rows = with_calendar(rows, days).join(F.broadcast(zone_names(rules.sparkSession, zones)), "tz", "left")
    rows = rows.join(failed, "source_id", "left") if failed is not None else rows.withColumn("query_error", F.lit(None).cast("struct<code:string,message:string>"))
    steps: list[dict[str, str]] = [
        dict(floor=FLOOR, inclusive="observed_at IS NULL"),
        dict(start="CASE WHEN observed_at <= now THEN observed_at WHEN observed_at IS NULL AND floor <= now THEN floor END"),
        dict(stale=f"coalesce(start < {days_off('now', -HORIZON_DAYS)}, false)"), *_search()]

    utc = lambda c: let("u", f"CAST({c} AS STRING)", "concat(translate(CASE WHEN length(u) > 19 THEN rpad(u, 26, '0') ELSE u END, ' ', 'T'), 'Z')")
    named, valid = _q("calendar "), "CAST(valid_until AS STRING)"
    errors = {
        "query_error IS NULL AND today > valid_until": _issue("E408", named, "label", _q(" is valid until "), valid, _q(", but the evaluation date is "), "CAST(today AS STRING)",
                                      _q("; review its holidays and overrides for the next period and extend valid_until")),
        "e214 IS NOT NULL": "e214",
        "unknown_on IS NOT NULL": _issue("E405", named, "label", _q(" has no holiday data for "), "CAST(year(unknown_on) AS STRING)"),
        "roll_failed_on IS NOT NULL": _issue("E407", _q("no business day within 31 days "), f"CASE WHEN policy = 'following' THEN {_q('after ')} ELSE {_q('before ')} END", "CAST(roll_failed_on AS STRING)"),
        "last IS NULL AND next_release IS NULL": _issue("E209", _q("schedule produces no release within 1830 days before or after "), utc("now")),
        "start IS NOT NULL AND stale AND first IS NULL": _issue("E215", _q("cannot decide freshness: observed timestamp "), utc("start"), _q(
            " is more than 1830 days old, no release in the last 1830 days has passed its deadline, and the schedule has no release within 1830 days after the observed timestamp")),
    }
    steps.append(dict(error="CASE " + " ".join(f"WHEN {c} THEN {i}" for c, i in errors.items()) + " END"))
    steps.append(dict(fault="coalesce(error, query_error)", status="CASE WHEN error IS NOT NULL THEN 'CONFIG_ERROR' WHEN query_error IS NOT NULL THEN 'QUERY_ERROR' WHEN observed_at IS NULL AND active_from IS NULL THEN 'NO_DATA' "
                             "WHEN first IS NULL THEN 'ON_TIME' WHEN missed > 0 THEN 'OVERDUE' ELSE 'NOT_DUE' END"))
    open_ = "status IN ('OVERDUE', 'NOT_DUE')"
    steps.append({
        "release": f"CASE WHEN error IS NOT NULL THEN NULL WHEN {open_} THEN first ELSE last END",
        "next_at": "CASE WHEN error IS NULL THEN next_release.instant END", "seen_at": "CASE WHEN error IS NULL THEN observed_at END",
        "missed_count": "CASE WHEN status = 'OVERDUE' THEN missed ELSE 0L END", "pending_count": f"CASE WHEN {open_} THEN n - missed ELSE 0L END",
        "missed_truncated": f"coalesce({open_} AND (by_recent OR n = {MAX_COUNTED}), false)",
        "consulted": f"greatest({local_day(days_off('now', CONSULT_DAYS))}, next_release.nominal, CAST(next_release.local AS DATE))"})
    w005 = _issue("W005", named, "label", _q(" was consulted for "), "CAST(consulted AS STRING)", _q(", after its valid_until "), valid, _q("; the next expected arrival may be wrong"))
    noted = f"CASE WHEN error IS NOT NULL THEN filter(noted, x -> false) WHEN query_error IS NULL AND {CONSULTS_CALENDAR} AND consulted > valid_until THEN concat(noted, array({w005})) ELSE noted END"
    steps.append(dict(texts=_TEXTS, warnings=noted))
    rows = in_steps(rows, steps).withColumn("dst", F.when(F.col("release").isNotNull(), classify_local(F.col("release.local"), F.col("tz"))))
    return rows.selectExpr(
        "source_id", "origin", "status", "now AS evaluated_at", "tz AS schedule_timezone", "release.instant AS release", "release.local AS release_local",
        "release.adjusted_from AS adjusted_from", "dst", "release.clamped AS clamped", "timestampadd(MICROSECOND, grace_us, release.instant) AS deadline",
        "seen_at AS observed_at", "CASE WHEN seen_at IS NOT NULL THEN observed END AS observed_raw", "CASE WHEN seen_at IS NOT NULL THEN naive END AS was_naive",
        "CASE WHEN seen_at IS NOT NULL AND naive THEN observed_tz END AS interpreted_timezone", "next_at AS next_expected_arrival", "missed_count",
        "missed_truncated", "pending_count", "warnings", "fault AS error", f"{_explanation()} AS explanation",
        "named_struct('release', texts[0], 'deadline', texts[1], 'next', texts[2], 'observed', texts[3]) AS texts")


def status_summary(verdicts: DataFrame) -> DataFrame:
    """Counts per status in fixed order, zeros filled in, and the total."""
    kinds = ("ON_TIME", "NOT_DUE", "OVERDUE", "NO_DATA", "CONFIG_ERROR", "QUERY_ERROR")
    return verdicts.agg(*[F.count_if(F.col("status") == k).alias(k.lower()) for k in kinds], F.count("*").alias("total"))


def exit_code(verdicts: DataFrame) -> DataFrame:
    """2 for configuration errors, else 3 for query errors, else 1 for overdue or missing data, else 0."""
    any_of = lambda *kinds: F.coalesce(F.bool_or(F.col("status").isin(*kinds)), F.lit(False))
    code = F.when(any_of("CONFIG_ERROR"), 2).when(any_of("QUERY_ERROR"), 3).when(any_of("OVERDUE", "NO_DATA"), 1).otherwise(0)
    return verdicts.agg(code.alias("exit_code"))
