"""Use cases: check, next, explain, validate. Each is one plan over all selected sources."""

from __future__ import annotations

import fnmatch
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.frames import local_frame
from tidewatch.functions.holidays import holiday_dim, holiday_ranges
from tidewatch.functions.timeutil import format_local, format_utc, ts, zone_names
from tidewatch.operators import calendar as cal
from tidewatch.operators import evaluate as ev
from tidewatch.operators import releases as rel
from tidewatch.operators import trace
from tidewatch.plans import report
from tidewatch.sources.config import Calendar, Config, ConfigError, Entry, Issue, load_config, load_manifest, merge
from tidewatch.sources.observe import OBSERVATIONS, observe

HORIZON = timedelta(days=1830 + 70)
ISSUE = "code string, message string"


def load_entries(path: str, patterns: list[str] = ()) -> tuple[Config, list[Entry]]:
    config = load_config(path)
    entries = merge(config, load_manifest(config.manifest, config) if config.manifest else [])
    if not entries:
        raise ConfigError([Issue("E216", "no sources to evaluate")])
    if patterns:
        entries = [e for e in entries if any(fnmatch.fnmatchcase(e.source_id, p) for p in patterns)]
        if not entries:
            raise ConfigError([Issue("E210", f"--select matched no sources: {', '.join(patterns)}")])
    return config, entries


def calendar_tables(spark: SparkSession, calendars: dict[str, Calendar], first: date, last: date) -> tuple[DataFrame, DataFrame]:
    """The calendars and their days from first to last."""
    cs = list(calendars.values())
    frame = local_frame(spark, [(c.calendar_id, c.weekend, c.valid_until, c.calendar_id) for c in cs], cal.CALENDARS)
    marks = [(c.calendar_id, d, w) for c in cs for days, w in ((c.working, True), (c.resting, False)) for d in sorted(days)]
    refs = [(c.calendar_id, r, i) for c in cs for i, r in enumerate(c.refs)]
    labels = sorted({r for _, r, _ in refs})
    dim = holiday_dim(spark, labels, first.year - 1, last.year + 1) if labels else local_frame(spark, [], cal.HOLIDAYS)
    days = cal.calendar_days(frame, local_frame(spark, marks, cal.OVERRIDES), local_frame(spark, refs, cal.REFS), dim, first, last,
                             holiday_ranges(spark, labels) if labels else None)
    return frame, days


def _tables(spark: SparkSession, config: Config, rows: list[tuple], now: datetime, since: date | None = None):
    first = min(filter(None, [(now - HORIZON).date(), since and since - timedelta(days=70)]))
    frame, days = calendar_tables(spark, config.calendars, first, (now + HORIZON).date())
    return rel.rules_frame(spark, rows), frame, days


def _broken(spark: SparkSession, entries: list[Entry], now: datetime, like: DataFrame) -> DataFrame:
    rows = [(e.source_id, e.origin, e.errors[0].code, e.errors[0].message) for e in entries if e.row is None or e.errors]
    df = local_frame(spark, rows, "source_id string, origin string, code string, message string")
    df = df.withColumns({"status": F.lit("CONFIG_ERROR"), "evaluated_at": ts(now), "error": F.struct("code", "message"), "missed_count": F.lit(0).cast("long"),
                         "pending_count": F.lit(0).cast("long"), "missed_truncated": F.lit(False), "warnings": F.array().cast(like.schema["warnings"].dataType),
                         "explanation": F.concat(F.lit("Configuration error: "), "code", F.lit(" "), "message")})
    return df.drop("code", "message")


def require_connection(config: Config) -> None:
    if config.connection is None:
        raise ConfigError([Issue("E213", "'connection' is required for this command")])


def verdicts_of(spark: SparkSession, config: Config, entries: list[Entry], now: datetime, found: DataFrame) -> DataFrame:
    """Verdicts of entries whose load times (a table of OBSERVATIONS) are known, a row each; broken ones carry their error."""
    rows = [e.row for e in entries if e.row is not None and not e.errors]
    oldest = found.agg(F.min("observed")).first()[0]
    rules, frame, days = _tables(spark, config, rows, now, oldest.date() if oldest else None)
    failed = found.where("code is not null").select("source_id", F.struct("code", "message").alias("query_error"))
    # a query error keeps the schedule's context (the validity of a calendar isn't asked) but has no verdict
    verdicts = ev.evaluate(rules, found.where("code is null"), days, frame, now, failed)
    warned = [(e.source_id, w.code, w.message) for e in entries for w in e.warnings]
    if warned:
        more = local_frame(spark, warned, "source_id string, code string, message string").groupBy("source_id").agg(F.collect_list(F.struct("code", "message")).alias("more"))
        verdicts = verdicts.join(more, "source_id", "left").withColumn("warnings", F.when(F.col("more").isNull(), F.col("warnings")).otherwise(F.concat("warnings", "more"))).drop("more")
    return verdicts.unionByName(_broken(spark, entries, now, verdicts), allowMissingColumns=True).orderBy("source_id")


def check(spark: SparkSession, path: str, now: datetime, patterns: list[str] = (), given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Verdicts of all sources, a row each; sources whose rule or query is broken carry their error."""
    config, entries = load_entries(path, patterns)
    require_connection(config)
    rows = [e.row for e in entries if e.row is not None and not e.errors]
    return verdicts_of(spark, config, entries, now, observe(spark, rel.rules_frame(spark, rows), config.folder, given, config.connection))


def upcoming(spark: SparkSession, path: str, now: datetime, count: int = 3, patterns: list[str] = ()) -> DataFrame:
    """The next releases of each source; expired calendars and broken rules give a row with the error."""
    config, entries = load_entries(path, patterns)
    require_connection(config)
    rows = [e.row for e in entries if e.row is not None and not e.errors]
    rules, frame, days = _tables(spark, config, rows, now)
    found = rel.next_releases(rules, days, now, count).withColumn("deadline", F.expr("timestampadd(MICROSECOND, grace_us, instant)"))
    found = found.select("source_id", "position", "instant", "local", "deadline", "adjusted_from", "clamped", "dst")
    nothing = local_frame(spark, [], OBSERVATIONS)
    judged = ev.evaluate(rules, nothing, days, frame, now).select("source_id", F.col("schedule_timezone").alias("tz"), "warnings", "error")
    joined = judged.join(found, "source_id", "left").where("error is null or coalesce(position, 1) = 1")
    described = ("position", "instant", "local", "deadline", "adjusted_from", "clamped", "dst")
    out = joined.select("source_id", "tz", "warnings", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in described])
    bad = [(e.source_id, (e.errors[0].code, e.errors[0].message)) for e in entries if e.errors]
    broken = local_frame(spark, bad, f"source_id string, error struct<{ISSUE.replace(' string', ':string')}>")
    return out.unionByName(broken, allowMissingColumns=True).orderBy("source_id", "position")


def validate(spark: SparkSession, path: str, now: datetime, patterns: list[str] = ()) -> DataFrame:
    """Issues of all rules, errors first, without reading any load time: severity, source_id, code, message. The message
    of ids defined twice (E206) is told once."""
    config, entries = load_entries(path, patterns)
    rows = [e.row for e in entries if e.row is not None and not e.errors]
    rules, frame, days = _tables(spark, config, rows, now)
    verdicts = ev.evaluate(rules, local_frame(spark, [], OBSERVATIONS), days, frame, now)
    found = verdicts.select("source_id", "error", "warnings").collect()
    issues = [(0, e.source_id, x.code, str(x)) for e in entries for x in e.errors]
    issues += [(0, r["source_id"], r["error"]["code"], f"{r['error']['code']} {r['source_id']}: {r['error']['message']}") for r in found if r["error"]]
    issues += [(1, e.source_id, x.code, str(x)) for e in entries for x in e.warnings]
    issues += [(1, r["source_id"], w["code"], f"{w['code']} {r['source_id']}: {w['message']}") for r in found for w in r["warnings"]]
    seen: set[str] = set()
    once = [i for i in issues if i[2] != "E206" or not (i[3].partition(": ")[2] in seen or seen.add(i[3].partition(": ")[2]))]
    rows_out = [(n, "error" if kind == 0 else "warning", source_id, code, text) for n, (kind, source_id, code, text) in enumerate(sorted(once, key=lambda i: i[:2]))]
    return local_frame(spark, rows_out, "position int, severity string, source_id string, code string, message string").orderBy("position")


def find_entry(path: str, source_id: str) -> tuple[Config, Entry]:
    config, entries = load_entries(path)
    chosen = [e for e in entries if e.source_id == source_id]
    if not chosen:
        raise ConfigError([Issue("E212", f"unknown source '{source_id}'", path)])
    return config, chosen[0]


def _listed(spark: SparkSession, rules: DataFrame, days: DataFrame, now: datetime) -> DataFrame:
    """The three releases before now and the two after it; looks back in steps, as far as needed."""
    ahead = rel.next_releases(rules, days, now, 2).drop("position")
    for back in (45, 400, rel.HORIZON_DAYS):
        past = rel.releases_between(rules, days, now - timedelta(days=back), now).drop("calendar_id")
        if back == rel.HORIZON_DAYS or past.count() >= 3:
            return trace.around_now(past.unionByName(ahead), now)


def explain(spark: SparkSession, path: str, source_id: str, now: datetime, given: dict[str, DataFrame] | None = None, observed: tuple | None = None) -> tuple[list[str], str]:
    """The steps that lead to one source's verdict, as lines, and its status.

    observed: (value or None, is it wall time?) instead of a query. A source whose rule is broken gives its issues.
    """
    config, entry = find_entry(path, source_id)
    if entry.row is None or entry.errors:
        return [str(i) for i in entry.errors], "CONFIG_ERROR"
    row = dict(zip([f.name for f in T.StructType.fromDDL(rel.RULES)], entry.row))
    rules = rel.rules_frame(spark, [entry.row])
    if observed is None:
        require_connection(config)
        found = observe(spark, rules, config.folder, given, config.connection)
    else:
        found = local_frame(spark, [(source_id, observed[0], observed[1], None, None)], OBSERVATIONS)
    verdict = verdicts_of(spark, config, [entry], now, found).first()
    if verdict["status"] == "QUERY_ERROR":
        return [f"Result    QUERY_ERROR: {verdict['explanation']}"], "QUERY_ERROR"
    _, frame, days = _tables(spark, config, [entry.row], now)
    listed = _listed(spark, rules, days, now)
    names = zone_names(spark, [row["tz"]])
    state = trace.release_state(now, F.lit(verdict["observed_at"]).cast("timestamp_ntz"), F.col("deadline_text"))
    show = lambda c: format_local(c, F.col("tz"), F.col("names"))
    listed = listed.join(names, "tz").withColumns({"deadline_text": show(F.expr("timestampadd(MICROSECOND, grace_us, instant)")), "text": show(F.col("instant")),
                                                   "month": F.trunc(F.col("local").cast("date"), "MM")})
    months = trace.business_days_per_month(days.where(F.col("calendar_id") == row["calendar_id"])).select("month", F.col("n").alias("open_days"))
    listed = listed.join(months, "month", "left").select("instant", "local", "text", state.alias("state"), "adjusted_from", "clamped", "dst", format_utc(F.col("instant")).alias("utc"),
                                                         trace.clamp_text(F.col("local"), F.coalesce("open_days", F.lit(0))).alias("clamp"), F.lit(source_id).alias("source_id"),
                                                         F.lit(row["calendar_id"]).alias("calendar_id")).orderBy("instant")
    releases = listed.collect()
    closed = []
    if row["kind"] == "business_days" or row["policy"] != "none":
        closed = trace.closed_days_between(listed, days).orderBy("date").collect()
    now_row = spark.range(1).select(F.lit(row["tz"]).alias("tz")).join(names, "tz").select(format_utc(ts(now)).alias("utc"), show(ts(now)).alias("local")).first()
    return report.explain_lines(config, entry, row, verdict, now_row, releases, closed, query=observed is None), verdict["status"]
