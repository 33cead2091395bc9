"""Reports of finished plans: JSON documents and aligned tables. Rows are one per source."""

from __future__ import annotations

import json
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import __version__
from tidewatch.functions.stored import stored
from tidewatch.operators.evaluate import exit_code as code_of
from tidewatch.operators.evaluate import status_summary

#: Fixed order of the summary.
STATUSES = ("ON_TIME", "NOT_DUE", "OVERDUE", "NO_DATA", "CONFIG_ERROR", "QUERY_ERROR")
VERDICTS = STATUSES[:4]
VERSION = "1.0"


TOOL = "tidewatch"


def utc(value: datetime | None) -> str | None:
    return None if value is None else value.isoformat() + "Z"


def _issue(issue, source_id: str | None) -> dict | None:
    return None if issue is None else {"code": issue["code"], "message": issue["message"], "location": source_id}


def _local(instant: datetime | None, zone: str | None) -> str | None:
    return None if instant is None else instant.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).isoformat()


def _result(r) -> dict:
    release = None if r["release"] is None else {
        "instant": utc(r["release"]), "local": _local(r["release"], r["schedule_timezone"]), "adjusted_from": r["adjusted_from"] and r["adjusted_from"].isoformat(),
        "dst": r["dst"], "clamped": r["clamped"]}
    raw = r["observed_raw"]
    seen = None if r["observed_at"] is None else {
        "instant": utc(r["observed_at"]), "raw": raw.isoformat() + ("" if r["was_naive"] else "+00:00"), "was_naive": r["was_naive"], "interpreted_timezone": r["interpreted_timezone"]}
    return {"source_id": r["source_id"], "origin": r["origin"], "status": r["status"], "is_verdict": r["status"] in VERDICTS, "schedule_timezone": r["schedule_timezone"],
            "release": release, "deadline": utc(r["deadline"]), "observed": seen, "next_expected_arrival": utc(r["next_expected_arrival"]), "missed_count": r["missed_count"],
            "missed_truncated": r["missed_truncated"], "pending_count": r["pending_count"], "explanation": r["explanation"],
            "warnings": [_issue(w, r["source_id"]) for w in r["warnings"] or []], "error": _issue(r["error"], r["source_id"])}


def by_source(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["source_id"], []).append(r)
    return out


def json_report(rows: DataFrame, kind: str, now: datetime) -> str:
    """A document of the published form: keys in its order, two-space indent, a final newline."""
    found = rows.collect()
    head = {"schema_version": VERSION, "kind": kind, f"{TOOL}_version": __version__, "evaluated_at": utc(now)}
    if kind == "check":
        counts = Counter(r["status"] for r in found)
        body = {"exit_code": exit_code([r["status"] for r in found]), "summary": {"total": len(found)} | {s: counts[s] for s in STATUSES}, "results": [_result(r) for r in found]}
    else:
        body = {"sources": [{
            "source_id": source_id, "schedule_timezone": held[0]["tz"],
            "releases": [{"instant": utc(r["instant"]), "local": _local(r["instant"], r["tz"]), "deadline": utc(r["deadline"])} for r in held if r["instant"] is not None],
            "warnings": [_issue(w, source_id) for w in held[0]["warnings"] or []], "error": _issue(held[0]["error"], source_id)} for source_id, held in by_source(found).items()]}
    return json.dumps(head | body, indent=2, ensure_ascii=False) + "\n"


#: A report of up to so many rows is one file written by the driver; a larger one is a folder of parts written by executors.
ONE_FILE = 100_000


def _text(c: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


def _iso(c: Column) -> Column:
    """``2026-09-25T16:00:00``, with six digits where there is a fraction."""
    text = F.translate(c.cast("string"), " ", "T")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def _zulu(c: Column) -> Column:
    return _text(F.concat(_iso(c), F.lit("Z")))


def _in_zone(instant: Column, tz: Column) -> Column:
    wall = F.convert_timezone(F.lit("UTC"), tz, instant)
    off = F.timestamp_diff("SECOND", instant, wall)
    size = F.abs(off)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    rest = F.when(size % 60 != 0, F.concat(F.lit(":"), two(size % 60))).otherwise("")
    return _text(F.concat(_iso(wall), F.when(off < 0, "-").otherwise("+"), two(F.floor(size / 3600)), F.lit(":"), two(F.floor(size / 60) % 60), rest))


def _object(fields: dict[str, Column], depth: int) -> Column:
    pad = "  " * depth
    parts = [F.concat(F.lit(f'{pad}  "{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit(f"\n{pad}}}"))


def _issue_text(issue: Column, source_id: Column, depth: int) -> Column:
    return F.when(issue.isNull(), "null").otherwise(_object({"code": _text(issue["code"]), "message": _text(issue["message"]), "location": _text(source_id)}, depth))


def _result_text() -> Column:
    """A verdict's entry of the document, as ``_result`` and ``json.dumps`` make it."""
    c, logical = F.col, lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    zone = c("schedule_timezone")
    release = _object({"instant": _zulu(c("release")), "local": _in_zone(c("release"), zone), "adjusted_from": _text(c("adjusted_from").cast("string")), "dst": _text(c("dst")), "clamped": logical(c("clamped"))}, 3)
    raw = F.concat(_iso(c("observed_raw")), F.when(c("was_naive"), "").otherwise("+00:00"))
    seen = _object({"instant": _zulu(c("observed_at")), "raw": _text(raw), "was_naive": logical(c("was_naive")), "interpreted_timezone": _text(c("interpreted_timezone"))}, 3)
    warnings = F.transform("warnings", lambda w: F.concat(F.lit("        "), _issue_text(w, c("source_id"), 4)))
    listed = F.when(F.coalesce(F.size("warnings"), F.lit(0)) < 1, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(warnings, ",\n"), F.lit("\n      ]")))
    return _object({
        "source_id": _text(c("source_id")), "origin": _text(c("origin")), "status": _text(c("status")), "is_verdict": logical(c("status").isin(*VERDICTS)), "schedule_timezone": _text(zone),
        "release": F.when(c("release").isNull(), "null").otherwise(release), "deadline": _zulu(c("deadline")), "observed": F.when(c("observed_at").isNull(), "null").otherwise(seen),
        "next_expected_arrival": _zulu(c("next_expected_arrival")), "missed_count": logical(c("missed_count")), "missed_truncated": logical(c("missed_truncated")),
        "pending_count": logical(c("pending_count")), "explanation": _text(c("explanation")), "warnings": listed, "error": _issue_text(c("error"), c("source_id"), 3)}, 2)


def json_report_parts(rows: DataFrame, now: datetime) -> DataFrame:
    """(ord, value): the text of a check's document in pieces, a row each, in the order of ord; the verdicts themselves never meet in one place."""
    spark = rows.sparkSession
    counts = status_summary(rows).first()
    head = {"schema_version": VERSION, "kind": "check", f"{TOOL}_version": __version__, "evaluated_at": utc(now), "exit_code": code_of(rows).first()[0],
            "summary": {"total": counts["total"]} | {s: counts[s.lower()] for s in STATUSES}}
    begin = json.dumps(head, indent=2, ensure_ascii=False)[:-2] + ',\n  "results": ['
    if not counts["total"]:
        return spark.createDataFrame([(0, begin + "]\n}")], "ord long, value string")
    # sorted by source, numbered in that order: places in a partition, which range partitions keep apart
    placed = stored(rows.orderBy("source_id").select(F.monotonically_increasing_id().alias("at"), F.concat(F.lit("    "), _result_text()).alias("text")))
    last = placed.agg(F.max("at")).first()[0]
    body = placed.select((F.col("at") + 1).alias("ord"), F.concat("text", F.when(F.col("at") < last, ",").otherwise("")).alias("value"))
    return spark.createDataFrame([(0, begin), (last + 2, "  ]\n}")], "ord long, value string").unionByName(body)


def write_json_report(rows: DataFrame, now: datetime, folder: str) -> None:
    """A check's document as a folder of parts, written by executors: run together in the order of their names they are what
    ``json_report`` gives. ``rows`` is read more than once and so should be stored."""
    parts = json_report_parts(rows, now)
    n = max(1, parts.sparkSession.sparkContext.defaultParallelism)
    parts.repartitionByRange(n, "ord").sortWithinPartitions("ord").select("value").write.text(folder)


def _table(header: list[str], rows: list[list[str]]) -> list[str]:
    widths = [max(map(len, column)) for column in zip(header, *rows)]
    return ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in (header, *rows)]


def _shown(instant: datetime | None, zone: str | None) -> str:
    """``Fri 2026-09-25 16:00 CEST``, or a dash."""
    return "-" if instant is None or zone is None else instant.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).strftime("%a %Y-%m-%d %H:%M %Z")


def table_report(rows: DataFrame, kind: str, now: datetime) -> str:
    found = rows.collect()
    if kind == "next":
        lines = [(r["source_id"], *(("-", "-", "-") if r["instant"] is None else (_shown(r["instant"], r["tz"]), utc(r["instant"]), _shown(r["deadline"], r["tz"])))) for r in found]
        out = _table(["SOURCE", "RELEASE", "RELEASE (UTC)", "DEADLINE"], lines) if lines else ["no sources"]
        notices = [f"  {i['code']} {s}: {i['message']}" for s, held in by_source(found).items() for i in [*(held[0]["warnings"] or []), held[0]["error"]] if i]
        return "\n".join(out + ([""] + notices if notices else [])) + "\n"
    noun = "source" if len(found) == 1 else "sources"
    rows_of = [(r["source_id"], r["status"], *(_shown(r[c], r["schedule_timezone"]) for c in ("release", "deadline", "observed_at", "next_expected_arrival"))) for r in found]
    lines = [f"{TOOL} {__version__} | evaluated at {utc(now)} | {len(found)} {noun}", "",
             *(_table(["SOURCE", "STATUS", "RELEASE", "DEADLINE", "OBSERVED", "NEXT EXPECTED"], rows_of) if rows_of else ["no sources"]), ""]
    for r in found:
        lines += [f"{r['source_id']}: {r['explanation']}", *(f"  {i['code']} {i['message']}" for i in [*(r["warnings"] or []), r["error"]] if i)]
    counts = Counter(r["status"] for r in found)
    listed = ", ".join(f"{counts[s]} {s}" for s in STATUSES if counts[s]) or "no sources"
    return "\n".join([*lines, "", f"Summary: {listed} | exit code {exit_code([r['status'] for r in found])}"]) + "\n"


def _schedule(row: dict) -> str:
    if row["kind"] == "cron":
        return f"cron '{row['cron_text']}' {row['tz']}" + (f" (on_non_business_day: {row['policy']})" if row["policy"] != "none" else "")
    number = f" {row['business_day']}" if row["kind"] == "monthly_business_day" else ""
    return f"{row['kind']}{number} at {row['at_minute'] // 60:02d}:{row['at_minute'] % 60:02d} {row['tz']}"


def _calendar(c) -> str:
    days = lambda held: ", ".join(d.isoformat() for d in sorted(held))
    overrides = " | ".join(f"{name}: {days(held)}" for name, held in (("working", c.working), ("non-working", c.resting)) if held)
    weekend = ", ".join(("mon", "tue", "wed", "thu", "fri", "sat", "sun")[d] for d in c.weekend)
    return (f"weekend: {weekend or 'none'} | holidays: {', '.join(c.refs) or 'none'} | overrides: {overrides or 'none'}"
            + (f" | valid_until: {c.valid_until.isoformat()}" if c.valid_until else ""))


def _duration(us: int) -> str:
    minutes = us // 60_000_000
    parts = [f"{n}{u}" for n, u in ((minutes // 1440, "d"), (minutes // 60 % 24, "h"), (minutes % 60, "m")) if n]
    return " ".join(parts) or "0m"


def reasoning(verdict) -> list[str]:
    """Why the status is what it is, step by step. The sentences are fixed values of the trace."""
    texts, status = verdict["texts"], verdict["status"]
    if verdict["error"]:
        return [f"  1. {verdict['error']['code']} {verdict['error']['message']}"]
    if status == "NO_DATA":
        return ["  1. The warehouse returned NULL and no active_from is configured, so no release can be attributed."]
    if status == "ON_TIME":
        if verdict["release"] is None or verdict["observed_at"] is None:
            return ["  1. No release has occurred yet."]
        later = (f"  2. The first release after the observed timestamp, {texts['next']}, is later than now (release > now)." if texts["next"]
                 else "  2. No release occurs after the observed timestamp within the search horizon.")
        return [f"  1. The latest release at or before the observed timestamp: {texts['release']} arrived (observed {texts['observed']}).", later,
                "  3. Nothing due is outstanding: no release in the searched interval is missing."]
    where = "the observed timestamp" if verdict["observed_at"] is not None else "active_from (the floor is inclusive)"
    passed = f"has not passed (now <= deadline)." if status == "NOT_DUE" else "has passed (now > deadline)."
    return [f"  1. First release after {where}: {texts['release']}.", "  2. It has occurred (release <= now).", f"  3. Its deadline {texts['deadline']} {passed}"]


def explain_lines(config, entry, row: dict, verdict, now_row, releases: list, closed: list, *, query: bool) -> list[str]:
    origin = f"config {config.path}" if entry.origin == "config" else f"manifest {config.manifest}"
    lines = [f"Source    {entry.source_id} ({origin}, {entry.location})", f"Schedule  {_schedule(row)}", f"Calendar  {_calendar(config.calendars[row['calendar_id']])}",
             f"Grace     {_duration(row['grace_us'])} (wall-clock)"]
    if query:
        lines.append(f"Query     SELECT max({row['loaded_at_field']}) AS observed FROM {row['relation']}" + (f" WHERE ({row['filter']})" if row["filter"] is not None else ""))
    lines.append(f"Now       {now_row['utc']} = {now_row['local']}")
    if verdict["observed_at"] is None:
        lines.append("Observed  NULL")
    else:
        how = f"naive value interpreted in {verdict['interpreted_timezone']} via observed_timezone" if verdict["was_naive"] else "timezone-aware value"
        lines.append(f"Observed  {utc(verdict['observed_at'])} = {verdict['texts']['observed']} ({how})")
    lines += ["", f"Releases around now ({row['tz']})"]
    for r in releases:
        lines += [f"  {c['date'].strftime('%a %Y-%m-%d')}  no release: {c['reason']}" for c in closed if c["to_date"] == r["local"].date()]
        notes = [f"adjusted from {r['adjusted_from']}"] * bool(r["adjusted_from"])
        notes += [f"DST gap: shifted to {r['text'].split()[2]}"] * (r["dst"] == "gap") + ["DST overlap: first occurrence"] * (r["dst"] == "ambiguous") + [r["clamp"]] * r["clamped"]
        lines.append(f"  {r['text']}  {r['utc']}  {r['state']}" + (f" ({'; '.join(notes)})" if notes else ""))
    if not releases:
        lines.append("  no releases within the search horizon")
    lines += ["", "Reasoning", *reasoning(verdict), f"  => {verdict['status']}", "", f"Result    {verdict['status']}: {verdict['explanation']}"]
    return lines + [f"{i['code']} {i['message']}" for i in [*(verdict["warnings"] or []), verdict["error"]] if i]


def exit_code(statuses: list[str]) -> int:
    """2 configuration errors, 3 query errors, 1 overdue or missing data, 0."""
    for code, kinds in ((2, {"CONFIG_ERROR"}), (3, {"QUERY_ERROR"}), (1, {"OVERDUE", "NO_DATA"})):
        if kinds & set(statuses):
            return code
    return 0


def writable(path: str) -> bool:
    """Can the output be written? Asked before any work is done."""
    try:
        Path(path).open("a").close()
        return True
    except OSError:
        return False
