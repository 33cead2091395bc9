"""YAML rules and dbt manifests to rule rows and calendar tables. Runs on the driver: documents, not data.

Document errors end the load together; errors of one source mark that source only.
"""

from __future__ import annotations

import json
import re
import reprlib
from dataclasses import dataclass, field
from datetime import date
from functools import cache
from pathlib import Path
from typing import Any, NamedTuple
from zoneinfo import available_timezones

from tidewatch.functions.cron import CronError, parse_cron
from tidewatch.functions.holidays import RULES as HOLIDAY_RULES
from tidewatch.functions.timeutil import ZONE_ALIASES


class Issue(NamedTuple):
    code: str
    message: str
    location: str | None = None

    def __str__(self) -> str:
        place = f"{self.location}: " if self.location and not self.message.startswith(self.location) else ""
        return f"{self.code} {place}{self.message}"


class ConfigError(Exception):
    def __init__(self, issues: list[Issue]):
        super().__init__("\n".join(map(str, issues)))
        self.issues = issues


#: Weekday names, field names, patterns and limits of the configuration format.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
POLICIES = ("none", "skip", "following", "preceding")
KINDS = ("cron", "business_days", "monthly_business_day")
SECRET_KEYS = {"password", "dsn", "user", "host", "uri", "url", "connection_string", "passwd", "token", "secret"}
MAX_GRACE_US = 366 * 86_400_000_000
DATE, TIME, DURATION = r"\d{4}-\d{2}-\d{2}", r"([01]\d|2[0-3]):[0-5]\d", r"(?:(\d+)d)?(?:(\d+)h)?(?:(\d+)m)?"
HINTS = {DATE: 'expected "YYYY-MM-DD"', TIME: 'expected "HH:MM" (24-hour), e.g. "16:00"', DURATION: 'expected a duration such as "90m", "2h", "1d6h"'}
TYPES = {"string": str, "object": dict, "array": list, "integer": int}
TYPE_NAMES = {type(None): "null"}

#: Fields of each mapping: type, or pattern of a string, or allowed values; ``!`` marks a required field.
TEXT, NAME = r"(?s).+", r"[^\x00-\x1f]+"
TOP = {"version!": (1,), "connection": "object", "dbt": "object", "defaults": "object", "calendars": "object", "sources": "array"}
DEFAULTS = {"timezone": TEXT, "grace": DURATION, "calendar": None, "observed_timezone": TEXT}
CONNECTIONS = {"duckdb": {"type!": None, "path!": TEXT}, "postgres": {"type!": None, "dsn_env": r"[A-Za-z_][A-Za-z0-9_]*", "statement_timeout_seconds": "integer"},
               "spark": {"type!": None, "folder": TEXT}, "jdbc": {"type!": None, "dsn_env!": r"[A-Za-z_][A-Za-z0-9_]*", "statement_timeout_seconds": "integer"}}
RULE = {"schedule!": "object", "filter": TEXT, "calendar": None, "grace": DURATION, "observed_timezone": TEXT, "active_from": DATE}
SOURCE = {"name!": NAME, "relation!": TEXT, "loaded_at_field!": TEXT, **RULE}
DBT_RULE = {"loaded_at_field": TEXT, **RULE}
SCHEDULES = {"cron": {"kind!": KINDS, "cron!": "string", "timezone": TEXT, "on_non_business_day": POLICIES},
             "business_days": {"kind!": KINDS, "time!": TIME, "timezone": TEXT},
             "monthly_business_day": {"kind!": KINDS, "business_day!": "integer", "time!": TIME, "timezone": TEXT}}
CALENDAR = {"weekend": "array", "holidays": "array", "overrides": "array", "valid_until": DATE}
OVERRIDE = {"description": "string", "working_days": "array", "non_working_days": "array"}
FINANCIAL = {"financial!": r"[A-Z0-9]{2,5}"}
COUNTRY = {"country!": r"[A-Z]{2}", "subdivision": TEXT, "categories": "array"}


@dataclass
class Calendar:
    calendar_id: str
    weekend: list[int] = field(default_factory=lambda: [5, 6])
    refs: list[str] = field(default_factory=list)
    working: set[date] = field(default_factory=set)
    resting: set[date] = field(default_factory=set)
    valid_until: date | None = None


@dataclass
class Entry:
    """One source: a row of RULES unless it has errors."""

    source_id: str
    origin: str
    location: str
    row: tuple | None = None
    errors: list[Issue] = field(default_factory=list)
    warnings: list[Issue] = field(default_factory=list)


@dataclass
class Config:
    entries: list[Entry]
    calendars: dict[str, Calendar]
    connection: dict | None
    manifest: str | None
    folder: str
    defaults: dict
    named: dict[str, Calendar]
    path: str = ""


class Bad(Exception):
    """Issues of one source or calendar."""

    def __init__(self, *issues: Issue):
        super().__init__("; ".join(map(str, issues)))
        self.issues = list(issues)


def at(code: str, location: str, text: str) -> Issue:
    return Issue(code, f"{location}: {text}" if location else text, location or None)


def shown(value: Any) -> str:
    """A value in a message, at most 80 characters, however large it is."""
    text = _SHORT.repr(value)
    return text if len(text) <= 80 else text[:77] + "..."


_SHORT = reprlib.Repr()
_SHORT.maxstring = _SHORT.maxother = 60


def check_fields(value: Any, fields: dict[str, Any], where: str, *, field: str = "", dbt: bool = False) -> list[Issue]:
    """All issues of one mapping against its table of fields."""
    if not isinstance(value, dict):
        return [at("E103", where, f"expected object, got {TYPE_NAMES.get(type(value), type(value).__name__)}")]
    names = {k.rstrip("!"): v for k, v in fields.items()}
    out = []
    for key in value:
        if key in names:
            continue
        if field == "connection" and str(key).lower() in SECRET_KEYS:
            out.append(at("E105", where, f"'{key}' is not allowed; secrets must not be stored in config files. Put the DSN in an environment variable and set dsn_env to its name"))
        elif field == "schedule" and key == "on_non_business_day":
            out.append(at("E205", where, "on_non_business_day is only valid for kind: cron"))
        elif dbt and key in ("name", "relation"):
            out.append(at("E304", where, f"'{key}' cannot be set in a rule of a manifest because dbt provides it"))
        else:
            out.append(at("E101", where, f"unknown field {shown(key)}"))
    out += [at("E102", where, f"missing required field '{k[:-1]}'") for k in fields if k.endswith("!") and k[:-1] not in value]
    for key, kind in names.items():
        if key in value and kind is not None:
            out += _check_value(value[key], kind, f"{where}.{key}" if where else key, key)
    return out


def _check_value(value: Any, kind: Any, where: str, key: str) -> list[Issue]:
    if isinstance(kind, tuple):
        if key == "version":
            return [] if value == 1 and not isinstance(value, bool) else [at("E104", where, "unsupported config version; expected 1")]
        text = f"'{value}'" if isinstance(value, str) and len(value) <= 80 else shown(value)
        return [] if isinstance(value, str) and value in kind else [at("E104", where, f"{text} is not one of: {', '.join(map(str, kind))}")]
    wanted = TYPES.get(kind, str)
    if not isinstance(value, wanted) or isinstance(value, bool):
        if key == "time" and isinstance(value, int) and not isinstance(value, bool):
            return [at("E103", where, f'expected a quoted time such as "16:00", got the integer {value}; YAML 1.1 reads unquoted 16:00 as the base-60 number 960, so write time: "16:00"')]
        if key == "business_day" and not isinstance(value, int):
            return [at("E103", where, f"expected integer, got {TYPE_NAMES.get(type(value), type(value).__name__)}")]
        return [at("E103", where, f"expected {kind if kind in TYPES else 'string'}, got {TYPE_NAMES.get(type(value), type(value).__name__)}")]
    if key == "business_day" and (value == 0 or abs(value) > 23):
        return [at("E204", where, f"business_day must be an integer between -23 and 23, excluding 0; got {value}")]
    if key == "dsn_env" and not re.fullmatch(kind, value):
        # a wrong value is likely the secret itself and isn't shown
        return [at("E106", where, "invalid value: expected the name of an environment variable, not the connection string itself")]
    if kind not in TYPES and (not re.fullmatch(kind, value) or not value):
        return [at("E106", where, f"invalid value {shown(value)}: {HINTS.get(kind, f'does not match {kind}')}")]
    return []


def parse_duration(text: Any, where: str = "grace") -> int:
    """``1d12h30m`` in microseconds; a day is 24 hours; at most 366 days."""
    m = re.fullmatch(DURATION, text) if isinstance(text, str) else None
    if not text or not m:
        raise Bad(at("E106", where, f"invalid value {shown(text)}: {HINTS[DURATION]}"))
    long = any(len(g.lstrip("0")) > 9 for g in m.groups() if g)
    days, hours, minutes = (0 if long else int(g or 0) for g in m.groups())
    us = ((days * 24 + hours) * 60 + minutes) * 60_000_000
    if long or us > MAX_GRACE_US:
        raise Bad(at("E203", where, f"duration '{text[:80]}' exceeds the maximum of 366d"))
    return us


def parse_date(value: Any, where: str = "date") -> date:
    if not isinstance(value, str) or not re.fullmatch(DATE, value):
        raise Bad(at("E106", where, f"invalid value {shown(value)}: {HINTS[DATE]}"))
    try:
        return date.fromisoformat(value)
    except ValueError as e:
        raise Bad(at("E106", where, f"invalid value {shown(value)}: not a valid calendar date")) from e


@cache
def zones() -> frozenset[str]:
    """The names of all zones; finding them reads the whole zone database."""
    return frozenset(available_timezones()) - {"Factory", "localtime"}


def parse_timezone(value: Any, where: str = "timezone") -> str:
    if not isinstance(value, str) or value not in zones():
        raise Bad(at("E201", where, f"unknown time zone {shown(value)}"))
    return ZONE_ALIASES.get(value, value)


def holiday_label(ref: Any, where: str) -> str:
    financial = isinstance(ref, dict) and "financial" in ref
    if issues := check_fields(ref, FINANCIAL if financial else COUNTRY, where):
        raise Bad(*issues)
    if financial:
        label, code = f"financial {ref['financial']}", "E402"
    else:
        label, code = "country " + "-".join(str(ref[k]) for k in ("country", "subdivision") if k in ref), "E401"
        for category in ref.get("categories") or ():
            if category != "public":
                raise Bad(at("E401", where, f"unknown category {shown(category)} for {ref['country']}; valid: public"))
    if label not in HOLIDAY_RULES:
        raise Bad(at(code, where, f"no holidays for {label}; valid: {', '.join(sorted(HOLIDAY_RULES))}"))
    return label


def parse_weekend(names: list, where: str) -> list[int]:
    if len(names) > 6:
        raise Bad(at("E406", where, "weekend may contain at most 6 days"))
    if bad := [at("E104", f"{where}[{i}]", f"{shown(n)} is not one of: {', '.join(WEEKDAYS)}") for i, n in enumerate(names) if n not in WEEKDAYS]:
        raise Bad(*bad)
    if len(set(names)) < len(names):
        raise Bad(at("E106", where, f"invalid value {shown(names)}: items must be unique"))
    return sorted(WEEKDAYS.index(n) for n in names)


def parse_calendar(calendar_id: str, spec: Any, folder: Path, where: str | None = None) -> Calendar:
    where = where or f"calendars.{calendar_id}"
    if issues := check_fields(spec, CALENDAR, where):
        raise Bad(*issues)
    out = Calendar(calendar_id)
    if "weekend" in spec:
        out.weekend = parse_weekend(spec["weekend"], f"{where}.weekend")
    out.refs = [holiday_label(r, f"{where}.holidays[{i}]") for i, r in enumerate(spec.get("holidays") or [])]
    for i, entry in enumerate(spec.get("overrides") or []):
        place = f"{where}.overrides[{i}]"
        if isinstance(entry, dict) and "file" in entry:
            if issues := check_fields(entry, {"file!": TEXT}, place):
                raise Bad(*issues)
            working, resting = read_override_file(folder / entry["file"], place)
        else:
            working, resting = override_days(entry, place)
        out.working |= working
        out.resting |= resting
    if both := out.working & out.resting:
        raise Bad(at("E403", where, f"{min(both)} is listed as both a working day and a non-working day"))
    out.valid_until = parse_date(spec["valid_until"], f"{where}.valid_until") if "valid_until" in spec else None
    return out


def override_days(entry: Any, where: str) -> tuple[set[date], set[date]]:
    if issues := check_fields(entry, OVERRIDE, where):
        raise Bad(*issues)
    if not entry:
        raise Bad(at("E106", where, "invalid value {}: expected at least one field"))
    dot = f"{where}." if where else ""
    return tuple({parse_date(d, f"{dot}{key}[{i}]") for i, d in enumerate(entry.get(key, ()))} for key in ("working_days", "non_working_days"))


def read_reason(error: Exception) -> str:
    """Why a file could not be read; fixed values of the format."""
    for kind, text in ((FileNotFoundError, "file not found"), (IsADirectoryError, "is a directory"), (PermissionError, "permission denied"), (UnicodeDecodeError, "not valid UTF-8")):
        if isinstance(error, kind):
            return text
    return str(error)[:80]


def read_override_file(path: Path, where: str) -> tuple[set[date], set[date]]:
    fail = lambda reason: Bad(at("E404", where, f"override file '{path}': {reason}"))
    try:
        text = path.read_text(encoding="utf-8")
    except (OSError, ValueError) as e:
        raise fail(read_reason(e)) from e
    try:
        return override_days(_yaml(text, str(path)), "")
    except (Bad, ConfigError) as e:
        raise fail(e.issues[0].message.removeprefix(f"{path}: ")) from e


def _yaml(text: str, source: str) -> Any:
    """Safe YAML; dates and base-60 numbers stay strings, repeated keys are errors. Faults are E100 with their place."""
    try:
        import yaml
    except ImportError as e:
        raise ConfigError([Issue("E505", "reading YAML needs the yaml package")]) from e

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp" and not (t.endswith(":int") and k in "0123456789+-")]
                                   for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def construct_mapping(self, node, deep=False):
            seen = set()
            for key, _ in getattr(node, "value", ()):
                if key.tag != "tag:yaml.org,2002:merge":
                    if key.value.__hash__ and key.value in seen:
                        raise yaml.constructor.ConstructorError(None, None, f"found duplicate key {key.value!r}", key.start_mark)
                    seen.add(key.value if key.value.__hash__ else id(key))
            return super().construct_mapping(node, deep)

    for c in "-+0123456789":
        Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?\d+$"), [c])
    try:
        return yaml.load(text, Loader)
    except (yaml.YAMLError, ValueError, KeyError, AttributeError, RecursionError) as e:
        mark = getattr(e, "problem_mark", None)
        what = "document is too deeply nested" if isinstance(e, RecursionError) else getattr(e, "problem", None) or str(e).splitlines()[0]
        place = f" at line {mark.line + 1}, column {mark.column + 1}" if mark else ""
        raise ConfigError([Issue("E100", f"{source}: YAML syntax error: {what}{place}", source)]) from e


def build_row(source_id: str, origin: str, spec: dict, defaults: dict, named: dict[str, Calendar], inline: dict[str, Calendar], folder: Path, where: str) -> tuple:
    """A row of RULES, defaults filled in; raises Bad. The fields' shapes have been checked."""
    schedule = spec["schedule"]
    kind, cron, minute = schedule["kind"], None, None
    place = f"{where}.schedule"

    def needed(key: str, value: Any, place: str) -> Any:
        value = value if value is not None else defaults.get(key)
        if value is None:
            raise Bad(at("E208", place, f"'{key}' is required; set it on the source or under defaults"))
        return value

    tz = parse_timezone(needed("timezone", schedule.get("timezone"), f"{place}.timezone"), f"{place}.timezone")
    if kind == "cron":
        try:
            cron = parse_cron(schedule["cron"])
        except CronError as e:
            raise Bad(at("E202", f"{place}.cron", f"invalid cron expression '{schedule['cron'][:80]}': {e}")) from e
    else:
        minute = int(schedule["time"][:2]) * 60 + int(schedule["time"][3:])
    calendar = spec.get("calendar") if spec.get("calendar") is not None else defaults.get("calendar")
    if isinstance(calendar, dict):
        inline[f"of {source_id}"] = parse_calendar(f"of {source_id}", calendar, folder, f"{where}.calendar")
        calendar = f"of {source_id}"
    elif calendar is not None and calendar not in named:
        if not isinstance(calendar, str):
            raise Bad(at("E103", f"{where}.calendar", f"expected object, got {type(calendar).__name__}"))
        raise Bad(at("E207", f"{where}.calendar", f"unknown calendar '{calendar[:80]}'; defined calendars: {', '.join(sorted(named)) or 'none'}"))
    grace = parse_duration(needed("grace", spec.get("grace"), f"{where}.grace"), f"{where}.grace")
    observed = spec.get("observed_timezone") if spec.get("observed_timezone") is not None else defaults.get("observed_timezone")
    return (source_id, origin, kind, schedule.get("cron"), cron.row() if cron else None, minute, schedule.get("business_day"), tz, schedule.get("on_non_business_day", "none"),
            calendar or "default", grace, spec["relation"], spec["loaded_at_field"], spec.get("filter"),
            parse_timezone(observed, f"{where}.observed_timezone") if observed is not None else None,
            parse_date(spec["active_from"], f"{where}.active_from") if spec.get("active_from") is not None else None)


def rule_issues(spec: Any, fields: dict[str, Any], where: str, *, dbt: bool = False) -> list[Issue]:
    """All issues of a source's shape, those of its schedule and inline calendar with them."""
    issues = check_fields(spec, fields, where, dbt=dbt)
    schedule = spec.get("schedule") if isinstance(spec, dict) else None
    if isinstance(schedule, dict):
        kind = schedule.get("kind")
        if "kind" not in schedule:
            issues.append(at("E102", f"{where}.schedule", "missing required field 'kind'"))
        elif not isinstance(kind, str) or kind not in SCHEDULES:
            issues += _check_value(kind, KINDS, f"{where}.schedule.kind", "kind")
        else:
            issues += check_fields(schedule, SCHEDULES[kind], f"{where}.schedule", field="schedule")
    return issues


def _entry(source_id: str, origin: str, location: str, spec: Any, config_parts: tuple, fields: dict[str, Any], given: dict | None = None, rule_location: str | None = None) -> Entry:
    entry = Entry(source_id, origin, location)
    defaults, named, inline, folder = config_parts
    entry.errors = rule_issues(spec, fields, rule_location or location, dbt=given is not None)
    if entry.errors:
        return entry
    try:
        entry.row = build_row(source_id, origin, spec | (given or {}), defaults, named, inline, folder, location)
        calendar = named.get(entry.row[9]) or inline.get(entry.row[9])
        if calendar and (calendar.working or calendar.resting) and calendar.valid_until is None:
            entry.warnings.append(Issue("W006", f"calendar {calendar.calendar_id} has overrides but no valid_until; override dates are usually valid for one year, "
                                                "so set valid_until to the last date you checked"))
    except Bad as e:
        entry.errors = e.issues
    return entry


def load_config(path: str | Path) -> Config:
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except (OSError, ValueError) as e:
        raise ConfigError([Issue("E110", f"cannot read config file {path}: {read_reason(e)}", str(path))]) from e
    document = _yaml(text, str(path))
    shape = dict(document, sources=[]) if isinstance(document, dict) and isinstance(document.get("sources"), list) else document
    issues = [i if i.location else Issue(i.code, f"{path}: {i.message}", str(path)) for i in check_fields(shape, TOP, "")]
    if not isinstance(document, dict):
        raise ConfigError(issues)

    def guarded(f, *args):
        try:
            return f(*args)
        except Bad as e:
            issues.extend(e.issues)
            return None

    part = lambda key: document[key] if isinstance(document.get(key), dict) else {}
    connection = document.get("connection")
    if isinstance(connection, dict):
        kind = connection.get("type")
        if "type" not in connection:
            issues.append(at("E102", "connection", "missing required field 'type'"))
        elif not isinstance(kind, str) or kind not in CONNECTIONS:
            issues += _check_value(kind, tuple(CONNECTIONS), "connection.type", "type")
        else:
            issues += check_fields(connection, CONNECTIONS[kind], "connection", field="connection")
    issues += check_fields(part("dbt"), {"manifest": TEXT}, "dbt")
    named = {str(k): c for k, v in part("calendars").items() if (c := guarded(parse_calendar, str(k), v, path.parent))}
    defaults = dict(part("defaults"))
    issues += check_fields(defaults, DEFAULTS, "defaults")
    inline: dict[str, Calendar] = {"default": Calendar("default")}
    if not issues:
        for key in ("timezone", "observed_timezone"):
            if defaults.get(key) is not None:
                guarded(parse_timezone, defaults[key], f"defaults.{key}")
        if defaults.get("grace") is not None:
            guarded(parse_duration, defaults["grace"], "defaults.grace")
        if isinstance(defaults.get("calendar"), dict):
            if calendar := guarded(parse_calendar, "of defaults", defaults["calendar"], path.parent, "defaults.calendar"):
                named["of defaults"], defaults["calendar"] = calendar, "of defaults"
        elif defaults.get("calendar") is not None and defaults["calendar"] not in named:
            issues.append(at("E207", "defaults.calendar", f"unknown calendar {shown(defaults['calendar'])}; defined calendars: {', '.join(sorted(named)) or 'none'}"))
    if issues:
        raise ConfigError(issues)
    parts = (defaults, named, inline, path.parent)
    entries = []
    for i, spec in enumerate(document.get("sources") or []):
        name = spec.get("name") if isinstance(spec, dict) else None
        entries.append(_entry(name if isinstance(name, str) and name else f"sources[{i}]", "config", f"sources[{i}]", spec, parts, SOURCE))
    mark_duplicates(entries)
    manifest = part("dbt").get("manifest")
    return Config(entries, inline | named, connection, str(path.parent / manifest) if manifest else None, str(path.parent), defaults, named, str(path))


def mark_duplicates(entries: list[Entry]) -> None:
    """E206 on every entry whose id occurs more than once, naming all places; its own errors stay beside it."""
    by_id: dict[str, list[Entry]] = {}
    for e in entries:
        by_id.setdefault(e.source_id, []).append(e)
    for source_id, same in by_id.items():
        if len(same) > 1:
            for e in same:
                e.row = None
                e.errors.insert(0, Issue("E206", f"source '{source_id}' is defined more than once: {', '.join(x.location for x in same)}", e.location))


def load_manifest(path: str | Path, config: Config, key: str = "tidewatch") -> list[Entry]:
    """Sources of a dbt manifest (schema v12) whose meta holds a rule under ``key``."""
    unreadable = lambda why: ConfigError([Issue("E302", f"{path}: cannot read dbt manifest: {why}")])
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
    except RecursionError as e:
        raise unreadable("document is too deeply nested") from e
    except (OSError, ValueError) as e:
        raise unreadable(read_reason(e)) from e
    if not isinstance(document, dict) or not isinstance(document.get("sources"), dict):
        raise unreadable("expected an object with a 'sources' object")
    metadata = document.get("metadata")
    version = metadata.get("dbt_schema_version") if isinstance(metadata, dict) else None
    if not isinstance(version, str) or not re.search(r"/v12(\.json)?$", version):
        raise ConfigError([Issue("E301", f"{path}: unsupported dbt manifest schema {shown(version or 'missing')}; schema v12 is read")])
    out = []
    parts = (config.defaults, config.named, config.calendars, Path(config.folder))
    for unique_id, node in document["sources"].items():
        metas = [] if not isinstance(node, dict) else [("meta", node.get("meta")), ("config.meta", (node.get("config") or {}).get("meta") if isinstance(node.get("config"), dict) else None)]
        found = [(where, m[key]) for where, m in metas if isinstance(m, dict) and key in m]
        if not found:
            continue
        where, spec = found[0]
        names, location = (node.get("source_name"), node.get("name")), f"dbt:{unique_id}"
        source_id = ".".join(names) if all(isinstance(n, str) and n for n in names) else unique_id
        missing = [at("E102", location, f"missing required field '{f}'") for f in ("source_name", "name", "relation_name") if not isinstance(node.get(f), str) or not node[f]]
        field_name = (spec.get("loaded_at_field") if isinstance(spec, dict) else None) or node.get("loaded_at_field")
        freshness = node.get("freshness")
        given = {"relation": node.get("relation_name"), "loaded_at_field": field_name}
        if isinstance(spec, dict) and not spec.get("filter") and isinstance(freshness, dict) and freshness.get("filter"):
            given["filter"] = str(freshness["filter"])
        if missing:
            out.append(Entry(source_id, "dbt", location, errors=missing + rule_issues(spec, DBT_RULE, f"{location}:{where}.{key}", dbt=True)))
        elif not field_name and not rule_issues(spec, DBT_RULE, location, dbt=True):
            out.append(Entry(source_id, "dbt", location, errors=[at("E303", location, "no loaded_at_field; set loaded_at_field on the dbt source or in its rule")]))
        else:
            out.append(_entry(source_id, "dbt", location, spec, parts, DBT_RULE, given, f"{location}:{where}.{key}"))
    return out


def merge(config: Config, manifest: list[Entry]) -> list[Entry]:
    """The configuration wins whole entries and is told so (W004); sorted by id."""
    own: dict[str, list[Entry]] = {}
    for e in config.entries:
        own.setdefault(e.source_id, []).append(e)
    for e in manifest:
        for mine in own.get(e.source_id, ()):
            mine.warnings.append(Issue("W004", f"'{e.source_id}' is defined in both {config.path} and the dbt manifest; using the config file definition", e.source_id))
    rest = [e for e in manifest if e.source_id not in own]
    mark_duplicates(rest)
    return sorted([*config.entries, *rest], key=lambda e: e.source_id)
