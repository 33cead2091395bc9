"""Release calendars: queries against SQL, rules against brute force, use cases end to end."""

import json
import random
from datetime import UTC, date, datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewatch import queries
from tidewatch.functions import holidays
from tidewatch.functions.cron import CronError, parse_cron
from tidewatch.functions.timeutil import classify_local, format_duration, format_utc, resolve_local, ts
from tidewatch.operators import evaluate, releases
from tidewatch.operators.releases import rule
from tidewatch.plans import api, cli
from tidewatch.sources import config as cfg
from tidewatch.sources.observe import scrub
from tidewatch.streaming.latest import latest_from_stream, on_each_batch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat().replace("T00:00:00", "")
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def test_clamp_notes_hold_every_month(spark, sf_dir):
    """Months without orders, those after August 2001, have a note too; the months together count every order."""
    rows = {r["month"]: r for r in queries.QUERIES["clamp_notes"](spark, sf_dir).collect()}
    assert sorted(rows) == [date(y, m, 1) for y in range(1995, 2002) for m in range(1, 13)]
    assert rows[date(2001, 12, 1)].asDict() == {"month": date(2001, 12, 1), "n": 21, "note": "clamped: December 2001 has only 21 business days", "n_rows": 0}
    assert sum(r["n_rows"] for r in rows.values()) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_entry(spark):
    rows = {r["source_id"]: r for r in __spark_entry__.entry(spark).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"click": "NOT_DUE", "error": "ON_TIME", "purchase": "OVERDUE", "signup": "OVERDUE", "view": "NO_DATA"}


def test_cron_grammar():
    assert parse_cron("5/20 8-10 * MAR,APR *").times[:3] == (485, 505, 525)
    assert parse_cron("0 0 L * *").dom_last and parse_cron("0 0 * * 7").dows == (6,)
    assert parse_cron("0 0 * * 1#3").nths == ((0, 3),) and not parse_cron("0 0 */2 * *").dom_any
    for bad in ("* * * *", "60 * * * *", "0 0 * * 1#6", "0 0 * * 1,2#1", "H * * * *", "0 0 5-1 * *", "*/0 * * * *"):
        with pytest.raises(CronError):
            parse_cron(bad)


def test_holidays_known_dates():
    days = lambda label, y: {d for _, d, _ in holidays.holiday_rows(label, y, y)}
    assert holidays.easter(2026) == date(2026, 4, 5)
    assert date(2026, 4, 6) in days("financial XECB", 2026) and len(days("financial XECB", 2026)) == 6
    assert date(2021, 12, 31) in days("country US", 2021) and date(2021, 12, 31) not in days("financial XNYS", 2021)
    assert date(2022, 6, 2) in days("country GB-ENG", 2022) and date(2020, 5, 8) in days("country GB-ENG", 2020)
    assert date(2026, 6, 4) in days("country DE-BY", 2026) and date(2026, 6, 4) not in days("country DE", 2026)


def test_local_times_match_zoneinfo(spark):
    zones = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Pacific/Apia", "UTC"]
    rows = [(z, datetime(2011, 1, 1) + timedelta(minutes=40 * i)) for z in zones for i in range(0, 13_000, 3)]
    rows += [(z, datetime(2026, m, d, h, 30)) for z in zones for m in (3, 4, 10, 11) for d in range(1, 32 if m in (3, 10) else 31) for h in (0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "tz string, local timestamp_ntz")
    for r in df.select("tz", "local", resolve_local(F.col("local"), F.col("tz")).alias("u"), classify_local(F.col("local"), F.col("tz")).alias("c")).collect():
        tz = ZoneInfo(r["tz"])
        one, two = (r["local"].replace(tzinfo=tz, fold=f).astimezone(UTC).replace(tzinfo=None) for f in (0, 1))
        back = one.replace(tzinfo=UTC).astimezone(tz).replace(tzinfo=None)
        assert r["u"] == one
        assert r["c"] == ("gap" if back != r["local"] else "ambiguous" if one != two else "normal"), r


def test_texts(spark):
    us = spark.createDataFrame([(0,), (59_999_999,), (-3_600_000_000,), (93_600_000_000,)], "us long").select(format_duration(F.col("us")).alias("t"))
    assert [r["t"] for r in us.collect()] == ["0m", "<1m", "-1h", "1d 2h"]
    one = spark.range(1).select(format_utc(ts(datetime(2024, 1, 2, 3, 4, 5))).alias("a"), format_utc(ts(datetime(2024, 1, 2, 3, 4, 5, 60))).alias("b")).first()
    assert tuple(one) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000060Z")


def brute_releases(spec, first, last, holiday=frozenset()):
    """All instants of a schedule, straight from its definition."""
    tz, out = ZoneInfo(spec["tz"]), {}
    is_bd = lambda d: d.weekday() < 5 and d not in holiday
    day = first.date() - timedelta(days=40)
    while day <= last.date() + timedelta(days=40):
        final, times = None, [spec.get("minute", 0)]
        if spec["kind"] == "business":
            final = day if is_bd(day) else None
        elif spec["kind"] == "monthly":
            days = [d for d in (day.replace(day=1) + timedelta(days=i) for i in range(31)) if d.month == day.month and is_bd(d)]
            n = spec["n"]
            final = day if days and day == (days[min(n, len(days)) - 1] if n > 0 else days[max(n, -len(days))]) else None
        else:
            c = parse_cron(spec["cron"])
            dom, dow = day.day in c.doms or (c.dom_last and (day + timedelta(days=1)).day == 1), day.weekday() in c.dows or (day.weekday(), -(-day.day // 7)) in c.nths
            if day.month in c.months and ((dom or dow) if not c.dom_any and not c.dow_any else (dom and dow)):
                times, final = c.times, day
                if spec["policy"] != "none" and not is_bd(day):
                    step = {"skip": 0, "following": 1, "preceding": -1}[spec["policy"]]
                    while step and not is_bd(final):
                        final += timedelta(days=step)
                    final = final if step else None
        for minute in times if final else ():
            local = datetime.combine(final, datetime.min.time()) + timedelta(minutes=minute)
            instant = local.replace(tzinfo=tz).astimezone(UTC).replace(tzinfo=None)
            if first <= instant <= last:
                out.setdefault(instant, day if day != final else None)
        day += timedelta(days=1)
    return out


def random_spec(rng):
    tz = rng.choice(["UTC", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Tokyo"])
    kind = rng.choice(["business", "monthly", "cron", "cron", "cron"])
    minute = rng.choice([0, 90, 150, 180, 960])
    cron = rng.choice(["0 6 * * *", "30 2 * * *", "*/30 1-3 * * 0", "15 9 1,15 * 5", "0 12 L * *", "0 0 * * 1#2", "0 18 13 * *", "30 1 * 3,10,11 *"])
    return {"kind": kind, "tz": tz, "minute": minute, "n": rng.choice([1, 5, 22, -1, -3]), "cron": cron, "policy": rng.choice(["none", "skip", "following", "preceding"])}


def as_rule(i, s, **more):
    at = f"{s['minute'] // 60:02d}:{s['minute'] % 60:02d}"
    if s["kind"] == "business":
        return rule(f"r{i:03d}", business_days=at, tz=s["tz"], **more)
    if s["kind"] == "monthly":
        return rule(f"r{i:03d}", monthly=(s["n"], at), tz=s["tz"], **more)
    return rule(f"r{i:03d}", cron=s["cron"], tz=s["tz"], policy=s["policy"], **more)


def test_releases_and_verdicts_against_brute_force(spark):
    rng = random.Random(7)
    specs = [random_spec(rng) for _ in range(40)]
    now = datetime(2026, 11, 2, 7, 15)
    cal, days = queries.calendars(spark, date(2018, 1, 1), date(2033, 1, 1), refs=["financial XECB"])
    closed = frozenset(d for _, d, _ in holidays.holiday_rows("financial XECB", 2018, 2033))
    first, last = now - timedelta(days=400), now + timedelta(days=100)
    rows = releases.rules_frame(spark, [as_rule(i, s, observed_tz="UTC", grace_minutes=240) for i, s in enumerate(specs)])
    want = {f"r{i:03d}": brute_releases(s, first, last, closed) for i, s in enumerate(specs)}
    got = {}
    for r in releases.releases_between(rows, days, first, last).collect():
        got.setdefault(r["source_id"], {})[r["instant"]] = r["adjusted_from"]
    assert got == {k: v for k, v in want.items() if v}
    seen = {k: rng.choice([None, now - timedelta(days=rng.randrange(300), minutes=rng.randrange(900)), now + timedelta(days=1), *list(v)[-3:-2]]) for k, v in want.items()}
    observed = spark.createDataFrame([(k, v, True) for k, v in seen.items()], "source_id string, observed timestamp_ntz, naive boolean")
    grace = timedelta(hours=4)
    for r in evaluate.evaluate(rows, observed, days, cal, now).collect():
        instants, o = sorted(want[r["source_id"]]), seen[r["source_id"]]
        if not instants:  # a schedule of closed days only
            assert r["error"]["code"] == "E209"
            continue
        past, ahead = [x for x in instants if x <= now], [x for x in instants if x > now]
        open_ = [x for x in past if o is not None and x > o]
        missed = [x for x in open_ if now > x + grace]
        status = "NO_DATA" if o is None else "ON_TIME" if not open_ else "OVERDUE" if missed else "NOT_DUE"
        assert r["status"] == status, r
        assert r["release"] == (open_[0] if open_ else past[-1]) and r["missed_count"] == len(missed) and r["pending_count"] == len(open_) - len(missed)
        assert r["next_expected_arrival"] == ahead[0]


def test_undecided_and_dead_schedules(spark):
    cal, days = queries.calendars(spark, date(2010, 1, 1), date(2033, 1, 1))
    rows = [rule("dead", cron="0 0 30 2 *", observed_tz="UTC"), rule("zone", cron="0 6 * * *"), rule("leap", cron="0 0 29 2 *", observed_tz="UTC")]
    seen = spark.createDataFrame([("dead", datetime(2024, 1, 1), True), ("zone", datetime(2024, 1, 1), True), ("leap", datetime(2024, 3, 1), True)],
                                 "source_id string, observed timestamp_ntz, naive boolean")
    got = {r["source_id"]: r for r in evaluate.evaluate(releases.rules_frame(spark, rows), seen, days, cal, datetime(2026, 1, 1)).collect()}
    assert got["dead"]["error"]["code"] == "E209" and got["zone"]["error"]["code"] == "E214" and got["leap"]["status"] == "ON_TIME"


YAML = """
version: 1
connection: {type: duckdb, path: ":memory:"}
defaults: {timezone: UTC, grace: 2h, observed_timezone: UTC}
calendars:
  ecb:
    holidays: [{financial: XECB}]
    overrides: [{working_days: ["2024-01-06"]}]
sources:
  - {name: fx.daily, relation: "read_csv('fx.csv')", loaded_at_field: _loaded_at, calendar: ecb, schedule: {kind: business_days, time: "16:00"}}
  - {name: fx.empty, relation: "read_csv('fx.csv')", loaded_at_field: _loaded_at, filter: "rate < 0", schedule: {kind: cron, cron: "0 6 * * *"}}
  - {name: fx.gone, relation: nowhere, loaded_at_field: x, schedule: {kind: cron, cron: "0 6 * * *"}}
  - {name: fx.bad, relation: r, loaded_at_field: x, schedule: {kind: cron, cron: "0 6 * *"}}
  - {name: fx.twice, relation: r, loaded_at_field: x, schedule: {kind: cron, cron: "0 6 * * *"}}
  - {name: fx.twice, relation: r, loaded_at_field: x, schedule: {kind: cron, cron: "0 6 * * *"}}
"""


@pytest.fixture
def folder(tmp_path):
    Path(tmp_path, "rules.yml").write_text(YAML)
    Path(tmp_path, "fx.csv").write_text("rate_date,rate,_loaded_at\n2024-01-29,1.1,2024-01-29 16:05:00\n2024-01-30,1.2,2024-01-30 16:04:00\n")
    return tmp_path


def test_check_next_validate_explain(spark, folder, capsys):
    path = str(folder / "rules.yml")
    got = {}
    for r in api.check(spark, path, datetime(2024, 1, 31, 12)).collect():
        got.setdefault(r["source_id"], r)
    assert {k: r["status"] for k, r in got.items()} == {"fx.daily": "ON_TIME", "fx.empty": "NO_DATA", "fx.gone": "QUERY_ERROR", "fx.bad": "CONFIG_ERROR", "fx.twice": "CONFIG_ERROR"}
    assert got["fx.bad"]["error"]["code"] == "E202" and got["fx.twice"]["error"]["code"] == "E206" and got["fx.gone"]["next_expected_arrival"] == datetime(2024, 2, 1, 6)
    assert {w["code"] for w in got["fx.daily"]["warnings"]} >= {"W006"}
    ahead = [r["instant"] for r in api.upcoming(spark, path, datetime(2024, 1, 31, 12), 3, ["fx.daily"]).collect()]
    assert ahead == [datetime(2024, 1, 31, 16), datetime(2024, 2, 1, 16), datetime(2024, 2, 2, 16)]
    codes = {r["code"] for r in api.validate(spark, path, datetime(2024, 1, 31, 12)).collect()}
    assert {"E202", "E206", "W006"} <= codes
    lines, status = api.explain(spark, path, "fx.daily", datetime(2024, 1, 31, 12))
    assert status == "ON_TIME" and any(x.startswith("Result    ON_TIME: On time: latest release Tue 2024-01-30 16:00 UTC arrived") for x in lines)
    assert "  Sat 2024-01-27  no release: weekend" in lines and any(x.endswith("future (next expected arrival)") for x in lines)
    assert "  3. Nothing due is outstanding: no release in the searched interval is missing." in lines
    assert cli.main(["check", "-c", path, "--now", "2024-01-31T12:00:00+00:00", "--format", "json", "-s", "fx.daily"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["ON_TIME"] == 1
    assert cli.main(["check", "-c", path, "--now", "2024-01-31T12:00:00+00:00"], spark) == 2
    assert "QUERY_ERROR" in capsys.readouterr().out
    assert cli.main(["next", "-c", path, "--now", "2024-01-31T12:00:00+00:00", "-s", "fx.empty"], spark) == 0
    assert cli.main(["explain", "-c", path, "--now", "2024-01-31T12:00:00+00:00", "nope"], spark) == 2
    assert cli.main([], spark) == 2
    capsys.readouterr()
    assert cli.main(["explain", "-c", path, "--now", "2024-01-31T12:00:00+00:00", "--observed", "null", "fx.empty"], spark) == 1
    assert "Observed  NULL" in capsys.readouterr().out
    assert cli.main(["check", "-c", path, "--now", "yesterday"], spark) == 2 and "E211" in capsys.readouterr().err


def test_one_bad_source_stops_no_other(spark, tmp_path):
    (tmp_path / "t.csv").write_text("v,at\n1,2024-01-30 16:04:00\n")
    source = lambda name, field, **more: {"name": name, "relation": "read_csv('t.csv')", "loaded_at_field": field, "schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": "1h"} | more
    sources = [source("good", "at"), source("cast", "CAST(concat('x', v) AS timestamp)"), source("tokyo", "at", observed_timezone="Asia/Tokyo"), source("number", "v"),
               source("forever", "timestamp_ntz'9999-12-31 23:59:59.999999'"), source("outside", "at", relation="read_csv('/etc/passwd')"), source("path", "at", relation="(SELECT * FROM csv.`/etc/passwd`)")]
    (tmp_path / "c.yml").write_text(json.dumps({"version": 1, "connection": {"type": "spark"}, "defaults": {"timezone": "UTC", "observed_timezone": "UTC"}, "sources": sources}))
    got = {r["source_id"]: r for r in api.check(spark, str(tmp_path / "c.yml"), datetime(2024, 1, 31, 5)).collect()}
    assert got["good"]["status"] == "ON_TIME" and got["good"]["observed_at"] == datetime(2024, 1, 30, 16, 4) and got["good"]["warnings"] == []
    assert got["tokyo"]["observed_at"] == datetime(2024, 1, 30, 7, 4)
    assert {k: r["error"]["code"] for k, r in got.items() if r["error"]} == {"cast": "E502", "number": "E503", "forever": "E502", "outside": "E502", "path": "E502"}


@pytest.mark.parametrize("connection, code", [({"type": "duckdb", "path": "./none.duckdb"}, "E501"), ({"type": "postgres", "dsn_env": "NO_SUCH_VARIABLE"}, "E504"), (None, "E213")])
def test_connections(spark, tmp_path, connection, code, capsys):
    source = {"name": "s", "relation": "r", "loaded_at_field": "x", "schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": "1h"}
    (tmp_path / "c.yml").write_text(json.dumps({"version": 1, "defaults": {"timezone": "UTC"}, "sources": [source]} | ({"connection": connection} if connection else {})))
    assert cli.main(["check", "-c", str(tmp_path / "c.yml"), "--now", "2024-01-31T12:00:00+00:00"], spark) == (2 if connection is None else 3)
    assert code in "".join(capsys.readouterr())


@pytest.mark.parametrize("text, code", [
    ("version: 2", "E104"), ("version: 1\nextra: 1", "E101"), ("version: 1\nversion: 1", "E100"), ("- 1", "E103"),
    ("version: 1\nconnection: {type: duckdb, password: x}", "E105"), ("version: 1\ncalendars: {a: {weekend: [mon, tue, wed, thu, fri, sat, sun]}}", "E406"),
    ("version: 1\ncalendars: {a: {overrides: [{working_days: ['2024-01-01'], non_working_days: ['2024-01-01']}]}}", "E403"),
    ("version: 1\ncalendars: {a: {overrides: [{file: nothere.yml}]}}", "E404"), ("version: 1\ncalendars: {a: {holidays: [{financial: NONE}]}}", "E402"),
    ("version: 1\ncalendars: {a: {valid_until: 2024-02-30}}", "E106")])
def test_document_errors(tmp_path, text, code):
    path = tmp_path / "c.yml"
    path.write_text(text)
    with pytest.raises(cfg.ConfigError) as e:
        cfg.load_config(path)
    assert e.value.issues[0].code == code


@pytest.mark.parametrize("change, code", [
    ({"grace": "1w"}, "E106"), ({"grace": "367d"}, "E203"), ({"calendar": "none"}, "E207"), ({"schedule": {"kind": "monthly_business_day", "business_day": 0, "time": "09:00"}}, "E204"),
    ({"schedule": {"kind": "business_days", "time": "09:00", "on_non_business_day": "skip"}}, "E205"), ({"schedule": {"kind": "business_days", "time": "9:00"}}, "E106"),
    ({"observed_timezone": "Mars"}, "E201"), ({"loaded_at_field": None}, "E103"), ({"schedule": {"cron": "0 6 * * *"}}, "E102"), ({"schedule": {"kind": "weekly"}}, "E104"), ({"schedule": {"kind": "business_days", "time": 960}}, "E103"), ({"schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": None}, "E103"), ({"colour": 1}, "E101")])
def test_source_errors(tmp_path, change, code):
    spec = {"name": "s", "relation": "r", "loaded_at_field": "x", "schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": "1h"} | change
    path = tmp_path / "c.yml"
    path.write_text(json.dumps({"version": 1, "defaults": {"timezone": "UTC"}, "sources": [spec]}))
    assert cfg.load_config(path).entries[0].errors[0].code == code


def test_manifest(tmp_path):
    node = lambda **x: {"source_name": "shop", "name": "orders", "relation_name": "db.orders", "loaded_at_field": "at"} | x
    good = {"schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": "1h"}
    sources = {"a": node(config={"meta": {"tidewatch": good}}), "b": node(name="b", meta={"tidewatch": good}, loaded_at_field=None), "c": node(name="c"),
               "d": node(name="d", meta={"tidewatch": "x"}), "e": node(name="e", meta={"tidewatch": good | {"relation": "r"}})}
    (tmp_path / "m.json").write_text(json.dumps({"metadata": {"dbt_schema_version": "https://x/manifest/v12.json"}, "sources": sources}))
    (tmp_path / "c.yml").write_text(json.dumps({"version": 1, "defaults": {"timezone": "UTC"}, "dbt": {"manifest": "m.json"},
                                                "sources": [{"name": "shop.orders", "relation": "r", "loaded_at_field": "x", **good}]}))
    config = cfg.load_config(tmp_path / "c.yml")
    found = {e.source_id: [i.code for i in e.errors] for e in cfg.load_manifest(config.manifest, config)}
    assert found == {"shop.orders": [], "shop.b": ["E303"], "shop.d": ["E103"], "shop.e": ["E304"]}
    merged = cfg.merge(config, cfg.load_manifest(config.manifest, config))
    assert [w.code for w in merged[-1].warnings] == ["W004"] and merged[-1].origin == "config"


def test_secrets_are_scrubbed():
    assert scrub("could not log in with p@ss at p%40ss", "p@ss") == "could not log in with <redacted> at <redacted>"


def test_stream_of_load_times(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    got = {}
    on_each_batch(latest_from_stream(events, "event_type", "ts"), lambda df: got.update({r[0]: r[1] for r in df.collect()}), str(tmp_path / "state")).awaitTermination(120)
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max("ts")).collect()
    assert got == {r[0]: r[1] for r in want}
