"""Verdicts of written-out scenarios, through the configuration's parser and one plan for all of them.

``scenarios.yml`` holds this library's own. TIDEWATCH_SCENARIOS may name another file of the same form: a list of
id, rule, calendars (optional), now, observed and expect.
"""

import os
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

import pytest
import yaml

from tidewatch.functions.frames import local_frame
from tidewatch.operators import evaluate, releases
from tidewatch.plans import api
from tidewatch.sources import config as cfg

FILES = [Path(__file__).with_name("scenarios.yml"), *map(Path, filter(None, [os.environ.get("TIDEWATCH_SCENARIOS")]))]


def utc(value):
    value = datetime.fromisoformat(value) if isinstance(value, str) else value
    return value if value is None or value.tzinfo is None else value.astimezone(UTC).replace(tzinfo=None)


def parsed(path):
    return cfg._yaml(path.read_text(), str(path))


@pytest.mark.parametrize("path", FILES, ids=str)
def test_scenarios(spark, path):
    scenarios, rows, calendars = parsed(path), [], {}
    for s in scenarios:
        named = {k: cfg.parse_calendar(k, v, path.parent) for k, v in (s.get("calendars") or {}).items()}
        inline = {"default": cfg.Calendar("default")}
        spec = dict(s["rule"])
        assert cfg.rule_issues(spec, cfg.DBT_RULE, s["id"], dbt=True) == []
        spec |= {"relation": "golden", "loaded_at_field": "_loaded_at"}
        rows.append(cfg.build_row(s["id"], "config", spec, {}, named, inline, path.parent, s["id"]))
        calendars |= inline | named
    first = min(utc(s["now"]) for s in scenarios) - timedelta(days=4200)
    frame, days = api.calendar_tables(spark, calendars, first.date(), date(2110, 1, 1))
    nows = local_frame(spark, [(s["id"], utc(s["now"])) for s in scenarios], "source_id string, now timestamp_ntz")
    naive = lambda v: v is not None and datetime.fromisoformat(str(v)).tzinfo is None
    seen = local_frame(spark, [(s["id"], utc(s["observed"]), naive(s["observed"])) for s in scenarios if s["observed"]],
                       "source_id string, observed timestamp_ntz, naive boolean")
    got = {r["source_id"]: r for r in evaluate.evaluate(releases.rules_frame(spark, rows).join(nows, "source_id"), seen, days, frame, None).collect()}
    assert len(got) == len(scenarios)
    wrong = []
    for s in scenarios:
        r, want = got[s["id"]], s["expect"]
        have = {"status": r["status"], "release": r["release"], "deadline": r["deadline"], "next_expected_arrival": r["next_expected_arrival"], "missed_count": r["missed_count"],
                "missed_truncated": r["missed_truncated"], "pending_count": r["pending_count"], "warning_codes": [w["code"] for w in r["warnings"]],
                "error_code": r["error"]["code"] if r["error"] else None, "explanation": r["explanation"]}
        if r["release"] is not None:
            have |= {"release_adjusted_from": str(r["adjusted_from"]) if r["adjusted_from"] else None, "release_dst": r["dst"], "release_clamped": r["clamped"]}
        expected = {"release_adjusted_from": None, "release_dst": "normal", "release_clamped": False} if r["release"] is not None else {}
        expected |= {k: utc(v) if k in ("release", "deadline", "next_expected_arrival") else v for k, v in want.items() if not k.startswith("next_") or k == "next_expected_arrival"}
        wrong += [(s["id"], k, have.get(k), v) for k, v in expected.items() if have.get(k) != v]
    assert wrong == []


def test_own_file_covers_all_sentences():
    told = [s["expect"]["explanation"].split(":")[0] for s in yaml.safe_load(FILES[0].read_text())]
    assert {"On time", "Not due", "Overdue", "No data", "Configuration error"} <= set(told)
