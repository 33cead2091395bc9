"""A replay from files to its report."""

import json
from datetime import datetime

from tidewatch.plans import replay

PUBLICATIONS = """rate_date,last_modified_utc,first_seen_utc
2024-01-08,2024-01-08T15:50:00Z,2024-01-08T16:00:00Z
2024-01-08,2024-01-08T19:00:00Z,2024-01-08T19:10:00Z
2024-01-09,2024-01-09T19:40:00Z,2024-01-09T19:45:00Z
2024-01-11,2024-01-11T15:55:00Z,2024-01-11T16:00:00Z
"""


def test_replay_of_files(spark, tmp_path):
    """Tuesday's publication is late; Wednesday was not collected and so is nobody's fault; the revision on Monday changes nothing."""
    (tmp_path / "pub.csv").write_text(PUBLICATIONS)
    source = {"name": "fx", "relation": "r", "loaded_at_field": "at", "schedule": {"kind": "business_days", "time": "16:00"}, "grace": "2h", "observed_timezone": "UTC"}
    (tmp_path / "c.yml").write_text(json.dumps({"version": 1, "connection": {"type": "spark"}, "defaults": {"timezone": "UTC"}, "sources": [source]}))
    text = replay.replay_files(spark, str(tmp_path / "c.yml"), "fx", str(tmp_path / "pub.csv"), datetime(2024, 1, 8, 17), datetime(2024, 1, 10, 12), 60, report=str(tmp_path / "out.md"))
    assert (tmp_path / "out.md").read_text() == text
    # loads: Monday 15:50, Tuesday 19:40. The rule counts from the load: Monday's release at 16:00 is never seen as arrived
    lines = text.splitlines()
    assert "# Replay of fx, immediate loader, 2024-01-08 to 2024-01-10" in lines and "# Replay of fx, hourly loader, 2024-01-08 to 2024-01-10" in lines
    table = [[c.strip() for c in x.strip("|").split("|")] for x in lines if x.startswith("| calendar rule, immediate") and x.count("|") == 6]
    model, *counts = table[0]
    tp, fp, fn, tn = map(int, counts)
    assert tp + fp + fn + tn == 44 and (tp, fn) == (1, 0) and fp == 24
    assert any("false alarm: calendar rule, immediate loader says late" in x for x in lines)
    hourly = [[c.strip() for c in x.strip("|").split("|")] for x in lines if x.startswith("| calendar rule, hourly") and x.count("|") == 6][0]
    assert [int(c) for c in hourly[1:]] == [1, 1, 0, 42]
