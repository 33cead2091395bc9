"""Reports in parts, and output that can't be delivered."""

import io
import json
import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch import queries
from tidewatch.functions.frames import local_frame
from tidewatch.operators import evaluate, releases
from tidewatch.operators.releases import rule
from tidewatch.plans import cli, report

NOW = datetime(2024, 3, 31, 6, 30)


@pytest.fixture(scope="module")
def verdicts(spark):
    """Verdicts of every kind: zones with odd offsets, fractions of seconds, warnings, errors, texts to be escaped."""
    cal, days = queries.calendars(spark, date(2018, 1, 1), date(2030, 1, 1), valid_until=date(2024, 4, 10))
    rows = [rule("plain", cron="0 6 * * *"), rule("zürich \"quoted\" \\ back\tslash\n", business_days="16:00", tz="Europe/Zurich", observed_tz="Europe/Zurich", grace_minutes=90),
            rule("kathmandu", cron="30 2 * * *", tz="Asia/Kathmandu", observed_tz="Asia/Kathmandu"), rule("newfoundland", monthly=(-1, "09:00"), tz="America/St_Johns", observed_tz="UTC"),
            rule("no zone", cron="0 6 * * *"), rule("future", cron="0 6 * * *", observed_tz="UTC"), rule("gap", cron="30 2 * * *", tz="Europe/Berlin", observed_tz="UTC", policy="following"),
            rule("empty", cron="0 6 * * *"), rule("failed", cron="0 6 * * *"), rule("dead", cron="0 0 30 2 *")]
    seen = [("plain", datetime(2024, 3, 31, 6, 0, 0, 120), False), (rows[1][0], datetime(2024, 3, 20, 16), True), ("kathmandu", datetime(2024, 3, 30, 1), True),
            ("newfoundland", datetime(2024, 1, 30, 1), True), ("no zone", datetime(2024, 3, 30), True), ("future", datetime(2024, 4, 2), True), ("gap", datetime(2024, 3, 28), True)]
    failed = spark.createDataFrame([("failed", ("E502", "query failed: \x01 'x'"))], "source_id string, query_error struct<code:string,message:string>")
    return evaluate.evaluate(releases.rules_frame(spark, rows), local_frame(spark, seen, "source_id string, observed timestamp_ntz, naive boolean"), days, cal, NOW, failed).cache()


def test_parts_run_together_are_the_document(spark, verdicts, tmp_path):
    want = report.json_report(verdicts.orderBy("source_id"), "check", NOW)
    assert {"ON_TIME", "OVERDUE", "NO_DATA", "CONFIG_ERROR", "QUERY_ERROR"} <= {r["status"] for r in json.loads(want)["results"]}
    report.write_json_report(verdicts.repartition(5), NOW, str(tmp_path / "r"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert got == want
    twice = verdicts.unionByName(verdicts.withColumn("source_id", F.concat("source_id", F.lit("~"))))
    assert [r["value"] for r in report.json_report_parts(twice, NOW).orderBy("ord").collect()] == report_lines(twice)
    none = report.json_report_parts(verdicts.limit(0), NOW).collect()
    assert none[0]["value"] + "\n" == report.json_report(verdicts.limit(0), "check", NOW)


def report_lines(rows):
    """The document in pieces: head, results, tail."""
    text = report.json_report(rows.orderBy("source_id"), "check", NOW)
    head, _, rest = text.partition("[\n")
    return [head + "[", *split_results(rest.rpartition("\n  ]\n}\n")[0]), "  ]\n}"]


def split_results(body):
    pieces = body.split("\n    },\n")
    return [p + "\n    }," for p in pieces[:-1]] + [pieces[-1]]


CONFIG = {"version": 1, "connection": {"type": "spark"}, "defaults": {"timezone": "UTC", "observed_timezone": "UTC"},
          "sources": [{"name": "s", "relation": "read_csv('t.csv')", "loaded_at_field": "at", "schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": "1h"}]}


@pytest.fixture
def config(tmp_path):
    (tmp_path / "t.csv").write_text("v,at\n1,2024-01-30 16:04:00\n")
    (tmp_path / "c.yml").write_text(json.dumps(CONFIG))
    return ["check", "-c", str(tmp_path / "c.yml"), "--now", "2024-01-31T12:00:00+00:00", "--format", "json"]


def test_large_reports_are_written_in_parts(spark, config, tmp_path, monkeypatch, capsys):
    out = tmp_path / "r.json"
    assert cli.main([*config, "--output", str(out)], spark) == 1
    monkeypatch.setattr(report, "ONE_FILE", 0)
    assert cli.main([*config, "--output", str(tmp_path / "big.json")], spark) == 1
    parts = "".join(p.read_text() for p in sorted(Path(str(tmp_path / "big.json") + ".parts").glob("part-*")))
    assert parts == out.read_text()


def test_output_that_cannot_be_written(capsys, tmp_path):
    assert cli._deliver("x", 0, str(tmp_path / "no" / "where")) == 2 and "E217" in capsys.readouterr().err
    assert cli._deliver("x", 3, str(tmp_path)) == 3 and "E217" in capsys.readouterr().err
    assert cli._deliver("text", 1, str(tmp_path / "fine")) == 1 and (tmp_path / "fine").read_text() == "text"


def test_a_reader_that_has_gone_away(monkeypatch):
    class Gone(io.StringIO):
        def flush(self):
            raise BrokenPipeError

    monkeypatch.setattr(sys, "stdout", Gone())
    assert cli._deliver("x", 1, None) == 1
