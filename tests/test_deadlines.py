"""A stream whose verdicts change by time alone."""

import json
import time
from datetime import UTC, datetime

import pytest

from tidewatch.functions.frames import local_frame
from tidewatch.operators import releases
from tidewatch.operators.releases import rule
from tidewatch.queries import calendars
from tidewatch.streaming import deadlines

ROWS = "source_id string, loaded_us long, release_us long, deadline_us long"


@pytest.fixture
def with_timers(spark):
    before = {k: spark.conf.get(k) for k in deadlines.STATE_STORE}
    for k, v in deadlines.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_silent_source_becomes_overdue(with_timers, tmp_path):
    spark = with_timers
    (tmp_path / "in").mkdir()
    put = lambda name, **row: (tmp_path / "in" / name).write_text(json.dumps(row) + "\n")
    now = int(time.time() * 1_000_000)
    second = 1_000_000
    begin = [(s, now - 3600 * second, None, None) for s in ("silent", "lively")] + [(s, None, now + 25 * second, now + 35 * second) for s in ("silent", "lively", "empty")]
    held = local_frame(spark, begin, ROWS)
    put("0.json", source_id="other", loaded_us=now)
    loads = spark.readStream.schema(ROWS).json(str(tmp_path / "in"))
    got = []
    query = (deadlines.watch_deadlines(loads, held).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second")
             .foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start())
    try:
        sent, until = False, time.time() + 150
        while time.time() < until and ("silent", "OVERDUE") not in {(r[0], r[2]) for r in got}:
            if not sent and {("lively", "NOT_DUE"), ("lively", "OVERDUE")} & {(r[0], r[2]) for r in got}:
                put("1.json", source_id="lively", loaded_us=now + 26 * second)
                sent = True
            time.sleep(0.5)
        while time.time() < until and [r[2] for r in got if r[0] == "lively"][-1] != "ON_TIME":
            time.sleep(0.5)
    finally:
        query.stop()
    said = {s: [r[2] for r in got if r[0] == s] for s in ("silent", "lively", "empty", "other")}
    steps = ["ON_TIME", "NOT_DUE", "OVERDUE"]  # a slow start may miss the first of them
    assert said["silent"] == steps[-len(said["silent"]):] and said["empty"] == ["NO_DATA"] and said["other"] == ["ON_TIME"]
    assert len(said["lively"]) > 1 and said["lively"][-1] == "ON_TIME"
    last = next(r for r in got if r[0] == "silent" and r[2] == "OVERDUE")
    assert last[3:5] == (now + 25 * second, now + 35 * second) and last[1] > now + 35 * second


def test_releases_of_rules_as_rows(spark):
    _, days = calendars(spark, datetime(2024, 1, 1).date(), datetime(2024, 12, 31).date())
    rows = deadlines.coming_releases(releases.rules_frame(spark, [rule("a", business_days="16:00", grace_minutes=60)]), days, datetime(2024, 1, 5), datetime(2024, 1, 9)).collect()
    at = lambda d: int(datetime(2024, 1, d, 16, tzinfo=UTC).timestamp() * 1_000_000)
    assert sorted((r["release_us"], r["deadline_us"]) for r in rows) == [(at(d), at(d) + 3_600_000_000) for d in (5, 8)]
