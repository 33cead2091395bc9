"""The sweep over change points against the search of each rule at each instant."""

import random
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from test_core import as_rule, random_spec
from tidewatch import queries
from tidewatch.functions.frames import local_frame
from tidewatch.operators import evaluate, releases, sweep
from tidewatch.operators.releases import rule

NOW = datetime(2026, 11, 2, 7, 15)
SEEN = "source_id string, observed timestamp_ntz, naive boolean"


def searched(spark, rules, loads, days, cal, instants):
    """What ``evaluate`` says at each instant about the latest load so far."""
    zone = {r["source_id"]: r["observed_tz"] or "UTC" for r in rules.collect()}
    out = {}
    for at in instants:
        seen = {}
        for source, load in loads:
            if load.replace(tzinfo=ZoneInfo(zone[source])).astimezone(UTC).replace(tzinfo=None) <= at:
                seen[source] = max(seen.get(source, load), load)
        observed = local_frame(spark, [(s, x, True) for s, x in seen.items()], SEEN)
        out |= {(r[0], r[1]): tuple(r) for r in evaluate.evaluate(rules, observed, days, cal, at).select(*sweep.COLUMNS).collect()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_search(spark, seed):
    rng = random.Random(seed)
    specs = [random_spec(rng) for _ in range(20)]
    cal, days = queries.calendars(spark, date(2018, 1, 1), date(2033, 1, 1), refs=["financial XECB"], valid_until=date(2026, 11, 1) if seed == 2 else None)
    rules = releases.rules_frame(spark, [as_rule(i, s, observed_tz=rng.choice(["UTC", "Europe/Berlin", None if i % 7 == 3 else "UTC"]), grace_minutes=rng.choice([0, 240, 3000]),
                                                active_from=rng.choice([None, None, date(2026, 10, 29), date(2027, 1, 1)])) for i, s in enumerate(specs)])
    loads = [(f"r{i:03d}", NOW - timedelta(days=rng.randrange(400), minutes=rng.randrange(900))) for i in range(16) for _ in range(rng.randrange(6))]
    loads += [("r003", datetime(1970, 1, 1)), ("r004", NOW), ("r005", NOW + timedelta(days=9))]
    grid = [NOW + timedelta(hours=7 * i) for i in range(-6, 7)]
    got = {(r[0], r[1]): tuple(r) for r in sweep.verdicts(rules, local_frame(spark, loads, "source_id string, loaded_at timestamp_ntz"), days, cal, grid).collect()}
    assert len(got) == 20 * len(grid)
    want = searched(spark, rules, loads, days, cal, grid[::6])
    assert {k: got[k] for k in want} == want


def test_thin_and_dead_schedules(spark):
    """Nothing within 45 days: the last and the next release come from the whole horizon; a schedule without releases is an error."""
    cal, days = queries.calendars(spark, date(2015, 1, 1), date(2033, 1, 1))
    rules = releases.rules_frame(spark, [rule("leap", cron="0 0 29 2 *", observed_tz="UTC"), rule("june", cron="0 0 1 6 *", observed_tz="UTC"), rule("dead", cron="0 0 30 2 *", observed_tz="UTC"),
                                         rule("minute", cron="* * * * *", observed_tz="UTC", grace_minutes=1)])
    loads = [("leap", datetime(2024, 2, 28)), ("june", datetime(2026, 6, 2)), ("dead", datetime(2026, 1, 1)), ("minute", NOW - timedelta(days=9))]
    got = {(r[0], r[1]): tuple(r) for r in sweep.verdicts(rules, local_frame(spark, loads, "source_id string, loaded_at timestamp_ntz"), days, cal, [NOW]).collect()}
    assert got == searched(spark, rules, loads, days, cal, [NOW])
    assert got["minute", NOW][7] == 10_000 and got["dead", NOW][2] == "CONFIG_ERROR" and got["leap", NOW][6] == datetime(2028, 2, 29)


def test_aware_loads_and_ties(spark):
    """A load at a release's instant has arrived; a deadline is passed only after it."""
    cal, days = queries.calendars(spark, date(2018, 1, 1), date(2033, 1, 1))
    rules = releases.rules_frame(spark, [rule("a", cron="0 6 * * *", grace_minutes=60), rule("b", cron="0 6 * * *", grace_minutes=60)])
    at = datetime(2026, 11, 2, 6)
    loads = local_frame(spark, [("a", at - timedelta(days=1), False), ("b", at, False)], "source_id string, loaded_at timestamp_ntz, naive boolean")
    grid = [at - timedelta(seconds=1), at, at + timedelta(hours=1), at + timedelta(hours=1, microseconds=1)]
    got = {(r["source_id"], r["evaluated_at"]): r["status"] for r in sweep.verdicts(rules, loads, days, cal, grid).collect()}
    assert [got["a", t] for t in grid] == ["ON_TIME", "NOT_DUE", "NOT_DUE", "OVERDUE"]
    assert [got["b", t] for t in grid] == ["NO_DATA", "ON_TIME", "ON_TIME", "ON_TIME"]


def test_rules_share_their_schedule(spark, sf_dir):
    rules = queries.customer_rules(spark, sf_dir)
    shared = sweep.shared_schedules(sweep.with_schedule(rules))
    assert rules.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count() and shared.count() == 4
    assert releases.rules_frame(spark, []).transform(sweep.with_schedule).transform(sweep.shared_schedules).count() == 0


def test_no_rules_and_no_loads(spark):
    cal, days = queries.calendars(spark, date(2018, 1, 1), date(2033, 1, 1))
    none = local_frame(spark, [], "source_id string, loaded_at timestamp_ntz")
    assert sweep.verdicts(releases.rules_frame(spark, []), none, days, cal, [NOW]).count() == 0
    row = sweep.verdicts(releases.rules_frame(spark, [rule("a", business_days="16:00")]), none, days, cal, [NOW]).first()
    assert row["status"] == "NO_DATA" and row["release"] == datetime(2026, 10, 30, 16) and row["missed_count"] == 0
