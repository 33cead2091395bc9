"""Holiday rules as rows against written-out dates."""

from datetime import date, timedelta

import pytest

from tidewatch.functions import holidays
from tidewatch.functions.frames import local_frame

#: Written out from published calendars: month and day.
WRITTEN = {
    ("FR", 2024): "01-01 04-01 05-01 05-08 05-09 05-20 07-14 08-15 11-01 11-11 12-25", ("IT", 2025): "01-01 01-06 04-20 04-21 04-25 05-01 06-02 08-15 11-01 12-08 12-25 12-26",
    ("BE", 2024): "01-01 03-31 04-01 05-01 05-09 05-19 05-20 07-21 08-15 11-01 11-11 12-25", ("AT", 2024): "01-01 01-06 04-01 05-01 05-09 05-20 05-30 08-15 10-26 11-01 12-08 12-25 12-26",
    ("PT", 2024): "01-01 03-29 03-31 04-25 05-01 05-30 06-10 08-15 10-05 11-01 12-01 12-08 12-25", ("LU", 2018): "01-01 04-02 05-01 05-10 05-21 06-23 08-15 11-01 12-25 12-26",
    ("LU", 2025): "01-01 04-21 05-01 05-09 05-29 06-09 06-23 08-15 11-01 12-25 12-26", ("PL", 2010): "01-01 04-04 04-05 05-01 05-03 05-23 06-03 08-15 11-01 11-11 12-25 12-26",
    ("PL", 2025): "01-01 01-06 04-20 04-21 05-01 05-03 06-08 06-19 08-15 11-01 11-11 12-24 12-25 12-26", ("DK", 2023): "01-01 04-06 04-07 04-09 04-10 05-05 05-18 05-28 05-29 12-25 12-26",
    ("DK", 2024): "01-01 03-28 03-29 03-31 04-01 05-09 05-19 05-20 12-25 12-26", ("NO", 2024): "01-01 03-28 03-29 03-31 04-01 05-01 05-09 05-17 05-19 05-20 12-25 12-26",
    ("FI", 2024): "01-01 01-06 03-29 03-31 04-01 05-01 05-09 05-19 06-22 11-02 12-06 12-25 12-26", ("BR", 2023): "01-01 04-07 04-21 05-01 09-07 10-12 11-02 11-15 12-25",
    ("BR", 2024): "01-01 03-29 04-21 05-01 09-07 10-12 11-02 11-15 11-20 12-25"}


def test_written_out_years(spark):
    labels = sorted({f"country {c}" for c, _ in WRITTEN})
    held = {}
    for r in holidays.holiday_dim(spark, labels, 1900, 2100).collect():
        held.setdefault((r["ref_label"][8:], r["date"].year), set()).add(r["date"].strftime("%m-%d"))
    assert {k: " ".join(sorted(held[k])) for k in WRITTEN} == WRITTEN
    for label, (_, first) in ((x, holidays.RULES[x]) for x in labels):
        years = [y for c, y in held if f"country {c}" == label]
        assert (min(years), max(years)) == (first, 2100)
    assert {(r["ref_label"], r["first_year"], r["last_year"]) for r in holidays.holiday_ranges(spark, labels[:1]).collect()} == {(labels[0], holidays.RULES[labels[0]][1], 2100)}


def test_easter_as_a_column(spark):
    rows = spark.range(1583, 2500).select(holidays.easter_day(holidays.F.col("id").cast("int")).alias("d")).collect()
    assert [r["d"] for r in rows] == [holidays.easter(y) for y in range(1583, 2500)]


@pytest.mark.parametrize("moved", [None, "nearest", "monday"])
def test_days_of_a_users_rules_move_from_weekends(spark, moved):
    rules = local_frame(spark, [("own", "fixed", 7, 4, None, None, 2000, 2030, moved), ("own", "third Monday", 1, 15, None, 0, None, None, None), ("own", "other", 1, 15, None, 0, 2020, None, None)], holidays.RULE_ROWS)
    got = {r["date"]: r["name"] for r in holidays.expand_rules(rules, 1995, 2035).collect()}
    for year in range(1995, 2036):
        day = date(year, 7, 4)
        step = {None: (0, 0), "nearest": (-1, 1), "monday": (2, 1)}[moved][day.weekday() - 5] if day.weekday() > 4 else 0
        assert (day + timedelta(days=step) in got) == (2000 <= year <= 2030)
        assert got[holidays.nth_weekday(year, 1, 0, 3)] == ("other" if year >= 2020 else "third Monday")
