"""Registered queries of the release-calendar engine, each with DuckDB SQL of its own making.

Instants are TIMESTAMP_NTZ in UTC, ``now`` is always a literal.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.frames import local_frame
from tidewatch.functions.holidays import holiday_dim, holiday_ranges
from tidewatch.functions.timeutil import classify_local, format_duration, resolve_local, ts
from tidewatch.operators import backtest, calendar, catalog, evaluate, releases, sweep, trace
from tidewatch.operators.releases import rule
from tidewatch.plans import replay as replays
from tidewatch.sources.observe import latest_by_relation, latest_for_keys, observe

NOW = datetime(2024, 1, 31, 18, 30)
MIXED_NOW = datetime(2024, 1, 31, 6, 30)
ORDERS_NOW = datetime(2001, 8, 6, 12, 0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendars(spark: SparkSession, first: date, last: date, *, refs: list[str] = (), working: list[str] = (), resting: list[str] = (),
              weekend: tuple[int, ...] = (5, 6), valid_until: date | None = None) -> tuple[DataFrame, DataFrame]:
    """One calendar called default: its row and its days."""
    cal = local_frame(spark, [("default", list(weekend), valid_until, "default")], calendar.CALENDARS)
    marks = local_frame(spark, [("default", date.fromisoformat(d), w) for ds, w in ((working, True), (resting, False)) for d in ds], calendar.OVERRIDES)
    named = local_frame(spark, [("default", r, i) for i, r in enumerate(refs)], calendar.REFS)
    dim = holiday_dim(spark, list(refs)) if refs else local_frame(spark, [], calendar.HOLIDAYS)
    ranges = holiday_ranges(spark, list(refs)) if refs else None
    return cal, calendar.calendar_days(cal, marks, named, dim, first, last, ranges)


def with_rows(spark, sf_dir, df: DataFrame, at: str = "instant", name: str = "orders", stamp: str = "o_orderdate") -> DataFrame:
    """The dates or instants of ``df`` with the number of rows a table has on that day (n_rows)."""
    held = table(spark, sf_dir, name).groupBy(F.col(stamp).cast("date").alias("_day")).agg(F.count("*").alias("_n"))
    return df.join(held, F.col(at).cast("date") == F.col("_day"), "left").select(*df.columns, F.coalesce("_n", F.lit(0)).alias("n_rows"))


def with_rows_sql(sql: str, at: str = "instant", name: str = "orders", stamp: str = "o_orderdate") -> str:
    return f"SELECT b.*, coalesce(n, 0) AS n_rows FROM ({sql}) b LEFT JOIN (SELECT CAST({stamp} AS DATE) AS _day, count(*) AS n FROM {name} GROUP BY 1) ON _day = CAST({at} AS DATE)"


# --- load times -------------------------------------------------------------------------------------------------


@query("SELECT 'events' AS source_id, max(ts) AS observed FROM events")
def latest_loaded_at(spark, sf_dir):
    return latest_by_relation(table(spark, sf_dir, "events"), [("events", "ts", None)]).select("source_id", "observed")


@query("SELECT 'orders' AS source_id, max(o_orderdate) AS observed FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def latest_loaded_at_filtered(spark, sf_dir):
    return latest_by_relation(table(spark, sf_dir, "orders"), [("orders", "o_orderdate", "o_orderstatus = 'F' AND o_totalprice > 1000")]).select("source_id", "observed")


@query("""SELECT event_type AS source_id, max(ts) AS observed FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1""")
def latest_per_source(spark, sf_dir):
    targets = [(t, "ts", f"event_type = '{t}'") for t in ("click", "error", "purchase", "signup", "view")]
    return latest_by_relation(table(spark, sf_dir, "events"), targets).select("source_id", "observed")


@query("SELECT 'orders' AS source_id, max(o_orderdate) AS observed FROM orders WHERE o_totalprice < -1")
def latest_empty_is_null(spark, sf_dir):
    return latest_by_relation(table(spark, sf_dir, "orders"), [("orders", "o_orderdate", "o_totalprice < -1")]).select("source_id", "observed")


@query("""SELECT source_id, observed, code FROM (VALUES ('a_good', (SELECT max(ts) FROM events), NULL), ('b_missing', NULL, 'E502'),
          ('c_number', NULL, 'E503'), ('d_joined', (SELECT max(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey), NULL)) t(source_id, observed, code)""")
def observe_many_relations(spark, sf_dir):
    rows = [rule("a_good", cron="0 6 * * *", relation=f"read_parquet('{sf_dir}/events.parquet')", loaded_at_field="ts"),
            rule("b_missing", cron="0 6 * * *", relation="no_such_table"),
            rule("c_number", cron="0 6 * * *", relation=f"read_parquet('{sf_dir}/events.parquet')", loaded_at_field="value"),
            rule("d_joined", cron="0 6 * * *", relation="joined", loaded_at_field="o_orderdate")]
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return observe(spark, releases.rules_frame(spark, rows), sf_dir, {"joined": joined}).select("source_id", "observed", "code")


@query("SELECT 'c' || c_custkey AS source_id, max(o_orderdate) AS observed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def keyed_load_times(spark, sf_dir):
    """A source per customer, all of them by one aggregate over the orders."""
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), F.lit(0).alias("f"), F.col("c_custkey").cast("long").alias("k0"))
    return latest_for_keys(table(spark, sf_dir, "orders"), asked, ("o_custkey",), ["o_orderdate"]).select("source_id", F.col("at").alias("observed"))


@query("""SELECT source_id, observed, code FROM (VALUES ('commented', NULL, 'E502'), ('field', NULL, 'E502'), ('filter', NULL, 'E502'), ('inside', (SELECT max(ts) FROM events WHERE value > 50), NULL), ('quoted', NULL, 'E502'),
          ('view', NULL, 'E502')) t(source_id, observed, code)""")
def outside_relation_refused(spark, sf_dir):
    """Ways to files that aren't below the rules' folder, each refused, beside a subquery that stays in it."""
    outside = f"{sf_dir}/orders.parquet"
    spark.read.parquet(outside).createOrReplaceTempView("tidewatch_outside")
    own = f"read_parquet('{sf_dir}/events.parquet')"
    texts = {"inside": (f"(SELECT * FROM {own} WHERE value > 50)", "ts", None), "commented": (f"(SELECT o_orderdate AS ts FROM parquet/**/.`{outside}`)", "ts", None),
             "quoted": (f"(SELECT o_orderdate AS ts FROM `parquet`.`{outside}`)", "ts", None), "view": ("(SELECT o_orderdate AS ts FROM tidewatch_outside)", "ts", None),
             "field": (own, f"(SELECT max(o_orderdate) FROM parquet.`{outside}`)", None), "filter": (own, "ts", f"ts > (SELECT min(o_orderdate) FROM parquet.`{outside}`)")}
    rows = [rule(s, cron="0 6 * * *", relation=r, loaded_at_field=f, filter=c) for s, (r, f, c) in texts.items()]
    return observe(spark, releases.rules_frame(spark, rows), f"{sf_dir}/events.parquet").select("source_id", "observed", "code")


@query("SELECT event_type AS source_id, timezone('UTC', timezone('Europe/Berlin', max(ts))) AS observed_at FROM events GROUP BY 1")
def observed_zone_normalised(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id")).agg(F.max("ts").alias("observed"))
    return last.select("source_id", resolve_local(F.col("observed"), F.lit("Europe/Berlin")).alias("observed_at"))


# --- calendars --------------------------------------------------------------------------------------------------

EASTER_SQL = """
years AS (SELECT y FROM generate_series(1999, 2030) t(y)),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3),
easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS d FROM e4),
target AS (
  SELECT make_date(y, 1, 1) AS date FROM years UNION SELECT make_date(y, 12, 25) FROM years
  UNION SELECT CAST(d - INTERVAL 2 DAY AS DATE) FROM easter WHERE y >= 2000 UNION SELECT CAST(d + INTERVAL 1 DAY AS DATE) FROM easter WHERE y >= 2000
  UNION SELECT make_date(y, 5, 1) FROM years WHERE y >= 2000 UNION SELECT make_date(y, 12, 26) FROM years WHERE y >= 2000
  UNION SELECT DATE '1999-12-31' UNION SELECT DATE '2001-12-31')
"""


@query(with_rows_sql("WITH " + EASTER_SQL + " SELECT date FROM target", "date"))
def target_holidays(spark, sf_dir):
    return with_rows(spark, sf_dir, holiday_dim(spark, ["financial XECB"], 1999, 2030).select("date"), "date")


@query(with_rows_sql("WITH " + EASTER_SQL + """ SELECT make_date(y, m, x) AS date FROM years, (VALUES (1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)) f(m, x)
  UNION SELECT CAST(d + k * INTERVAL 1 DAY AS DATE) FROM easter, (VALUES (1), (39), (50)) o(k)""", "date"))
def holidays_from_rule_rows(spark, sf_dir):
    """French holidays, expanded from rows of rules."""
    return with_rows(spark, sf_dir, holiday_dim(spark, ["country FR"], 1999, 2030).select("date"), "date")


@query(with_rows_sql("WITH " + EASTER_SQL + """ SELECT date, count(*) AS n_refs FROM (SELECT date FROM target UNION ALL SELECT * FROM (VALUES (DATE '2001-12-24'), (DATE '2001-12-25')) v(date))
          WHERE year(date) = 2001 GROUP BY 1""", "date"))
def holiday_union(spark, sf_dir):
    own = local_frame(spark, [("own", date(2001, 12, 24), "Eve"), ("own", date(2001, 12, 25), "Day")], calendar.HOLIDAYS)
    dim = holiday_dim(spark, ["financial XECB"], 2001, 2001).union(own)
    refs = local_frame(spark, [("default", "financial XECB", 0), ("default", "own", 1)], calendar.REFS)
    union = calendar.holiday_union(refs, dim)
    counts = refs.join(dim, "ref_label").groupBy("date").agg(F.count("*").alias("n_refs"))
    return with_rows(spark, sf_dir, union.join(counts, "date").select("date", "n_refs"), "date")


@query(with_rows_sql("WITH " + EASTER_SQL + """ SELECT CAST(d AS DATE) AS date, CASE WHEN d = DATE '2001-01-06' THEN TRUE WHEN d = DATE '2001-01-09' THEN FALSE
          WHEN isodow(d) > 5 THEN FALSE ELSE CAST(d AS DATE) NOT IN (SELECT date FROM target) END AS is_bd
          FROM generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d)""", "date"))
def business_day_spine(spark, sf_dir):
    _, days = calendars(spark, date(2001, 1, 1), date(2001, 12, 31), refs=["financial XECB"], working=["2001-01-06"], resting=["2001-01-09"])
    return with_rows(spark, sf_dir, days.select("date", "is_bd"), "date")


@query(with_rows_sql("""SELECT CAST(d AS DATE) AS date, CASE WHEN CAST(d AS DATE) IN (DATE '2001-05-05', DATE '2001-05-01') THEN NULL WHEN CAST(d AS DATE) = DATE '2001-05-06' THEN 'override: non-working day'
          WHEN isodow(d) > 5 THEN 'weekend' WHEN CAST(d AS DATE) = DATE '2001-05-08' THEN 'override: non-working day' END AS reason
          FROM generate_series(TIMESTAMP '2001-05-01', TIMESTAMP '2001-05-31', INTERVAL 1 DAY) t(d)""", "date"))
def override_precedence(spark, sf_dir):
    _, days = calendars(spark, date(2001, 5, 1), date(2001, 5, 31), refs=["financial XECB"], working=["2001-05-05", "2001-05-01"], resting=["2001-05-06", "2001-05-08"])
    return with_rows(spark, sf_dir, days.select("date", "reason"), "date")


@query("""SELECT calendar_id, min(date) AS date FROM (SELECT o_orderpriority AS calendar_id, CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1, 2
          HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F')) GROUP BY 1""")
def override_conflict(spark, sf_dir):
    """A calendar per priority, closed orders taken for working days and the others for resting days."""
    marks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("calendar_id"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderstatus") == "F").alias("is_working"))
    return calendar.override_conflicts(marks)


def _rolled(spark, sf_dir, column):
    _, days = calendars(spark, date(1995, 1, 1), date(2001, 12, 31))
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return dates.join(days, "date").select("date", F.when(F.col("is_bd"), F.col("date")).otherwise(F.col(column)).alias("rolled"))


@query("""WITH bd AS (SELECT CAST(d AS DATE) AS b FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-28', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
          o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, (SELECT min(b) FROM bd WHERE b >= date) AS rolled FROM o""")
def roll_following(spark, sf_dir):
    return _rolled(spark, sf_dir, "next_bd")


@query("""WITH bd AS (SELECT CAST(d AS DATE) AS b FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-28', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
          o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, (SELECT max(b) FROM bd WHERE b <= date) AS rolled FROM o""")
def roll_preceding(spark, sf_dir):
    return _rolled(spark, sf_dir, "prev_bd")


# --- releases ---------------------------------------------------------------------------------------------------


def _between(spark, first: datetime, last: datetime, *rows, days=None) -> DataFrame:
    if days is None:
        _, days = calendars(spark, date(first.year - 1, 12, 1), date(last.year + 1, 1, 31))
    return releases.releases_between(releases.rules_frame(spark, list(rows)), days, first, last)


NTH_SQL = """WITH bd AS (SELECT CAST(d AS DATE) AS b, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS r,
  row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d DESC) AS e, count(*) OVER (PARTITION BY date_trunc('month', d)) AS c
  FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
SELECT CAST(b AS TIMESTAMP) + INTERVAL 9 HOUR AS instant, {clamped} AS clamped FROM bd WHERE {pick}"""


def _monthly(spark, sf_dir, n):
    found = _between(spark, datetime(1995, 1, 1), datetime(2001, 12, 31, 23), rule("m", monthly=(n, "09:00")))
    return with_rows(spark, sf_dir, found.select("instant", "clamped"))


@query(with_rows_sql(NTH_SQL.format(clamped="FALSE", pick="r = 5")))
def nth_business_day(spark, sf_dir):
    return _monthly(spark, sf_dir, 5)


@query(with_rows_sql(NTH_SQL.format(clamped="FALSE", pick="e = 1")))
def last_business_day(spark, sf_dir):
    return _monthly(spark, sf_dir, -1)


@query(with_rows_sql(NTH_SQL.format(clamped="c < 22", pick="r = least(22, c)")))
def clamped_business_day(spark, sf_dir):
    return _monthly(spark, sf_dir, 22)


CRON_SQL = """SELECT CAST(d AS TIMESTAMP) AS instant FROM generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2001-12-31 23:59', INTERVAL {step}) t(d) WHERE {where}"""
AT_SIX = "hour(d) = 6 AND minute(d) = 30"


def _cron(spark, sf_dir, expression, **more):
    return with_rows(spark, sf_dir, _between(spark, datetime(2001, 1, 1), datetime(2001, 12, 31, 23, 59), rule("c", cron=expression, **more)).select("instant"))


@query(with_rows_sql(CRON_SQL.format(step="30 MINUTE", where=AT_SIX)))
def cron_daily(spark, sf_dir):
    return _cron(spark, sf_dir, "30 6 * * *")


@query(with_rows_sql(CRON_SQL.format(step="30 MINUTE", where=AT_SIX + " AND isodow(d) < 6")))
def cron_weekdays(spark, sf_dir):
    return _cron(spark, sf_dir, "30 6 * * MON-FRI")


@query(with_rows_sql(CRON_SQL.format(step="30 MINUTE", where=AT_SIX + " AND (day(d) IN (1, 15) OR isodow(d) = 5)")))
def cron_dom_dow_or(spark, sf_dir):
    return _cron(spark, sf_dir, "30 6 1,15 * 5")


@query(with_rows_sql(CRON_SQL.format(step="30 MINUTE", where=AT_SIX + " AND CAST(d AS DATE) = last_day(CAST(d AS DATE))")))
def cron_last_day(spark, sf_dir):
    return _cron(spark, sf_dir, "30 6 L * *")


@query(with_rows_sql(CRON_SQL.format(step="30 MINUTE", where=AT_SIX + " AND isodow(d) = 7 AND ceil(day(d) / 7.0) = 2")))
def cron_nth_weekday(spark, sf_dir):
    return _cron(spark, sf_dir, "30 6 * * 0#2")


@query(with_rows_sql(CRON_SQL.format(step="1 MINUTE", where="month(d) IN (3, 4) AND hour(d) BETWEEN 8 AND 10 AND minute(d) % 20 = 5")))
def cron_step_minutes(spark, sf_dir):
    return _cron(spark, sf_dir, "5/20 8-10 * MAR,APR *")


@query(with_rows_sql(CRON_SQL.format(step="30 MINUTE", where=AT_SIX + " AND isodow(d) < 6 AND day(d) BETWEEN 10 AND 20")))
def cron_skip(spark, sf_dir):
    return _cron(spark, sf_dir, "30 6 10-20 * *", policy="skip")


@query(with_rows_sql("""WITH n AS (SELECT CAST(d AS DATE) AS nominal, CAST(d AS DATE) + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS final
          FROM generate_series(TIMESTAMP '2000-11-01', TIMESTAMP '2002-01-31', INTERVAL 1 DAY) t(d) WHERE day(d) IN (5, 6, 7))
          SELECT CAST(final AS TIMESTAMP) + INTERVAL 390 MINUTE AS instant, CASE WHEN min(nominal) <> final THEN min(nominal) END AS adjusted_from
          FROM n WHERE final BETWEEN DATE '2001-01-01' AND DATE '2001-12-31' GROUP BY final"""))
def cron_following_dedupe(spark, sf_dir):
    found = _between(spark, datetime(2001, 1, 1), datetime(2001, 12, 31, 23, 59), rule("c", cron="30 6 5,6,7 * *", policy="following"))
    return with_rows(spark, sf_dir, found.select("instant", "adjusted_from"))


DST_SQL = """WITH w AS (SELECT CAST(d AS TIMESTAMP) + INTERVAL 150 MINUTE AS l FROM generate_series(TIMESTAMP '2000-03-20', TIMESTAMP '2000-11-05', INTERVAL 1 DAY) t(d)),
u AS (SELECT l, least(timezone('UTC', timezone('Europe/Berlin', l)), timezone('UTC', timezone('Europe/Berlin', l - INTERVAL 1 HOUR)) + INTERVAL 1 HOUR) AS instant FROM w)
SELECT instant, CASE WHEN CAST(l AS DATE) = DATE '2000-03-26' THEN 'gap' WHEN CAST(l AS DATE) = DATE '2000-10-29' THEN 'ambiguous' ELSE 'normal' END AS dst
FROM u WHERE {where}"""


def _berlin(spark, sf_dir, first, last):
    return with_rows(spark, sf_dir, _between(spark, first, last, rule("b", cron="30 2 * * *", tz="Europe/Berlin")).select("instant", "dst"))


@query(with_rows_sql(DST_SQL.format(where="instant BETWEEN TIMESTAMP '2000-03-22' AND TIMESTAMP '2000-03-30'")))
def releases_dst_gap(spark, sf_dir):
    return _berlin(spark, sf_dir, datetime(2000, 3, 22), datetime(2000, 3, 30))


@query(with_rows_sql(DST_SQL.format(where="instant BETWEEN TIMESTAMP '2000-10-24' AND TIMESTAMP '2000-11-03'")))
def releases_dst_overlap(spark, sf_dir):
    return _berlin(spark, sf_dir, datetime(2000, 10, 24), datetime(2000, 11, 3))


@query(with_rows_sql("""SELECT CAST(d AS TIMESTAMP) AS instant FROM generate_series(TIMESTAMP '2001-01-01 06:00', TIMESTAMP '2001-12-31 06:00', INTERVAL 1 DAY) t(d) WHERE d >= TIMESTAMP '2001-07-01'"""))
def active_from_floor(spark, sf_dir):
    found = _between(spark, datetime(2001, 1, 1), datetime(2001, 12, 31, 23), rule("a", cron="0 6 * * *", active_from=date(2001, 7, 1)))
    return with_rows(spark, sf_dir, found.select("instant"))


@query("""WITH k AS (SELECT event_type AS source_id, (row_number() OVER (ORDER BY event_type) - 1) % 3 AS k FROM (SELECT DISTINCT event_type FROM events)),
r AS (SELECT 0 AS k, CAST(d AS TIMESTAMP) AS instant FROM generate_series(TIMESTAMP '2024-01-31 06:00', TIMESTAMP '2024-12-31 06:00', INTERVAL 1 DAY) t(d)
  UNION ALL SELECT 1, CAST(d AS TIMESTAMP) FROM generate_series(TIMESTAMP '2024-01-31 00:00', TIMESTAMP '2024-02-20', INTERVAL 15 MINUTE) t(d)
  UNION ALL SELECT 2, CAST(d AS TIMESTAMP) FROM generate_series(TIMESTAMP '2024-01-31 16:00', TIMESTAMP '2024-12-31 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY instant) AS position FROM k JOIN r USING (k) WHERE instant > TIMESTAMP '2024-01-31 18:30')
SELECT source_id, CAST(position AS INTEGER) AS position, instant FROM n WHERE position <= 100""")
def next_releases_top_n(spark, sf_dir):
    """The next hundred releases of a source per event type, of three kinds in turn."""
    _, days = calendars(spark, date(2023, 12, 1), date(2029, 6, 30))
    kinds = releases.rules_frame(spark, [rule("0", cron="0 6 * * *"), rule("1", cron="*/15 * * * *"), rule("2", business_days="16:00")])
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    turn = ((F.row_number().over(Window.orderBy("name")) - 1) % 3).cast("string")  # a row per type
    rows = types.select("name", turn.alias("source_id")).join(kinds, "source_id").withColumn("source_id", F.col("name")).select(*kinds.columns)
    return releases.next_releases(rows, days, NOW, 100).select("source_id", "position", "instant")


# --- verdicts ---------------------------------------------------------------------------------------------------


def _observed(df: DataFrame, key: str, stamp: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("source_id")).agg(F.max(stamp).alias("observed")).withColumn("naive", F.lit(True))


def _verdicts(spark, rows, observations, now, **calendar_options):
    cal, days = calendars(spark, date(now.year - 7, 1, 1), date(now.year + 6, 12, 31), **calendar_options)
    return evaluate.evaluate(releases.rules_frame(spark, rows), observations, days, cal, now)


def _orders(spark, sf_dir, **schedule):
    observed = _observed(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = [rule(p, observed_tz="UTC", grace_minutes=60, **schedule) for p in names]
    return rows, observed


ORDERS_SQL = """WITH o AS (SELECT o_orderpriority AS source_id, max(o_orderdate) AS obs FROM orders GROUP BY 1),
rel AS (SELECT CAST(d AS TIMESTAMP) AS r FROM generate_series(TIMESTAMP '1995-01-01 16:00', TIMESTAMP '2003-12-31 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
"""


def _around_loads(spark, sf_dir):
    """Each source's verdict at the instant of its last load: the releases next to it."""
    rows, observed = _orders(spark, sf_dir, business_days="16:00")
    rules = releases.rules_frame(spark, rows).join(observed.select("source_id", F.col("observed").alias("now")), "source_id")
    cal, days = calendars(spark, date(1989, 1, 1), date(2008, 12, 31))
    return evaluate.evaluate(rules, observed, days, cal, None)


@query(ORDERS_SQL + "SELECT source_id, (SELECT max(r) FROM rel WHERE r <= obs) AS previous FROM o")
def previous_release(spark, sf_dir):
    return _around_loads(spark, sf_dir).select("source_id", F.col("release").alias("previous"))


@query(ORDERS_SQL + "SELECT source_id, (SELECT min(r) FROM rel WHERE r > obs) AS following FROM o")
def next_release(spark, sf_dir):
    return _around_loads(spark, sf_dir).select("source_id", F.col("next_expected_arrival").alias("following"))


@query(ORDERS_SQL + """SELECT source_id, (SELECT min(r) FROM rel WHERE r > obs AND r <= TIMESTAMP '2001-08-06 12:00') AS release FROM o""")
def first_unarrived(spark, sf_dir):
    rows, observed = _orders(spark, sf_dir, business_days="16:00")
    return _verdicts(spark, rows, observed, ORDERS_NOW).select("source_id", "release")


@query(ORDERS_SQL + """SELECT source_id, count(*) FILTER (r + INTERVAL 1 HOUR < TIMESTAMP '2001-08-06 12:00') AS missed_count,
  count(*) FILTER (r + INTERVAL 1 HOUR >= TIMESTAMP '2001-08-06 12:00') AS pending_count FROM o JOIN rel ON r > obs AND r <= TIMESTAMP '2001-08-06 12:00' GROUP BY 1""")
def missed_pending_counts(spark, sf_dir):
    rows, observed = _orders(spark, sf_dir, business_days="16:00")
    return _verdicts(spark, rows, observed, ORDERS_NOW).select("source_id", "missed_count", "pending_count")


@query("""WITH o AS (SELECT o_orderpriority AS source_id, max(o_orderdate) AS obs FROM orders GROUP BY 1)
SELECT source_id, CAST(least(10000, date_diff('minute', obs, TIMESTAMP '2001-09-01 12:00')) AS BIGINT) AS counted, date_diff('minute', obs, TIMESTAMP '2001-09-01 12:00') >= 10000 AS missed_truncated FROM o""")
def count_cap_truncated(spark, sf_dir):
    rows, observed = _orders(spark, sf_dir, cron="* * * * *")
    v = _verdicts(spark, rows, observed, datetime(2001, 9, 1, 12))
    return v.select("source_id", (F.col("missed_count") + F.col("pending_count")).alias("counted"), "missed_truncated")


@query("""SELECT DISTINCT o_orderpriority AS source_id, 'OVERDUE' AS status, TIMESTAMP '2024-01-31 18:30:00' - INTERVAL 1830 DAY - INTERVAL 18 HOUR - INTERVAL 30 MINUTE + INTERVAL 30 HOUR AS release,
  CAST(1830 AS BIGINT) AS missed_count, TRUE AS missed_truncated FROM orders""")
def stale_beyond_horizon(spark, sf_dir):
    rows, observed = _orders(spark, sf_dir, cron="0 6 * * *")
    return _verdicts(spark, rows, observed, NOW).select("source_id", "status", "release", "missed_count", "missed_truncated")


VERDICT_SQL = """WITH o AS ({observed}), rel AS ({releases}), m AS (SELECT TIMESTAMP '{now}' AS now),
j AS (SELECT o.source_id, o.obs, g, (SELECT max(r) FROM rel WHERE rel.source_id = o.source_id AND r <= now) AS last,
        (SELECT min(r) FROM rel WHERE rel.source_id = o.source_id AND r > now) AS next,
        (SELECT min(r) FROM rel WHERE rel.source_id = o.source_id AND r > obs AND r <= now) AS u,
        (SELECT count(*) FROM rel WHERE rel.source_id = o.source_id AND r > obs AND r <= now AND r + g < now) AS missed,
        (SELECT count(*) FROM rel WHERE rel.source_id = o.source_id AND r > obs AND r <= now AND r + g >= now) AS pending
      FROM o, m),
v AS (SELECT *, CASE WHEN obs IS NULL THEN 'NO_DATA' WHEN u IS NULL THEN 'ON_TIME' WHEN missed > 0 THEN 'OVERDUE' ELSE 'NOT_DUE' END AS status FROM j)
"""
VERDICT_COLUMNS = """SELECT source_id, status, CASE WHEN status IN ('OVERDUE', 'NOT_DUE') THEN u ELSE last END AS release,
  CASE WHEN status IN ('OVERDUE', 'NOT_DUE') THEN u ELSE last END + g AS deadline, CAST(missed AS BIGINT) AS missed_count, CAST(pending AS BIGINT) AS pending_count,
  next AS next_expected_arrival FROM v"""
COLUMNS = ("source_id", "status", "release", "deadline", "missed_count", "pending_count", "next_expected_arrival")
BUSINESS_SQL = VERDICT_SQL.format(
    now="2024-01-31 18:30:00", observed="SELECT event_type AS source_id, max(ts) AS obs, INTERVAL 2 HOUR AS g FROM events GROUP BY 1",
    releases="""SELECT source_id, CAST(d AS TIMESTAMP) AS r FROM (SELECT DISTINCT event_type AS source_id FROM events),
      generate_series(TIMESTAMP '2023-12-01 16:00', TIMESTAMP '2024-03-31 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6""")


def _by_event_type(spark, sf_dir):
    observed = _observed(table(spark, sf_dir, "events"), "event_type", "ts")
    rows = [rule(t, business_days="16:00", grace_minutes=120, observed_tz="UTC") for t in ("click", "error", "purchase", "signup", "view")]
    return _verdicts(spark, rows, observed, NOW)


@query(BUSINESS_SQL + VERDICT_COLUMNS)
def verdict_by_event_type(spark, sf_dir):
    return _by_event_type(spark, sf_dir).select(*COLUMNS)


MIXED_SQL = VERDICT_SQL.format(
    now="2024-01-31 06:30:00",
    observed="SELECT event_type AS source_id, max(ts) FILTER (event_type <> 'view') AS obs, CASE event_type WHEN 'error' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS g FROM events GROUP BY 1",
    releases="""SELECT 'click' AS source_id, CAST(d AS TIMESTAMP) AS r FROM generate_series(TIMESTAMP '2023-12-01 06:00', TIMESTAMP '2024-03-31 06:00', INTERVAL 1 DAY) t(d)
      UNION ALL SELECT 'view', CAST(d AS TIMESTAMP) FROM generate_series(TIMESTAMP '2023-12-01 06:00', TIMESTAMP '2024-03-31 06:00', INTERVAL 1 DAY) t(d)
      UNION ALL SELECT 'error', CAST(d AS TIMESTAMP) FROM generate_series(TIMESTAMP '2023-12-01 16:00', TIMESTAMP '2024-03-31 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6
      UNION ALL SELECT 'purchase', CAST(d AS TIMESTAMP) FROM generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-31', INTERVAL 15 MINUTE) t(d)
      UNION ALL SELECT 'signup', max(CAST(d AS TIMESTAMP)) FROM generate_series(TIMESTAMP '2023-12-01 05:00', TIMESTAMP '2024-03-31 05:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 GROUP BY date_trunc('month', d)""")


def mixed_verdicts(spark, sf_dir):
    relation = f"read_parquet('{sf_dir}/events.parquet')"
    common = {"observed_tz": "UTC", "relation": relation, "loaded_at_field": "ts"}
    rows = [rule("click", cron="0 6 * * *", grace_minutes=60, filter="event_type = 'click'", **common),
            rule("error", business_days="16:00", grace_minutes=120, filter="event_type = 'error'", **common),
            rule("purchase", cron="*/15 * * * *", grace_minutes=60, filter="event_type = 'purchase'", **common),
            rule("signup", monthly=(-1, "05:00"), grace_minutes=60, filter="event_type = 'signup'", **common),
            rule("view", cron="0 6 * * *", grace_minutes=60, filter="value < -1e9", **common)]
    observed = observe(spark, releases.rules_frame(spark, rows), sf_dir).select("source_id", "observed", "naive")
    return _verdicts(spark, rows, observed, MIXED_NOW)


@query(MIXED_SQL + VERDICT_COLUMNS)
def verdict_mixed_rules(spark, sf_dir):
    return mixed_verdicts(spark, sf_dir).select(*COLUMNS)


@query("""WITH rel AS (SELECT CAST(d AS TIMESTAMP) AS r FROM generate_series(TIMESTAMP '2023-12-01 06:00', TIMESTAMP '2024-04-30 06:00', INTERVAL 1 DAY) t(d)),
s AS (SELECT event_type || ' ' || kind AS source_id, floor FROM (SELECT event_type FROM events GROUP BY 1 HAVING max(ts) FILTER (value < -1e9) IS NULL),
  (VALUES ('empty', NULL), ('floored', TIMESTAMP '2024-01-20'), ('not yet', TIMESTAMP '2024-03-01')) t(kind, floor)),
j AS (SELECT source_id, floor, max(r) FILTER (r <= now AND r >= coalesce(floor, r)) AS last, min(r) FILTER (r <= now AND r >= floor) AS u, count(*) FILTER (r < now AND r >= floor) AS m
      FROM s, rel, (SELECT TIMESTAMP '2024-01-31 18:30' AS now) GROUP BY 1, 2)
SELECT source_id, CASE WHEN floor IS NULL THEN 'NO_DATA' WHEN u IS NULL THEN 'ON_TIME' ELSE 'OVERDUE' END AS status, coalesce(u, last) AS release, m AS missed_count FROM j""")
def verdict_no_data_and_active_from(spark, sf_dir):
    """Three rules per event type, whose filter keeps none of its rows."""
    floors = {"empty": None, "floored": date(2024, 1, 20), "not yet": date(2024, 3, 1)}
    rows = [rule(f"{t} {kind}", cron="0 6 * * *", active_from=floor, loaded_at_field="ts", filter=f"event_type = '{t}' AND value < -1e9")
            for t in ("click", "error", "purchase", "signup", "view") for kind, floor in floors.items()]
    observed = latest_by_relation(table(spark, sf_dir, "events"), [(r[0], "ts", r[13]) for r in rows]).select("source_id", "observed", "naive")
    return _verdicts(spark, rows, observed, NOW).select("source_id", "status", "release", "missed_count")


@query("""SELECT event_type AS source_id, max(ts) > TIMESTAMP '2024-01-30 12:00' + INTERVAL 5 MINUTE AS future FROM events GROUP BY 1""")
def future_skew_warning(spark, sf_dir):
    observed = _observed(table(spark, sf_dir, "events"), "event_type", "ts")
    rows = [rule(t, cron="0 6 * * *", observed_tz="UTC") for t in ("click", "error", "purchase", "signup", "view")]
    v = _verdicts(spark, rows, observed, datetime(2024, 1, 30, 12))
    return v.select("source_id", F.exists("warnings", lambda w: w["code"] == "W003").alias("future"))


@query(MIXED_SQL + """SELECT count(*) FILTER (status = 'ON_TIME') AS on_time, count(*) FILTER (status = 'NOT_DUE') AS not_due, count(*) FILTER (status = 'OVERDUE') AS overdue,
  count(*) FILTER (status = 'NO_DATA') AS no_data, CAST(0 AS BIGINT) AS config_error, CAST(0 AS BIGINT) AS query_error, count(*) AS total FROM v""")
def status_summary(spark, sf_dir):
    return evaluate.status_summary(mixed_verdicts(spark, sf_dir))


@query(MIXED_SQL + "SELECT CAST(CASE WHEN count(*) FILTER (status IN ('OVERDUE', 'NO_DATA')) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM v")
def exit_code(spark, sf_dir):
    return evaluate.exit_code(mixed_verdicts(spark, sf_dir))


@query(BUSINESS_SQL + """SELECT source_id, 'Overdue: release ' || strftime(u, '%a %Y-%m-%d %H:%M') || ' UTC missed its deadline ' || strftime(u + g, '%a %Y-%m-%d %H:%M') || ' UTC; '
  || missed || CASE WHEN missed = 1 THEN ' release' ELSE ' releases' END || ' missed; latest data observed ' || strftime(obs, '%a %Y-%m-%d %H:%M') || ' UTC.' AS explanation FROM v""")
def explanation_sentence(spark, sf_dir):
    return _by_event_type(spark, sf_dir).select("source_id", "explanation")


@query("""WITH s AS (SELECT s_suppkey AS k, (s_suppkey * 7919) % 400000 * 1000000 + s_suppkey % 3 AS us FROM supplier)
SELECT CAST(k AS BIGINT) AS k, CASE WHEN us = 0 THEN '0m' WHEN us < 60000000 THEN '<1m' ELSE trim(
  CASE WHEN us >= 86400000000 THEN (us // 86400000000) || 'd ' ELSE '' END || CASE WHEN us // 3600000000 % 24 > 0 THEN (us // 3600000000 % 24) || 'h ' ELSE '' END
  || CASE WHEN us // 60000000 % 60 > 0 THEN (us // 60000000 % 60) || 'm' ELSE '' END) END AS shown FROM s""")
def duration_text(spark, sf_dir):
    us = (F.col("s_suppkey") * 7919) % 400000 * 1000000 + F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), format_duration(us).alias("shown"))


# --- catalogs ---------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT n_name AS source_id, 'config' AS origin FROM nation WHERE n_regionkey < 3), m AS (SELECT n_name AS source_id, 'dbt' AS origin FROM nation)
SELECT source_id, origin, source_id IN (SELECT source_id FROM m) AND origin = 'config' AS w004 FROM (SELECT * FROM c UNION ALL SELECT * FROM m WHERE source_id NOT IN (SELECT source_id FROM c))""")
def config_manifest_merge(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    config = nation.where("n_regionkey < 3").select(F.col("n_name").alias("source_id"), F.lit("config").alias("origin"))
    manifest = nation.select(F.col("n_name").alias("source_id"), F.lit("dbt").alias("origin"))
    merged, both = catalog.merge_catalogs(config, manifest)
    return merged.join(both.withColumn("w004", F.lit(True)), "source_id", "left").select("source_id", "origin", F.coalesce("w004", F.lit(False)).alias("w004"))


@query("""SELECT c_name AS source_id, string_agg(place, ',' ORDER BY place) AS places
  FROM (SELECT CASE WHEN c_custkey % 1000 < 2 THEN 'shared ' || c_custkey // 1000 ELSE c_name END AS c_name, CAST(c_custkey AS VARCHAR) AS place FROM customer) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    key = F.col("c_custkey")
    named = F.when(key % 1000 < 2, F.concat(F.lit("shared "), F.floor(key / 1000).cast("string"))).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(named.alias("source_id"), key.cast("string").alias("location"))
    marked = catalog.mark_duplicates(rows).where("duplicate_at is not null")
    return marked.select("source_id", F.array_join("duplicate_at", ",").alias("places")).distinct()


@query("SELECT n_name AS source_id FROM nation WHERE n_name GLOB '*1*' OR n_name GLOB '?ATION_?'")
def select_by_pattern(spark, sf_dir):
    return catalog.select_entries(table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id")), ["*1*", "?ATION_?"])


# --- backtests --------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
e AS (SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
SELECT coalesce(e.date, p.date) AS date, CASE WHEN p.date IS NULL THEN 'expected-only' WHEN e.date IS NULL THEN 'published-only' ELSE 'matched' END AS outcome FROM e FULL JOIN p ON e.date = p.date""")
def calendar_history_compare(spark, sf_dir):
    published = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    _, days = calendars(spark, date(1995, 1, 1), date(2001, 8, 1))
    return backtest.history_compare(days.where("is_bd"), published)


PUBLICATIONS_SQL = """WITH pub AS (SELECT CAST(ts AS DATE) AS rate_date, date_trunc('hour', ts) + INTERVAL 1 HOUR AS last_modified, ts + INTERVAL 3 HOUR AS first_seen FROM events),
proxies AS (SELECT rate_date, min(last_modified) AS proxy, min(first_seen) AS first_seen FROM pub GROUP BY 1)
"""


def _publications(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("HOUR", "ts").cast("timestamp_ntz")
    return events.select(F.col("ts").cast("date").alias("rate_date"), F.timestamp_add("HOUR", F.lit(1), hour).alias("last_modified"),
                          F.timestamp_add("HOUR", F.lit(3), F.col("ts")).alias("first_seen"))


def _proxies(spark, sf_dir):
    pub = _publications(spark, sf_dir)
    return backtest.publication_proxy(pub).join(pub.groupBy("rate_date").agg(F.min("first_seen").alias("first_seen")), "rate_date")


@query(PUBLICATIONS_SQL + "SELECT rate_date, proxy FROM proxies")
def publication_proxy(spark, sf_dir):
    return backtest.publication_proxy(_publications(spark, sf_dir))


@query(PUBLICATIONS_SQL + """SELECT DISTINCT pub.rate_date, last_modified AS revised_at FROM pub JOIN proxies ON pub.rate_date = proxies.rate_date WHERE last_modified > proxy""")
def revisions(spark, sf_dir):
    return backtest.revisions(_publications(spark, sf_dir))


@query(PUBLICATIONS_SQL + "SELECT CAST(min(date_sub('minute', proxy, first_seen)) AS BIGINT) AS min_minutes, CAST(max(date_sub('minute', proxy, first_seen)) AS BIGINT) AS max_minutes FROM proxies")
def gap_minutes(spark, sf_dir):
    return backtest.gap_minutes(_proxies(spark, sf_dir))


@query(PUBLICATIONS_SQL + "SELECT strftime(timezone('Europe/Berlin', timezone('UTC', proxy)), '%H:%M') AS local_time, count(*) AS n FROM proxies GROUP BY 1")
def local_time_histogram(spark, sf_dir):
    return backtest.local_time_histogram(_proxies(spark, sf_dir), "Europe/Berlin")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'config' ELSE 'fresh' END AS origin FROM orders""")
def append_if_absent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = orders.where("o_totalprice > 150000").select("o_orderkey", F.lit("config").alias("origin"))
    fresh = orders.select("o_orderkey", F.lit("fresh").alias("origin"))
    return backtest.append_if_absent(known, fresh, ["o_orderkey"])


GRID_SQL = """WITH grid AS (SELECT CAST(d AS TIMESTAMP) AS "at" FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-29', INTERVAL 6 HOUR) t(d)),
loads AS (SELECT DISTINCT ts FROM events), l AS (SELECT "at", (SELECT max(ts) FROM loads WHERE ts <= "at") AS last_load FROM grid)
"""


def _grid_loads(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.sequence(ts(datetime(2024, 1, 5)), ts(datetime(2024, 1, 29)), F.expr("interval 6 hours"))).alias("at"))
    loads = table(spark, sf_dir, "events").select(F.col("ts").alias("loaded_at"))
    return backtest.loads_as_of(grid, loads)


@query(GRID_SQL + 'SELECT "at", last_load FROM l')
def loads_as_of_grid(spark, sf_dir):
    return _grid_loads(spark, sf_dir)


@query(GRID_SQL + """, rel AS (SELECT CAST(d AS TIMESTAMP) AS r FROM generate_series(TIMESTAMP '2023-12-25 16:00', TIMESTAMP '2024-02-01 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
j AS (SELECT "at", coalesce(date_diff('microsecond', last_load, "at") > 26 * 3600000000, FALSE) AS fixed,
        last_load IS NOT NULL AND EXISTS (SELECT 1 FROM rel WHERE r > last_load AND r + INTERVAL 2 HOUR < "at") AS calendar FROM l),
x AS (SELECT 'fixed 26 h' AS model, fixed AS said, calendar AS truth FROM j UNION ALL SELECT 'calendar', calendar, calendar FROM j)
SELECT model, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM x GROUP BY 1""")
def fixed_threshold_vs_calendar(spark, sf_dir):
    loads = _grid_loads(spark, sf_dir)
    rel = _between(spark, datetime(2023, 12, 25), datetime(2024, 2, 1, 23), rule("r", business_days="16:00")).select("instant")
    # the first release after each load: numbered releases, and how many there are up to the load, by one sweep in time order
    asked = loads.where("last_load is not null").select(F.col("last_load").alias("at"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("step")).distinct()
    events = rel.select(F.col("instant").alias("at"), F.lit(-1).alias("place"), F.lit(1).cast("long").alias("step")).unionByName(asked).withColumn("key", F.lit(0))
    swept = backtest.carried(events, "key", "step", "sum", ("at", "place"), block_minutes=1440)
    numbered = swept.where("place = -1").select(F.col("_run").alias("n"), F.col("at").alias("u"))
    first = swept.where("place = 0").select(F.col("at").alias("last_load"), (F.col("_run") + 1).alias("n")).join(numbered, "n")
    rows = loads.join(first, "last_load", "left")
    calendar_says = F.coalesce(F.timestamp_add("HOUR", F.lit(2), F.col("u")) < F.col("at"), F.lit(False))
    fixed_says = F.coalesce(backtest.fixed_threshold(F.col("last_load"), F.col("at"), 26), F.lit(False))
    rows = rows.select(fixed_says.alias("fixed"), calendar_says.alias("truth"))
    models = F.array(F.struct(F.lit("fixed 26 h").alias("model"), F.col("fixed").alias("said")), F.struct(F.lit("calendar").alias("model"), F.col("truth").alias("said")))
    return backtest.confusion(rows.select("truth", F.explode(models).alias("m")).select("m.model", "m.said", "truth"))


@query("""SELECT DISTINCT date_trunc('minute', ts) AS stamp, CASE WHEN date_trunc('hour', ts) + INTERVAL 5 MINUTE >= date_trunc('minute', ts) THEN date_trunc('hour', ts) + INTERVAL 5 MINUTE
  ELSE date_trunc('hour', ts) + INTERVAL 65 MINUTE END AS loaded FROM events""")
def hourly_loader(spark, sf_dir):
    stamps = table(spark, sf_dir, "events").select(F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").alias("stamp")).distinct()
    return stamps.select("stamp", backtest.hourly_load(F.col("stamp")).alias("loaded"))


@query("""SELECT event_type AS kind, CASE WHEN value > 90 THEN 'high' ELSE 'low' END AS explanation, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2""")
def disagreement_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.when(F.col("value") > 90, "high").otherwise("low").alias("explanation"))
    return backtest.disagreements(rows)


@query("""WITH grid AS (SELECT CAST(d AS TIMESTAMP) AS "at" FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-25', INTERVAL 3 HOUR) t(d)),
pub AS (SELECT CAST(ts AS DATE) + INTERVAL 20 HOUR AS deadline, max(ts) + INTERVAL 90 MINUTE AS proxy FROM events GROUP BY CAST(ts AS DATE))
SELECT "at", EXISTS (SELECT 1 FROM pub WHERE deadline < "at" AND proxy > "at") AS overdue FROM grid""")
def reference_overdue(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.sequence(ts(datetime(2024, 1, 2)), ts(datetime(2024, 1, 25)), F.expr("interval 3 hours"))).alias("at"))
    views = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    pub = views.groupBy("day").agg(F.timestamp_add("MINUTE", F.lit(90), F.max("ts")).alias("proxy")).withColumn(
        "deadline", F.timestamp_add("HOUR", F.lit(20), F.col("day").cast("timestamp_ntz")))
    return backtest.reference_overdue(grid, pub)


# --- traces -----------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CAST(d AS TIMESTAMP) AS instant FROM generate_series(TIMESTAMP '2024-01-01 16:00', TIMESTAMP '2024-02-29 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
o AS (SELECT max(ts) AS obs FROM events WHERE ts < TIMESTAMP '2024-01-29'),
n AS (SELECT *, instant > TIMESTAMP '2024-01-31 18:30' AS future, row_number() OVER (PARTITION BY instant > TIMESTAMP '2024-01-31 18:30' ORDER BY instant) AS early,
  row_number() OVER (PARTITION BY instant > TIMESTAMP '2024-01-31 18:30' ORDER BY instant DESC) AS late FROM r)
SELECT instant, CASE WHEN obs >= instant THEN 'arrived' WHEN future AND early = 1 THEN 'future (next expected arrival)' WHEN future THEN 'future'
  WHEN instant + INTERVAL 3 HOUR < TIMESTAMP '2024-01-31 18:30' THEN 'occurred, not arrived; deadline passed' ELSE 'occurred, not arrived; deadline not passed' END AS state
FROM n, o WHERE (future AND early <= 2) OR (NOT future AND late <= 3)""")
def release_states(spark, sf_dir):
    found = _between(spark, datetime(2024, 1, 1), datetime(2024, 2, 29, 23), rule("r", business_days="16:00", grace_minutes=180))
    last = table(spark, sf_dir, "events").where("ts < timestamp_ntz'2024-01-29'").agg(F.max("ts").alias("obs"))
    rows = trace.around_now(found, NOW).join(last, how="cross")  # one row
    return rows.select("instant", trace.release_state(NOW, F.col("obs")).alias("state"))


@query(with_rows_sql("WITH " + EASTER_SQL + """, d AS (SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2001-04-10', TIMESTAMP '2001-04-18', INTERVAL 1 DAY) t(x)),
open AS (SELECT date FROM d WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM target))
SELECT (SELECT min(o.date) FROM open o WHERE o.date > d.date) AS to_date, date, CASE WHEN isodow(date) > 5 THEN 'weekend'
  WHEN date + 2 IN (SELECT d FROM easter) THEN 'holiday: Good Friday (financial XECB)' ELSE 'holiday: Easter Monday (financial XECB)' END AS reason
FROM d WHERE date NOT IN (SELECT date FROM open)""", "date"))
def closed_days_between(spark, sf_dir):
    _, days = calendars(spark, date(2001, 3, 1), date(2001, 5, 31), refs=["financial XECB"])
    found = releases.releases_between(releases.rules_frame(spark, [rule("r", business_days="16:00")]), days, datetime(2001, 4, 10), datetime(2001, 4, 18))
    return with_rows(spark, sf_dir, trace.closed_days_between(found.withColumn("calendar_id", F.lit("default")), days).select("to_date", "date", "reason"), "date")


@query("""WITH m AS (SELECT date_trunc('month', d) AS month, count(*) AS n FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 GROUP BY 1),
h AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT CAST(m.month AS DATE) AS month, n, 'clamped: ' || strftime(m.month, '%B %Y') || ' has only ' || n || ' business days' AS note, coalesce(n_rows, 0) AS n_rows
FROM m LEFT JOIN h ON h.month = m.month""")
def clamp_notes(spark, sf_dir):
    """Every month of the calendar, with the number of orders it has (none: 0)."""
    _, days = calendars(spark, date(1995, 1, 1), date(2001, 12, 31))
    held = table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(F.count("*").alias("n_rows"))
    months = trace.business_days_per_month(days).join(held, "month", "left")
    return months.select("month", "n", trace.clamp_text(F.col("month"), F.col("n")).alias("note"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("""WITH o AS (SELECT o_orderpriority AS p, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1999-03-09') AS late, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1998-12-02') AS early FROM orders GROUP BY 1),
s AS (SELECT p || ' inside' AS source_id, late AS obs, 1 AS step, DATE '1999-01-01' AS floor, TRUE AS asks FROM o UNION ALL SELECT p || ' outside', early, 1, NULL, TRUE FROM o UNION ALL SELECT p || ' plain', early, 1, NULL, FALSE FROM o),
v AS (SELECT source_id, asks AND year(greatest(obs, coalesce(floor, obs))) < 1999 AS unknown, CASE WHEN source_id LIKE '% inside'
        THEN (SELECT count(*) FROM generate_series(TIMESTAMP '1998-01-05 06:00', TIMESTAMP '1999-03-15 06:00', INTERVAL 7 DAY) t(r) WHERE r > obs AND r >= floor AND r < TIMESTAMP '1999-03-15 12:00')
        ELSE (SELECT count(*) FROM generate_series(TIMESTAMP '1998-01-05 06:00', TIMESTAMP '1999-03-15 06:00', INTERVAL 1 DAY) t(r) WHERE r > obs AND r < TIMESTAMP '1999-03-15 12:00') END AS missed FROM s)
SELECT source_id, CASE WHEN unknown THEN 'CONFIG_ERROR' WHEN missed > 0 THEN 'OVERDUE' ELSE 'ON_TIME' END AS status, CASE WHEN unknown THEN 'E405' END AS code FROM v""")
def calendar_out_of_range(spark, sf_dir):
    """Three rules per priority; the holidays are known from 1999 on, and only some searches reach further back."""
    cal, days = calendars(spark, date(1992, 1, 1), date(2005, 1, 1), refs=["financial XECB"])
    before = lambda day: F.max(F.when(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz"), F.col("o_orderdate")))
    last = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(before("1999-03-09").alias("inside"), before("1998-12-02").alias("outside"))
    observed = last.withColumn("plain", F.col("outside")).unpivot("o_orderpriority", ["inside", "outside", "plain"], "kind", "observed").select(
        F.concat_ws(" ", "o_orderpriority", "kind").alias("source_id"), "observed", F.lit(True).alias("naive"))
    rows = []
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        rows += [rule(f"{p} inside", cron="0 6 * * MON", policy="following", observed_tz="UTC", active_from=date(1999, 1, 1)), rule(f"{p} outside", business_days="06:00", observed_tz="UTC"),
                 rule(f"{p} plain", cron="0 6 * * *", observed_tz="UTC")]
    v = evaluate.evaluate(releases.rules_frame(spark, rows), observed, days, cal, datetime(1999, 3, 15, 12))
    return v.select("source_id", "status", F.col("error.code").alias("code"))


@query("""WITH grid AS (SELECT CAST(d AS TIMESTAMP) AS now FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-29', INTERVAL 6 HOUR) t(d)),
loads AS (SELECT event_type AS source_id, ts FROM events),
o AS (SELECT source_id, now, (SELECT max(ts) FROM loads l WHERE l.source_id = s.source_id AND ts <= now) AS obs FROM (SELECT DISTINCT source_id FROM loads) s, grid),
rel AS (SELECT CAST(d AS TIMESTAMP) AS r FROM generate_series(TIMESTAMP '2023-12-01 16:00', TIMESTAMP '2024-03-01 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
SELECT source_id, now AS evaluated_at, CASE WHEN obs IS NULL THEN 'NO_DATA' WHEN NOT EXISTS (SELECT 1 FROM rel WHERE r > obs AND r <= now) THEN 'ON_TIME'
  WHEN EXISTS (SELECT 1 FROM rel WHERE r > obs AND r + INTERVAL 2 HOUR < now) THEN 'OVERDUE' ELSE 'NOT_DUE' END AS status FROM o""")
def replay_grid(spark, sf_dir):
    cal, days = calendars(spark, date(2018, 12, 1), date(2029, 6, 1))
    loads = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("ts").alias("loaded_at"))
    rows = releases.rules_frame(spark, [rule(t, business_days="16:00", grace_minutes=120, observed_tz="UTC") for t in ("click", "error", "purchase", "signup", "view")])
    v = sweep.replay(rows, loads, days, cal, datetime(2024, 1, 5), datetime(2024, 1, 29), 360)
    return v.select("source_id", "evaluated_at", "status")



# --- reading and reporting --------------------------------------------------------------------------------------


@query("""SELECT source_id, observed, code FROM (VALUES ('bad cast', NULL, 'E502'), ('bad field', NULL, 'E502'), ('fine', (SELECT max(ts) FROM events), NULL)) t(source_id, observed, code)""")
def bad_source_isolated(spark, sf_dir):
    common = {"cron": "0 6 * * *", "relation": f"read_parquet('{sf_dir}/events.parquet')"}
    rows = [rule("fine", loaded_at_field="ts", **common), rule("bad cast", loaded_at_field="CAST(concat('x', event_type) AS TIMESTAMP)", **common), rule("bad field", loaded_at_field="no_such", **common)]
    return observe(spark, releases.rules_frame(spark, rows), sf_dir).select("source_id", "observed", "code")


@query("""SELECT source_id, observed, code FROM (VALUES ('endless', NULL, 'E502'), ('fine', (SELECT max(ts) FROM events), NULL)) t(source_id, observed, code)""")
def infinite_load_time(spark, sf_dir):
    common = {"cron": "0 6 * * *", "relation": f"read_parquet('{sf_dir}/events.parquet')"}
    rows = [rule("fine", loaded_at_field="ts", **common), rule("endless", loaded_at_field="CASE WHEN event_id >= 0 THEN timestamp_ntz'9999-12-31 23:59:59.999999' ELSE ts END", **common)]
    return observe(spark, releases.rules_frame(spark, rows), sf_dir).select("source_id", "observed", "code")


SENTENCE_SQL = VERDICT_SQL.format(
    now="2024-01-31 06:30:00",
    observed="""SELECT event_type || z.tz AS source_id, z.tz, z.name, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN max(ts) ELSE max(ts) - INTERVAL 40 HOUR END AS obs,
      CASE event_type WHEN 'purchase' THEN INTERVAL 48 HOUR ELSE INTERVAL 2 HOUR END AS g FROM events, (VALUES ('Europe/Berlin', 'CET'), ('Asia/Tokyo', 'JST')) z(tz, name) GROUP BY event_type, z.tz, z.name""",
    releases="""SELECT event_type || tz AS source_id, timezone('UTC', timezone(tz, CAST(d AS TIMESTAMP))) AS r FROM (SELECT DISTINCT event_type FROM events), (VALUES ('Europe/Berlin'), ('Asia/Tokyo')) z(tz),
      generate_series(TIMESTAMP '2023-12-01 16:00', TIMESTAMP '2024-03-31 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6""").replace("SELECT o.source_id, o.obs, g,", "SELECT o.source_id, o.tz, o.name, o.obs, g,")
_AT = "strftime(timezone(tz, timezone('UTC', {})), '%a %Y-%m-%d %H:%M') || ' ' || name"


@query(SENTENCE_SQL + f"""SELECT source_id, CASE status WHEN 'NO_DATA' THEN 'No data: max(loaded_at) returned NULL; latest release ' || {_AT.format('last')} || '; next release ' || {_AT.format('next')} || '.'
  WHEN 'ON_TIME' THEN 'On time: latest release ' || {_AT.format('last')} || ' arrived (observed ' || {_AT.format('obs')} || '); next release ' || {_AT.format('next')} || '.'
  WHEN 'NOT_DUE' THEN 'Not due: release ' || {_AT.format('u')} || ' has not arrived yet' || CASE WHEN pending = 1 THEN '' ELSE ' (' || pending || ' releases pending)' END
    || '; grace window ends ' || {_AT.format('u + g')} || '; next release ' || {_AT.format('next')} || '.'
  ELSE 'Overdue: release ' || {_AT.format('u')} || ' missed its deadline ' || {_AT.format('u + g')} || '; ' || missed || CASE WHEN missed = 1 THEN ' release' ELSE ' releases' END
    || ' missed; latest data observed ' || {_AT.format('obs')} || '.' END AS explanation FROM v""")
def sentences_in_zones(spark, sf_dir):
    zones = ("Europe/Berlin", "Asia/Tokyo")
    last = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    obs = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", F.col("last")).otherwise(F.timestamp_add("HOUR", F.lit(-40), F.col("last")))
    observed = last.select("event_type", obs.alias("observed")).withColumn("tz", F.explode(F.array(*map(F.lit, zones)))).select(
        F.concat("event_type", "tz").alias("source_id"), "observed", F.lit(False).alias("naive"))
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = [rule(t + z, business_days="16:00", tz=z, grace_minutes=2880 if t == "purchase" else 120) for t in kinds for z in zones]
    return _verdicts(spark, rows, observed, MIXED_NOW).select("source_id", "explanation")


@query(with_rows_sql("""WITH bd AS (SELECT CAST(d AS DATE) AS b FROM generate_series(TIMESTAMP '2023-06-01', TIMESTAMP '2025-06-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
SELECT (SELECT max(b) FROM bd WHERE b <= CAST(d AS DATE)) + INTERVAL 9 HOUR AS instant, CASE WHEN isodow(d) > 5 THEN CAST(d AS DATE) END AS adjusted_from
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) t(d) WHERE day(d) = 15""", name="events", stamp="ts"))
def cron_preceding(spark, sf_dir):
    found = _between(spark, datetime(2024, 1, 1), datetime(2024, 12, 31, 23, 59), rule("c", cron="0 9 15 * *", policy="preceding"))
    return with_rows(spark, sf_dir, found.select("instant", "adjusted_from"), name="events", stamp="ts")


@query("""WITH c AS (SELECT 'expired' AS source_id, DATE '2024-01-30' AS v UNION ALL SELECT 'soon', DATE '2024-02-20' UNION ALL SELECT 'later', DATE '2024-12-31'),
d AS (SELECT DATE '2024-01-31' AS today, DATE '2024-01-31' + 34 AS horizon)
SELECT event_type || ' ' || source_id AS source_id, CASE WHEN today > v THEN 'E408' END AS error, today <= v AND horizon > v AS w005 FROM c, d, (SELECT DISTINCT event_type FROM events)""")
def calendar_validity(spark, sf_dir):
    """E408 past a calendar's last valid day, W005 where the notice window of 34 days reaches beyond it."""
    out, last = None, _observed(table(spark, sf_dir, "events"), "event_type", "ts")
    for source_id, valid in (("expired", date(2024, 1, 30)), ("soon", date(2024, 2, 20)), ("later", date(2024, 12, 31))):
        observed = last.withColumn("source_id", F.concat_ws(" ", "source_id", F.lit(source_id)))
        rows = [rule(f"{t} {source_id}", business_days="16:00", observed_tz="UTC") for t in ("click", "error", "purchase", "signup", "view")]
        v = _verdicts(spark, rows, observed, NOW, valid_until=valid)
        v = v.select("source_id", F.col("error.code").alias("error"), F.exists("warnings", lambda w: w["code"] == "W005").alias("w005"))
        out = v if out is None else out.unionByName(v)
    return out


@query("""WITH l AS (SELECT event_type AS source_id, ts FROM events), g AS (SELECT CAST(d AS TIMESTAMP) AS "at" FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-29', INTERVAL 6 HOUR) t(d))
SELECT s.source_id, g."at", (SELECT max(ts) FROM l WHERE l.source_id = s.source_id AND ts <= g."at") AS last_load FROM (SELECT DISTINCT source_id FROM l) s, g""")
def loads_as_of_by_source(spark, sf_dir):
    loads = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("ts").alias("loaded_at"))
    grid = loads.select("source_id").distinct().select("source_id", F.explode(F.sequence(ts(datetime(2024, 1, 5)), ts(datetime(2024, 1, 29)), F.expr("interval 6 hours"))).alias("at"))
    return backtest.loads_as_of(grid, loads)


def customer_rules(spark, sf_dir):
    """A rule per customer, all with one of four schedules."""
    kinds = releases.rules_frame(spark, [rule("0", business_days="16:00", grace_minutes=120, observed_tz="UTC"), rule("1", cron="0 6 * * *", grace_minutes=60, observed_tz="UTC"),
                                         rule("2", monthly=(-1, "09:00"), grace_minutes=1440, observed_tz="UTC"), rule("3", cron="0 * * * *", grace_minutes=180, observed_tz="UTC")])
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_custkey") % 4).cast("string").alias("source_id"))
    return customers.join(F.broadcast(kinds), "source_id").withColumn("source_id", F.col("name")).select(*kinds.columns)


CUSTOMERS_SQL = """WITH m AS (SELECT TIMESTAMP '1999-06-01 12:00' AS now), d AS (SELECT CAST(x AS TIMESTAMP) AS d FROM generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '1999-08-31', INTERVAL 1 DAY) t(x)),
rel AS (SELECT 0 AS k, d + INTERVAL 16 HOUR AS r, INTERVAL 2 HOUR AS g FROM d WHERE isodow(d) < 6 UNION ALL SELECT 1, d + INTERVAL 6 HOUR, INTERVAL 1 HOUR FROM d
  UNION ALL SELECT 2, max(d) + INTERVAL 9 HOUR, INTERVAL 24 HOUR FROM d WHERE isodow(d) < 6 GROUP BY date_trunc('month', d) UNION ALL SELECT 3, d + h * INTERVAL 1 HOUR, INTERVAL 3 HOUR FROM d, range(24) t(h)),
o AS (SELECT c_custkey, c_custkey % 4 AS k, max(o_orderdate) FILTER (o_orderdate <= now) AS obs FROM customer CROSS JOIN m LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
ends AS (SELECT k, max(r) FILTER (r <= now) AS last, min(r) FILTER (r > now) AS next, any_value(g) AS g FROM rel, m GROUP BY k),
open AS (SELECT c_custkey, min(r) AS u, count(*) AS n, count(*) FILTER (r + g < now) AS missed FROM o JOIN rel USING (k), m WHERE r > obs AND r <= now GROUP BY c_custkey),
v AS (SELECT c_custkey, obs, last, next, g, u, least(coalesce(n, 0), 10000) AS n, least(coalesce(missed, 0), 10000) AS missed, CASE WHEN obs IS NULL THEN 'NO_DATA' WHEN u IS NULL THEN 'ON_TIME' WHEN missed > 0 THEN 'OVERDUE' ELSE 'NOT_DUE' END AS status
      FROM o JOIN ends USING (k) LEFT JOIN open USING (c_custkey))
SELECT 'c' || c_custkey AS source_id, status, coalesce(u, last) AS release, coalesce(u, last) + g AS deadline, CAST(missed AS BIGINT) AS missed_count, CAST(n - missed AS BIGINT) AS pending_count, next AS next_expected_arrival FROM v"""


@query(CUSTOMERS_SQL)
def verdicts_of_customers(spark, sf_dir):
    """Every customer is a source whose loads are its orders; four schedules are made and shared by all."""
    cal, days = calendars(spark, date(1989, 1, 1), date(2005, 1, 1))
    loads = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderdate").alias("loaded_at"))
    return sweep.verdicts(customer_rules(spark, sf_dir), loads, days, cal, [datetime(1999, 6, 1, 12)]).select(*COLUMNS)


REPLAY_SQL = """WITH pub AS (SELECT CAST(ts AS DATE) AS rate_date, min(ts + INTERVAL 20 HOUR) AS proxy FROM events GROUP BY 1),
loads AS (SELECT CASE WHEN date_trunc('hour', proxy) + INTERVAL 5 MINUTE >= proxy THEN date_trunc('hour', proxy) + INTERVAL 5 MINUTE ELSE date_trunc('hour', proxy) + INTERVAL 65 MINUTE END AS l FROM pub),
rel AS (SELECT CAST(d AS TIMESTAMP) AS r FROM generate_series(TIMESTAMP '2023-11-01 16:00', TIMESTAMP '2024-03-01 16:00', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
grid AS (SELECT CAST(d AS TIMESTAMP) AS "at" FROM generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-29', INTERVAL 30 MINUTE) t(d)),
late AS (SELECT r + INTERVAL 2 HOUR AS deadline, proxy FROM rel JOIN pub ON rate_date = CAST(r AS DATE)),
j AS (SELECT "at", EXISTS (SELECT 1 FROM late WHERE deadline < "at" AND proxy > "at") AS truth, (SELECT max(l) FROM loads WHERE l <= "at") AS last_load FROM grid),
k AS (SELECT *, last_load IS NOT NULL AND EXISTS (SELECT 1 FROM rel WHERE r > last_load AND r + INTERVAL 2 HOUR < "at") AS rule_says,
        coalesce(date_diff('microsecond', last_load, "at") > 26 * 3600000000, FALSE) AS stale FROM j),
x AS (SELECT "at", 'calendar rule, hourly loader' AS model, rule_says AS said, truth, last_load FROM k UNION ALL SELECT "at", 'fixed threshold 26 h', stale, truth, last_load FROM k)
"""


def _replayed(spark, sf_dir):
    """Publications twenty hours after each event, the day's first counts; the loader runs at HH:05."""
    cal, days = calendars(spark, date(2018, 1, 1), date(2030, 1, 1))
    pub = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("rate_date"), F.timestamp_add("HOUR", F.lit(20), F.col("ts")).alias("last_modified"))
    rules = releases.rules_frame(spark, [rule("fx", business_days="16:00", grace_minutes=120)])
    return replays.replayed(rules, pub, days, cal, datetime(2024, 1, 3), datetime(2024, 1, 29), 30)


@query(REPLAY_SQL + """SELECT model, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM x GROUP BY 1""")
def replay_scores(spark, sf_dir):
    return backtest.confusion(_replayed(spark, sf_dir).select("model", "said", "truth"))


@query(REPLAY_SQL + """SELECT model AS kind, CASE WHEN said THEN 'false alarm: ' || model || ' says late, nothing published is missing; last load ' ELSE 'missed: ' || model || ' says fine, a publication is past its deadline; last load ' END
  || coalesce(strftime(last_load, '%Y-%m-%d %H:%M'), 'never') AS explanation, count(*) AS n, min("at") AS first_at, max("at") AS last_at FROM x WHERE said <> truth GROUP BY 1, 2""")
def replay_disagreements(spark, sf_dir):
    return replays.disagreement_groups(_replayed(spark, sf_dir))
