"""Replay of a rule against what was published: one job from collected publications to scores, disagreements and their report.

At every instant of a grid the reference says whether a publication is past its deadline and not out yet; models say the same from the
loads they would have seen. Expected releases count only for dates that were collected, so that a gap in the collection is no late
publication.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.frames import local_frame
from tidewatch.functions.timeutil import ts
from tidewatch.operators import backtest, releases, sweep
from tidewatch.plans import api

#: Loaders: as soon as it appears, or by a job at HH:05.
LOADERS = {"immediate": lambda proxy: proxy, "hourly": backtest.hourly_load}


def expected_publications(rules: DataFrame, publications: DataFrame, days: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """(source_id, rate_date, deadline, proxy): the releases of one rule from start to end whose local date was collected, with the first time that
    date was out."""
    found = releases.releases_between(rules, days, start, end).select("source_id", F.col("local").cast("date").alias("rate_date"),
                                                                     F.expr("timestampadd(MICROSECOND, grace_us, instant)").alias("deadline"))
    return found.join(backtest.publication_proxy(publications), "rate_date").select("source_id", "rate_date", "deadline", "proxy")


def replayed(rules: DataFrame, publications: DataFrame, days: DataFrame, calendars: DataFrame, start: datetime, end: datetime, step_minutes: int, *,
             loader: str = "hourly", threshold_hours: int = 26) -> DataFrame:
    """(at, model, said, truth, last_load): what two models say at every instant of the grid, the rule and a plain threshold, and what is so.

    rules: a table of one rule; publications: rate_date, last_modified."""
    grid = [start + timedelta(minutes=step_minutes * i) for i in range(int((end - start).total_seconds() // 60 // step_minutes) + 1)]
    proxies = backtest.publication_proxy(publications)
    loads = proxies.select(LOADERS[loader](F.col("proxy")).alias("loaded_at"))
    instants = local_frame(rules.sparkSession, [(t,) for t in grid], "at timestamp_ntz")
    truth = backtest.reference_overdue(instants, expected_publications(rules, publications, days, start - timedelta(days=releases.ROLL_DAYS), end).select("deadline", "proxy"))
    seen = backtest.loads_as_of(instants, loads)
    named = loads.crossJoin(F.broadcast(rules.select("source_id"))).withColumn("naive", F.lit(False))  # one rule
    verdict = sweep.verdicts(rules, named, days, calendars, grid).select(F.col("evaluated_at").alias("at"), (F.col("status") == "OVERDUE").alias("rule_says"))
    rows = truth.join(seen, "at").join(verdict, "at")
    stale = F.coalesce(backtest.fixed_threshold(F.col("last_load"), F.col("at"), threshold_hours), F.lit(False))
    models = F.array(F.struct(F.lit(f"calendar rule, {loader} loader").alias("model"), F.col("rule_says").alias("said")),
                     F.struct(F.lit(f"fixed threshold {threshold_hours} h").alias("model"), stale.alias("said")))
    return rows.select("at", F.explode(models).alias("m"), F.col("overdue").alias("truth"), "last_load").select("at", "m.model", "m.said", "truth", "last_load")


def disagreement_groups(rows: DataFrame) -> DataFrame:
    """Instants at which a model and the reference differ, by model and explanation, with their count and bounds."""
    told = rows.withColumn("explanation", backtest.disagreement_text(F.col("said"), F.col("truth"), F.col("model"), F.col("last_load")))
    return backtest.disagreements(told.where("explanation is not null").select("at", F.col("model").alias("kind"), "explanation"))


def replay_files(spark: SparkSession, config: str, source_id: str, publications: str, start: datetime, end: datetime, step_minutes: int = 15, *, report: str | None = None,
                 threshold_hours: int = 26) -> str:
    """The whole job for a source of a configuration and a file of collected publications: its report, also written if a path is given."""
    _, entry = api.find_entry(config, source_id)
    if entry.row is None or entry.errors:
        raise api.ConfigError(entry.errors)
    rules = releases.rules_frame(spark, [entry.row])
    loaded = api.load_config(config)
    calendars, days = api.calendar_tables(spark, loaded.calendars, (start - api.HORIZON).date(), (end + api.HORIZON).date())
    collected = backtest.read_publications(spark, publications)
    text = ""
    for loader in LOADERS:
        rows = replayed(rules, collected, days, calendars, start, end, step_minutes, loader=loader, threshold_hours=threshold_hours)
        title = f"Replay of {source_id}, {loader} loader, {start:%Y-%m-%d} to {end:%Y-%m-%d}"
        text += backtest.replay_report(title, backtest.confusion(rows.select("model", "said", "truth")), disagreement_groups(rows)) + "\n"
    if report:
        Path(report).write_text(text, encoding="utf-8")
    return text
