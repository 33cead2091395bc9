"""Backtests: expected against published dates, publication proxies, replays of models on a time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import to_local


def history_compare(expected: DataFrame, published: DataFrame) -> DataFrame:
    """(date, outcome): matched, expected-only or published-only; both sides have a date column."""
    e = expected.select("date").distinct().withColumn("e", F.lit(True))
    p = published.select("date").distinct().withColumn("p", F.lit(True))
    outcome = F.when(F.col("e") & F.col("p"), "matched").when(F.col("e"), "expected-only").otherwise("published-only")
    return e.join(p, "date", "full_outer").select("date", outcome.alias("outcome"))


def publication_proxy(publications: DataFrame) -> DataFrame:
    """Earliest Last-Modified per date."""
    return publications.groupBy("rate_date").agg(F.min("last_modified").alias("proxy"))


def revisions(publications: DataFrame) -> DataFrame:
    """Distinct later Last-Modified times of dates that have more than one, in order."""
    times = F.array_sort(F.collect_set("last_modified"))
    return (publications.groupBy("rate_date").agg(times.alias("times")).where(F.size("times") > 1)
            .select("rate_date", F.explode(F.expr("slice(times, 2, size(times))")).alias("revised_at")))


def append_if_absent(known: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The known rows and those fresh ones whose key is new."""
    return known.unionByName(fresh.dropDuplicates(keys).join(known, keys, "left_anti"))


def local_time_histogram(proxies: DataFrame, tz: str) -> DataFrame:
    local = to_local(F.col("proxy"), F.lit(tz))
    return proxies.groupBy(F.substring(local.cast("string"), 12, 5).alias("local_time")).agg(F.count("*").alias("n"))


def gap_minutes(proxies: DataFrame) -> DataFrame:
    """Smallest and largest distance in minutes between first seen and Last-Modified."""
    gap = F.timestamp_diff("MINUTE", F.col("proxy"), F.col("first_seen"))
    return proxies.agg(F.min(gap).alias("min_minutes"), F.max(gap).alias("max_minutes"))


def fixed_threshold(last_load: Column, at: Column, hours: int) -> Column:
    """The plain staleness model: older than so many hours."""
    return F.timestamp_diff("MICROSECOND", last_load, at) > hours * 3_600_000_000


def hourly_load(stamp: Column, minute: int = 5) -> Column:
    """When a loader that runs at HH:05 picks up what appeared at ``stamp``."""
    hour = F.date_trunc("HOUR", stamp).cast("timestamp_ntz")
    slot = F.timestamp_add("MINUTE", F.lit(minute), hour)
    return F.when(slot >= stamp, slot).otherwise(F.timestamp_add("HOUR", F.lit(1), slot))


#: Rows of about so many minutes are carried forward together.
BLOCK_MINUTES = 60


def carried(events: DataFrame, key: str, value: str, how: str, order: tuple[str, ...] = ("at",), block_minutes: int = BLOCK_MINUTES) -> DataFrame:
    """Adds _run, the running max or sum of ``value`` per key in time order: within blocks of time, plus what the blocks before it add up to.

    A key's rows are dealt by blocks of time, and only one row a block is put in order over all of its time, so a
    key with very many rows is no task's alone."""
    block = (F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (block_minutes * 60_000_000))).alias("_block")
    events = events.withColumn("_block", block)
    fold = {"max": F.max, "sum": F.sum}[how]
    blocks = events.groupBy(key, "_block").agg(fold(value).alias("_all"))
    before = fold("_all").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    events = events.join(blocks.select(key, "_block", before.alias("_before")), [key, "_block"])
    own = fold(value).over(Window.partitionBy(key, "_block").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
                           if len(order) == 1 else Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = F.coalesce(own, F.col("_before")) if how == "max" else F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(own, F.lit(0))
    return events.withColumn("_run", run).drop("_block", "_before")


def loads_as_of(instants: DataFrame, loads: DataFrame, key: str = "source_id") -> DataFrame:
    """instants: at; loads: loaded_at; both with a key if there are several series. The latest load at or before each
    instant, null if none. Instants and loads are merged in time order, so neither side meets all rows of the other."""
    single = key not in loads.columns
    if single:
        instants, loads = instants.withColumn(key, F.lit("")), loads.withColumn(key, F.lit(""))
    # loads of one instant count once
    loads = loads.select(key, "loaded_at").distinct()
    events = instants.select(key, "at", F.lit(None).cast("timestamp_ntz").alias("loaded_at")).unionByName(loads.select(key, F.col("loaded_at").alias("at"), "loaded_at"))
    seen = carried(events, key, "loaded_at", "max").where("loaded_at is null").select(key, "at", F.col("_run").alias("last_load"))
    return seen.drop(key) if single else seen


def confusion(rows: DataFrame) -> DataFrame:
    """rows: model, said, truth. Counts of tp, fp, fn and tn per model."""
    said, truth = F.col("said"), F.col("truth")
    return rows.groupBy("model").agg(F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"),
                                     F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn"))


def disagreements(rows: DataFrame) -> DataFrame:
    """rows: at, kind, explanation. Groups with their count, first and last instant; the instants stay rows of the input."""
    return rows.groupBy("kind", "explanation").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def disagreement_text(said: Column, truth: Column, model: Column, last_load: Column) -> Column:
    """What a model said against the reference, in a sentence; null where they agree."""
    load = F.coalesce(F.substring(last_load.cast("string"), 1, 16), F.lit("never"))
    return (F.when(said & ~truth, F.concat(F.lit("false alarm: "), model, F.lit(" says late, nothing published is missing; last load "), load))
            .when(~said & truth, F.concat(F.lit("missed: "), model, F.lit(" says fine, a publication is past its deadline; last load "), load)))


def reference_overdue(instants: DataFrame, publications: DataFrame, key: str = "source_id") -> DataFrame:
    """instants: at; publications: deadline, proxy; both with a key if there are several series. Was any publication
    past its deadline and not out yet at each instant?

    Opens and closes of the intervals (deadline, proxy) are counted in time order, so instants and publications
    never meet pairwise. Equal opens and closes are added up first.
    """
    single = key not in publications.columns
    if single:
        instants, publications = instants.withColumn(key, F.lit("")), publications.withColumn(key, F.lit(""))
    late = publications.where("proxy > deadline")
    # an interval is open strictly after its deadline and strictly before its proxy
    marks = late.select(key, F.col("deadline").alias("at"), F.lit(1).alias("step"), F.lit(0).alias("place")).unionByName(
        late.select(key, F.col("proxy").alias("at"), F.lit(-1).alias("step"), F.lit(-2).alias("place")))
    marks = marks.groupBy(key, "at", "place").agg(F.sum("step").alias("step")).withColumn("asked", F.lit(False))
    events = marks.unionByName(instants.select(key, "at", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("step"), F.lit(True).alias("asked")).distinct())
    seen = carried(events, key, "step", "sum", ("at", "place")).where("asked").select(key, "at", (F.col("_run") > 0).alias("overdue"))
    return seen.drop(key) if single else seen


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    """(rate_date, last_modified, first_seen) of a file of collected publications; times are UTC."""
    rows = spark.read.csv(path, header=True)
    at = lambda c: F.to_timestamp_ntz(F.translate(F.regexp_replace(c, "Z$", ""), "T", " ")).alias(c.removesuffix("_utc"))
    return rows.select(F.col("rate_date").cast("date"), at("last_modified_utc"), at("first_seen_utc"))


def replay_report(title: str, scores: DataFrame, groups: DataFrame) -> str:
    """Markdown of a replay: counts by model and the groups of disagreements. Both are a few rows."""
    head = ("model", "tp", "fp", "fn", "tn")
    text = markdown_report(title, scores.orderBy("model").collect(), head)
    return text + "\n" + markdown_report("Disagreements", groups.orderBy("kind", "explanation").collect(), ("kind", "explanation", "n", "first_at", "last_at"))


def markdown_report(title: str, counts: list, header: tuple[str, ...]) -> str:
    """A small Markdown table of collected rows."""
    lines = [f"# {title}", "", "| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join(lines + ["| " + " | ".join(str(r[h]) for h in header) + " |" for r in counts]) + "\n"
