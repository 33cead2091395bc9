"""Load times from a stream: the latest per source as running state, evaluated batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_from_stream(events: DataFrame, source: str, stamp: str) -> DataFrame:
    """(source_id, observed, naive): running maximum per source; the state is one row per source."""
    last = events.groupBy(F.col(source).alias("source_id")).agg(F.max(stamp).alias("observed"))
    return last.withColumn("naive", F.lit(True))


def on_each_batch(latest: DataFrame, evaluate: Callable[[DataFrame], None], checkpoint: str, query_name: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Hand the complete table of latest load times to ``evaluate`` after every batch."""
    writer = latest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: evaluate(df))
    if query_name:
        writer = writer.queryName(query_name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
