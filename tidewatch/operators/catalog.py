"""Set operations on rules: merging catalogs, duplicate ids, selection."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_duplicates(rules: DataFrame) -> DataFrame:
    """Adds duplicate_at: all locations of an id that occurs more than once (E206), else null. Locations of an id are
    gathered once and joined back; they are places in documents, so an id has few."""
    twice = rules.groupBy("source_id").agg(F.count("*").alias("_n"), F.min("location").alias("_one")).where("_n > 1").select("source_id")
    places = rules.join(twice, "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_list("location")).alias("duplicate_at"))
    return rules.join(places, "source_id", "left")


def merge_catalogs(config: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sources, the configuration winning whole entries, and the ids that both define (W004)."""
    both = manifest.join(config, "source_id", "left_semi").select("source_id").distinct()
    return config.unionByName(manifest.join(config, "source_id", "left_anti"), allowMissingColumns=True), both


def select_entries(rules: DataFrame, patterns: list[str]) -> DataFrame:
    """Sources whose id matches any of the case-sensitive shell patterns; all without patterns."""
    if not patterns:
        return rules
    keep = F.lit(False)
    for p in patterns:
        keep = keep | F.col("source_id").rlike("^" + fnmatch.translate(p).removesuffix("\\Z").removesuffix("\\z") + "$")
    return rules.where(keep)
