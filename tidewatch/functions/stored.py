"""Intermediate tables that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The table, computed once and read from the shared folder afterwards: the one named by spark.checkpoint.dir. Only a local session
    may do without and gets a temporary one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidewatch-")
        sc.setCheckpointDir(named)
    return df.checkpoint()
