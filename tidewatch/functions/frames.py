"""Small tables made on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _plain(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _plain(v, f.dataType) for f, v in zip(kind, value)}
    return value


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table whose size the planner knows, so that small ones are joined by broadcast
    (a table made from Python rows is an RDD of unknown size, and every join with it shuffles)."""
    kinds = T.StructType.fromDDL(schema)
    rows = list(rows)
    columns = [pa.array([_plain(r[i], f.dataType) for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.names), kinds)
