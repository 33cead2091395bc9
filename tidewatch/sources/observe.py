"""Load times: what a rule's relation, field and filter name is read by Spark, one scan per relation.

Relations: a table or view name, ``read_parquet('path')``, ``read_csv('path')`` or ``read_json('path')`` below the
allowed folder, a parenthesised subquery that may hold these, or a DataFrame given by name. Reads only; nothing is ever written,
and what may be read is decided in ``boundary``.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import unquote, urlsplit

from py4j.java_gateway import is_instance_of
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.frames import local_frame
from tidewatch.sources import boundary

OBSERVATIONS = "source_id string, observed timestamp_ntz, naive boolean, code string, message string"
_READ = re.compile(r"read_(parquet|csv|json)\('([^']+)'\)")
#: Read outside of quoted text only.
_READ_IN_QUERY = re.compile(r"('(?:[^'\\]|\\.)*'|`[^`]*`|\"[^\"]*\")|\bread_(parquet|csv|json)\s*\(\s*'([^']+)'\s*\)", re.IGNORECASE)
#: Spark type -> name of the value's type in messages; fixed values.
VALUE_NAMES = {"date": "date", "string": "str", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "binary": "bytes"}
RELATIONS_AT_ONCE = 8
#: Targets of one relation that one aggregate computes side by side; more are computed in turn.
WIDE = 400
#: From so many targets on, filters of the form column = literal are one aggregate by that column.
KEYED = 8

class QueryError(Exception):
    """A relation can't be read; carries the issue code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def first_line(error: Exception | str) -> str:
    return (str(error).strip().splitlines() or [""])[0][:300]


def scrub(text: str, *secrets: str) -> str:
    """Take connection secrets out of a message, percent-encoded forms included."""
    from urllib.parse import quote

    for secret in filter(None, secrets):
        for form in {secret, quote(secret, safe=""), quote(secret)}:
            text = text.replace(form, "<redacted>")
    return text


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types inferred; times without an offset stay wall times, whatever the session's zone. They are inferred in a session
    of their own, as they depend on an option that other threads of this one would see."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    return spark.read.csv(path, header=True, schema=apart.read.csv(path, header=True, inferSchema=True).schema)


def _read_file(spark: SparkSession, kind: str, path: str, folder: str) -> DataFrame:
    if ".." in path.split("/"):
        raise QueryError("E502", f"query failed: path '{path}' leaves the configuration's folder")
    path = path if "://" in path or path.startswith("/") else f"{folder}/{path}"
    if not boundary.inside(path, folder):
        raise QueryError("E502", f"query failed: path '{path}' is outside the configuration's folder")
    return read_csv(spark, path) if kind == "csv" else getattr(spark.read, kind)(path)


def resolve_relation(spark: SparkSession, relation: str, folder: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The table a relation names. QueryError (E502) if it reads anything but catalog tables, data of the session and files below the folder."""
    relation = relation.strip()
    if given and relation in given:
        return given[relation]
    try:
        if m := _READ.fullmatch(relation):
            df = _read_file(spark, *m.groups(), folder)
        elif relation.startswith("(") and relation.endswith(")"):
            def named(m: re.Match) -> str:
                if m[1]:
                    return m[1]
                view = "file_" + hashlib.md5(f"{m[2].lower()} {m[3]} {folder}".encode()).hexdigest()
                _read_file(spark, m[2].lower(), m[3], folder).createOrReplaceTempView(view)
                return view

            sql = f"SELECT * FROM {_READ_IN_QUERY.sub(named, relation)}"  # a subquery can only read
            boundary.check_query(spark, sql)
            df = spark.sql(sql)
        else:
            boundary.check_table(spark, relation)
            df = spark.table(relation)
        boundary.check_leaves(df, folder)
    except boundary.OutsideFolder as e:
        raise QueryError("E502", f"query failed: {e}") from None
    return df


_NAME = re.compile(r"""[A-Za-z_]\w*|"[^"]+\"""")
_QUOTED = re.compile(r"""'(?:[^']|'')*'|"[^"]*\"""")


def _one_relation(relation: str) -> str:
    """A name, or one subquery in parentheses, as the FROM item of a query; nothing may follow it."""
    relation = relation.strip()
    if all(_NAME.fullmatch(part) for part in relation.split(".")):
        return relation
    depth, bare = 0, _QUOTED.sub("''", relation)
    if bare.startswith("(") and bare.endswith(")") and ";" not in bare and "--" not in bare and "/*" not in bare:
        depths = [depth := depth + (c == "(") - (c == ")") for c in bare]
        if depths[-1] == 0 and 0 not in depths[:-1]:
            return f"{relation} observed_relation"
    raise QueryError("E502", f"query failed: '{relation[:80]}' is neither a name nor a subquery in parentheses")


def _one_expression(text: str) -> str:
    depth, bare = 0, _QUOTED.sub("''", text)
    depths = [depth := depth + (c == "(") - (c == ")") for c in bare]
    if min(depths, default=0) < 0 or depth or ";" in bare or "--" in bare or "/*" in bare or "'" in bare.replace("''", ""):
        raise QueryError("E502", f"query failed: '{text[:80]}' is no single expression")
    return text


def _sql_error(spark: SparkSession, error: Exception):
    """The database's own error, if there is one."""
    at = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while at is not None and not is_instance_of(spark._sc._gateway, at, "java.sql.SQLException"):
        at = at.getCause()
    return at


#: Classes of SQL states that say there is no connection: connection, authorization, catalog name, system error, and the driver's own of a database that
#: can't be found or started.
_NO_CONNECTION = ("08", "28", "3D", "57P", "XJ004", "XJ040", "XJ041", "XJ049")


class Warehouse:
    """Relations behind JDBC. Maxima are computed by the warehouse, in its own SQL: a query per relation, and a row back.

    After a connection has failed, the relations that follow fail alike and no further connection is tried."""

    def __init__(self, spark: SparkSession, kind: str, url: str, secrets: tuple[str, ...], timeout_seconds: int = 30, **options: str):
        if url.startswith("jdbc:postgresql:"):
            options.setdefault("sessionInitStatement", "SET default_transaction_read_only = on; SET TIME ZONE 'UTC'")
        self.spark, self.kind, self.secrets, self.broken = spark, kind, secrets, None
        self.options = {"url": url, "queryTimeout": str(timeout_seconds), "preferTimestampNTZ": "true"} | options

    def latest(self, relation: str, targets: list[tuple[str, str, str | None]]) -> DataFrame:
        """A row with a column m0, m1, ... for each target (source_id, field, filter)."""
        picks = []
        for i, (_, field, condition) in enumerate(targets):
            value = f"({_one_expression(field)})"
            picks.append(f"max({f'CASE WHEN ({_one_expression(condition)}) THEN {value} END' if condition else value}) AS m{i}")
        sql = f"SELECT {', '.join(picks)} FROM {_one_relation(relation)}"
        if self.broken is not None:
            raise self.broken
        try:
            return self.spark.read.format("jdbc").option("query", sql).options(**self.options).load()
        except Exception as e:
            raise self.failure(e) from None

    def failure(self, error: Exception) -> QueryError:
        if "No suitable driver" in str(error) or "ClassNotFound" in str(error):
            self.broken = QueryError("E505", f"reading {self.kind} needs its JDBC driver on Spark's class path")
            return self.broken
        own = _sql_error(self.spark, error)
        text = scrub(first_line(own.getMessage() if own is not None else error), *self.secrets)
        if own is None or (own.getSQLState() or "").startswith(_NO_CONNECTION):
            self.broken = QueryError("E501", f"cannot connect to the warehouse: {text}")
            return self.broken
        return QueryError("E502", f"query failed: {text}")

    def read(self, relation: str, targets: list[tuple]) -> list[tuple]:
        """Rows of OBSERVATIONS; where a query of several targets fails, halves of them are asked."""
        try:
            df = self.latest(relation, targets)
            kinds = df.dtypes
            found = df.first()
        except Exception as e:
            error = e if isinstance(e, QueryError) else self.failure(e)
            if len(targets) == 1 or error is self.broken:
                return _failed(targets, error)
            half = len(targets) // 2
            return self.read(relation, targets[:half]) + self.read(relation, targets[half:])
        out = []
        for target, (name, kind), field in zip(targets, kinds, df.schema):
            try:
                _checked(field.dataType, target[1])
                at = found[name]
                if at is not None and not kind.endswith("ntz"):
                    at = df.select(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz"))).first()[0]
                if at is not None and (at.year >= 9999 or at.year <= 1):
                    raise QueryError("E502", f"query failed: max({target[1]}) returned an infinite timestamp")
                out.append((target[0], at, kind.endswith("ntz"), None, None))
            except QueryError as e:
                out += _failed([target], e)
        return out


def connected(spark: SparkSession, connection: dict | None, folder: str) -> Warehouse | None:
    """The warehouse of a connection; None: relations are read by Spark itself. Raises QueryError (E501, E504)."""
    kind = (connection or {}).get("type")
    if kind == "duckdb" and connection["path"] != ":memory:":
        path = connection["path"] if connection["path"].startswith("/") else f"{folder}/{connection['path']}"
        if not Path(path).exists():
            raise QueryError("E501", f"cannot connect to the warehouse: no database file '{path}'")
        url, secrets, options = f"jdbc:duckdb:{path}", (), {"duckdb.read_only": "true"}
    elif kind in ("postgres", "jdbc"):
        name = connection.get("dsn_env") or "TIDEWATCH_DSN"
        if not (dsn := os.environ.get(name)):
            raise QueryError("E504", f"environment variable {name} is not set")
        at = urlsplit(dsn.removeprefix("jdbc:"))
        where = f"{at.hostname or ''}{f':{at.port}' if at.port else ''}{at.path}"
        url = dsn if dsn.startswith("jdbc:") else f"jdbc:postgresql://{where}"
        secrets = tuple(filter(None, (at.password, unquote(at.password or ""), dsn)))
        options = {k: unquote(v) for k, v in (("user", at.username), ("password", at.password)) if v and not dsn.startswith("jdbc:")}
    else:
        return None
    return Warehouse(spark, kind, url, secrets, connection.get("statement_timeout_seconds", 30), **options)


def _checked(kind: T.DataType, field: str) -> None:
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.NullType)):
        name = VALUE_NAMES.get(kind.simpleString(), "Decimal" if isinstance(kind, T.DecimalType) else kind.simpleString())
        raise QueryError("E503", f"max({field}) returned {name}; expected TIMESTAMP or TIMESTAMPTZ")


_EQUAL = re.compile(r"\s*(`[^`]+`|[A-Za-z_]\w*)\s*=\s*(?:'([^'\\]*)'|(-?\d{1,18}))\s*")


def key_of(condition: str | None, kinds: dict[str, T.DataType]) -> tuple[tuple[str, str | int], ...] | None:
    """(column, value) pairs in order if the filter is column = literal, or several of these joined by AND, with literals of the
    columns' own types (so that Spark casts neither side); else None. kinds: types by lower-case name."""
    if not condition or not (found := re.split(r"\bAND\b", condition, flags=re.IGNORECASE)):
        return None
    out: dict[str, str | int] = {}
    for part in found:
        m = _EQUAL.fullmatch(part)
        if not m or (name := m[1].strip("`").lower()) not in kinds or name in out:
            return None
        kind = kinds[name]
        if m[2] is not None and kind == T.StringType():
            out[name] = m[2]
        elif m[3] is not None and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[name] = int(m[3])
        else:
            return None
    return tuple(sorted(out.items()))


def _utc(value, kind: T.DataType):
    """A load time as TIMESTAMP_NTZ: wall times as they are, instants in UTC."""
    return value.cast("timestamp_ntz") if isinstance(kind, (T.TimestampNTZType, T.NullType)) else F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))


def _field_kind(df: DataFrame, field: str) -> T.DataType:
    kind = df.select(F.expr(field).alias("v")).schema["v"].dataType
    _checked(kind, field)
    return kind


def _wide(df: DataFrame, targets: list[tuple], kinds: dict[str, T.DataType]) -> DataFrame:
    """One aggregate with a maximum per target."""
    picks = []
    for i, (_, field, condition) in enumerate(targets):
        value = F.expr(field)
        picks.append(F.max(_utc(F.when(F.expr(f"({condition})"), value) if condition else value, kinds[field])).alias(f"m{i}"))
    # rows that no target's filter keeps needn't be read
    if all(c for _, _, c in targets):
        df = df.where(F.expr(" OR ".join(sorted({f"({c})" for _, _, c in targets}))))
    naive = lambda f: isinstance(kinds[f], T.TimestampNTZType)
    rows = F.array(*[F.struct(F.lit(s).alias("source_id"), F.col(f"m{i}").alias("at"), F.lit(naive(f)).alias("naive")) for i, (s, f, _) in enumerate(targets)])
    return df.agg(*picks).select(F.explode(rows).alias("r")).select("r.*")


def latest_for_keys(df: DataFrame, asked: DataFrame, columns: tuple[str, ...], fields: list[str]) -> DataFrame:
    """(source_id, at, naive) of sources that differ by key: one aggregate over the rows whose key is asked for.

    asked: source_id, f (number of its field, from 0) and its key in k0, k1, ..., of type string or bigint like ``columns``; it
    may be as large as a table. Sources without rows have a null."""
    kinds = [_field_kind(df, f) for f in fields]
    own = [f"k{i}" for i in range(len(columns))]
    rows = df.select(*[F.col(f"`{c}`").cast(asked.schema[k].dataType).alias(k) for c, k in zip(columns, own)], *[_utc(F.expr(f), kind).alias(f"m{i}") for i, (f, kind) in enumerate(zip(fields, kinds))])
    held = rows.join(asked.select(*own).distinct(), own, "left_semi").groupBy(*own).agg(F.array(*[F.max(f"m{i}") for i in range(len(fields))]).alias("at"))
    naive = F.get(F.array(*[F.lit(isinstance(kind, T.TimestampNTZType)) for kind in kinds]), F.col("f"))
    return asked.join(held, own, "left").select("source_id", F.get("at", F.col("f")).alias("at"), naive.alias("naive"))


def _by_key(df: DataFrame, columns: tuple[str, ...], targets: list[tuple], keys: dict[str, tuple], types: dict[str, T.DataType]) -> DataFrame:
    """The maxima of targets whose filters fix the columns to literals."""
    fields = sorted({f for _, f, _ in targets})
    asked = local_frame(df.sparkSession, [(s, fields.index(f), *(v for _, v in keys[c])) for s, f, c in targets],
                        "source_id string, f int, " + ", ".join(f"k{i} {'string' if types[c] == T.StringType() else 'bigint'}" for i, c in enumerate(columns)))
    return latest_for_keys(df, asked, columns, fields)


def latest_by_relation(df: DataFrame, targets: list[tuple[str, str, str | None]]) -> DataFrame:
    """(source_id, observed, naive, infinite) of several targets (source_id, field, filter) over one relation.

    Targets whose filters fix the same columns to literals are one aggregate by these, however many they are; the others
    are maxima side by side, some hundred a scan. A value at either end of what a timestamp can hold stands for infinity and is no
    load time."""
    kinds = {field: _field_kind(df, field) for field in {f for _, f, _ in targets}}
    types = {f.name.lower(): f.dataType for f in df.schema}
    keys = {c: key_of(c, types) for c in {c for _, _, c in targets}}
    by_columns, wide = defaultdict(list), []
    for t in targets:
        (by_columns[tuple(c for c, _ in keys[t[2]])] if keys[t[2]] else wide).append(t)
    for few in [c for c, ts in by_columns.items() if len(ts) < KEYED]:
        wide += by_columns.pop(few)
    parts = [_by_key(df, c, ts, keys, types) for c, ts in sorted(by_columns.items())]
    parts += [_wide(df, wide[i:i + WIDE], kinds) for i in range(0, len(wide), WIDE)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    infinite = F.expr("coalesce(at >= timestamp_ntz'9999-12-31 23:59:59.999999' OR at <= timestamp_ntz'0001-01-01 00:00:00', false)")
    return found.select("source_id", F.when(~infinite, F.col("at")).alias("observed"), "naive", infinite.alias("infinite"))


def observe(spark: SparkSession, rules: DataFrame, folder: str = "", given: dict[str, DataFrame] | None = None, connection: dict | None = None) -> DataFrame:
    """Load times of all rules: a scan per relation, a few of them at a time, a row per source back.

    What fails while a relation is named or analysed marks its sources (E502, E503). Where a scan fails as it
    runs, halves of its sources are read, so that only the broken ones are marked.
    """
    by_relation = defaultdict(list)
    for r in rules.select("source_id", "relation", "loaded_at_field", "filter").collect():
        by_relation[r["relation"]].append((r["source_id"], r["loaded_at_field"], r["filter"]))
    try:
        warehouse = connected(spark, connection, folder)
    except QueryError as e:
        return local_frame(spark, [r for targets in by_relation.values() for r in _failed(targets, e)], OBSERVATIONS)

    def read(relation: str, targets: list[tuple]) -> list[tuple]:
        if warehouse is not None and not (given and relation in given):
            return warehouse.read(relation, targets)
        try:
            df = resolve_relation(spark, relation, folder, given)
        except (QueryError, PySparkException) as e:
            return _failed(targets, e)
        return _read(df, targets)

    # a warehouse is asked one query at a time: after a failed connection no other is tried
    with ThreadPoolExecutor(1 if warehouse else RELATIONS_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(lambda x: read(*x)), sorted(by_relation.items())))
    return local_frame(spark, [r for rows in found for r in rows], OBSERVATIONS)


def _read(df: DataFrame, targets: list[tuple]) -> list[tuple]:
    """Rows of OBSERVATIONS. Each text is analysed once, however many targets have it."""
    types = {f.name.lower(): f.dataType for f in df.schema}
    faults: dict[tuple[str, bool], Exception | None] = {}

    def fault(text: str, condition: bool) -> Exception | None:
        if (text, condition) not in faults:
            try:
                boundary.check_expression(df, f"({text})" if condition else text, condition)
                if not condition:
                    _field_kind(df, text)
                faults[text, condition] = None
            except boundary.OutsideFolder as e:
                faults[text, condition] = QueryError("E502", f"query failed: {e}")
            except (QueryError, PySparkException) as e:
                faults[text, condition] = e
        return faults[text, condition]

    out, good = [], []
    for t in targets:
        error = fault(t[1], False) or (fault(t[2], True) if t[2] and key_of(t[2], types) is None else None)
        if error:
            out += _failed([t], error)
        else:
            good.append(t)
    return out + (_scanned(df, good) if good else [])


def _scanned(df: DataFrame, targets: list[tuple]) -> list[tuple]:
    try:
        rows = {r["source_id"]: r for r in latest_by_relation(df, targets).collect()}  # a row per target
    except Exception as e:  # a failure of the data, known only as it runs
        if len(targets) == 1:
            return _failed(targets, e)
        half = len(targets) // 2
        return _scanned(df, targets[:half]) + _scanned(df, targets[half:])
    out = []
    for source_id, field, _ in targets:
        r = rows[source_id]
        if r["infinite"]:
            out += _failed([(source_id, field, None)], QueryError("E502", f"query failed: max({field}) returned an infinite timestamp"))
        else:
            out.append((source_id, r["observed"], r["naive"], None, None))
    return out


def _failed(targets: list[tuple], error: Exception) -> list[tuple]:
    code = error.code if isinstance(error, QueryError) else "E502"
    message = str(error) if isinstance(error, QueryError) else f"query failed: {first_line(error)}"
    return [(s, None, None, code, message) for s, _, _ in targets]
