"""What the texts of a rule may read, decided on Spark's own plans and not on the texts.

A relation may read catalog tables, data that the host keeps in the session, and files below the rules' folder. Names are
looked at before anything is opened (a path named like a table would be read to find its columns); then every leaf of the analysed plan,
those of views, common table expressions and subqueries among them, is asked for its files. Field and filter may read nothing but
the relation's own rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions that call any Java method.
REFLECTION = frozenset({"java_method", "reflect", "try_reflect"})
#: Leaves that hold no files: data in the plan itself, of the session, or of a common table expression.
IN_MEMORY = frozenset({"CTERelationRef", "LocalRelation", "LogicalRDD", "OneRowRelation", "Range", "UnionLoopRef"})


class OutsideFolder(Exception):
    """A text of a rule reads what it may not."""


def inside(path: str, folder: str) -> bool:
    """Is the path the folder or below it, part by part? A local path may be written with or without its scheme."""
    def parts(p: str) -> tuple[str, ...]:
        scheme, sep, rest = p.partition(":")
        if sep and scheme == "file":
            scheme, p = "", "/" + rest.lstrip("/")
        elif sep and rest.startswith("//"):
            p = rest[2:]
        else:
            scheme = ""
        return (scheme, *PurePosixPath(p).parts)

    own, top = parts(path), parts(folder)
    return own[:len(top)] == top and ".." not in own


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _walk(spark: SparkSession, plan) -> Iterator:
    """All nodes of a plan as it was parsed, those of common table expressions and subqueries too."""
    todo = [plan]
    is_plan = lambda x: is_instance_of(spark._sc._gateway, x, "org.apache.spark.sql.catalyst.plans.QueryPlan")
    while todo:
        node = todo.pop()
        yield node
        for more in (node.children(), node.innerChildren(), node.subqueries()):
            todo += filter(is_plan, _each(more))


def _functions(expressions: Iterable) -> Iterator[str]:
    todo = list(expressions)
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            yield list(_each(e.nameParts()))[-1].lower()
        todo += _each(e.children())


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def _refuse_reflection(expressions: Iterable) -> None:
    for name in _functions(expressions):
        if name in REFLECTION:
            raise OutsideFolder(f"function {name} may not be used")


def _check_name(spark: SparkSession, parts: list[str]) -> None:
    """A name of two parts is a table of a database; any other first part would make Spark take the second for a path."""
    if len(parts) == 2 and not spark.catalog.databaseExists(parts[0]):
        raise OutsideFolder(f"'{'.'.join(parts)}' names no table of a known database; files are read with read_parquet, read_csv or read_json")


def check_query(spark: SparkSession, sql: str) -> None:
    """Refuse a query for its names and functions, before Spark looks anything up."""
    for node in _walk(spark, _parser(spark).parsePlan(sql)):
        if node.getClass().getSimpleName() == "UnresolvedRelation":
            _check_name(spark, list(_each(node.multipartIdentifier())))
        _refuse_reflection(_each(node.expressions()))


def check_table(spark: SparkSession, name: str) -> None:
    _check_name(spark, list(_each(_parser(spark).parseMultipartIdentifier(name))))


def _leaves(plan) -> list:
    found = list(_each(plan.collectLeaves()))
    for sub in _each(plan.subqueriesAll()):
        found += _each(sub.collectLeaves())
    return found


def _analysed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def check_leaves(df: DataFrame, folder: str) -> None:
    """Refuse a table that reads files outside of the folder, wherever in its plan."""
    for leaf in _leaves(_analysed(df)):
        kind = leaf.getClass().getSimpleName()
        if kind in IN_MEMORY or kind == "HiveTableRelation":
            continue
        if kind == "LogicalRelation":
            if leaf.catalogTable().isDefined():
                continue
            if leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                for path in _each(leaf.relation().location().rootPaths()):
                    if not inside(path.toString(), folder):
                        raise OutsideFolder(f"path '{path.toString()}' is outside the configuration's folder")
                continue
        if kind == "DataSourceV2Relation" and leaf.catalog().isDefined() and leaf.identifier().isDefined():
            continue
        raise OutsideFolder(f"a relation may not read {kind}")


def check_expression(df: DataFrame, text: str, condition: bool = False) -> None:
    """Refuse a field or filter that reads anything but the rows of ``df``."""
    _refuse_reflection([_parser(df.sparkSession).parseExpression(text)])
    before, after = _analysed(df), _analysed(df.where(F.expr(text)) if condition else df.select(F.expr(text)))
    if after.subqueriesAll().size() > before.subqueriesAll().size() or after.collectLeaves().size() > before.collectLeaves().size():
        raise OutsideFolder("a field or filter may not read another relation")
