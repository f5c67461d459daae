"""Guarded read-only SQL over tables, views and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .errors import EngineError
from .plans.sqltext import check_read_sql

#: Classes of parsed plans that are no query, by the end of their name.
_NO_QUERY = ("Command", "Statement", "CompoundBody", "DeleteFromTable", "UpdateTable", "MergeIntoTable", "CreateTable", "CreateTableAsSelect", "InsertIntoDir", "SetCatalogAndNamespace")


def _refuse_writes(plan) -> None:
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName().endswith(_NO_QUERY):
            raise EngineError("INVALID_SQL", f"not a query: {node.getClass().getSimpleName()}")
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]


def guarded(session: SparkSession, sql: str) -> DataFrame:
    """The result of one SELECT or WITH statement over what ``session`` can see, lazily."""
    text = check_read_sql(sql)
    try:
        _refuse_writes(session._jsparkSession.sessionState().sqlParser().parsePlan(text))
        return session.sql(text)
    except EngineError:
        raise
    except Exception as e:
        raise EngineError("INVALID_SQL", str(e).strip().splitlines()[0]) from e


def read(engine: Engine, sql: str) -> DataFrame:
    """``guarded`` over the tables, views and log of ``engine``, in a session of its own; collect it within bounds."""
    check_read_sql(sql)
    own = Engine(engine.spark.newSession(), engine.storage.root)
    manifest = own.manifest()
    for name in manifest["tables"]:
        own.table(name, manifest).createOrReplaceTempView(f"`{name}`")
    own.commits_df().createOrReplaceTempView("_stratum_commit")
    own.effects().createOrReplaceTempView("_stratum_row_effect")
    for name, view in manifest["views"].items():
        try:
            own.spark.sql(view["sql"]).createOrReplaceTempView(f"`{name}`")
        except Exception as e:
            raise EngineError("INVALID_SQL", f"view {name}: {str(e).strip().splitlines()[0]}") from e
    return guarded(own.spark, sql)
