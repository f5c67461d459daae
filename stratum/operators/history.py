"""History, sizes and overviews, from commit headers and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import lower_ascii
from ..plans.sqltext import fold

PAGE_SIZE, PAGE_SIZE_MAX = 50, 500


def page_size(value: int | None) -> int:
    return PAGE_SIZE if value is None or value < 1 else min(int(value), PAGE_SIZE_MAX)


def page_number(value: int | None) -> int:
    return 1 if value is None or value < 1 else int(value)


def summaries(headers: DataFrame, kind: str | None = None, table: str | None = None) -> DataFrame:
    """Commit summaries, last first; ``table`` is matched by ASCII case folding, dropped tables included."""
    rows = headers
    if kind in ("apply", "revert"):
        rows = rows.filter(F.col("kind") == kind)
    if table and table.strip():
        want = fold(table.strip())
        rows = rows.filter(F.exists("tables", lambda t: lower_ascii(t) == want))
    names = F.array_sort("tables", lambda a, b: F.when(lower_ascii(a) < lower_ascii(b), -1).when(lower_ascii(a) > lower_ascii(b), 1).otherwise(0))
    return rows.select("commitId", "seq", "kind", "message", "createdAt", "parentIds", "revertTargetId", "operationCount", "rowEffectCount", "schemaEffectCount", names.alias("affectedTables"), "bytes").orderBy(F.desc("seq"))


def history(headers: DataFrame, limit: int | None = None, page: int | None = None, kind: str | None = None, table: str | None = None) -> list[dict]:
    size = page_size(limit)
    rows = summaries(headers, kind, table).offset((page_number(page) - 1) * size).limit(size)
    return [r.asDict(recursive=True) for r in rows.collect()]


def commit_size(headers: DataFrame, commit_id: str) -> int | None:
    found = headers.filter(F.col("commitId") == commit_id).select("bytes").first()
    return found and found[0]


def history_size(headers: DataFrame) -> int:
    return headers.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def last_updates(headers: DataFrame) -> DataFrame:
    """Each table's last commit: seq and time."""
    return headers.select("seq", "createdAt", F.explode("tables").alias("table")).groupBy("table").agg(F.max("seq").alias("seq"), F.max_by("createdAt", "seq").alias("lastUpdatedAt"))
