"""Ranks within large partitions, of which there may be few: work is spread over ranges, not over partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .effects import number_rows

#: Values whose ranks are broadcast.
FEW = 10_000


def ranks(rows: DataFrame, parts: Sequence[str], by: Sequence[str], rank: str, dense: str) -> DataFrame:
    """``rows`` with rank() and dense_rank() in the ascending order of ``by`` within ``parts``.

    Rows of one value share their ranks, so values are counted and ranked, and joined to the rows: a window holds one
    row a value.
    """
    values = [*parts, *by]
    order = Window.partitionBy(*parts).orderBy(*by)
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = rows.groupBy(*values).agg(F.count("*").alias("__n"))
    found = counted.select(*[F.col(v).alias(f"__{k}") for k, v in enumerate(values)], (before + 1).cast("int").alias(rank), F.row_number().over(order).alias(dense))
    return _joined(rows, found, values)


def _joined(rows: DataFrame, found: DataFrame, values: Sequence[str]) -> DataFrame:
    """``rows`` with what was found of their values; few values go to all tasks, many are joined by shuffle."""
    if found.limit(FEW + 1).count() <= FEW:
        found = F.broadcast(found)
    same = [F.col(v).eqNullSafe(F.col(f"__{k}")) for k, v in enumerate(values)]
    return rows.join(found, same, "left").drop(*[f"__{k}" for k in range(len(values))])


def row_numbers(rows: DataFrame, parts: Sequence[str], order: Sequence[Column], name: str, scratch: str) -> DataFrame:
    """``rows`` with row_number() in the order ``order`` within ``parts``, which has to leave no ties.

    All rows are numbered through, part after part, by ranges (``number_rows``, kept at ``scratch``); where a part begins follows from
    the counts of parts.
    """
    first = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*parts).agg(F.count("*").alias("__n"))
    begins = counted.select(*[F.col(p).alias(f"__{k}") for k, p in enumerate(parts)], F.coalesce(F.sum("__n").over(first), F.lit(0)).alias("__begin"))
    through = number_rows(rows, [*map(F.col, parts), *order], rows.count(), scratch, "__through")
    number = (F.col("__through") - F.col("__begin") + 1).cast("int")
    return _joined(through, begins, parts).withColumn(name, number).drop("__through", "__begin")
