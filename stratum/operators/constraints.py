"""Constraints as queries for the rows that break them.

Each takes the rows to be judged; where a commit changed few rows, the engine passes only the keys that
changed as ``keys``, so that the rest of the table is filtered by a semi join before it is grouped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in zip(left, right, strict=True)])


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(f"`{c}`").isNull() for c in columns])


def duplicate_keys(rows: DataFrame, columns: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """Keys without nulls that occur more than once, with their count."""
    rows = rows.select(*[f"`{c}`" for c in columns]).filter(~any_null(columns))
    if keys is not None:
        rows = rows.join(keys.select(*[f"`{c}`" for c in columns]).distinct(), list(columns), "left_semi")
    return rows.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("n")).filter("n > 1")


def clashing_keys(stored: DataFrame, gone: DataFrame, after: DataFrame, fresh: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that ``fresh`` brings and another row has: a changed one (``after``), or a stored one that is not among those ``gone``.

    Stored keys are unique, so a new duplicate has a fresh key; unchanged rows are read as they are stored.
    """
    cells = [f"`{c}`" for c in columns]
    keys, on = fresh.select(*cells).distinct(), list(columns)
    met = stored.select(*cells).join(keys, on, "left_semi").join(gone.select(*cells), on, "left_anti")
    return duplicate_keys(after, columns, keys).unionAll(met.select(*cells, F.lit(2).cast("long").alias("n")))


def null_keys(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.filter(any_null(columns))


def check_failures(rows: DataFrame, expression: str) -> DataFrame:
    """Rows for which the check is false; a null passes."""
    return rows.filter(~F.expr(f"({expression})"))


def orphans(child: DataFrame, parent: DataFrame, columns: Sequence[str], referenced: Sequence[str]) -> DataFrame:
    """Rows of ``child`` whose reference, where it has no null, meets no row of ``parent``."""
    keys = parent.select(*[F.col(f"`{r}`").alias(f"__r{k}") for k, r in enumerate(referenced)])
    on = reduce(lambda x, y: x & y, [F.col(f"`{c}`") == F.col(f"__r{k}") for k, c in enumerate(columns)])
    return child.filter(~any_null(columns)).join(keys, on, "left_anti")


def cascade(child: DataFrame, doomed: DataFrame, columns: Sequence[str], referenced: Sequence[str]) -> DataFrame:
    """Rows of ``child`` that refer to rows of ``doomed``."""
    keys = doomed.select(*[F.col(f"`{r}`").alias(f"__r{k}") for k, r in enumerate(referenced)])
    on = reduce(lambda x, y: x & y, [F.col(f"`{c}`") == F.col(f"__r{k}") for k, c in enumerate(columns)])
    return child.join(keys, on, "left_semi")
