"""Paged browsing and descriptions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, describe, schema_hash
from ..errors import EngineError
from ..functions.compat import contains_text, normalize_cell
from .history import last_updates, page_number, page_size
from .work import resolve


def unique_columns(entry: dict) -> set[str]:
    """Columns that alone are a primary key, UNIQUE, or under a whole unique index."""
    out = {c["name"] for c in entry["columns"] if c.get("unique")}
    out |= {i["columns"][0] for i in entry["indexes"] if i.get("unique") and len(i["columns"]) == 1 and not i.get("where")}
    return out | (set(entry["pk"]) if len(entry["pk"]) == 1 else set())


def is_visible(hidden: int | None) -> bool:
    """Ordinary and generated columns (2 virtual, 3 stored) are shown, others that carry a mark aren't."""
    return (hidden or 0) in (0, 2, 3)


def columns_of(entry: dict) -> list[dict]:
    """What is shown: stored columns but hidden ones, then generated columns."""
    unique = unique_columns(entry)
    stored = [
        {"name": c["name"], "type": c["type"], "notNull": bool(c.get("notNull")), "primaryKey": c["name"] in entry["pk"], "unique": c["name"] in unique, "defaultValue": c.get("default")}
        for c in entry["columns"] if is_visible(c.get("hidden"))
    ]
    return stored + [{"name": g, "type": "", "notNull": False, "primaryKey": False, "unique": False, "defaultValue": None} for g in entry.get("generated", {})]


def matching(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    for name, value in filters.items():
        rows = rows.filter(contains_text(F.col(f"`{name}`"), value))
    return rows


def ordered(rows: DataFrame, pk: list[str], sort_by: str | None = None, descending: bool = False) -> DataFrame:
    """By the asked column, nulls first going up, then by key, so that pages never overlap."""
    keys = pk or rows.columns
    order = [F.col(f"`{sort_by}`").desc_nulls_last() if descending else F.col(f"`{sort_by}`").asc_nulls_first()] if sort_by else []
    return rows.orderBy(*order, *[F.col(f"`{k}`").asc_nulls_first() for k in keys if k != sort_by])


def query_table(engine: Engine, table: str, page: int | None = None, limit: int | None = None, sort_by: str | None = None, sort_dir: str = "asc", filters: dict[str, str] | None = None) -> dict:
    manifest = engine.manifest()
    name = resolve(manifest["tables"], table)
    entry = manifest["tables"][name]
    columns = columns_of(entry)
    names = {c["name"] for c in columns}
    wanted = {k: v.strip() for k, v in (filters or {}).items()}
    if unknown := sorted(set(wanted) - names):
        raise EngineError("INVALID_OPERATION", f"can't filter by {unknown[0]}: no such column")
    wanted = {k: v for k, v in wanted.items() if v}
    sort_by = (sort_by or "").strip() or None
    if sort_by and sort_by not in names:
        raise EngineError("INVALID_OPERATION", f"can't sort by {sort_by}: no such column")
    size = page_size(limit)
    pk = [c["name"] for c in entry["columns"] if c["name"] in entry["pk"]]
    rows = matching(engine.table(name, manifest), wanted)
    total = rows.count() if wanted else entry["lanes"][-1]
    pages = max(1, -(-total // size))
    at = min(page_number(page), pages)
    kinds = {f.name: f.dataType for f in rows.schema}
    shown = ordered(rows, pk, sort_by, sort_dir == "desc").offset((at - 1) * size).limit(size).select(*[normalize_cell(F.col(f"`{c['name']}`"), kinds[c["name"]]).alias(c["name"]) for c in columns])
    return {
        "table": name, "page": at, "pageSize": size, "totalRows": total, "totalPages": pages, "sortBy": sort_by, "sortDir": "desc" if sort_dir == "desc" else "asc",
        "filters": wanted, "columns": columns, "rows": [r.asDict() for r in shown.collect()],
    }


def describe_db(engine: Engine, table: str | None = None) -> dict:
    manifest = engine.manifest()
    names = [resolve(manifest["tables"], table)] if table else sorted(manifest["tables"])
    return {
        "schemaHash": schema_hash(manifest),
        "tables": [{"table": n, "rowCount": manifest["tables"][n]["lanes"][-1], **describe(manifest["tables"][n]), "columns": columns_of(manifest["tables"][n])} for n in names],
        "views": [] if table else [{"name": n, "sql": v["sql"]} for n, v in sorted(manifest["views"].items())],
    }


def table_overview(engine: Engine) -> list[dict]:
    manifest = engine.manifest()
    last = {r["table"]: r["lastUpdatedAt"] for r in last_updates(engine.commits_df()).filter(F.col("table").isin(sorted(manifest["tables"]))).collect()}  # one row a table
    return [{"name": n, "rowCount": e["lanes"][-1], "columnCount": len(columns_of(e)), "lastUpdatedAt": last.get(n)} for n, e in sorted(manifest["tables"].items())]
