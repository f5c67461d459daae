"""JSON edits and table-valued JSON as Spark expressions: objects are maps of variants, so other members keep their types.

Paths are ``$.a.b`` of object members.  A text that is no JSON object comes back as it is; members keep their
places and new ones come last; null stays null.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"


def keys_of(path: str) -> list[str]:
    head, *keys = path.split(".")
    if head != "$" or not keys or not all(keys) or "[" in path:
        raise ValueError(f"a path of object members is needed, as $.a.b: {path}")
    return keys


def _literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def _edit(doc: Column, keys: list[str], value: Any, create: bool, replace: bool) -> Column:
    members, key = F.from_json(doc, OBJECT), F.lit(keys[0])
    if len(keys) > 1:
        inner = F.to_json(F.element_at(members, key))
        changed = F.parse_json(_edit(inner, keys[1:], value, create, replace))
        fresh = value
        for k in reversed(keys[1:]):
            fresh = {k: fresh}
        fresh, replace = _literal(fresh), True
    else:
        changed = fresh = _literal(value)
    there = F.transform_values(members, lambda k, v: F.when(k == key, changed).otherwise(v)) if replace else members
    absent = F.map_concat(members, F.create_map(key, fresh)) if create else members
    out = F.to_json(F.when(F.map_contains_key(members, key), there).otherwise(absent))
    return F.when(members.isNotNull(), out).otherwise(doc)


def json_set(doc: Column, path: str, value: Any) -> Column:
    return _edit(doc, keys_of(path), value, True, True)


def json_insert(doc: Column, path: str, value: Any) -> Column:
    """Only where nothing stands there."""
    return _edit(doc, keys_of(path), value, True, False)


def json_replace(doc: Column, path: str, value: Any) -> Column:
    """Only where something stands there."""
    return _edit(doc, keys_of(path), value, False, True)


def _remove(doc: Column, keys: list[str]) -> Column:
    members, key = F.from_json(doc, OBJECT), F.lit(keys[0])
    if len(keys) > 1:
        inner = F.parse_json(_remove(F.to_json(F.element_at(members, key)), keys[1:]))
        left = F.transform_values(members, lambda k, v: F.when(k == key, inner).otherwise(v))
    else:
        left = F.map_filter(members, lambda k, _: k != key)
    return F.when(members.isNotNull(), F.to_json(left)).otherwise(doc)


def json_remove(doc: Column, path: str) -> Column:
    return _remove(doc, keys_of(path))


def json_patch(doc: Column, patch: dict[str, Any]) -> Column:
    """Merge patch: null removes a member, objects are merged, all else is set."""

    def merge(at: Column, changes: dict[str, Any], above: list[str]) -> Column:
        for k, v in changes.items():
            if v is None:
                at = _remove(at, [*above, k])
            elif isinstance(v, dict) and v:
                at = merge(at, v, [*above, k])
            else:
                at = _edit(at, [*above, k], v, True, True)
        return at

    return merge(doc, patch, [])


def json_type(doc: Column) -> Column:
    """null, true, false, integer, real, text, array or object; null where the text is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.trim(doc)).when(kind == "BIGINT", "integer").when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "real")
    )


def json_group_array(c: Column) -> Column:
    """In order of value, since groups have none of their own; nulls are left out."""
    return F.to_json(F.array_sort(F.collect_list(c)))


def json_group_object(key: Column, value: Column) -> Column:
    """In order of key; of equal keys one fails."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))))


def json_each(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row a member or element of ``column``: what is kept, then key (text; position in arrays), value (JSON text) and type."""
    members = F.try_parse_json(F.col(f"`{column}`")).alias("__json")
    each = rows.select(*[f"`{k}`" for k in keep], members).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("__json").outer()))
    value = F.to_json("value")
    return each.select(*[f"`{k}`" for k in keep], F.coalesce("key", F.col("pos").cast("string")).alias("key"), value.alias("value"), json_type(value).alias("type"))
