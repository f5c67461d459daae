"""Plans: JSON text to validated operations.

A plan is ``{"baseSchemaHash": 64 hex digits, "message": text, "operations": [...]}``.  Shape is checked
against a small table of fields; what a shape can't say (one primary key, identifiers, expressions) is
checked afterwards.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import EngineError
from .sqltext import check_expression, check_identifier, check_type

Scalar = (str, int, float, bool, type(None))

#: Fields of each operation: name to kind; a kind ends in ``?`` where the field may be left out.
SHAPES: dict[str, dict[str, str]] = {
    "create_table": {"table": "name", "columns": "columns"},
    "add_column": {"table": "name", "column": "column"},
    "insert": {"table": "name", "values": "record"},
    "update": {"table": "name", "values": "record", "where": "record"},
    "delete": {"table": "name", "where": "record"},
    "drop_table": {"table": "name"},
    "drop_column": {"table": "name", "column": "name"},
    "alter_column_type": {"table": "name", "column": "name", "newType": "type"},
    "add_check": {"table": "name", "expression": "expression"},
    "drop_check": {"table": "name", "expression": "expression"},
    "drop_index": {"table": "name", "name": "name"},
    "drop_trigger": {"table": "name", "name": "name"},
    "drop_view": {"name": "name"},
    "restore_table": {"table": "name", "entry": "any"},
}
COLUMN_SHAPE = {"name": "name", "type": "type", "notNull": "bool?", "primaryKey": "bool?", "unique": "bool?", "default": "default?"}
SCHEMA_OPERATIONS = frozenset(SHAPES) - {"insert", "update", "delete", "restore_table"}
DESTRUCTIVE_OPERATIONS = frozenset(x for x in SHAPES if x.startswith("drop_")) | {"alter_column_type", "update", "delete"}
CLOCK_DEFAULTS = ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME")


@dataclass(frozen=True)
class Plan:
    base_schema_hash: str
    message: str
    operations: list[dict[str, Any]] = field(default_factory=list)

    def to_json(self) -> dict:
        return {"baseSchemaHash": self.base_schema_hash, "message": self.message, "operations": self.operations}


def _fields(value: Any, shape: dict[str, str], label: str, code: str = "INVALID_PLAN") -> dict:
    if not isinstance(value, dict):
        raise EngineError(code, f"{label}: an object is needed")
    if extra := sorted(set(value) - set(shape)):
        raise EngineError(code, f"{label}: unknown field {extra[0]}")
    out = {}
    for name, kind in shape.items():
        if name not in value:
            if kind.endswith("?"):
                continue
            raise EngineError(code, f"{label}: field {name} is missing")
        out[name] = _value(value[name], kind.rstrip("?"), f"{label}.{name}", code)
    return out


def _value(value: Any, kind: str, label: str, code: str) -> Any:
    if kind in ("name", "type", "expression"):
        if not isinstance(value, str) or not value.strip():
            raise EngineError(code, f"{label}: a text is needed")
        return value.strip()
    if kind == "bool" and not isinstance(value, bool):
        raise EngineError(code, f"{label}: true or false is needed")
    if kind == "record":
        if not isinstance(value, dict) or not value or not all(isinstance(v, Scalar) for v in value.values()):
            raise EngineError(code, f"{label}: an object of scalars, not empty, is needed")
    if kind == "columns":
        if not isinstance(value, list) or not value:
            raise EngineError(code, f"{label}: a list of columns, not empty, is needed")
        return [_fields(c, COLUMN_SHAPE, f"{label}[{k}]", code) for k, c in enumerate(value)]
    if kind == "column":
        return _fields(value, COLUMN_SHAPE, label, code)
    if kind == "default":
        if isinstance(value, dict) and value.get("kind") == "sql":
            value = _fields(value, {"kind": "name", "expr": "name"}, label, code)
            if value["expr"] not in CLOCK_DEFAULTS:
                raise EngineError(code, f"{label}: expression not allowed: {value['expr']}")
        elif isinstance(value, dict) and value.get("kind") == "literal" and isinstance(value.get("value"), Scalar) and set(value) == {"kind", "value"}:
            pass
        else:
            raise EngineError(code, f"{label}: a literal or one of {', '.join(CLOCK_DEFAULTS)} is needed")
    return value


def _column(c: dict, label: str) -> None:
    check_identifier(c["name"], f"{label}.name")
    c["type"] = check_type(c["type"], f"{label}.type")


def _meaning(op: dict) -> None:
    kind = op["type"]
    if kind == "restore_table":
        raise EngineError("INVALID_OPERATION", "restore_table is for the engine itself")
    for name in ("table", "name"):
        if name in op:
            check_identifier(op[name], f"{kind}.{name}")
    if kind == "create_table":
        for c in op["columns"]:
            _column(c, "create_table.column")
        names = [c["name"] for c in op["columns"]]
        if twice := next((n for n in names if names.count(n) > 1), None):
            raise EngineError("INVALID_OPERATION", f"create_table: column {twice} is named twice")
        if sum(bool(c.get("primaryKey")) for c in op["columns"]) != 1:
            raise EngineError("INVALID_OPERATION", "create_table: exactly one column is the primary key")
    elif kind == "add_column":
        c = op["column"]
        _column(c, "add_column.column")
        if c.get("primaryKey") or c.get("unique"):
            raise EngineError("INVALID_OPERATION", "add_column: a new column is neither primary key nor unique")
        if c.get("notNull") and "default" not in c:
            raise EngineError("INVALID_OPERATION", "add_column: NOT NULL needs a default")
    elif kind in ("drop_column", "alter_column_type"):
        check_identifier(op["column"], f"{kind}.column")
        if kind == "alter_column_type":
            op["newType"] = check_type(op["newType"], "alter_column_type.newType")
    elif kind in ("add_check", "drop_check"):
        op["expression"] = check_expression(op["expression"], f"{kind}.expression")
    for name in ("values", "where"):
        for key in op.get(name, {}):
            check_identifier(key, f"{kind}.{name}")


def parse_plan(source: str | dict) -> Plan:
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise EngineError("INVALID_JSON", f"the plan is not JSON: {e}") from e
    top = _fields(source, {"baseSchemaHash": "any", "message": "name", "operations": "any"}, "plan")
    if not isinstance(top["baseSchemaHash"], str) or not re.fullmatch(r"[0-9a-fA-F]{64}", top["baseSchemaHash"]):
        raise EngineError("INVALID_PLAN", "plan.baseSchemaHash: 64 hexadecimal digits are needed")
    if not isinstance(top["operations"], list) or not top["operations"]:
        raise EngineError("INVALID_PLAN", "plan.operations: a list, not empty, is needed")
    made = []
    for k, raw in enumerate(top["operations"]):
        kind = raw.get("type") if isinstance(raw, dict) else None
        if kind not in SHAPES:
            raise EngineError("INVALID_PLAN", f"operations[{k}]: unknown type {kind!r}")
        body = {x: v for x, v in raw.items() if x != "type"}
        op = {"type": kind} | _fields(body, SHAPES[kind], f"operations[{k}]")
        _meaning(op)
        made.append(op)
    return Plan(top["baseSchemaHash"], top["message"], made)
