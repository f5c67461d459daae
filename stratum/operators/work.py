"""A plan's working state: lazy tables and a manifest that nobody else sees until it is published.

Every row of a working table carries the image it began with (``__before``), its key then (``__key``),
whether it still stands (``__alive``), the file that holds it (``__file``) and whether any operation met it
(``__touched``).  Operations add columns and filters; nothing runs until the changes are asked for.
"""

from __future__ import annotations

import copy
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.compat import cast_like, spark_type
from ..functions.hashing import encoded
from ..plans.sqltext import fold, mentions, normalize_sql
from ..sources.storage import Storage
from . import constraints
from .effects import ALIVE, BEFORE, FILE, KEY, TOUCHED, number_rows
from .triggers import Statement, added, names_of, read_trigger

MARKS = (BEFORE, KEY, ALIVE, FILE, TOUCHED)


def schema_of(entry: dict) -> T.StructType:
    return T.StructType([T.StructField(c["name"], spark_type(c["type"])) for c in entry["columns"]])


def literal(value: Any, kind: T.DataType, strict: bool = True) -> Column:
    """A plan's scalar as a cell; booleans are 1 and 0."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, bool):
        value = int(value)
    try:
        if isinstance(kind, T.LongType):
            number = int(value) if not isinstance(value, float) or value.is_integer() else None
            if number is None or not -(1 << 63) <= number < 1 << 63:
                raise ValueError(value)
            return F.lit(number).cast(kind)
        if isinstance(kind, T.DoubleType):
            return F.lit(float(value))
        if isinstance(kind, T.DecimalType):
            return F.lit(str(value)).cast(kind)
        if isinstance(kind, T.BinaryType):
            return F.lit(str(value).encode())
        return F.lit(str(value))
    except ValueError as e:
        if strict:
            raise EngineError("APPLY_FAILED", f"{value!r} does not fit a column of type {kind.simpleString()}") from e
        return F.lit(None).cast(kind)


def where(values: dict[str, Any], schema: T.StructType) -> Column:
    """All columns equal; null asks for null; a value that can't be of the column's type meets nothing."""
    if not values:
        raise EngineError("INVALID_OPERATION", "an empty where")
    kinds = {f.name: f.dataType for f in schema}
    out = F.lit(True)
    for name, value in values.items():
        if name not in kinds:
            raise EngineError("INVALID_OPERATION", f"no such column: {name}")
        c = F.col(f"`{name}`")
        out = out & (c.isNull() if value is None else F.coalesce(c == literal(value, kinds[name], strict=False), F.lit(False)))
    return out


def met(values: dict[str, Any], schema: T.StructType) -> Column:
    """``where`` for a filter, in which null is as good as false: a form that scans can take over."""
    kinds = {f.name: f.dataType for f in schema}
    out = F.lit(True)
    for name, value in values.items():
        c = F.col(f"`{name}`")
        out = out & (c.isNull() if value is None else c == literal(value, kinds[name], strict=False))
    return out


def new_marks() -> list[Column]:
    """The marks of a row that no file holds yet."""
    none = F.lit(None).cast("string")
    return [none.alias(BEFORE), none.alias(KEY), F.lit(True).alias(ALIVE), none.alias(FILE), F.lit(True).alias(TOUCHED)]


def resolve(names: Any, name: str) -> str:
    """Exact name, else the one that is equal by ASCII case folding."""
    if name in names:
        return name
    found = next((n for n in sorted(names) if fold(n) == fold(name)), None)
    if found is None:
        raise EngineError("NOT_FOUND", f"no such table: {name}")
    return found


class Work:
    def __init__(self, storage: Storage, manifest: dict, clock: dict[str, str]):
        self.storage, self.spark = storage, storage.spark
        self.before, self.manifest, self.clock = manifest, copy.deepcopy(manifest), clock
        self.rows: dict[str, DataFrame] = {}
        self.pending: dict[str, list[dict]] = {}
        self.scratch: list[str] = []  # folders below the root that go when the work is over
        self.firing: list[str] = []  # triggers that are being run
        self.known: dict[str, tuple[DataFrame, DataFrame]] = {}  # changes of a table that are known without a scan, and the rows they lead to
        self.caches: list[DataFrame] = []  # held until the work is over

    def drop_caches(self) -> None:
        for c in self.caches:
            c.unpersist()
        self.caches.clear()

    # -- tables ---------------------------------------------------------------------------------------

    def entry(self, table: str) -> dict:
        return self.manifest["tables"][resolve(self.manifest["tables"], table)]

    def name(self, table: str) -> str:
        return resolve(self.manifest["tables"], table)

    def load(self, table: str) -> DataFrame:
        """The working rows of ``table``, buffered inserts included."""
        if table not in self.rows:
            entry = self.manifest["tables"][table]
            schema = schema_of(entry)
            rows = self.storage.read_rows(entry["files"], schema)
            file = F.concat(F.lit("tables/"), F.substring_index(F.col("_metadata.file_path"), "/tables/", -1)) if entry["files"] else F.lit(None).cast("string")
            if any(f.startswith("snapshots/") for f in entry["files"]):
                file = F.lit(None).cast("string")
            self.rows[table] = rows.select("*", file.alias(FILE)).select(
                *[f"`{f.name}`" for f in schema], encoded(schema).alias(BEFORE), encoded(schema, entry["pk"]).alias(KEY), F.lit(True).alias(ALIVE), FILE, F.lit(False).alias(TOUCHED)
            )
        self._flush(table)
        return self.rows[table]

    def alive(self, table: str) -> DataFrame:
        return self.load(table).filter(F.col(ALIVE)).select(*[f"`{c['name']}`" for c in self.manifest["tables"][table]["columns"]])

    def _flush(self, table: str) -> None:
        buffered = self.pending.pop(table, None)
        if not buffered:
            return
        entry, schema = self.manifest["tables"][table], schema_of(self.manifest["tables"][table])
        kinds = {f.name: f.dataType for f in schema}
        key = entry["pk"][0] if len(entry["pk"]) == 1 and isinstance(kinds[entry["pk"][0]], T.LongType) else None
        if key and any(row.get(key) is None for row in buffered):
            top = self.rows[table].filter(F.col(ALIVE)).agg(F.max(f"`{key}`")).first()[0] or 0
            top = max(top, entry.get("sequence") or 0)
            for row in buffered:
                if row.get(key) is None:
                    row[key] = top + 1
                top = max(top, int(row[key]))
        if key and entry.get("sequence") is not None:
            entry["sequence"] = max([entry["sequence"], *(int(row[key]) for row in buffered)])
        # scalars travel as text and are cast in the plan, so a batch of any size is one relation
        def text(v: Any, kind: T.DataType) -> str | None:
            return None if v is None else str(int(v)) if isinstance(v, bool) or isinstance(kind, T.LongType) and isinstance(v, float) else str(v)

        for row in buffered:
            for n, v in row.items():
                literal(v, kinds[n])
        texts = [tuple(text(row.get(n), k) for n, k in kinds.items()) for row in buffered]
        frame = self.spark.createDataFrame(texts, T.StructType([T.StructField(n, T.StringType()) for n in kinds]))
        cells = [F.encode(f"`{n}`", "UTF-8").alias(n) if isinstance(k, T.BinaryType) else F.col(f"`{n}`").cast(k).alias(n) for n, k in kinds.items()]
        self.rows[table] = self.rows[table].unionByName(frame.select(*cells, *new_marks()))
        if entry["triggers"]:
            self._fire(table, "insert", frame.select(*cells).select(self._image(table).alias("new")))

    # -- triggers -------------------------------------------------------------------------------------

    def _image(self, table: str, cells: dict[str, Column] | None = None) -> Column:
        return F.struct(*[(cells or {}).get(c, F.col(f"`{c}`")).alias(c) for c in self._names(table)])

    def _fire(self, table: str, event: str, rows: DataFrame, columns: Any = ()) -> None:
        """Run the triggers of ``table`` on the rows (new, old) that an operation met; none fires within itself."""
        for t in self.manifest["tables"][table]["triggers"]:
            trigger = read_trigger(t["sql"])
            if trigger.event != event or t["name"] in self.firing:
                continue
            if trigger.columns is not None and not {fold(c) for c in trigger.columns} & {fold(c) for c in columns}:
                continue
            self.firing.append(t["name"])
            try:
                met_rows = rows.filter(F.expr(trigger.when)) if trigger.when else rows
                for statement in trigger.statements:
                    getattr(self, f"_{statement.kind}_fired")(self.name(statement.table), statement, met_rows)
            except EngineError:
                raise
            except AnalysisException as e:
                raise EngineError("UNSUPPORTED", f"trigger {t['name']}: {str(e).splitlines()[0]}") from e
            finally:
                self.firing.pop()

    def _insert_fired(self, table: str, statement: Statement, rows: DataFrame) -> None:
        entry, schema = self.manifest["tables"][table], schema_of(self.manifest["tables"][table])
        self.load(table)
        given = {self._column(entry, n): F.expr(x) for n, x in statement.cells.items()}
        cells = []
        for c, f in zip(entry["columns"], schema, strict=True):
            if c["name"] in given:
                cells.append(given[c["name"]].cast(f.dataType).alias(f.name))
            else:
                d = c.get("default")
                cells.append((literal(d["value"] if d["kind"] == "literal" else self.clock[d["expr"]], f.dataType) if d else F.lit(None).cast(f.dataType)).alias(f.name))
        frame = rows.select(*cells)
        key = entry["pk"][0] if len(entry["pk"]) == 1 and isinstance(schema[entry["pk"][0]].dataType, T.LongType) else None
        if key and key not in given:
            count = frame.count()
            top = max(self.rows[table].filter(F.col(ALIVE)).agg(F.max(f"`{key}`")).first()[0] or 0, entry.get("sequence") or 0)
            place = f"_log/scratch/{uuid.uuid4().hex}"
            self.scratch.append(place)
            order = [F.col(f"`{f.name}`") for f in schema if f.name != key]
            frame = number_rows(frame, order, count, self.storage.path(place), "__n").withColumn(key, F.col("__n") + top + 1).drop("__n")
            if entry.get("sequence") is not None:
                entry["sequence"] = top + count
        self.rows[table] = self.rows[table].unionByName(frame.select(*[f"`{f.name}`" for f in schema], *new_marks()))
        self._fire(table, "insert", frame.select(self._image(table).alias("new")))

    def _update_fired(self, table: str, statement: Statement, rows: DataFrame) -> None:
        entry, schema, names = self.manifest["tables"][table], schema_of(self.manifest["tables"][table]), self._names(table)
        keys = [f"`{k}`" for k in entry["pk"]]
        pairs = self.alive(table).join(rows, F.expr(statement.where))
        sums, once = [], False
        for k, (n, x) in enumerate(statement.cells.items()):
            more = added(self._column(entry, n), x)
            if more is not None and not names_of(more, names):
                sums.append(F.sum(F.expr(more)).alias(f"__s{k}"))
            else:
                once |= bool(names_of(x, names))
                sums.append(F.max_by(F.expr(x), F.to_json(F.struct(*[c for c in ("new", "old") if c in rows.columns]))).alias(f"__s{k}"))
        found = pairs.groupBy(*keys).agg(F.count("*").alias("__times"), *sums)
        if once and not found.filter("__times > 1").isEmpty():
            raise EngineError("UNSUPPORTED", f"a trigger changes one row of {table} several times by an expression of its own cells")
        found = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__times", *[f"__s{k}" for k in range(len(sums))])
        here = self.load(table)
        joined = here.join(found, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
        hit = F.col("__times").isNotNull() & F.col(ALIVE)
        cells = {}
        for k, (n, x) in enumerate(statement.cells.items()):
            c = self._column(entry, n)
            more = added(c, x)
            value = F.col(f"`{c}`") + F.col(f"__s{k}") if more is not None and not names_of(more, names) else F.col(f"__s{k}")
            cells[c] = F.when(hit, value.cast(schema[c].dataType)).otherwise(F.col(f"`{c}`"))
        fired = joined.filter(hit).select(self._image(table).alias("old"), self._image(table, cells).alias("new"))
        out = joined.withColumns({TOUCHED: F.col(TOUCHED) | hit} | {f"__c{k}": x for k, x in enumerate(cells.values())})
        self.rows[table] = out.select(*[F.col(f"__c{list(cells).index(c)}").alias(c) if c in cells else F.col(f"`{c}`") for c in here.columns])
        self._fire(table, "update", fired, list(cells))

    def _delete_fired(self, table: str, statement: Statement, rows: DataFrame) -> None:
        keys = [f"`{k}`" for k in self.manifest["tables"][table]["pk"]]
        gone = self.alive(table).join(rows, F.expr(statement.where), "left_semi")
        found = gone.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).withColumn("__gone", F.lit(True))
        here = self.load(table)
        joined = here.join(found, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
        hit = F.col("__gone").isNotNull() & F.col(ALIVE)
        self.rows[table] = joined.withColumns({ALIVE: F.col(ALIVE) & ~hit, TOUCHED: F.col(TOUCHED) | hit}).select(*[f"`{c}`" for c in here.columns])
        self._cascade(table, gone)
        self._fire(table, "delete", gone.select(self._image(table).alias("old")))

    # -- rows -----------------------------------------------------------------------------------------

    def insert(self, op: dict) -> None:
        table = self.name(op["table"])
        entry = self.manifest["tables"][table]
        names = {c["name"] for c in entry["columns"]}
        if missing := sorted(set(op["values"]) - names):
            raise EngineError("INVALID_OPERATION", f"no such column: {missing[0]}")
        row = dict(op["values"])
        for c in entry["columns"]:
            if c["name"] not in row and (d := c.get("default")):
                row[c["name"]] = d["value"] if d["kind"] == "literal" else self.clock[d["expr"]]
        if table not in self.rows:
            self.load(table)
        self.pending.setdefault(table, []).append(row)

    def update(self, op: dict) -> None:
        table = self.name(op["table"])
        rows, schema = self.load(table), schema_of(self.manifest["tables"][table])
        kinds = {f.name: f.dataType for f in schema}
        hit = where(op["where"], schema) & F.col(ALIVE)
        if missing := sorted(set(op["values"]) - set(kinds)):
            raise EngineError("INVALID_OPERATION", f"no such column: {missing[0]}")
        cells = {n: F.when(hit, literal(v, kinds[n])).otherwise(F.col(f"`{n}`")) for n, v in op["values"].items()}
        self.rows[table] = rows.withColumns(cells | {TOUCHED: F.col(TOUCHED) | met(op["where"], schema)})
        if self.manifest["tables"][table]["triggers"]:
            self._fire(table, "update", rows.filter(hit).select(self._image(table).alias("old"), self._image(table, cells).alias("new")), op["values"])

    def delete(self, op: dict) -> None:
        table = self.name(op["table"])
        rows, schema = self.load(table), schema_of(self.manifest["tables"][table])
        hit = where(op["where"], schema) & F.col(ALIVE)
        self.rows[table] = rows.withColumns({ALIVE: F.col(ALIVE) & ~hit, TOUCHED: F.col(TOUCHED) | met(op["where"], schema)})
        self._cascade(table, rows.filter(hit))
        self._fire(table, "delete", rows.filter(hit).select(self._image(table).alias("old")))

    def _cascade(self, table: str, doomed: DataFrame) -> None:
        """Delete what refers to ``doomed`` by a cascading reference, level by level.

        The rows that fall on a level are written aside, so the plan stays as small on the last level as on the first.
        """
        pointing: dict[str, list[tuple[str, dict]]] = {}
        for child, entry in self.manifest["tables"].items():
            for fk in entry["fks"]:
                action = (fk.get("onDelete") or "").upper()
                if action == "CASCADE":
                    pointing.setdefault(fold(fk["table"]), []).append((child, fk))
                elif action in ("SET NULL", "SET DEFAULT") and fold(fk["table"]) == fold(table) and not constraints.cascade(self.alive(child), doomed, fk["columns"], fk["referenced"]).isEmpty():
                    raise EngineError("UNSUPPORTED", f"{child} refers to {table} with ON DELETE {action}, which is not run")
        if fold(table) not in pointing:
            return
        place = f"_log/scratch/{uuid.uuid4().hex}"
        self.scratch.append(place)
        fallen: dict[str, list[str]] = {}

        def kept(name: str, folders: list[str]) -> DataFrame:
            return self.spark.read.schema(schema_of(self.manifest["tables"][name])).parquet(*map(self.storage.path, folders))

        level: dict[str, DataFrame] = {table: doomed}
        while level:
            found: dict[str, list[str]] = {}
            for parent, gone in level.items():
                for child, fk in pointing.get(fold(parent), ()):
                    rows, pk = self.alive(child), [f"`{k}`" for k in self.manifest["tables"][child]["pk"]]
                    if child in fallen:
                        rows = rows.join(kept(child, fallen[child]).select(*pk), self.manifest["tables"][child]["pk"], "left_anti")
                    folder = f"{place}/{sum(map(len, fallen.values()))}"
                    constraints.cascade(rows.select(*[f"`{c}`" for c in self._names(child)]), gone, fk["columns"], fk["referenced"]).write.parquet(self.storage.path(folder))
                    if not kept(child, [folder]).isEmpty():
                        fallen.setdefault(child, []).append(folder)
                        found.setdefault(child, []).append(folder)
                    else:
                        self.storage.delete(folder)
            level = {child: kept(child, folders) for child, folders in found.items()}
        for child, folders in fallen.items():
            rows, pk = self.load(child), self.manifest["tables"][child]["pk"]
            keys = kept(child, folders).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(pk)]).distinct().withColumn("__fall", F.lit(True))
            marked = rows.join(keys, [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(pk)], "left")
            fell = F.col("__fall").isNotNull()
            self.rows[child] = marked.withColumns({ALIVE: F.col(ALIVE) & ~fell, TOUCHED: F.col(TOUCHED) | fell}).select(*[f"`{c}`" for c in rows.columns])
        for child, folders in fallen.items():
            self._fire(child, "delete", kept(child, folders).select(self._image(child).alias("old")))

    def _names(self, table: str) -> list[str]:
        return [c["name"] for c in self.manifest["tables"][table]["columns"]]

    # -- schema ---------------------------------------------------------------------------------------

    def create_table(self, op: dict) -> None:
        if any(fold(n) == fold(op["table"]) for n in (*self.manifest["tables"], *self.manifest["views"])):
            raise EngineError("APPLY_FAILED", f"{op['table']} exists already")
        columns = [dict(c) for c in op["columns"]]
        self.manifest["tables"][op["table"]] = new_entry(columns, [c["name"] for c in columns if c.get("primaryKey")])

    def add_column(self, op: dict) -> None:
        table, c = self.name(op["table"]), dict(op["column"])
        entry = self.manifest["tables"][table]
        if any(fold(x["name"]) == fold(c["name"]) for x in entry["columns"]):
            raise EngineError("APPLY_FAILED", f"column {c['name']} exists already")
        rows, kind, d = self.load(table), spark_type(c["type"]), c.get("default")
        if d and d["kind"] == "sql" and not rows.filter(F.col(ALIVE)).isEmpty():
            raise EngineError("APPLY_FAILED", "a column with a clock default can only be added to an empty table")
        value = literal(d["value"], kind) if d and d["kind"] == "literal" else F.lit(None).cast(kind)
        entry["columns"].append(c)
        self.rows[table] = rows.withColumn(c["name"], value).withColumn(TOUCHED, F.lit(True))

    def drop_table(self, op: dict) -> None:
        table = self.name(op["table"])
        found = [
            {"type": "fk", "name": f"{n}({', '.join(fk['columns'])})", "table": n, "reason": f"{n} refers to {table}"}
            for n, e in self.manifest["tables"].items() if n != table for fk in e["fks"] if fold(fk["table"]) == fold(table)
        ]
        found += [{"type": "view", "name": v, "reason": f"the view reads {table}"} for v, e in self.manifest["views"].items() if mentions(e["sql"], table)]
        found += [
            {"type": "trigger", "name": t["name"], "table": n, "reason": f"the trigger mentions {table}"}
            for n, e in self.manifest["tables"].items() if n != table for t in e["triggers"] if mentions(t["sql"], table)
        ]
        self._refuse("drop_table", table, None, found)
        del self.manifest["tables"][table]
        self.rows.pop(table, None)
        self.pending.pop(table, None)

    def drop_column(self, op: dict) -> None:
        table = self.name(op["table"])
        entry = self.manifest["tables"][table]
        column = self._column(entry, op["column"])
        if column in entry["pk"] or len(entry["columns"]) == 1:
            raise EngineError("INVALID_OPERATION", f"{column} is part of the primary key or the last column")
        c = next(c for c in entry["columns"] if c["name"] == column)
        if c.get("unique"):
            raise EngineError("INVALID_OPERATION", f"{column} is UNIQUE")
        found = [{"type": "index", "name": i["name"], "table": table, "reason": f"the index covers {column}"} for i in entry["indexes"] if column in i["columns"] or mentions(i.get("where") or "", column)]
        found += [{"type": "trigger", "name": t["name"], "table": n, "reason": f"the trigger mentions {column}"} for n, e in self.manifest["tables"].items() for t in e["triggers"] if mentions(t["sql"], column) and (n == table or mentions(t["sql"], table))]
        found += [{"type": "view", "name": v, "reason": f"the view reads {table}.{column}"} for v, e in self.manifest["views"].items() if self._view_needs(e["sql"], table, column)]
        found += [{"type": "fk", "name": ", ".join(fk["columns"]), "table": table, "reason": f"a reference of {table} uses {column}"} for fk in entry["fks"] if column in fk["columns"]]
        found += [{"type": "fk", "name": f"{n}({', '.join(fk['columns'])})", "table": n, "reason": f"{n} refers to {table}.{column}"} for n, e in self.manifest["tables"].items() for fk in e["fks"] if fold(fk["table"]) == fold(table) and column in fk["referenced"]]
        found += [{"type": "generated", "name": g, "table": table, "reason": f"{g} is generated from {column}"} for g, x in entry.get("generated", {}).items() if mentions(x, column)]
        self._refuse("drop_column", table, column, found)
        if any(mentions(x, column) for x in entry["checks"]):
            raise EngineError("APPLY_FAILED", f"a check of {table} uses {column}")
        rows = self.load(table)
        entry["columns"] = [c for c in entry["columns"] if c["name"] != column]
        self.rows[table] = rows.drop(column).withColumn(TOUCHED, F.lit(True))

    def alter_column_type(self, op: dict) -> None:
        table = self.name(op["table"])
        entry = self.manifest["tables"][table]
        column = self._column(entry, op["column"])
        rows = self.load(table)
        c = next(c for c in entry["columns"] if c["name"] == column)
        source, target = spark_type(c["type"]), spark_type(op["newType"])
        c["type"] = op["newType"]
        self.rows[table] = rows.withColumn(column, cast_like(F.col(f"`{column}`"), source, target)).withColumn(TOUCHED, F.lit(True))

    def add_check(self, op: dict) -> None:
        table = self.name(op["table"])
        checks = self.manifest["tables"][table]["checks"]
        if normalize_sql(op["expression"], tight=True) in [normalize_sql(x, tight=True) for x in checks]:
            raise EngineError("INVALID_OPERATION", f"{table} has this check already")
        self.load(table)
        checks.append(op["expression"])

    def drop_check(self, op: dict) -> None:
        entry, want = self.entry(op["table"]), normalize_sql(op["expression"], tight=True)
        left = [x for x in entry["checks"] if normalize_sql(x, tight=True) != want]
        if len(left) == len(entry["checks"]):
            raise EngineError("INVALID_OPERATION", f"{op['table']} has no such check")
        entry["checks"] = left

    def _drop_object(self, op: dict, kind: str) -> None:
        entry = self.entry(op["table"])
        left = [x for x in entry[kind] if fold(x["name"]) != fold(op["name"])]
        if len(left) == len(entry[kind]):
            raise EngineError("NOT_FOUND", f"{op['table']} has no such {kind[:-1].rstrip('e')}: {op['name']}")
        entry[kind] = left

    def drop_index(self, op: dict) -> None:
        self._drop_object(op, "indexes")

    def drop_trigger(self, op: dict) -> None:
        self._drop_object(op, "triggers")

    def drop_view(self, op: dict) -> None:
        found = next((v for v in self.manifest["views"] if fold(v) == fold(op["name"])), None)
        if found is None:
            raise EngineError("NOT_FOUND", f"no such view: {op['name']}")
        del self.manifest["views"][found]

    def restore_table(self, table: str, entry: dict | None) -> None:
        """Point ``table`` at an older version, or remove it."""
        self.rows.pop(table, None)
        self.pending.pop(table, None)
        if entry is None:
            self.manifest["tables"].pop(table, None)
        else:
            self.manifest["tables"][table] = copy.deepcopy(entry)

    def run(self, op: dict) -> None:
        for table in list(self.pending):  # what an insertion fires comes before the next operation
            if self.manifest["tables"][table]["triggers"] and not (op["type"] == "insert" and self.name(op["table"]) == table):
                self.load(table)
        getattr(self, op["type"])(op)

    # -- helpers --------------------------------------------------------------------------------------

    @staticmethod
    def _column(entry: dict, name: str) -> str:
        found = next((c["name"] for c in entry["columns"] if c["name"] == name), None) or next((c["name"] for c in entry["columns"] if fold(c["name"]) == fold(name)), None)
        if found is None:
            raise EngineError("INVALID_OPERATION", f"no such column: {name}")
        return found

    def _refuse(self, operation: str, table: str, column: str | None, found: list[dict]) -> None:
        if not found:
            return
        drops = {"view": lambda f: {"type": "drop_view", "name": f["name"]}, "index": lambda f: {"type": "drop_index", "table": f["table"], "name": f["name"]}, "trigger": lambda f: {"type": "drop_trigger", "table": f["table"], "name": f["name"]}}
        suggested = []
        for f in found:
            if f["type"] in drops and (s := drops[f["type"]](f)) not in suggested:
                suggested.append(s)
        detail = {"operation": operation, "table": table, "conflicts": found, "suggestedOps": suggested} | ({"column": column} if column else {})
        raise EngineError("DEPENDENCY_CONFLICT", f"{operation}: {len(found)} objects depend on {table}{'.' + column if column else ''}", detail)

    def _view_needs(self, sql: str, table: str, column: str) -> bool:
        """Does the view fail to resolve once the column is gone?"""
        if not mentions(sql, table) or not mentions(sql, column):
            return False

        def resolves(without: bool) -> bool:
            session = self.spark.newSession()
            for name, entry in self.manifest["tables"].items():
                schema = schema_of(entry)
                if without and name == table:
                    schema = T.StructType([f for f in schema if f.name != column])
                session.createDataFrame([], schema).createOrReplaceTempView(name)
            try:
                session.sql(sql).schema
            except Exception:  # noqa: BLE001  whatever the analyser has against it
                return False
            return True

        return not resolves(True)


def with_generated(rows: DataFrame, entry: dict) -> DataFrame:
    """Stored rows and the table's generated columns after them, which may use one another but not in a circle."""
    left = dict(entry.get("generated", {}))
    stored = rows.columns
    while left:
        ready = [g for g, sql in left.items() if not any(mentions(sql, other) for other in left)]
        if not ready:
            raise EngineError("INVALID_OPERATION", f"generated columns use one another in a circle: {', '.join(sorted(left))}")
        rows = rows.withColumns({g: F.expr(left.pop(g)) for g in ready})
    return rows.select(*[f"`{c}`" for c in [*stored, *entry.get("generated", {})]])


def new_entry(columns: list[dict], pk: list[str], **more: Any) -> dict:
    base = {"columns": columns, "pk": pk, "checks": [], "fks": [], "indexes": [], "triggers": [], "generated": {}, "sequence": None, "files": [], "lanes": [0, 0, 0, 0, 0]}
    return base | more
