"""The engine: plans in, content-addressed commits out.

A root folder holds immutable Parquet files below ``tables/``, row effects below ``_log/row_effect/seq=N``
and one JSON object a commit below ``_log/commits``.  A commit is published by creating that object; who
comes second gets STALE_PLAN.  The driver handles plans, manifests and digests; rows stay in DataFrames.
"""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .functions import hashing as H
from .operators import constraints
from .operators import effects as E
from .operators.work import Work, new_entry, new_marks, schema_of, with_generated
from .plans.model import DESTRUCTIVE_OPERATIONS, SCHEMA_OPERATIONS, Plan, parse_plan
from .plans.sqltext import check_identifier, fold, normalize_sql
from .sources.storage import Storage

FORMAT_VERSION = 1
SNAPSHOT_INTERVAL, SNAPSHOTS_KEPT = 100, 20
LARGE_COMMIT = 262_144
#: Row conflicts of a table that a report lists; more are counted and written to a table that it names.
REPORTED = 1000
EMPTY_MANIFEST: dict[str, Any] = {"tables": {}, "views": {}}
#: Fields of a table entry that are not part of its schema.
DATA_FIELDS = ("files", "lanes", "sequence")
EFFECTS = E.EFFECT + ", seq long"
HEADER = (
    "commitId string, seq long, kind string, message string, createdAt long, parentIds array<string>, schemaHashBefore string, schemaHashAfter string, "
    "stateHashAfter string, planHash string, revertible boolean, revertTargetId string, operationCount long, rowEffectCount long, schemaEffectCount long, "
    "tables array<string>, bytes long"
)


def describe(entry: dict) -> dict:
    """The schema of a table entry, checks and SQL in normal form."""
    out = {k: v for k, v in entry.items() if k not in DATA_FIELDS}
    out["checks"] = sorted(normalize_sql(x, tight=True) for x in entry["checks"])
    out["triggers"] = sorted(({**t, "sql": normalize_sql(t["sql"])} for t in entry["triggers"]), key=lambda t: t["name"])
    out["indexes"] = sorted(entry["indexes"], key=lambda i: i["name"])
    return out


def schema_hash(manifest: dict) -> str:
    return H.sha256_hex({"tables": {n: describe(e) for n, e in manifest["tables"].items()}, "views": {n: normalize_sql(v["sql"]) for n, v in manifest["views"].items()}})


def state_hash(manifest: dict) -> str:
    return H.state_hash({n: tuple(e["lanes"]) for n, e in manifest["tables"].items()})


class Commit(dict):
    """A commit as published: header, operations, schema effects, effect digest and the manifest after it."""

    def compute_id(self) -> str:
        signed = {k: self[k] for k in ("seq", "kind", "message", "createdAt", "schemaHashBefore", "schemaHashAfter", "stateHashAfter", "planHash", "revertible", "revertTargetId", "parentIds", "operations", "rowEffectDigest")}
        return H.sha256_hex(signed | {"schemaEffects": [_portable(x) for x in self["schemaEffects"]]})


def _portable(effect: dict) -> dict:
    """A schema effect without what differs between replicas: where the files are."""
    drop = lambda e: e and {k: v for k, v in e.items() if k != "files"}
    return {"table": effect["table"], "before": drop(effect["before"]), "after": drop(effect["after"])}


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock=None):
        self.spark, self.storage = spark, Storage(spark, root)
        self._clock = clock or (lambda: int(time.time() * 1000))

    # -- S: roots -------------------------------------------------------------------------------------

    @classmethod
    def init(cls, spark: SparkSession, root: str, force_new: bool = False, clock=None) -> Engine:
        self = cls(spark, root, clock)
        if force_new:
            self.storage.delete("")
        elif self.is_initialized():
            return cls.open(spark, root, clock)
        self.storage.put_if_absent("_log/meta.json", {"format_version": FORMAT_VERSION, "created_at": self._clock()})
        self.storage.put("_log/refs/main.json", {"seq": 0, "commitId": None, "updatedAt": self._clock()})
        return self

    @classmethod
    def open(cls, spark: SparkSession, root: str, clock=None) -> Engine:
        self = cls(spark, root, clock)
        if not self.is_initialized():
            raise EngineError("NOT_INITIALIZED", f"no tables were set up at {root}")
        version = self.meta("format_version")
        if version != FORMAT_VERSION:
            raise EngineError("IMMUTABLE_MIGRATION_EDITED", f"format {version} is not known")
        return self

    def is_initialized(self) -> bool:
        return self.storage.exists("_log/meta.json") and self.storage.exists("_log/refs/main.json")

    def meta(self, key: str, default: Any = None) -> Any:
        return (self.storage.read("_log/meta.json") or {}).get(key, default)

    def set_meta(self, **values: Any) -> None:
        self.storage.put("_log/meta.json", (self.storage.read("_log/meta.json") or {}) | values)

    # -- N14: log -------------------------------------------------------------------------------------

    def commit_at(self, seq: int) -> Commit | None:
        found = self.storage.read(f"_log/commits/{seq:020d}.json")
        return Commit(found) if found else None

    def head(self) -> Commit | None:
        """The last commit; the ref may lag behind a publisher that died, so later ones are looked for."""
        seq = (self.storage.read("_log/refs/main.json") or {}).get("seq", 0)
        while self.storage.exists(f"_log/commits/{seq + 1:020d}.json"):
            seq += 1
        return self.commit_at(seq) if seq else None

    def manifest(self) -> dict:
        head = self.head()
        return head["manifest"] if head else EMPTY_MANIFEST

    def commits_df(self) -> DataFrame:
        """Commit headers, one row a commit."""
        if not self.storage.list("_log/commits"):
            return self.spark.createDataFrame([], HEADER)
        return self.spark.read.schema(HEADER).json(self.storage.path("_log/commits"))

    def find_commit(self, commit_id: str) -> Commit:
        found = self.commits_df().filter(F.col("commitId") == commit_id).select("seq").first()
        if not found:
            raise EngineError("NOT_FOUND", f"no such commit: {commit_id}")
        return self.commit_at(found.seq)

    def list_commits(self, after: int = 0) -> list[Commit]:
        names = [n for n in self.storage.list("_log/commits") if n.endswith(".json") and int(n[:20]) > after]
        return [self.commit_at(int(n[:20])) for n in names]

    def effects(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Row effects of commits with a higher seq than ``after``: the change feed, pruned by partition."""
        if not self.storage.list("_log/row_effect"):
            return self.spark.createDataFrame([], EFFECTS)
        rows = self.spark.read.schema(EFFECTS).parquet(self.storage.path("_log/row_effect")).filter(F.col("seq") > after)
        return rows if upto is None else rows.filter(F.col("seq") <= upto)

    def commit_effects(self, commit: Commit, verify: bool = True, ordered: bool = True) -> DataFrame:
        """A commit's row effects, in order where ``ordered``; the hashes of their images are held against the images."""
        rows = self.effects(commit["seq"] - 1, commit["seq"]).drop("seq")
        if verify:
            wrong = rows.filter(~H.digest(F.col("before_json")).eqNullSafe(F.col("before_hash")) | ~H.digest(F.col("after_json")).eqNullSafe(F.col("after_hash")))
            if wrong.agg(F.count("*")).first()[0]:  # all tasks at once
                raise EngineError("INTEGRITY_ERROR", f"a row image of commit {commit['commitId']} differs from its hash")
        return rows.orderBy("effect_index") if ordered else rows

    # -- tables ---------------------------------------------------------------------------------------

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def views(self) -> list[str]:
        return sorted(self.manifest()["views"])

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        work = Work(self.storage, manifest or self.manifest(), {})
        entry = work.manifest["tables"][work.name(name)]
        return with_generated(self.storage.read_rows(entry["files"], schema_of(entry)), entry)

    def table_as_of(self, name: str, seq: int) -> DataFrame:
        return self.table(name, (self.commit_at(seq) or {"manifest": EMPTY_MANIFEST})["manifest"])

    def schema_hash(self) -> str:
        return schema_hash(self.manifest())

    def state_hash(self) -> str:
        return state_hash(self.manifest())

    def _work(self, manifest: dict, now: int) -> Work:
        at = datetime.fromtimestamp(now / 1000, UTC)
        return Work(self.storage, manifest, {"CURRENT_TIMESTAMP": f"{at:%Y-%m-%d %H:%M:%S}", "CURRENT_DATE": f"{at:%Y-%m-%d}", "CURRENT_TIME": f"{at:%H:%M:%S}"})

    # -- changes and their checks ---------------------------------------------------------------------

    def _schema_effects(self, work: Work) -> list[dict]:
        out = []
        for kind in ("tables", "views"):
            for name in sorted({*work.before[kind], *work.manifest[kind]}):
                before, after = work.before[kind].get(name), work.manifest[kind].get(name)
                same = before and after and (describe(before) == describe(after) if kind == "tables" else before == after)
                if not same:
                    out.append({"table": name, "kind": kind[:-1], "before": before, "after": after})
        return out

    def _changes(self, work: Work) -> dict[str, DataFrame]:
        """Changed rows of every table that operations touched."""
        out = {}
        for table in list(work.rows):
            if table in work.manifest["tables"]:
                entry = work.manifest["tables"][table]
                rows, changes = work.known.get(table, (None, None))
                out[table] = changes if rows is not None and rows is work.load(table) else E.changed_rows(work.load(table), schema_of(entry), entry["pk"]).persist()
        return out

    def _check_constraints(self, work: Work, changed: dict[str, DataFrame]) -> None:
        """K1 to K5 on what changed; on all rows of a table where columns or the constraint itself changed."""

        def fail(rows: DataFrame, message: str, code: str = "APPLY_FAILED") -> None:
            first = rows.agg(F.to_json(F.first(F.struct("*")))).first()[0]  # all tasks at once
            if first is not None:
                raise EngineError(code, message, {"row": first})

        for table, changes in changed.items():
            entry, schema = work.manifest["tables"][table], schema_of(work.manifest["tables"][table])
            before, alive = work.before["tables"].get(table), work.alive(table)
            rewritten = before is None or any(before[k] != entry[k] for k in ("columns", "pk"))  # no row may be relied on
            after = changes.filter("__after is not null").select(*H.decoded(F.col("__after"), schema), "__fresh")
            left = [0, 0]  # changed rows, and those of them that bring a key
            if not rewritten:
                left = list(changes.agg(F.count("*"), F.count(F.when(F.col("__after").isNotNull() & F.col("__fresh"), 1))).first())

            def judged(*kinds: str) -> DataFrame | None:
                """The rows that a constraint described by ``kinds`` concerns: all, those changed, or none."""
                if rewritten or any(before[k] != entry[k] for k in kinds):
                    return alive
                return after.drop("__fresh") if left[0] else None

            if entry["pk"] and rewritten:
                fail(constraints.null_keys(alive, entry["pk"]), f"PRIMARY KEY of {table} is null")
                fail(constraints.duplicate_keys(alive, entry["pk"]), f"UNIQUE constraint failed: {table}.{entry['pk'][0]}")
            elif entry["pk"] and left[1]:
                fresh = after.filter("__fresh").select(*[f"`{k}`" for k in entry["pk"]])
                fail(constraints.null_keys(fresh, entry["pk"]), f"PRIMARY KEY of {table} is null")
                gone = changes.filter(F.col(E.BEFORE).isNotNull()).select(*H.decoded(F.col(E.BEFORE), schema))
                stored = self.storage.read_rows(entry["files"], schema)
                fail(constraints.clashing_keys(stored, gone, after, fresh, entry["pk"]), f"UNIQUE constraint failed: {table}.{entry['pk'][0]}")
            if (new := judged()) is not None:
                for c in entry["columns"]:
                    if c.get("notNull"):
                        fail(constraints.null_keys(new, [c["name"]]), f"NOT NULL constraint failed: {table}.{c['name']}")
            uniques = [([c["name"]], None) for c in entry["columns"] if c.get("unique")] + [(i["columns"], i.get("where")) for i in entry["indexes"] if i.get("unique")]
            new = judged("indexes")
            for unique, only in uniques if new is not None else ():
                among, changed_keys = (alive.filter(F.expr(only)), new.filter(F.expr(only))) if only else (alive, new)
                fail(constraints.duplicate_keys(among, unique, None if new is alive else changed_keys), f"UNIQUE constraint failed: {table}.{unique[0]}")
            new = judged("checks")
            for expression in entry["checks"] if new is not None else ():
                try:
                    fail(constraints.check_failures(new, expression), f"CHECK constraint failed: {expression}")
                except EngineError:
                    raise
                except Exception as e:
                    raise EngineError("APPLY_FAILED", f"check {expression!r} can't be evaluated: {str(e).splitlines()[0]}") from e
            new = judged("fks")
            for fk in entry["fks"] if new is not None else ():
                parent = work.name(fk["table"])
                fail(constraints.orphans(new, work.alive(parent), fk["columns"], fk["referenced"]), f"FOREIGN KEY constraint failed: {table} refers to {parent}", "FK_VIOLATION")
            gone = changes.filter(F.col(E.BEFORE).isNotNull())
            for child, other in work.manifest["tables"].items():
                for fk in other["fks"]:
                    if fold(fk["table"]) != fold(table) or table not in work.before["tables"]:
                        continue
                    old = gone.select(*H.decoded(F.col(E.BEFORE), schema_of(work.before["tables"][table])))
                    pointing = constraints.cascade(work.alive(child), old, fk["columns"], fk["referenced"])
                    fail(constraints.orphans(pointing, alive, fk["columns"], fk["referenced"]), f"FOREIGN KEY constraint failed: {child} refers to {table}", "FK_VIOLATION")

    def _write_tables(self, work: Work, changed: dict[str, DataFrame], seq: int) -> None:
        """Rewrite the files that hold changed rows, add a file of new ones, and carry the lanes on."""
        tag = f"v={seq}-{uuid.uuid4().hex[:8]}"
        for table, changes in changed.items():
            entry, before = work.manifest["tables"][table], work.before["tables"].get(table)
            schema = schema_of(entry)
            columns = [F.col(f"`{f.name}`") for f in schema]
            rows = work.load(table).filter(F.col(E.ALIVE))
            folder = f"tables/{H.sha256_hex(table)[:16]}/{tag}"
            if before and before["columns"] == entry["columns"]:
                if changes.isEmpty():
                    continue
                named = changes.filter(F.col(E.BEFORE).isNotNull()).select(E.FILE).distinct()
                found = {r[0] for r in named.collect()}  # names of files, as in the manifest, not rows
                if None in found:
                    kept, part = [], rows
                elif found.issuperset(entry["files"]):
                    kept, part = [], rows
                else:
                    kept = [f for f in entry["files"] if f not in found]
                    part = rows.join(F.broadcast(named).select(F.col(E.FILE).alias("__of")), F.col(E.FILE) == F.col("__of"), "left").filter(F.col(E.FILE).isNull() | F.col("__of").isNotNull())
                entry["files"] = kept + self.storage.write_rows(part.select(*columns), folder)
                images = changes.select(F.explode(F.array(F.struct(F.col(E.BEFORE).alias("image"), F.lit(False).alias("new")), F.struct(F.col("__after").alias("image"), F.lit(True).alias("new")))).alias("i"))
                sums = images.select(H.digest(F.col("i.image")).alias("h"), F.col("i.new").alias("new")).filter("h is not null").groupBy("new").agg(*H.lane_sums(F.col("h"))).collect()  # two rows at most
                for r in sums:
                    entry["lanes"] = list(H.add(tuple(entry["lanes"]), H.lanes_of(r), 1 if r["new"] else -1))
            else:
                entry["files"] = self.storage.write_rows(rows.select(*columns), folder)
                entry["lanes"] = list(H.collect_lanes(self.storage.read_rows(entry["files"], schema).select(H.digest(H.encoded(schema)).alias("h")), "h"))

    def _row_effects(self, work: Work, changed: dict[str, DataFrame], schema_tables: set[str]) -> DataFrame | None:
        parts = [E.complete(t, E.merge_changes(c)) for t, c in changed.items() if t not in schema_tables]
        out = None
        for p in parts:
            out = p if out is None else out.unionAll(p)
        return out

    @staticmethod
    def _ranks(tables: dict[str, dict]) -> dict[str, int]:
        names = {fold(n): n for n in tables}
        references = {n: {names.get(fold(fk["table"]), fk["table"]) for fk in e["fks"]} for n, e in tables.items()}
        return {n: k for k, n in enumerate(E.dependency_order(list(tables), references))}

    def _stage(self, work: Work) -> dict[str, DataFrame]:
        """Changed rows, held so that checks, effects and files are made from one scan."""
        return self._changes(work)

    def _publish(self, work: Work, kind: str, message: str, operations: list[dict], plan_hash: str, now: int, target: str | None = None, expect: dict | None = None) -> Commit:
        head = self.head()
        seq = (head["seq"] if head else 0) + 1
        changed = self._stage(work)
        try:
            self._check_constraints(work, changed)
            schema_effects = self._schema_effects(work)
            rows = self._row_effects(work, changed, {e["table"] for e in schema_effects})
            self._write_tables(work, changed, seq)
            schema_effects = self._schema_effects(work)
            count, lanes = 0, H.EMPTY
            place, tables = f"_log/row_effect/seq={seq}", {e["table"] for e in schema_effects}
            if rows is not None:
                rows = rows.persist()
                by = {r["table_name"]: r["count"] for r in rows.groupBy("table_name").count().collect()}  # one row a table
                count, tables = sum(by.values()), tables | set(by)
                if count:
                    E.number_effects(rows, self._ranks(work.before["tables"] | work.manifest["tables"]), count).write.mode("overwrite").parquet(self.storage.path(place))
                    lanes = self._effect_lanes(self.effects(seq - 1, seq))
                rows.unpersist()
        finally:
            for c in changed.values():
                c.unpersist()
            work.drop_caches()
            for place in work.scratch:
                self.storage.delete(place)
        commit = Commit(
            seq=seq, kind=kind, message=message, createdAt=now, parentIds=[head["commitId"]] if head else [], parentCount=1 if head else 0,
            schemaHashBefore=schema_hash(work.before), schemaHashAfter=schema_hash(work.manifest), stateHashAfter=state_hash(work.manifest), planHash=plan_hash,
            revertible=True, revertTargetId=target, operations=operations, schemaEffects=schema_effects, rowEffectDigest=H.lanes_hex(lanes),
            operationCount=len(operations), rowEffectCount=count, schemaEffectCount=len(schema_effects), tables=sorted(tables), manifest=work.manifest,
        )
        commit["bytes"] = len(H.canonical_json({k: v for k, v in commit.items() if k != "manifest"}))
        commit["commitId"] = commit.compute_id()
        for key in ("commitId", "schemaHashAfter", "stateHashAfter"):
            if expect and expect[key] != commit[key]:
                self.storage.delete(place)
                raise EngineError("INTEGRITY_ERROR", f"replay of {expect['commitId']} gives another {key}", {"expected": expect[key], "actual": commit[key]})
        if not self.storage.put_if_absent(f"_log/commits/{seq:020d}.json", commit):
            raise EngineError("STALE_PLAN", f"another commit {seq} was published first")
        self.storage.put("_log/refs/main.json", {"seq": seq, "commitId": commit["commitId"], "updatedAt": now})
        self.storage.put(f"_log/reflog/{seq:020d}-{now}.json", {"ref": "main", "old": head and head["commitId"], "new": commit["commitId"], "reason": kind, "createdAt": now})
        self._maybe_snapshot(commit)
        return commit

    @staticmethod
    def _signed_effect() -> Column:
        """Digest of all that a commit's id says of a row effect."""
        return H.digest(F.concat_ws("\x1f", "table_name", "pk_json", "op_kind", F.coalesce("before_json", F.lit("\x1e")), F.coalesce("after_json", F.lit("\x1e")), F.col("effect_index").cast("string")))

    def _effect_lanes(self, effects: DataFrame) -> H.Lanes:
        return H.collect_lanes(effects.select(self._signed_effect().alias("h")), "h")

    # -- N17, N18: apply and check --------------------------------------------------------------------

    def _tracked(self, manifest: dict) -> None:
        bare = sorted(n for n, e in manifest["tables"].items() if not e["pk"])
        if bare:
            raise EngineError("NO_PRIMARY_KEY", f"{bare[0]} has no primary key and can't be tracked")

    def _run(self, work: Work, plan: Plan) -> None:
        for op in plan.operations:
            work.run(op)
        for table in list(work.pending):
            work.load(table)

    def apply(self, plan: Plan | str | dict) -> Commit:
        plan = plan if isinstance(plan, Plan) else parse_plan(plan)
        manifest, now = self.manifest(), self._clock()
        actual = schema_hash(manifest)
        if plan.base_schema_hash.lower() != actual:
            raise EngineError("STALE_PLAN", "the schema has changed since the plan was made", {"expected": plan.base_schema_hash, "actual": actual})
        self._tracked(manifest)
        work = self._work(manifest, now)
        self._run(work, plan)
        return self._publish(work, "apply", plan.message, plan.operations, H.sha256_hex(plan.to_json()), now)

    def check(self, plan: Plan | str | dict) -> dict:
        """A dry run: what the plan would do, and how risky it is.  Nothing is written."""
        plan = plan if isinstance(plan, Plan) else parse_plan(plan)
        manifest = self.manifest()
        kinds = [op["type"] for op in plan.operations]
        schema_ops = sum(k in SCHEMA_OPERATIONS for k in kinds)
        warnings = [
            {"code": "DESTRUCTIVE_OPERATION", "message": f"operation {k} ({op['type']}) changes or removes what is there", "operationIndex": k, "operationType": op["type"], "table": op.get("table")}
            for k, op in enumerate(plan.operations) if op["type"] in DESTRUCTIVE_OPERATIONS
        ]
        predicted: dict[str, Any] = {"rowEffects": 0, "schemaEffects": 0, "tables": []}
        errors: list[dict] = []
        changed: dict[str, DataFrame] = {}
        work = None
        actual = schema_hash(manifest)
        if plan.base_schema_hash.lower() != actual:
            errors.append({"code": "STALE_PLAN", "message": "the schema has changed since the plan was made", "detail": {"expected": plan.base_schema_hash, "actual": actual}})
        else:
            try:
                self._tracked(manifest)
                work = self._work(manifest, self._clock())
                self._run(work, plan)
                changed = self._stage(work)
                self._check_constraints(work, changed)
                found = {e["table"] for e in self._schema_effects(work)}
                rows = self._row_effects(work, changed, found)
                by = {r["table_name"]: r["count"] for r in rows.groupBy("table_name").count().collect()} if rows is not None else {}
                predicted = {"rowEffects": sum(by.values()), "schemaEffects": len(found), "tables": sorted({*by, *found})}
            except EngineError as e:
                errors.append({"code": e.code, "message": e.message})
            except Exception as e:  # noqa: BLE001  the plan fails, whatever the reason
                errors.append({"code": "PLAN_CHECK_FAILED", "message": str(e).splitlines()[0]})
            finally:
                for c in changed.values():
                    c.unpersist()
                for place in work.scratch if work else ():
                    self.storage.delete(place)
        risk = "high" if errors or warnings else "medium" if schema_ops or predicted["schemaEffects"] else "low"
        summary = {
            "operations": len(kinds), "schemaOperations": schema_ops, "dataOperations": len(kinds) - schema_ops, "destructiveOperations": len(warnings),
            "touchedTables": sorted({op["table"] for op in plan.operations if "table" in op}), "predicted": predicted,
        }
        return {"ok": not errors, "risk": risk, "errors": errors, "warnings": warnings, "summary": summary, "checkedAt": datetime.now(UTC).isoformat()}

    def define(self, tables: dict[str, dict] | None = None, views: dict[str, str] | None = None, message: str = "define", frames: dict[str, DataFrame] | None = None) -> Commit:
        """Objects that plans can't make: foreign keys, indexes, triggers, composite keys, views, loaded tables.

        ``tables``: name to entry fields (columns, pk, checks, fks, indexes, triggers, sequence, generated: name to
        expression of a column that is computed when read, never stored); ``frames``: rows to load, by table name,
        for new tables.
        """
        manifest, now = self.manifest(), self._clock()
        work = self._work(manifest, now)
        for name, fields in (tables or {}).items():
            check_identifier(name, "table")
            old = work.manifest["tables"].get(name)
            if old:
                work.load(name)
            columns = fields.get("columns") or old["columns"]
            pk = fields.get("pk") or [c["name"] for c in columns if c.get("primaryKey")]
            more = {k: v for k, v in fields.items() if k not in ("columns", "pk")}
            work.manifest["tables"][name] = (old or new_entry(columns, pk)) | {"columns": columns, "pk": pk} | more
            self._check_generated(name, work.manifest["tables"][name])
            if frames and name in frames:
                rows = frames[name].select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema_of(work.manifest["tables"][name])])
                work.rows[name] = rows.select("*", *new_marks())
        for name, sql in (views or {}).items():
            work.manifest["views"][check_identifier(name, "view")] = {"sql": sql}
        operations = [{"type": "define", "tables": sorted(tables or {}), "views": sorted(views or {})}]
        return self._publish(work, "define", message, operations, H.sha256_hex(operations), now)

    def _check_generated(self, table: str, entry: dict) -> None:
        taken = {fold(c["name"]) for c in entry["columns"]}
        for column in entry.get("generated", {}):
            if fold(check_identifier(column, "column")) in taken:
                raise EngineError("INVALID_OPERATION", f"{table} has two columns {column}")
            taken.add(fold(column))
        try:
            with_generated(self.spark.createDataFrame([], schema_of(entry)), entry).schema
        except AnalysisException as e:
            raise EngineError("INVALID_OPERATION", f"a generated column of {table}: {str(e).strip().splitlines()[0]}") from e

    # -- N20, N22: effects ----------------------------------------------------------------------------

    def _apply_effects(self, work: Work, rows: DataFrame, schema_effects: list[dict], code: str, publish: bool = False) -> list[dict]:
        """Run effects (before to after) on the working state; conflicts where the rows are not as before.

        Where it is to be published, effects that meet the rows as stored are kept as its changes: their images have
        been held against the rows and needn't be made again.
        """
        for e in schema_effects:
            if e.get("kind") == "view":
                work.manifest["views"].pop(e["table"], None)
                if e["after"]:
                    work.manifest["views"][e["table"]] = e["after"]
            else:
                work.restore_table(e["table"], e["after"])
        conflicts = []
        for table in [r[0] for r in rows.select("table_name").distinct().collect()]:  # one row a table
            if table not in work.manifest["tables"]:
                conflicts.append({"kind": "schema", "table": table, "reason": f"{table} is not there any more"})
                continue
            entry, schema = work.manifest["tables"][table], schema_of(work.manifest["tables"][table])
            own = rows.filter(F.col("table_name") == table).select(F.col("pk_json").alias("__pk"), "op_kind", F.col("before_hash").alias("__bh"), F.col("before_json").alias("__bj"), F.col("after_json").alias("__aj"))
            stored = table not in work.rows and table not in work.pending
            current = work.load(table)
            now = current.withColumn("__pkn", H.encoded(schema, entry["pk"]))
            # only rows that an effect meets are encoded and hashed
            held = own.join(now.filter(F.col(E.ALIVE)), now["__pkn"] == own["__pk"], "left")
            met = F.when(F.col("__pkn").isNotNull(), H.digest(H.encoded(schema)))
            form, known = H.form(schema), None
            if publish and stored and form:
                fits = F.coalesce(F.rlike("__aj", F.lit(form)), F.lit(True))
                known = held.select("__pk", "op_kind", "__bj", "__aj", E.FILE, (~F.col("__bh").eqNullSafe(met)).alias("__wrong"), fits.alias("__fits")).persist()
                work.caches.append(known)
                wrong = known.filter("__wrong").select(F.col("__pk").alias("pk_json"), "op_kind")
                bad, odd = known.agg(F.count_if("__wrong"), F.count_if(~F.col("__fits"))).first()
            else:
                wrong = held.filter(~F.col("__bh").eqNullSafe(met)).select(F.col("__pk").alias("pk_json"), "op_kind")
                bad, odd = wrong.agg(F.count("*")).first()[0], 0  # all tasks at once
            if bad:
                first = wrong.limit(REPORTED + 1).collect()
                conflicts += [{"kind": "row", "table": table, "pk": r["pk_json"], "op": r["op_kind"]} for r in first[:REPORTED]]
                if len(first) > REPORTED:
                    self._keep_conflicts(table, wrong, conflicts)
            hit = F.col("__pk").isNotNull()
            joined = now.join(own, now["__pkn"] == own["__pk"], "left")
            cells = [F.when(hit & F.col("__aj").isNotNull(), H.cell(F.col("__aj"), f.name, f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) for f in schema]
            # images of rows as stored are made after the join, so they are not shuffled
            began = [H.encoded(schema).alias(E.BEFORE), F.col("__pkn").alias(E.KEY)] if stored else [E.BEFORE, E.KEY]
            kept = joined.select(*cells, *began, (F.col(E.ALIVE) & ~(hit & F.col("__aj").isNull())).alias(E.ALIVE), E.FILE, (F.col(E.TOUCHED) | hit).alias(E.TOUCHED))
            fresh = own.filter("op_kind = 'insert'").select(*[H.cell(F.col("__aj"), f.name, f.dataType).alias(f.name) for f in schema], *new_marks())
            work.rows[table] = kept.unionByName(fresh)
            if known is not None and not odd:
                work.known[table] = work.rows[table], E.changes_of(known)
            if entry.get("sequence") is not None and len(entry["pk"]) == 1:
                top = work.rows[table].filter(F.col(E.ALIVE)).agg(F.max(F.col(f"`{entry['pk'][0]}`"))).first()[0]
                entry["sequence"] = max(entry["sequence"], int(top or 0))
        return conflicts

    def _keep_conflicts(self, table: str, wrong: DataFrame, conflicts: list[dict]) -> None:
        """Write all conflicts of a table where a report lists only the first, and say where they are."""
        place = f"_log/conflicts/{uuid.uuid4().hex}"
        rows = wrong.select(F.lit(table).alias("table"), F.col("pk_json").alias("pk"), F.col("op_kind").alias("op"))
        rows.write.parquet(self.storage.path(place))
        conflicts.append({"kind": "more", "table": table, "count": self.spark.read.parquet(self.storage.path(place)).count(), "all": place})

    def conflicts(self, place: str) -> DataFrame:
        """(table, pk, op) of every conflict, at the place that a report names."""
        return self.spark.read.parquet(self.storage.path(place))

    def replay(self, commit: Commit, source: Engine) -> Commit:
        """Apply a commit of another replica here; every hash has to come out as there."""
        manifest = self.manifest()
        if schema_hash(manifest) != commit["schemaHashBefore"]:
            raise EngineError("INTEGRITY_ERROR", f"the schema here is not what {commit['commitId']} was made on")
        work = self._work(manifest, commit["createdAt"])
        schema_effects = [dict(e, after=self._adopt(e["after"], source)) if e.get("kind") != "view" else e for e in commit["schemaEffects"]]
        conflicts = self._apply_effects(work, source.commit_effects(commit, ordered=False), schema_effects, "INTEGRITY_ERROR", publish=True)
        if conflicts:
            work.drop_caches()
            raise EngineError("INTEGRITY_ERROR", f"rows here are not what {commit['commitId']} was made on", conflicts[:20])
        for name, entry in commit["manifest"]["tables"].items():
            if name in work.manifest["tables"]:
                work.manifest["tables"][name]["sequence"] = entry["sequence"]
        # a schema effect restores files as a whole; the rest of the manifest follows from rows
        return self._publish(work, commit["kind"], commit["message"], commit["operations"], commit["planHash"], commit["createdAt"], commit["revertTargetId"], commit)

    def _adopt(self, entry: dict | None, source: Engine) -> dict | None:
        """An entry of another root, its files copied here."""
        if entry is None or source.storage.root == self.storage.root:
            return entry
        for f in entry["files"]:
            if not self.storage.exists(f):
                source.storage.copy_to(f, self.storage, f)
        return entry

    # -- R: revert ------------------------------------------------------------------------------------

    def revert(self, commit_id: str) -> dict:
        """Undo a commit by a new one; what stands in the way is returned, not raised."""
        target = self.find_commit(commit_id)
        if not target["revertible"]:
            raise EngineError("NOT_REVERTIBLE", f"{commit_id} can't be reverted")
        later = self.list_commits(target["seq"])
        if any(c["revertTargetId"] == commit_id for c in later):
            raise EngineError("ALREADY_REVERTED", f"{commit_id} was reverted already")
        manifest, now = self.manifest(), self._clock()
        effects = self.commit_effects(target, ordered=False)
        conflicts: list[dict] = []
        reverted = {e["table"] for e in target["schemaEffects"]}
        for c in later:
            conflicts += [{"kind": "schema", "table": e["table"], "reason": f"its schema was changed by {c['commitId']}"} for e in c["schemaEffects"] if e["table"] in reverted]
        if reverted:
            for table in sorted(reverted):
                touched = self.effects(target["seq"]).filter(F.col("table_name") == table).select("pk_json", "op_kind").distinct()
                first = touched.limit(REPORTED + 1).collect()
                conflicts += [{"kind": "schema", "table": table, "pk": r[0], "reason": "rows were changed since, which reverting the schema would drop"} for r in first[:REPORTED]]
                if len(first) > REPORTED:
                    self._keep_conflicts(table, touched, conflicts)
        if not conflicts:
            work = self._work(manifest, now)
            swapped = [dict(e, before=e["after"], after=e["before"]) for e in target["schemaEffects"]]
            found = self._apply_effects(work, E.inverse(effects), swapped, "REVERT_FAILED", publish=True)
            if found:
                work.drop_caches()
            for f in found:
                if f["kind"] == "more":
                    conflicts.append(f)
                    continue
                reasons = {"insert": "the deleted row is there again", "delete": "the inserted row was changed or removed since", "update": "the row was changed since"}
                conflicts.append({k: v for k, v in f.items() if k != "op"} | ({"reason": reasons[f["op"]]} if "op" in f else {}))
        if not conflicts:
            try:
                commit = self._publish(work, "revert", f"Revert: {target['message']}", [], H.sha256_hex([]), now, commit_id)
                return {"ok": True, "commit": commit, "conflicts": []}
            except EngineError as e:
                if e.code not in ("APPLY_FAILED", "FK_VIOLATION"):
                    raise
                table = e.message.partition(": ")[2].partition(".")[0]
                row = e.message.startswith(("UNIQUE", "NOT NULL"))
                conflicts.append({"kind": "row" if row else "schema", "table": table if row else "(unknown)", "reason": e.message})
        return {"ok": False, "commit": None, "conflicts": conflicts}

    # -- N24: verify ----------------------------------------------------------------------------------

    def verify(self, full: bool = False) -> dict:
        """Recompute every commit id; quick: files are there; full: every table's lanes from its rows."""
        issues, parent = [], None
        signed = self.effects().select("seq", self._signed_effect().alias("h"))
        lanes = {r["seq"]: H.lanes_of(r) for r in signed.groupBy("seq").agg(*H.lane_sums(F.col("h"))).collect()}  # one row a commit
        for c in self.list_commits():
            digest = H.lanes_hex(lanes.get(c["seq"], H.EMPTY))
            if digest != c["rowEffectDigest"] or c.compute_id() != c["commitId"]:
                issues.append(f"Commit hash mismatch: {c['commitId']}")
            if c["parentCount"] != len(c["parentIds"]) or c["parentIds"] != ([parent] if parent else []):
                issues.append(f"Parent mismatch: {c['commitId']}")
            parent = c["commitId"]
        chain = not issues
        manifest = self.manifest()
        lost = [f for e in manifest["tables"].values() for f in e["files"] if not self.storage.exists(f)]
        issues += [f"File missing: {f}" for f in lost]
        integrity = None
        if full and not lost:
            for name, e in manifest["tables"].items():
                schema = schema_of(e)
                if list(H.collect_lanes(self.table(name).select(H.digest(H.encoded(schema)).alias("h")), "h")) != e["lanes"]:
                    issues.append(f"Rows of {name} differ from the state hash")
            integrity = "ok" if len(issues) == (not chain) else "failed"
        now = datetime.now(UTC).isoformat()
        self.set_meta(last_verified_at=now, last_verified_ok=not issues)
        return {"ok": not issues, "mode": "full" if full else "quick", "chainValid": chain, "quickCheck": "ok" if not lost else "failed", "integrityCheck": integrity, "issues": issues, "checkedAt": now}

    # -- N25, N26: snapshots --------------------------------------------------------------------------

    def _maybe_snapshot(self, commit: Commit) -> None:
        if commit["seq"] % SNAPSHOT_INTERVAL == 0:
            self.snapshot(commit)
            for old in self.storage.list("snapshots")[:-SNAPSHOTS_KEPT]:
                self.storage.delete(f"snapshots/{old}")

    def snapshot(self, commit: Commit | None = None) -> dict:
        """Copy the tables of a commit, with a manifest of their digests."""
        commit = commit or self.head()
        if commit is None:
            raise EngineError("SNAPSHOT_FAILED", "there is no commit yet")
        folder = f"snapshots/{commit['seq']:020d}"
        manifest = {"tables": {}, "views": commit["manifest"]["views"]}
        for name, e in commit["manifest"]["tables"].items():
            files = self.storage.write_rows(self.storage.read_rows(e["files"], schema_of(e)), f"{folder}/{H.sha256_hex(name)[:16]}")
            manifest["tables"][name] = e | {"files": files}
        record = {"commitId": commit["commitId"], "seq": commit["seq"], "createdAt": self._clock(), "rowCountHint": sum(e["lanes"][-1] for e in manifest["tables"].values()), "manifest": manifest}
        record["sha256"] = H.sha256_hex(manifest)
        self.storage.put(f"{folder}/snapshot.json", record)
        return record

    def snapshots(self) -> list[dict]:
        found = (self.storage.read(f"snapshots/{n}/snapshot.json") for n in self.storage.list("snapshots"))
        return [s for s in found if s]

    def recover(self, commit_id: str) -> dict:
        """Rebuild from the snapshot of ``commit_id`` and the commits after it, aside, then take its place."""
        snap = next((s for s in self.snapshots() if s["commitId"] == commit_id), None)
        if snap is None:
            raise EngineError("NOT_FOUND", f"no snapshot of {commit_id}")
        if H.sha256_hex(snap["manifest"]) != snap["sha256"]:
            raise EngineError("RECOVER_FAILED", "the snapshot's manifest was changed")
        for name, e in snap["manifest"]["tables"].items():
            schema = schema_of(e)
            if list(H.collect_lanes(self.storage.read_rows(e["files"], schema).select(H.digest(H.encoded(schema)).alias("h")), "h")) != e["lanes"]:
                raise EngineError("RECOVER_FAILED", f"the snapshot's rows of {name} were changed")
        staging = Engine.init(self.spark, f"{self.storage.root}.staging", force_new=True, clock=self._clock)
        try:
            for c in self.list_commits():
                if c["seq"] > snap["seq"]:
                    staging.replay(c, self)
                    continue
                if self.storage.exists(f"_log/row_effect/seq={c['seq']}"):
                    self.storage.copy_to(f"_log/row_effect/seq={c['seq']}", staging.storage, f"_log/row_effect/seq={c['seq']}")
                if c["seq"] == snap["seq"]:
                    tables = {}
                    for name, e in snap["manifest"]["tables"].items():
                        folder = f"tables/{H.sha256_hex(name)[:16]}/v={c['seq']}-recovered"
                        tables[name] = e | {"files": staging.storage.write_rows(self.storage.read_rows(e["files"], schema_of(e)), folder)}
                    c["manifest"] = snap["manifest"] | {"tables": tables}
                staging.storage.put_if_absent(f"_log/commits/{c['seq']:020d}.json", c)
                staging.storage.put("_log/refs/main.json", {"seq": c["seq"], "commitId": c["commitId"], "updatedAt": c["createdAt"]})
        except Exception as e:
            staging.storage.delete("")
            raise e if isinstance(e, EngineError) and e.code == "RECOVER_FAILED" else EngineError("RECOVER_FAILED", f"replay failed: {e}") from e
        for n in self.storage.list("snapshots"):
            self.storage.copy_to(f"snapshots/{n}", staging.storage, f"snapshots/{n}")
        staging.storage.promote(self.storage)
        head = self.head()
        return {"ok": True, "from": commit_id, "headCommit": head["commitId"], "replayed": head["seq"] - snap["seq"]}

    # -- N27: status ----------------------------------------------------------------------------------

    def status(self) -> dict:
        head, manifest = self.head(), self.manifest()
        totals = self.commits_df().agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
        return {
            "root": self.storage.root, "tableCount": len(manifest["tables"]), "tables": [{"name": n, "count": e["lanes"][-1]} for n, e in sorted(manifest["tables"].items())],
            "headCommit": head and {k: head[k] for k in ("commitId", "seq", "kind", "message", "createdAt")}, "snapshotCount": len(self.snapshots()),
            "lastVerifiedAt": self.meta("last_verified_at"), "lastVerifiedOk": self.meta("last_verified_ok"), "sync": self.meta("sync", {"state": "unconfigured"}),
            "storage": {"commitCount": totals.n, "estimatedHistoryBytes": totals.b, "latestCommitEstimatedBytes": head and head["bytes"]},
        }

    def size_warning(self, commit: Commit) -> dict | None:
        if commit["bytes"] < LARGE_COMMIT:
            return None
        return {"code": "LARGE_COMMIT", "bytes": commit["bytes"], "limit": LARGE_COMMIT}
