import pytest
from pyspark.sql import functions as F

from stratum.engine import Engine
from stratum.errors import EngineError
from stratum.operators import browse, history
from stratum.operators import effects as E
from stratum.operators.work import schema_of
from stratum.read import read
from stratum.sources.replica import Replica, mask_secrets
from stratum.streaming import feed

ID = {"name": "id", "type": "INTEGER", "primaryKey": True}
TASKS = {"type": "create_table", "table": "tasks", "columns": [ID, {"name": "title", "type": "TEXT", "notNull": True}, {"name": "n", "type": "REAL", "default": {"kind": "literal", "value": 1.5}}]}


def insert(table, **values):
    return {"type": "insert", "table": table, "values": values}


def update(table, values, **where):
    return {"type": "update", "table": table, "values": values, "where": where}


def delete(table, **where):
    return {"type": "delete", "table": table, "where": where}


def rows(engine, table="tasks"):
    return sorted(tuple(r) for r in engine.table(table).collect())


def fails(code, f, *a, **k):
    with pytest.raises(EngineError) as e:
        f(*a, **k)
    assert e.value.code == code, e.value
    return e.value


def test_rows_effects_and_history(engine, do):
    assert engine.status()["tableCount"] == 0
    do(TASKS)
    do(insert("tasks", title="a"), insert("tasks", title="b", n=2))
    c = do(update("tasks", {"title": "bb"}, id=2), delete("tasks", id=1), insert("tasks", title="c"))
    assert rows(engine) == [(2, "bb", 2.0), (3, "c", 1.5)]
    kinds = [r.op_kind for r in engine.commit_effects(c).collect()]
    assert kinds == ["delete", "update", "insert"] and c["rowEffectCount"] == 3
    found = history.history(engine.commits_df(), table="TASKS")
    assert [h["seq"] for h in found] == [3, 2, 1] and found[0]["affectedTables"] == ["tasks"]
    assert sorted(tuple(r) for r in engine.table_as_of("tasks", 2).collect()) == [(1, "a", 1.5), (2, "b", 2.0)]
    assert [r.seq for r in engine.effects(after=2).select("seq").distinct().collect()] == [3]
    v = engine.verify(full=True)
    assert v["ok"] and v["chainValid"]
    shown = browse.query_table(engine, "TASKS", filters={"title": "B"}, page=9)
    assert (shown["page"], shown["totalRows"], shown["rows"][0]["title"]) == (1, 1, "bb")
    fails("INVALID_OPERATION", browse.query_table, engine, "tasks", sort_by="nope")
    assert browse.describe_db(engine)["tables"][0]["rowCount"] == 2
    assert [r.title for r in read(engine, "SELECT title FROM tasks ORDER BY id;").collect()] == ["bb", "c"]
    assert read(engine, "SELECT count(*) AS n FROM _stratum_row_effect").first().n == 5
    seen = []
    feed.follow(engine, engine.storage.path("cp"), lambda df, i: seen.append(df.count())).awaitTermination(60)
    assert sum(seen) == 5 and feed.projection(engine, "tasks").count() == 2


def test_stale_plan_and_dry_run(engine, do):
    do(TASKS)
    fails("STALE_PLAN", do, insert("tasks", title="x"), base="0" * 64)
    report = engine.check({"baseSchemaHash": engine.schema_hash(), "message": "m", "operations": [insert("tasks", title="x")]})
    assert report["ok"] and report["risk"] == "low" and report["summary"]["predicted"] == {"rowEffects": 1, "schemaEffects": 0, "tables": ["tasks"]}
    report = engine.check({"baseSchemaHash": "0" * 64, "message": "m", "operations": [delete("tasks", id=1)]})
    assert not report["ok"] and report["risk"] == "high" and report["errors"][0]["code"] == "STALE_PLAN"
    assert rows(engine) == [] and engine.head()["seq"] == 1


def test_constraints(engine, do):
    do(TASKS, {"type": "add_check", "table": "tasks", "expression": "n > 0"})
    do(insert("tasks", id=1, title="a"))
    fails("APPLY_FAILED", do, insert("tasks", id=1, title="b"))
    fails("APPLY_FAILED", do, insert("tasks", n=1))
    fails("APPLY_FAILED", do, update("tasks", {"n": -1}, id=1))
    fails("APPLY_FAILED", do, insert("tasks", id="x", title="b"))
    fails("INVALID_OPERATION", do, {"type": "add_check", "table": "tasks", "expression": "N  >  0"})
    fails("APPLY_FAILED", do, {"type": "add_check", "table": "tasks", "expression": "n > 5"})
    do(insert("tasks", title="null passes", n=None))
    do({"type": "drop_check", "table": "tasks", "expression": "n>0"}, update("tasks", {"n": -1}, id=1))
    assert rows(engine)[0][2] == -1.0
    fails("INVALID_OPERATION", do, {"type": "drop_check", "table": "tasks", "expression": "n > 0"})


def test_schema_operations(engine, do):
    do(TASKS, insert("tasks", title="12abc", n=3.9))
    c = do({"type": "alter_column_type", "table": "tasks", "column": "n", "newType": "INTEGER"}, {"type": "add_column", "table": "tasks", "column": {"name": "k", "type": "TEXT", "default": {"kind": "literal", "value": "z"}}})
    assert (c["rowEffectCount"], c["schemaEffectCount"]) == (0, 1) and rows(engine) == [(1, "12abc", 3, "z")]
    do({"type": "alter_column_type", "table": "tasks", "column": "title", "newType": "INTEGER"})
    assert rows(engine) == [(1, 12, 3, "z")]
    d = do({"type": "drop_column", "table": "tasks", "column": "k"})
    fails("INVALID_OPERATION", do, {"type": "drop_column", "table": "tasks", "column": "id"})
    assert engine.revert(d["commitId"])["ok"] and rows(engine) == [(1, 12, 3, "z")]
    do({"type": "drop_table", "table": "TASKS"})
    fails("NOT_FOUND", engine.table, "tasks")
    assert history.history(engine.commits_df(), table="tasks")[0]["schemaEffectCount"] == 1


@pytest.fixture
def family(engine, do):
    do({"type": "create_table", "table": "parent", "columns": [ID]}, {"type": "create_table", "table": "child", "columns": [ID, {"name": "pid", "type": "INTEGER"}, {"name": "email", "type": "TEXT", "unique": True}]})
    engine.define({"child": {"fks": [{"table": "parent", "columns": ["pid"], "referenced": ["id"], "onDelete": "CASCADE"}]}}, views={"v": "SELECT c.email FROM child c"})
    do(insert("parent", id=1), insert("child", pid=1, email="a"), insert("child", pid=1, email="b"))
    return engine


def test_references(family, do):
    fails("FK_VIOLATION", do, insert("child", pid=9, email="q"))
    fails("FK_VIOLATION", do, update("parent", {"id": 5}, id=1))
    fails("APPLY_FAILED", do, insert("child", pid=1, email="a"))
    assert fails("DEPENDENCY_CONFLICT", do, {"type": "drop_table", "table": "parent"}).detail["conflicts"][0]["type"] == "fk"
    c = do(delete("parent", id=1))
    assert c["tables"] == ["child", "parent"] and rows(family, "child") == []
    order = [(r.table_name, r.op_kind) for r in family.commit_effects(c).collect()]
    assert order == [("child", "delete"), ("child", "delete"), ("parent", "delete")]
    r = family.revert(c["commitId"])
    assert r["ok"] and len(rows(family, "child")) == 2
    fails("ALREADY_REVERTED", family.revert, c["commitId"])
    again = family.revert(r["commit"]["commitId"])
    assert again["ok"] and rows(family, "child") == []


def test_view_dependency(family, do):
    family.define({"plain": {"columns": [ID, {"name": "x", "type": "TEXT"}, {"name": "y", "type": "TEXT"}]}}, views={"w": "SELECT x, 'y' AS z FROM plain"})
    do({"type": "drop_column", "table": "plain", "column": "y"})
    e = fails("DEPENDENCY_CONFLICT", do, {"type": "drop_column", "table": "plain", "column": "x"})
    assert e.detail["suggestedOps"] == [{"type": "drop_view", "name": "w"}]
    do({"type": "drop_view", "name": "W"}, {"type": "drop_column", "table": "plain", "column": "x"})


def test_revert_conflicts(engine, do):
    do(TASKS)
    c = do(insert("tasks", id=1, title="a"))
    do(update("tasks", {"title": "b"}, id=1))
    r = engine.revert(c["commitId"])
    assert not r["ok"] and r["conflicts"][0]["kind"] == "row" and engine.head()["seq"] == 3
    s = do({"type": "add_column", "table": "tasks", "column": {"name": "k", "type": "TEXT"}})
    do(update("tasks", {"k": "x"}, id=1))
    assert {x["kind"] for x in engine.revert(s["commitId"])["conflicts"]} == {"schema"}
    fails("NOT_FOUND", engine.revert, "0" * 64)


def test_unique_conflict_on_revert(family, do):
    c = do(delete("child", email="a"))
    do(insert("child", id=77, pid=1, email="a"))
    r = family.revert(c["commitId"])
    assert not r["ok"] and "UNIQUE" in r["conflicts"][0]["reason"]


def test_fidelity(engine, do):
    do({"type": "create_table", "table": "t", "columns": [ID, {"name": "b", "type": "BLOB"}, {"name": "s", "type": "TEXT"}, {"name": "big", "type": "INTEGER"}]})
    do(insert("t", id=1, b="x", s="A\0B é", big=9223372036854775806))
    c = do(update("t", {"big": 9223372036854775807, "s": None}, id=1))
    assert engine.revert(c["commitId"])["ok"]
    r = engine.table("t").first()
    assert (bytes(r.b), r.s, r.big) == (b"x", "A\0B é", 9223372036854775806)


def test_tracking_needs_a_key(engine, do):
    engine.define({"bare": {"columns": [{"name": "a", "type": "TEXT"}]}})
    fails("NO_PRIMARY_KEY", do, TASKS)


def test_large_commit_and_sequence(engine, do):
    engine.define({"auto": {"columns": [ID, {"name": "v", "type": "TEXT"}], "sequence": 0}})
    c = do(*[insert("auto", v=str(k)) for k in range(320)])
    assert c["rowEffectCount"] == 320 and engine.size_warning(c) is None
    do(delete("auto", id=320))
    do(insert("auto", v="next"))
    assert max(rows(engine, "auto"))[0] == 321


def test_files_without_changes_are_kept(engine, do):
    do(TASKS, insert("tasks", title="a"))
    first = set(engine.manifest()["tables"]["tasks"]["files"])
    do(insert("tasks", title="b"))
    assert first < set(engine.manifest()["tables"]["tasks"]["files"])
    before = engine.state_hash()
    c = do(update("tasks", {"title": "x"}, id=2))
    assert engine.revert(c["commitId"])["ok"] and engine.state_hash() == before


def test_tampering_is_found(engine, do):
    do(TASKS, insert("tasks", title="a"))
    name = "_log/commits/00000000000000000001.json"
    body = engine.storage.read(name)
    engine.storage.put(name, body | {"message": "other"})
    v = engine.verify()
    assert not v["ok"] and not v["chainValid"] and engine.status()["lastVerifiedOk"] is False


def test_recover(engine, do, spark):
    do(TASKS)
    c = do(insert("tasks", title="a"))
    engine.snapshot()
    last = do(insert("tasks", title="b"))
    out = engine.recover(c["commitId"])
    assert out["replayed"] == 1 and engine.head()["commitId"] == last["commitId"] and len(rows(engine)) == 2 and engine.verify(full=True)["ok"]
    snap = engine.snapshots()[0]
    engine.storage.put(f"snapshots/{snap['seq']:020d}/snapshot.json", snap | {"sha256": "0" * 64})
    fails("RECOVER_FAILED", engine.recover, c["commitId"])
    assert len(rows(engine)) == 2


def test_replication(engine, do, spark, tmp_path):
    url = str(tmp_path / "remote")
    do(TASKS)
    do(insert("tasks", title="a"))
    fails("SYNC_NOT_CONFIGURED", Replica(engine).push)
    fails("CONFIG", Replica(engine).connect, "ftp://x/y")
    replica = Replica(engine, url)
    replica.connect(url)
    assert replica.status()["state"] == "pending" and replica.push()["pushed"] == 2 and replica.push()["pushed"] == 0
    other = Replica.clone(spark, url, str(tmp_path / "other"))
    assert other.state_hash() == engine.state_hash() and other.head()["commitId"] == engine.head()["commitId"]
    do(insert("tasks", title="mine"))
    other.apply({"baseSchemaHash": other.schema_hash(), "message": "theirs", "operations": [insert("tasks", title="theirs")]})
    Replica(other, url).push()
    fails("SYNC_NON_FAST_FORWARD", replica.push)
    fails("SYNC_DIVERGED", replica.pull)
    assert replica.auto_sync()["state"] == "conflict" and replica.status()["state"] == "conflict"
    assert Replica(other, url).verify_projection()["ok"]
    fails("CONFIG", Replica.clone, spark, url, str(tmp_path / "other"))


def test_secrets_are_masked():
    assert "hunter2" not in mask_secrets("https://u:hunter2@h/x?token=hunter2 Bearer hunter2")


def test_random_plans_revert_to_the_same_state(engine, do):
    import random

    rng = random.Random(5)
    do(TASKS, *[insert("tasks", id=k, title=str(k)) for k in range(1, 9)])
    for _ in range(3):
        before = engine.state_hash()
        keys = [r[0] for r in rows(engine)]
        ops = [rng.choice([update("tasks", {"title": str(rng.random())}, id=k), delete("tasks", id=k), update("tasks", {"id": k + 1000}, id=k)]) for k in rng.sample(keys, 3)]
        c = do(*ops, insert("tasks", title="new"))
        assert engine.revert(c["commitId"])["ok"] and engine.state_hash() == before


def test_open_needs_a_root(spark, tmp_path):
    fails("NOT_INITIALIZED", Engine.open, spark, str(tmp_path / "none"))


# -- numbering and replicas at any size -----------------------------------------------------------------


@pytest.mark.parametrize("task_effects", [7, 100_000])
def test_effect_numbers_do_not_depend_on_how_they_are_dealt(spark, tmp_path, monkeypatch, task_effects):
    from stratum.operators import effects as E

    monkeypatch.setattr(E, "TASK_EFFECTS", task_effects)
    rows = [(t, f"{k:03}", kind) for t in ("a", "b", "c") for k, kind in enumerate(["insert", "delete", "update"] * 9)]
    df = spark.createDataFrame(rows, "table_name string, pk_json string, op_kind string").repartition(5)
    ranks = {"b": 0, "a": 1, "c": 2}
    want = sorted(rows, key=lambda r: (E.PHASE[r[2]], -ranks[r[0]] if r[2] == "delete" else ranks[r[0]], r[1]))
    got = E.number_effects(df, ranks, len(rows), str(tmp_path / "numbering")).collect()
    assert {r.effect_index: (r.table_name, r.pk_json, r.op_kind) for r in got} == dict(enumerate(want))


def test_parents_come_first():
    from stratum.operators.effects import dependency_order

    assert dependency_order(["c", "b", "a"], {"a": {"b"}, "b": {"c"}}) == ["c", "b", "a"]
    assert dependency_order(["x", "y", "z"], {"x": {"y"}, "y": {"x"}, "z": {"x"}}) == ["x", "y", "z"]
    assert dependency_order(["n", "m"], {"n": {"n", "elsewhere"}}) == ["m", "n"]
    assert dependency_order([f"t{k:04}" for k in range(3000)], {f"t{k:04}": {f"t{k + 1:04}"} for k in range(2999)})[0] == "t2999"


@pytest.mark.parametrize("rows, task_effects", [(150, 10), (150_000, 100_000)])
def test_commits_of_any_size_replicate(spark, tmp_path, monkeypatch, rows, task_effects):
    from stratum.engine import Engine
    from stratum.operators import effects as E
    from stratum.sources.replica import Replica

    monkeypatch.setattr(E, "TASK_EFFECTS", task_effects)
    first = Engine.init(spark, str(tmp_path / "first"))
    columns = [{"name": "id", "type": "INTEGER", "primaryKey": True}, {"name": "v", "type": "TEXT"}]
    first.define({"t": {"columns": columns, "pk": ["id"]}}, frames={"t": spark.range(rows).select("id", F.lit("old").alias("v"))})
    first.snapshot()
    snapshot = first.head()["commitId"]
    first.apply({"baseSchemaHash": first.schema_hash(), "message": "all", "operations": [{"type": "update", "table": "t", "values": {"v": "new"}, "where": {"v": "old"}}]})
    assert first.effects().agg(F.countDistinct("effect_index"), F.max("effect_index")).first() == (rows, rows - 1)
    assert first.storage.list("_log/numbering") == []
    remote, before = str(tmp_path / "remote"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # ids must not depend on it
    try:
        assert Replica(first, remote).push()["pushed"] == 2
        clone = Replica.clone(spark, remote, str(tmp_path / "clone"))
        assert clone.head()["commitId"] == first.head()["commitId"] and clone.verify(full=True)["ok"]
        assert first.recover(snapshot)["replayed"] == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first.table("t").filter("v = 'new'").count() == rows


# -- plans of changes -----------------------------------------------------------------------------------


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_of_a_plan_reach_the_scan(engine, do, spark):
    columns = [{"name": "id", "type": "INTEGER", "primaryKey": True}, {"name": "v", "type": "TEXT"}, {"name": "w", "type": "TEXT"}]
    engine.define({"t": {"columns": columns, "pk": ["id"]}}, frames={"t": spark.range(100).selectExpr("id", "'a' AS v", "'b' AS w")})
    work = engine._work(engine.manifest(), 0)
    work.run({"type": "update", "table": "t", "values": {"w": "c"}, "where": {"id": 7}})
    work.run({"type": "delete", "table": "t", "where": {"v": "z"}})
    plan = physical(engine._changes(work)["t"])
    assert "EqualTo(id,7)" in plan and "EqualTo(v,z)" in plan and "Or(" in plan
    assert engine._changes(work)["t"].count() == 1


def test_cascades_of_many_levels(engine, do, spark):
    columns = [{"name": "id", "type": "INTEGER", "primaryKey": True}, {"name": "parent", "type": "INTEGER"}]
    fk = {"columns": ["parent"], "table": "T", "referenced": ["id"], "onDelete": "CASCADE"}
    rows = [(k, k - 1 if k % 50 else None) for k in range(60)]
    engine.define({"t": {"columns": columns, "pk": ["id"], "fks": [fk]}}, frames={"t": spark.createDataFrame(rows, "id long, parent long")})
    commit = do({"type": "delete", "table": "t", "where": {"id": 44}})
    assert commit["rowEffectCount"] == 6 and sorted(r.id for r in engine.table("t").collect()) == [*range(44), *range(50, 60)]
    assert engine.storage.list("_log/scratch") == []
    do({"type": "delete", "table": "t", "where": {"id": 50}}, {"type": "insert", "table": "t", "values": {"id": 50, "parent": 3}})
    assert sorted(r.id for r in engine.table("t").collect()) == [*range(44), 50]


# -- triggers -------------------------------------------------------------------------------------------

INT, TEXT = {"type": "INTEGER"}, {"type": "TEXT"}


def bank(engine, spark, *triggers):
    """account(id, balance), ledger(id, account_id, amount) and audit(id, note), with triggers by table."""
    made = {
        "account": ([{"name": "id", "primaryKey": True, **INT}, {"name": "balance", **INT}], [(1, 0), (2, 10)], "id long, balance long"),
        "ledger": ([{"name": "id", "primaryKey": True, **INT}, {"name": "account_id", **INT}, {"name": "amount", **INT}], [], "id long, account_id long, amount long"),
        "audit": ([{"name": "id", "primaryKey": True, **INT}, {"name": "note", **TEXT}], [], "id long, note string"),
    }
    tables = {n: {"columns": c, "pk": ["id"], "triggers": [{"name": f"{n}{k}", "sql": sql} for k, (t, sql) in enumerate(triggers) if t == n]} for n, (c, _, _) in made.items()}
    engine.define(tables, frames={n: spark.createDataFrame(rows, form) for n, (_, rows, form) in made.items()})


def rows_of(engine, name):
    return sorted(tuple(r) for r in engine.table(name).collect())


ADD = ("ledger", "CREATE TRIGGER t AFTER INSERT ON ledger FOR EACH ROW BEGIN UPDATE account SET balance = balance + NEW.amount WHERE id = NEW.account_id; END")


def test_insertions_fire(engine, do, spark, tmp_path):
    bank(engine, spark, ADD)
    commit = do(*[{"type": "insert", "table": "ledger", "values": {"account_id": k % 2 + 1, "amount": 5 + k}} for k in range(4)])
    assert rows_of(engine, "account") == [(1, 12), (2, 24)] and commit["rowEffectCount"] == 6
    assert [r.table_name for r in engine.commit_effects(commit).select("table_name").collect()].count("account") == 2
    remote = Replica(engine, str(tmp_path / "remote"))
    remote.push()  # the effects travel; nothing fires again
    assert rows_of(Engine.open(spark, str(tmp_path / "remote")), "account") == [(1, 12), (2, 24)]
    assert engine.revert(commit["commitId"])["ok"] and rows_of(engine, "account") == [(1, 0), (2, 10)] and rows_of(engine, "ledger") == []


def test_updates_and_deletions_fire(engine, do, spark):
    bank(
        engine, spark, ADD,
        ("account", "CREATE TRIGGER a AFTER UPDATE OF balance ON account WHEN NEW.balance <> OLD.balance BEGIN INSERT INTO audit (note) VALUES ('a' || NEW.id || ':' || OLD.balance || '->' || NEW.balance); END"),
        ("ledger", "CREATE TRIGGER d AFTER DELETE ON \"ledger\" BEGIN UPDATE account SET balance = balance - OLD.amount WHERE id = OLD.account_id; DELETE FROM audit WHERE note LIKE 'a' || OLD.account_id || ':%'; END"),
    )
    do({"type": "insert", "table": "ledger", "values": {"account_id": 1, "amount": 7}}, {"type": "update", "table": "account", "values": {"balance": 10}, "where": {"id": 2}})
    assert rows_of(engine, "account") == [(1, 7), (2, 10)] and rows_of(engine, "audit") == [(1, "a1:0->7")]
    do({"type": "delete", "table": "ledger", "where": {"account_id": 1}})
    assert rows_of(engine, "account") == [(1, 0), (2, 10)] and rows_of(engine, "audit") == []
    do({"type": "drop_trigger", "table": "ledger", "name": "ledger0"})
    do({"type": "insert", "table": "ledger", "values": {"account_id": 1, "amount": 7}})
    assert rows_of(engine, "account") == [(1, 0), (2, 10)]


def test_triggers_that_cannot_be_run(engine, do, spark):
    bank(
        engine, spark,
        ("ledger", "CREATE TRIGGER b AFTER INSERT ON ledger BEGIN UPDATE account SET balance = balance * NEW.amount WHERE id = NEW.account_id; END"),
        ("audit", "CREATE TRIGGER c BEFORE INSERT ON audit BEGIN DELETE FROM account; END"),
    )
    do({"type": "insert", "table": "ledger", "values": {"account_id": 2, "amount": 3}})
    assert rows_of(engine, "account") == [(1, 0), (2, 30)]
    for table, values in (("audit", [{"note": "x"}]), ("ledger", [{"account_id": 2, "amount": 3}] * 2)):
        with pytest.raises(EngineError) as e:
            do(*[{"type": "insert", "table": table, "values": v} for v in values])
        assert e.value.code == "UNSUPPORTED"
    assert rows_of(engine, "account") == [(1, 0), (2, 30)]


def test_a_trigger_does_not_fire_within_itself(engine, do, spark):
    bank(engine, spark, ("audit", "CREATE TRIGGER s AFTER INSERT ON audit BEGIN INSERT INTO audit (id, note) VALUES (NEW.id + 100, 'copy; of -- ' || NEW.note); END"))
    do({"type": "insert", "table": "audit", "values": {"note": "x"}}, {"type": "insert", "table": "audit", "values": {"note": "y"}})
    assert rows_of(engine, "audit") == [(1, "x"), (2, "y"), (101, "copy; of -- x"), (102, "copy; of -- y")]


def test_generated_and_hidden_columns(engine, do, spark):
    columns = [ID, {"name": "price", "type": "REAL"}, {"name": "secret", "type": "TEXT", "hidden": 1}]
    entry = {"columns": columns, "pk": ["id"], "generated": {"big": "net > 10", "net": "price * 0.5"}}
    engine.define({"sales": entry}, frames={"sales": spark.createDataFrame([(1, 10.0, "a"), (2, 30.0, "b")], "id long, price double, secret string")})
    do(update("sales", {"price": 50.0}, id=1), insert("sales", id=3, price=None))
    assert sorted((r.id, r.net, r.big) for r in engine.table("sales").select("id", F.coalesce("net", F.lit(0.0)).alias("net"), "big").collect()) == [(1, 25.0, True), (2, 15.0, True), (3, 0.0, None)]
    shown = browse.query_table(engine, "sales", sort_by="net", sort_dir="desc", filters={"big": "true"})
    assert [sorted(r.items()) for r in shown["rows"]] == [[("big", True), ("id", 1), ("net", 25.0), ("price", 50.0)], [("big", True), ("id", 2), ("net", 15.0), ("price", 30.0)]]
    assert read(engine, "SELECT sum(net) AS s FROM sales").collect()[0].s == 40.0
    assert engine.verify()["ok"]
    fails("INVALID_OPERATION", do, insert("sales", id=4, net=1.0))
    for generated in ({"price": "1"}, {"x": "nowhere + 1"}, {"x": "y", "y": "x"}):
        fails("INVALID_OPERATION", engine.define, {"sales": {"generated": generated}})
    with pytest.raises(EngineError):
        do({"type": "drop_column", "table": "sales", "column": "price"})


def test_numbering_keeps_nothing_aside(spark, tmp_path, monkeypatch):
    from stratum.operators import effects as E

    monkeypatch.setattr(E, "TASK_EFFECTS", 100)
    rows = [("t", f"{k * 7919 % 1000:04d}", ("delete", "update", "insert")[k % 3], "b", "a") for k in range(1000)]
    df = spark.createDataFrame(rows, "table_name string, pk_json string, op_kind string, before_json string, after_json string").repartition(5)
    got = E.number_effects(df, {"t": 0}, len(rows), str(tmp_path / "aside")).collect()
    want = sorted(rows, key=lambda r: (E.PHASE[r[2]], r[1]))
    assert [(r.op_kind, r.pk_json) for r in sorted(got, key=lambda r: r.effect_index)] == [(r[2], r[1]) for r in want]
    assert sorted(r.effect_index for r in got) == list(range(1000))
    assert not (tmp_path / "aside").exists()


def test_keys_left_and_taken_in_one_plan(engine, do):
    do({"type": "create_table", "table": "t", "columns": [{"name": "id", "type": "INTEGER", "primaryKey": True}, {"name": "v", "type": "TEXT"}]}, *[{"type": "insert", "table": "t", "values": {"id": k, "v": "x"}} for k in (1, 2, 3)])
    with pytest.raises(EngineError, match="UNIQUE"):
        do({"type": "insert", "table": "t", "values": {"id": 2, "v": "y"}})
    do({"type": "delete", "table": "t", "where": {"id": 1}}, {"type": "insert", "table": "t", "values": {"id": 1, "v": "y"}}, {"type": "update", "table": "t", "values": {"id": 4}, "where": {"id": 3}})
    assert sorted((r.op_kind, r.pk_json) for r in engine.effects(1).collect()) == [("delete", '{"id":"i:3"}'), ("insert", '{"id":"i:4"}'), ("update", '{"id":"i:1"}')]


COLUMNS = [{"name": "id", "type": "INTEGER", "primaryKey": True}, {"name": "v", "type": "TEXT"}, {"name": "x", "type": "REAL"}]


def filled(do, n=12):
    do({"type": "create_table", "table": "t", "columns": COLUMNS}, *({"type": "insert", "table": "t", "values": {"id": k, "v": "ab"[k % 2], "x": k / 8}} for k in range(n)))


def test_effects_to_be_published_are_the_changes(engine, do):
    """A replay's changes come from its effects as they would from the rows."""
    filled(do)
    plan = [{"type": "update", "table": "t", "values": {"v": "c\"\\"}, "where": {"v": "a"}}, {"type": "delete", "table": "t", "where": {"id": 3}}, {"type": "insert", "table": "t", "values": {"id": 99, "x": None}}]
    do(*plan)
    work = engine._work(engine.commit_at(1)["manifest"], 0)
    assert engine._apply_effects(work, engine.commit_effects(engine.commit_at(2)), [], "INTEGRITY_ERROR", publish=True) == []
    known = engine._changes(work)["t"]
    assert known is work.known["t"][1]
    entry = work.manifest["tables"]["t"]
    want = E.changed_rows(work.load("t"), schema_of(entry), entry["pk"])
    left = want.filter("__before is not null").select(*known.columns)  # rows that come have no key of old
    assert sorted(known.select(*left.columns).collect(), key=str) == sorted(want.select(*left.columns).collect(), key=str) and left.count() == 7
    work.drop_caches()


def test_revert_of_a_deletion_after_the_columns_changed(engine, do):
    """Images of another form than the table has now are made again."""
    filled(do)
    gone = do({"type": "delete", "table": "t", "where": {"v": "a"}})
    do({"type": "add_column", "table": "t", "column": {"name": "w", "type": "TEXT"}})
    assert engine.revert(gone["commitId"])["ok"]
    assert engine.table("t").count() == 12 and engine.verify(full=True)["ok"]
