import json

from stratum import cli, http


def test_routes_and_commands(engine, do, spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    do({"type": "create_table", "table": "t", "columns": [{"name": "id", "type": "INTEGER", "primaryKey": True}, {"name": "v", "type": "TEXT"}]})
    c = do({"type": "insert", "table": "t", "values": {"v": "x"}})
    status, out = http.handle(engine, "GET", "/api/tables")
    assert status == 200 and out["tables"][0]["rowCount"] == 1
    assert http.handle(engine, "POST", "/api/tables/T/rows/query", '{"filters": {"v": "X"}}')[1]["rows"] == [{"id": 1, "v": "x"}]
    assert http.handle(engine, "GET", "/api/tables/nope/schema")[0] == 404
    assert http.handle(engine, "POST", "/api/tables/t/rows/query", "{")[0] == 400
    assert http.handle(engine, "POST", "/api/tables/t/rows/query", '{"x": 1}')[0] == 400
    assert http.handle(engine, "GET", "/api/commits?limit=a")[0] == 400 and http.handle(engine, "GET", "/api/x")[0] == 404
    assert http.handle(engine, "GET", "/api/tables/t/schema")[1]["tables"][0]["table"] == "t"
    assert len(http.handle(engine, "GET", "/api/commits?limit=1")[1]["commits"]) == 1
    assert len(http.handle(engine, "GET", "/api/tables/t/history")[1]["commits"]) == 2
    assert http.handle(engine, "GET", f"/api/commits/{c['commitId']}")[1]["rowEffects"][0]["op_kind"] == "insert"
    assert http.handle(engine, "POST", f"/api/commits/{c['commitId']}/revert")[0] == 200
    assert http.handle(engine, "POST", f"/api/commits/{c['commitId']}/revert")[0] == 409
    assert http.handle(engine, "GET", "/api/status")[1]["tableCount"] == 1
    root = engine.storage.root
    plan = tmp_path / "plan.json"
    plan.write_text(json.dumps({"baseSchemaHash": engine.schema_hash(), "message": "m", "operations": [{"type": "insert", "table": "t", "values": {"v": "y"}}]}))
    assert cli.main([root, "plan", "-f", str(plan)]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert cli.main([root, "apply", "-f", str(plan)]) == 0 and json.loads(capsys.readouterr().out)["sync"] == {"state": "unconfigured"}
    assert cli.main([root, "read", "--sql", "SELECT v FROM t", "--json"]) == 0 and json.loads(capsys.readouterr().out) == [{"v": "y"}]
    assert cli.main([root, "read", "--sql", "DROP TABLE t"]) == 1 and json.loads(capsys.readouterr().err)["code"] == "INVALID_SQL"
    for command in (["status"], ["history", "--table", "t"], ["schema"], ["verify"], ["remote", "status"]):
        assert cli.main([root, *command]) == 0
