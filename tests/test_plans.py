import pytest

from stratum.errors import STATUS, EngineError
from stratum.functions.hashing import canonical_json, sha256_hex
from stratum.operators.history import page_number, page_size
from stratum.plans.model import parse_plan
from stratum.plans.sqltext import check_expression, check_identifier, check_read_sql, mentions, normalize_sql

ID = {"name": "id", "type": "INTEGER", "primaryKey": True}


def plan(*ops, **more):
    return {"baseSchemaHash": "0" * 64, "message": "m", "operations": list(ops)} | more


def code(f, *a):
    with pytest.raises(EngineError) as e:
        f(*a)
    return e.value.code


def test_codes_have_a_status():
    assert EngineError("STALE_PLAN", "x").problem("/a")["status"] == 409
    assert set(STATUS.values()) == {400, 404, 409, 500}


def test_canonical_json_ignores_key_order():
    assert canonical_json({"b": 1, "a": {"d": None, "c": "é"}}) == '{"a":{"c":"é","d":null},"b":1}'
    assert sha256_hex({"a": 1, "b": 2}) == sha256_hex({"b": 2, "a": 1})
    assert sha256_hex("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize(
    "bad, want",
    [
        ("{", "INVALID_JSON"),
        (plan(), "INVALID_PLAN"),
        (plan({"type": "nope"}), "INVALID_PLAN"),
        (plan({"type": "drop_table", "table": "t", "x": 1}), "INVALID_PLAN"),
        (plan({"type": "drop_table", "table": "t"}, baseSchemaHash="zz"), "INVALID_PLAN"),
        (plan({"type": "update", "table": "t", "values": {"a": 1}, "where": {}}), "INVALID_PLAN"),
        (plan({"type": "drop_table", "table": "1t"}), "INVALID_IDENTIFIER"),
        (plan({"type": "drop_table", "table": "sqlite_x"}), "INVALID_IDENTIFIER"),
        (plan({"type": "restore_table", "table": "t", "entry": {}}), "INVALID_OPERATION"),
        (plan({"type": "create_table", "table": "t", "columns": [{"name": "a", "type": "TEXT"}]}), "INVALID_OPERATION"),
        (plan({"type": "create_table", "table": "t", "columns": [ID, {"name": "b", "type": "TEXT", "primaryKey": True}]}), "INVALID_OPERATION"),
        (plan({"type": "create_table", "table": "t", "columns": [ID, ID]}), "INVALID_OPERATION"),
        (plan({"type": "create_table", "table": "t", "columns": [ID, {"name": "b", "type": "DOUBLE PRECISION"}]}), "INVALID_OPERATION"),
        (plan({"type": "add_column", "table": "t", "column": {"name": "b", "type": "TEXT", "notNull": True}}), "INVALID_OPERATION"),
        (plan({"type": "add_column", "table": "t", "column": {"name": "b", "type": "TEXT", "unique": True}}), "INVALID_OPERATION"),
    ],
)
def test_plans_refused(bad, want):
    assert code(parse_plan, bad) == want


def test_plan_accepted():
    p = parse_plan(plan({"type": "create_table", "table": "사용자", "columns": [ID, {"name": "n", "type": "decimal ( 10 , 2 )"}]}))
    assert p.operations[0]["columns"][1]["type"] == "DECIMAL(10,2)"


@pytest.mark.parametrize("text", ["", "a;b", "a -- x", "a /* x */", "a, b", "(a", "a)", "'x", "a\0"])
def test_check_expressions_refused(text):
    assert code(check_expression, text, "e") == "INVALID_OPERATION"


def test_check_expressions_accepted():
    for text in ("a IN (1, 2)", "b <> ';--'", "length(c) > 0 AND (d OR e)"):
        assert check_expression(text, "e") == text


def test_identifiers():
    for name in ("a", "_x$1", "사용자", "Ä"):
        assert check_identifier(name, "n") == name
    for name in ("", "1a", "a b", "a-b", "_stratum_x"):
        assert code(check_identifier, name, "n") == "INVALID_IDENTIFIER"


def test_normal_form():
    assert normalize_sql("select  a -- c\n from \"t\" where b = 'x  Y'") == "SELECT A FROM \"t\" WHERE B = 'x  Y'"
    assert normalize_sql("a in ( 1 , 2 )", tight=True) == normalize_sql("A IN(1,2)", tight=True)
    assert normalize_sql("a = 'x'") != normalize_sql("a = 'X'")


def test_mentions():
    assert mentions('SELECT * FROM "Tasks"', "tasks") and mentions("select [tasks].a from x", "TASKS")
    assert not mentions("SELECT 'tasks' FROM t -- tasks", "tasks")


@pytest.mark.parametrize("sql", ["", "DELETE FROM t", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT 1", "SELECT replace(a, 'b', 'c') FROM t", "SELECT update FROM t", "PRAGMA x"])
def test_reads_refused(sql):
    assert code(check_read_sql, sql) == "INVALID_SQL"


def test_reads_accepted():
    assert check_read_sql(" SELECT 1 ; ") == "SELECT 1"
    assert check_read_sql("SELECT \"update\", 'drop' FROM t /* delete */")


def test_pages():
    assert [page_size(x) for x in (None, 0, 7, 9999)] == [50, 50, 7, 500]
    assert [page_number(x) for x in (None, -1, 3)] == [1, 1, 3]
