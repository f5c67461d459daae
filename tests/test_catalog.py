import math
import os

import duckdb
import pytest

from stratum import catalog

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    out = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in out.description]
    assert sorted(cols) == names
    want = sorted((tuple(norm(r[cols.index(c)]) for c in names) for r in out.fetchall()), key=repr)
    assert got == want


OVER_ORDERS = (
    "plan_insert", "plan_update", "plan_delete", "plan_add_column", "plan_drop_column", "plan_alter_type", "plan_create_table", "plan_create_restore", "plan_auto_key", "plan_applied",
    "time_travel", "row_effects", "state_diff", "effect_counts", "effects_ordered", "db_state_hash", "replay_forward", "replay_inverse", "optimistic_mismatch", "revert_row_conflicts",
    "revert_schema_row_conflicts", "change_feed_after", "feed_compaction", "projection_drift", "dry_run", "read_view", "table_overview", "verify_chain",
)


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Orders that hold the keys a million above those that the plan copies, of every status and priority."""
    folder = tmp_path_factory.mktemp("crowded")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW o AS SELECT * FROM '{DATA}/orders.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey < 60 THEN o_orderkey WHEN o_orderkey < 67 THEN o_orderkey - 60 + 1000000 ELSE o_orderkey + 1000010 END AS o_orderkey) FROM o) TO '{folder}/orders.parquet'")
    con.execute(f"COPY (FROM '{DATA}/nation.parquet') TO '{folder}/nation.parquet'")
    return str(folder)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", OVER_ORDERS)
def test_query_over_orders_that_hold_the_keys_of_the_copies(spark, crowded, name):
    con = duckdb.connect()
    for t in ("orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{crowded}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, crowded)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    out = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in out.description]
    assert sorted(cols) == names
    assert got == sorted((tuple(norm(r[cols.index(c)]) for c in names) for r in out.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_places_of_effects_over_several_ranges_where_copies_are_paired_anew(spark, crowded, tmp_path, monkeypatch):
    from stratum.operators import effects

    monkeypatch.setattr(effects, "TASK_EFFECTS", 40)
    con = duckdb.connect()
    con.execute(f"COPY (FROM '{crowded}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = catalog.QUERIES["effects_ordered"](spark, str(tmp_path)).orderBy("effect_index").collect()
    want = con.execute(f"SELECT o_orderkey, op_kind, effect_index FROM ({catalog.ORACLES['effects_ordered']}) ORDER BY effect_index").fetchall()
    assert len(want) > 10 * 40 and list(map(tuple, got)) == want


FAR = {"behind a gap": "CASE WHEN o_orderkey < 60 THEN o_orderkey ELSE o_orderkey + 10000000 END", "nothing to copy": "o_orderkey + 1000000", "just behind the copied": "o_orderkey + 999990"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("shape", FAR)
def test_insertions_where_orders_beyond_a_million_leave_the_keys_of_the_copies_free(spark, tmp_path, shape):
    """The SQL shows V2's rows from a million on, whether a copy meets one of them or not."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({FAR[shape]} AS o_orderkey) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = catalog.QUERIES["plan_insert"](spark, str(tmp_path)).orderBy("o_orderkey", "o_orderstatus").collect()
    want = con.execute(f"SELECT * FROM ({catalog.ORACLES['plan_insert']}) ORDER BY o_orderkey, o_orderstatus").fetchall()
    assert list(map(tuple, got)) == want


def test_ranks_within_a_few_parts(spark, tmp_path, monkeypatch):
    """As by windows over the parts, which hold a part in one task; nulls and ties among them, over several ranges."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from stratum.operators import effects, ranks

    monkeypatch.setattr(effects, "TASK_EFFECTS", 40)
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("p"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 11).alias("v")).repartition(5)
    got = ranks.row_numbers(ranks.ranks(rows, ["p"], ["v"], "r", "dr"), ["p"], [F.col("v").desc(), F.col("id").asc()], "rn", str(tmp_path / "ranked"))
    w = Window.partitionBy("p")
    want = rows.select("*", F.rank().over(w.orderBy("v")).alias("r"), F.dense_rank().over(w.orderBy("v")).alias("dr"), F.row_number().over(w.orderBy(F.col("v").desc(), "id")).alias("rn"))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
