"""Column functions at their edges."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions import compat
from stratum.functions import jsonedit as J

TEXTS = ['{"b":1,"a":{"x":[1,2]},"s":"q\\"t"}', "[1]", "{bad", None, "{}"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "i int, j string").coalesce(1).cache()


def each(rows, c):
    return [r.c for r in rows.select("i", c.alias("c")).orderBy("i").collect()]


def test_json_edits(texts):
    j, rest = F.col("j"), TEXTS[1:4]
    assert each(texts, J.json_set(j, "$.b", None)) == ['{"b":null,"a":{"x":[1,2]},"s":"q\\"t"}', *rest, '{"b":null}']
    assert each(texts, J.json_set(j, "$.a.y.z", "é")) == ['{"b":1,"a":{"x":[1,2],"y":{"z":"é"}},"s":"q\\"t"}', *rest, '{"a":{"y":{"z":"é"}}}']
    assert each(texts, J.json_insert(j, "$.a.x", 9)) == [TEXTS[0], *rest, '{"a":{"x":9}}']
    assert each(texts, J.json_replace(j, "$.a.x", 9)) == ['{"b":1,"a":{"x":9},"s":"q\\"t"}', *rest, "{}"]
    assert each(texts, J.json_replace(j, "$.b.c", 9)) == [TEXTS[0], *rest, "{}"]
    assert each(texts, J.json_remove(j, "$.a.x")) == ['{"b":1,"a":{},"s":"q\\"t"}', *rest, "{}"]
    assert each(texts, J.json_patch(j, {"a": {"x": None, "n": 2}, "s": None})) == ['{"b":1,"a":{"n":2}}', *rest, '{"a":{"n":2}}']
    with pytest.raises(ValueError):
        J.json_set(j, "$.a[0]", 1)


def test_json_members(spark, texts):
    got = [tuple(r) for r in J.json_each(texts, "j", "i").orderBy("i", "key").collect()]
    assert got == [(0, "a", '{"x":[1,2]}', "object"), (0, "b", "1", "integer"), (0, "s", '"q\\"t"', "text"), (1, "0", "1", "integer")]
    kinds = spark.createDataFrame([(k, t) for k, t in enumerate(["null", " true", "false", "1", "1.5", "1e3", '"a"', "[]", "{}", "x", None])], "i int, j string").coalesce(1)
    assert each(kinds, J.json_type(F.col("j"))) == ["null", "true", "false", "integer", "real", "real", "text", "array", "object", None, None]


def test_date_modifiers(spark):
    rows = spark.createDataFrame([(0, "2001-01-31 10:00:00"), (1, "2000-02-29 00:00:00"), (2, None)], "i int, t string").coalesce(1)

    def shifted(*modifiers):
        return each(rows, F.date_format(compat.date_shift(F.col("t"), *modifiers), "yyyy-MM-dd HH:mm"))

    assert shifted("+1 month") == ["2001-03-03 10:00", "2000-03-29 00:00", None]
    assert shifted("1 year") == ["2002-01-31 10:00", "2001-03-01 00:00", None]
    assert shifted("weekday 3", "start of day") == ["2001-01-31 00:00", "2000-03-01 00:00", None]
    assert shifted("start of year", "-90 minutes") == ["2000-12-31 22:30", "1999-12-31 22:30", None]
    with pytest.raises(ValueError):
        compat.date_shift(F.col("t"), "next week")


def test_literals_and_affinity(spark):
    rows = spark.createDataFrame([(0, "1", 1.0), (1, " 1.50 ", 1.5), (2, "1x", 1.0), (3, None, 1.0), (4, "it's", None)], "i int, t string, n double").coalesce(1)
    assert each(rows, compat.equal_by_affinity(F.col("t"), F.col("n"))) == [True, True, False, None, None]
    assert each(rows, compat.quote(F.col("t"), T.StringType())) == ["'1'", "' 1.50 '", "'1x'", "NULL", "'it''s'"]
    assert each(rows, compat.storage_class(F.col("n"), T.DoubleType())) == ["real"] * 4 + ["null"]
    assert each(rows, compat.quote(F.col("n") > 1, T.BooleanType())) == ["0", "1", "0", "0", "NULL"]
