"""Row effects: what a commit did to each row.

Rows that run through a plan carry the image they began with, so what changed is a filter on one scan;
only changed rows are grouped by key, to join a delete and an insert of one key to an update.  Where two
states come from elsewhere, ``diff`` joins them by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest, encoded

BEFORE, KEY, ALIVE, FILE, TOUCHED = "__before", "__key", "__alive", "__file", "__touched"
EFFECT = "table_name string, pk_json string, op_kind string, before_json string, after_json string, before_hash string, after_hash string, effect_index long"
PHASE = {"delete": 0, "update": 1, "insert": 2}
#: Effects that one task sorts and numbers.
TASK_EFFECTS = 100_000
#: Most ranges of a commit; beyond, ranges grow and are sorted with spills.
MAX_RANGES = 256


def kind_of(before: Column, after: Column) -> Column:
    return F.when(before.isNull(), "insert").when(after.isNull(), "delete").otherwise("update")


def changed_rows(rows: DataFrame, schema: T.StructType, pk: Sequence[str]) -> DataFrame:
    """(before, key, file, after, key now, whether that key is new) of rows that differ from what they began as.

    Only rows that some operation met are encoded at all; the predicate goes down to the scan.
    """
    after = F.when(F.col(ALIVE), encoded(schema))
    seen = rows.filter(F.col(TOUCHED)).select(F.col(BEFORE), F.col(KEY), F.col(FILE), after.alias("__after"), encoded(schema, list(pk)).alias("__now"))
    return seen.filter(~F.col(BEFORE).eqNullSafe(F.col("__after"))).withColumn("__fresh", ~F.col(KEY).eqNullSafe(F.col("__now")))


def changes_of(effects: DataFrame) -> DataFrame:
    """``changed_rows`` of effects (``__pk``, ``__bj``, ``__aj``, file) that have been held against the rows they meet."""
    found = effects.filter(~F.col("__bj").eqNullSafe(F.col("__aj")))
    key = F.when(F.col("__bj").isNotNull(), F.col("__pk"))
    return found.select(F.col("__bj").alias(BEFORE), key.alias(KEY), F.col(FILE), F.col("__aj").alias("__after"), F.col("__pk").alias("__now"), F.col("__bj").isNull().alias("__fresh"))


def merge_changes(changed: DataFrame) -> DataFrame:
    """One row a key: before and after.

    A row that kept its key is an effect of its own; those that left a key and those that came to one are grouped by
    it, where there are both.
    """
    own = F.col(BEFORE).isNotNull() & F.col("__after").isNotNull() & ~F.col("__fresh")
    left, came = F.col(BEFORE).isNotNull() & ~own, F.col("__after").isNotNull() & ~own
    some = changed.agg(F.max(left), F.max(came)).first()
    if not (some[0] and some[1]):
        key = F.when(F.col(BEFORE).isNotNull(), F.col(KEY)).otherwise(F.col("__now"))
        return changed.select(key.alias("pk_json"), F.col(BEFORE).alias("before_json"), F.col("__after").alias("after_json"))
    alone = changed.filter(own).select(F.col(KEY).alias("pk_json"), F.col(BEFORE).alias("before_json"), F.col("__after").alias("after_json"))
    return alone.unionAll(_by_key(changed.filter(~own)))


def _by_key(changed: DataFrame) -> DataFrame:
    gone = F.struct(F.col(KEY).alias("pk_json"), F.col(BEFORE).alias("before_json"), F.lit(None).cast("string").alias("after_json"))
    come = F.struct(F.col("__now").alias("pk_json"), F.lit(None).cast("string").alias("before_json"), F.col("__after").alias("after_json"))
    both = F.filter(F.array(gone, come), lambda x: x["before_json"].isNotNull() | x["after_json"].isNotNull())
    keyed = changed.select(F.inline(both)).groupBy("pk_json").agg(F.max("before_json").alias("before_json"), F.max("after_json").alias("after_json"))
    return keyed.filter(~F.col("before_json").eqNullSafe(F.col("after_json")))


def complete(table: str, keyed: DataFrame) -> DataFrame:
    return keyed.select(
        F.lit(table).alias("table_name"), "pk_json", kind_of(F.col("before_json"), F.col("after_json")).alias("op_kind"), "before_json", "after_json",
        digest(F.col("before_json")).alias("before_hash"), digest(F.col("after_json")).alias("after_hash"),
    )


def dependency_order(tables: Sequence[str], references: dict[str, set[str]]) -> list[str]:
    """Level by level: tables whose parents are all placed, by name; where a cycle leaves none, the least name."""
    waiting = {t: {p for p in references.get(t, ()) if p != t} & set(tables) for t in tables}
    out: list[str] = []
    while waiting:
        level = sorted(t for t, parents in waiting.items() if parents.isdisjoint(waiting)) or [min(waiting)]
        out += level
        for t in level:
            del waiting[t]
    return out


def effect_order(ranks: dict[str, int]) -> list[Column]:
    """Deletes child first, then updates and inserts parent first, by key within a table."""
    rank = F.lit(len(ranks))
    for name, k in ranks.items():
        rank = F.when(F.col("table_name") == name, F.lit(k)).otherwise(rank)
    phase = F.when(F.col("op_kind") == "delete", 0).when(F.col("op_kind") == "update", 1).otherwise(2)
    return [phase, F.when(F.col("op_kind") == "delete", -rank).otherwise(rank), F.col("table_name"), F.col("pk_json")]


def number_rows(rows: DataFrame, order: Sequence[Column], count: int, scratch: str, name: str) -> DataFrame:
    """``rows`` numbered from 0 without gaps, at any size: sorted ranges number their own and then add what lies before them.

    More than one range is kept at ``scratch`` in between, so that a lost executor can't draw the ranges anew.
    """
    ranges = -(-count // TASK_EFFECTS)
    local = rows.repartitionByRange(max(1, ranges), *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    if ranges < 2:
        return local
    local.write.mode("overwrite").parquet(scratch)
    local = rows.sparkSession.read.schema(local.schema).parquet(scratch).withColumn("__range", F.shiftright(name, 33))
    counts = sorted(local.groupBy("__range").agg(F.count("*")).collect())  # one row a range
    before, offsets = 0, []
    for at, n in counts:
        offsets.append((at, before - (at << 33)))
        before += n
    found = rows.sparkSession.createDataFrame(offsets, "__range long, __offset long")
    return local.join(F.broadcast(found), "__range").withColumn(name, F.col(name) + F.col("__offset")).drop("__range", "__offset")


def _place_key(ranks: dict[str, int]) -> Column:
    """``effect_order`` as one text, which sorts as it does."""
    phase, rank, table, pk = effect_order(ranks)
    return F.concat(phase.cast("string"), F.lpad((rank + len(ranks)).cast("string"), 10, "0"), F.lit("\0"), table, F.lit("\0"), pk)


def _range_of(key: Column, bounds: Sequence[str], first: int = 0) -> Column:
    """How many of ``bounds`` are not above ``key``, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), _range_of(key, bounds[:mid], first)).otherwise(_range_of(key, bounds[mid + 1 :], first + mid + 1))


def number_effects(effects: DataFrame, ranks: dict[str, int], count: int, scratch: str = "") -> DataFrame:
    """``effects`` with their places from 0 without gaps, at any size, by one shuffle.

    Bounds are drawn once, on the driver, so a row's range is a function of the row; ranges are counted, then each
    is sorted and numbered by one task, wherever that runs again.
    """
    ranges = min(-(-count // TASK_EFFECTS), MAX_RANGES)
    if ranges < 2:
        return number_rows(effects, effect_order(ranks), count, scratch, "effect_index")
    keyed = effects.withColumn("__place", _place_key(ranks))
    drawn = sorted(r[0] for r in keyed.select("__place").sample(min(1.0, 40 * ranges / count), 7).collect())  # about 40 keys a range
    bounds = sorted({drawn[k * len(drawn) // ranges] for k in range(1, ranges)}) if drawn else []
    keyed = keyed.withColumn("__range", _range_of(F.col("__place"), bounds))
    sizes = dict(map(tuple, keyed.groupBy("__range").count().collect()))  # one row a range
    offsets, before = [], 0
    for k in range(len(bounds) + 1):
        offsets.append(F.lit(before).cast("long"))
        before += sizes.get(k, 0)
    own = keyed.repartitionById(len(bounds) + 1, "__range").sortWithinPartitions("__place")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn("effect_index", index).withColumn("effect_index", F.col("effect_index") + F.element_at(F.array(*offsets), F.col("__range") + 1)).drop("__place", "__range")


def diff(before: DataFrame, after: DataFrame, pk: Sequence[str], table: str = "t") -> DataFrame:
    """Row effects between two states of one schema, by a full outer join on the key."""
    def images(df: DataFrame, name: str) -> DataFrame:
        return df.select(encoded(df.schema, list(pk)).alias("pk_json"), encoded(df.schema).alias(name))

    joined = images(before, "before_json").join(images(after, "after_json"), "pk_json", "full_outer")
    return complete(table, joined.filter(~F.col("before_json").eqNullSafe(F.col("after_json"))))


def inverse(effects: DataFrame) -> DataFrame:
    """The effects that undo ``effects``."""
    kind = F.when(F.col("op_kind") == "insert", "delete").when(F.col("op_kind") == "delete", "insert").otherwise("update")
    return effects.select(
        "table_name", "pk_json", kind.alias("op_kind"), F.col("after_json").alias("before_json"), F.col("before_json").alias("after_json"),
        F.col("after_hash").alias("before_hash"), F.col("before_hash").alias("after_hash"), "effect_index",
    )


def mismatches(current: DataFrame, effects: DataFrame) -> DataFrame:
    """Effects whose before-image is not what ``current`` (pk_json, hash) holds; null-safe both ways."""
    found = effects.join(current.select("pk_json", F.col("hash").alias("current_hash")), "pk_json", "left")
    return found.filter(~F.col("before_hash").eqNullSafe(F.col("current_hash")))


def latest_images(effects: DataFrame) -> DataFrame:
    """Compaction of a change feed: of each key its last image; rows deleted last are left out."""
    last = effects.groupBy("table_name", "pk_json").agg(F.max_by("after_json", F.struct("seq", "effect_index")).alias("after_json"))
    return last.filter("after_json is not null")
