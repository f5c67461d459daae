"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal text form one group, which is never split.  Groups stand in a fixed order (that of their
hash); the smallest capacity for which a greedy left-to-right fill needs at most ``shards`` shards is
found by binary search, and the order is cut there.

The order may hold any number of groups, so the driver never sees them all.  It keeps a *skyline*: the
order as consecutive hash ranges with their total, their largest group and their count.  A greedy check
on the skyline gives bounds for every cut; where the bounds leave the answer open, only the ranges in
which those cuts fall are split into 4096 finer ones by one aggregation, until the answer is sure.  The
skyline thus has some thousand entries at any input size, and the capacity found is exact.

Groups too large to share a shard fairly get one of their own; other large ones (at most 64 to a shard)
are placed, largest first, where most room is left, so that cuts do not fall inside them.

Defined results: null and empty texts have size 1, CRC 0 and form one group; repeated rows are separate
rows of one group; with fewer groups than shards some shards are empty; an empty table gives an empty
table; other columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import discard, materialize, table, utf8_bytes

#: Bits by which a hash range is split, and the share of a shard from which a group counts as large.
SPLIT_BITS, LARGE_SHARE = 12, 64
#: Rows numbered by one window at most, on average.
ROWS_PER_BUCKET = 100_000


@dataclass
class Span:
    """Consecutive groups: hashes ``lo`` to below ``lo + 2**bits``, or one large group (``key`` set)."""

    lo: int
    bits: int
    total: int
    largest: int
    count: int
    key: int | None = None


def _spans(groups: DataFrame, parents: list[tuple[int, int]]) -> list[Span]:
    """The groups of ``parents`` (ranges as lo and bits), by range of SPLIT_BITS fewer bits."""
    shift = max(0, parents[0][1] - SPLIT_BITS)
    some = F.lit(False)
    for lo, bits in parents:
        some = some | F.col("h").between(lo, lo + (1 << bits) - 1)
    rows = (
        groups.filter(some).groupBy(F.shiftright("h", shift).alias("k")).agg(F.sum("size").alias("t"), F.max("size").alias("m"), F.count("*").alias("n")).collect()
    )
    return sorted((Span(r.k << shift, shift, r.t, r.m, r.n) for r in rows), key=lambda s: s.lo)


class Skyline:
    def __init__(self, groups: DataFrame, order: list[Span]):
        self.groups, self.order = groups, order
        self._sum()

    def _sum(self) -> None:
        self.ends = [0, *accumulate(s.total for s in self.order)]

    def refine(self, at: set[int]) -> None:
        """Split the spans at these places; all of one width are split by one aggregation."""
        found: dict[int, list[Span]] = {}
        for bits in {self.order[j].bits for j in at}:
            js = sorted(j for j in at if self.order[j].bits == bits)
            for s in _spans(self.groups, [(self.order[j].lo, bits) for j in js]):
                j = next(j for j in js if self.order[j].lo <= s.lo < self.order[j].lo + (1 << bits))
                found.setdefault(j, []).append(s)
        self.order = [x for j, s in enumerate(self.order) for x in (found.get(j) or [s] if j in at else [s])]
        self._sum()

    def step(self, x: int, capacity: int, low: bool) -> tuple[int, int | None]:
        """Where a shard that begins at ``x`` ends at least (``low``) or at most; the span left open."""
        y = x + capacity
        if y >= self.ends[-1]:
            return self.ends[-1], None
        j = bisect_right(self.ends, y) - 1
        if self.order[j].count == 1 or y == self.ends[j]:
            return self.ends[j], None
        return (max(self.ends[j], y - self.order[j].largest + 1) if low else y), j

    def feasible(self, shards: int, capacity: int) -> bool:
        while True:
            a = b = 0
            open_at: set[int] = set()
            for _ in range(shards):
                a, i = self.step(a, capacity, True)
                b, j = self.step(b, capacity, False)
                open_at |= {k for k in (i, j) if k is not None}
            if a >= self.ends[-1]:
                return True
            if b < self.ends[-1]:
                return False
            self.refine(open_at)

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Places in ``order`` where a shard begins, the first left out."""
        while True:
            x, found, open_at = 0, [], set()
            for _ in range(shards - 1):
                x, j = self.step(x, capacity, True)
                if j is not None:
                    open_at.add(j)
                    break
                found.append(bisect_right(self.ends, x) - 1 if x < self.ends[-1] else len(self.order))
            if not open_at:
                return found
            self.refine(open_at)


def _place_large(large: list[tuple[int, int]], small: list[Span], shards: int) -> list[Span]:
    """The order: each large group stands where the shard with most room begins."""
    total = sum(s for _, s in large) + sum(s.total for s in small)
    load, bins = [0] * shards, [[] for _ in range(shards)]
    for key, size in large:
        k = min(range(shards), key=lambda i: (load[i], i))
        load[k] += size
        bins[k].append(Span(0, 0, size, size, 1, key))
    room = [max(0.0, total / shards - x) for x in load]
    scale = sum(s.total for s in small) / (sum(room) or 1)
    starts = [0.0, *accumulate(r * scale for r in room)]
    order, at, k = [], 0, 0
    for s in small:
        while k < shards and starts[k] <= at:
            order += bins[k]
            k += 1
        order.append(s)
        at += s.total
    return order + [x for b in bins[k:] for x in b]


def plan_shards(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[tuple[int, int]], list[int]]:
    """Shards of large groups by hash; (lowest hash, shard) of the others; the capacity of each stage.

    ``groups`` has ``h`` and ``size``, one row a group.
    """
    whole = groups.agg(F.sum("size").alias("t"), F.max("size").alias("m")).first()
    if not whole.t:
        return {}, [], []
    bar = max(1, whole.t // (shards * LARGE_SHARE))
    large = sorted(((r.h, r["size"]) for r in groups.filter(F.col("size") > bar).collect()), key=lambda x: (-x[1], x[0]))
    placed: dict[int, int] = {}
    rest, first = whole.t, 0
    while large and first < shards - 1 and large[0][1] * (shards - first) >= rest:
        h, size = large.pop(0)
        placed[h] = first
        rest, first = rest - size, first + 1
    n = shards - first
    others = groups.filter(F.col("size") <= bar)
    sky = Skyline(others, _place_large(large, _spans(others, [(-(1 << 63), 64)]), n))
    if not sky.order:
        return placed, [], []
    lo, hi = max(-(-rest // n), max(s.largest for s in sky.order)), -(-rest // n) + max(s.largest for s in sky.order)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if sky.feasible(n, mid) else (mid + 1, hi)
    cuts = sky.cuts(n, lo)
    bounds: list[tuple[int, int]] = []
    for j, s in enumerate(sky.order):
        shard = first + bisect_right(cuts, j)
        if s.key is not None:
            placed[s.key] = shard
        elif not bounds or bounds[-1][1] != shard:
            bounds.append((s.lo, shard))
    return placed, bounds, [lo]


def shard_of(h: Column, placed: dict[int, int], bounds: list[tuple[int, int]]) -> Column:
    out = F.lit(bounds[0][1] if bounds else 0)
    for lo, shard in bounds[1:]:
        out = F.when(h >= lo, F.lit(shard)).otherwise(out)
    for shard in sorted(set(placed.values())):
        out = F.when(h.isin([k for k, s in placed.items() if s == shard]), F.lit(shard)).otherwise(out)
    return out.cast("int")


def number_slots(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard: counts of hashed buckets give each its offset."""
    buckets = max(16, n_rows // (shards * ROWS_PER_BUCKET))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int"))
    before = W.Window.partitionBy("shard").orderBy("__b").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "__b").agg(F.count("*").alias("n")).select("shard", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    own = W.Window.partitionBy("shard", "__b").orderBy("doc_id", "h")
    return rows.withColumn("__r", F.row_number().over(own)).join(offsets, ["shard", "__b"]).withColumn("slot", F.col("__o") + F.col("__r") - 1)


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    raw = utf8_bytes(F.col(text))
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"))
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    placed, bounds, _ = plan_shards(groups, shards)
    discard(groups)
    n_rows = rows.count()
    put = rows.withColumn("shard", shard_of(F.col("h"), placed, bounds))
    return number_slots(put, n_rows, shards)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
