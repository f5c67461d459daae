"""N-gram Jaccard join, size-aware: subset enumeration for small sets, inverted lists for large ones.

A document's set is its distinct word shingles; two documents link when
``q * |A & B| >= p * |A | B|`` (threshold p/q).  The result is each document's class under the links,
found without ever writing out the pairs of a group:

* Documents of equal set are one *class* from the start (128-bit set hash).
* Small sets (both of at most ``boundary`` shingles) enumerate their subsets with few enough shingles
  left out.  Sets that share such a subset are linked to the smallest of them, which is as good as all
  pairs for connectivity, since each of those pairs meets the threshold by size alone.
* Large sets use prefix lists: in one global order of shingles, linked sets share one of the first
  ``n - ceil(p/q * n) + 1``.  The order is by counts in a fixed-size sketch over all documents, then by
  hash, so frequent passages come last.  A list is parted by size bands as wide as linked sets may differ,
  each set in its own band and the next; lists with one member go, the rest are gathered in *cells* by
  their least member.  In a cell each set first shows its size and a parity sketch: bit i says whether it
  has an odd number of shingles in bucket i, so two sketches differ in no more bits than their sets have
  differences, and pairs that differ in too many are ruled out for certain.  Sketches of BRIEF_BITS at most
  go first; what they leave shows one with as many bits as the set has shingles.  What is left then is dealt
  out by candidate component, with texts, and there inverted lists count every overlap exactly; a local
  union-find keeps a spanning forest, so a cell gives fewer links than it has sets.
* A hot cell, of more sets or shingles than a task should hold, is first dealt out once, in blocks that all
  hold some of its sets besides (anchors), and linked exactly there.  Sets that this joins to one anchor need
  not be compared again: only those outside the largest such group meet the rest, in pairs of blocks.
* ``boundary`` minimises the estimated cost over the histogram of set sizes.
* Connected components by alternating large-star and small-star steps, each written to the shared folder.

Every set above the boundary, and every set that could link with one, is scanned; nothing is capped.

Defined results: without words or text a set is empty and links with nothing (its component is its own
doc_id); texts of fewer words than a shingle are one shingle; repeated rows share a class and a result;
a null doc_id is passed over as the smallest id of its component, and ``keep_one`` keeps such rows; an empty table gives an empty table;
extra columns are ignored by ``link_documents`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, give_back, materialize, release, table
from .shingles import batches_of, mix, shingle_runs

#: Counters of the sketch, and blocks in which it travels.
SKETCH, SKETCH_BLOCKS = 1 << 20, 16
#: Sets (or BLOCK_ROOTS times the root of their number) and shingles that one cell holds at most before it is dealt out in blocks.
CELL_SETS, BLOCK_ROOTS, CELL_ITEMS = 128, 4, 2_000_000
#: Sets of a hot cell that each of its first blocks holds, about.
ANCHORS = 8
#: Hot cells up to this number are broadcast (16 bytes each), more are joined by shuffle.
HOT_CELLS = 100_000
#: Bits of the least parity sketch and of the longest that is compared first.
LEAST_BITS, BRIEF_BITS = 128, 1024
#: Parts in which the counters of all tasks are summed before the last sum.
SUM_PARTS = 64
#: Bits of the filters that keep documents of no cell, and shingles of one prefix alone, out of shuffles.
BITMAP, ITEM_BITMAP = 1 << 25, 1 << 27
#: Cells of so many sets are never dealt out, whatever the sets' sizes.
SMALL_CELL = 16
#: Sizes for which the enumeration of subsets is considered.
LARGEST_BOUNDARY = 24
#: Relative costs: a subset or list row; a scanned set, and each of its shingles, on its way to a cell.
ROW_COST, SET_COST, ITEM_COST = 1.0, 8.0, 0.25


def prefix_length(n: int, p: int, q: int) -> int:
    return n - -(-p * n // q) + 1


def deletions(n: int, p: int, q: int) -> int:
    """Shingles that a linked partner may lack at most."""
    return n - -(-p * n // q)


def choose_boundary(sizes: dict[int, int], p: int, q: int) -> int:
    """The largest set size to enumerate, by cost over a histogram of sizes."""

    def enumerated(n: int) -> float:
        return ROW_COST * sum(math.comb(n, j) for j in range(deletions(n, p, q) + 1))

    def scanned(n: int) -> float:
        return ROW_COST * prefix_length(n, p, q) + SET_COST + ITEM_COST * n

    def total(b: int) -> float:
        least = -(-p * (b + 1) // q)
        return sum(c * enumerated(n) for n, c in sizes.items() if n <= b) + sum(c * scanned(n) for n, c in sizes.items() if n >= least)

    return min(range(LARGEST_BOUNDARY + 1), key=lambda b: (total(b), b))


def _sketch(docs: DataFrame, k: int, text: str) -> tuple[np.ndarray, dict[int, int]]:
    """Counts of all shingles by hashed counter, and the histogram of the sizes of small documents."""
    width = SKETCH // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(SKETCH, np.uint32), np.zeros(256, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = batch.column(0).slice(at, 1024).to_pylist()
                for a, b in batches_of(texts):
                    runs = shingle_runs(texts[a:b], k)
                    at_counter, times = np.unique((np.concatenate(runs) & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
                    counts[at_counter] += times.astype(np.uint32)
                    sizes += np.bincount([min(len(r), 255) for r in runs], minlength=256)
        rows = [(b, counts[b * width : (b + 1) * width].astype(np.int64).tobytes()) for b in range(SKETCH_BLOCKS)] + [(-1, sizes.tobytes())]
        part = TaskContext.get().partitionId() % SUM_PARTS
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, _, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = np.frombuffer(raw, np.int64)
                sums[block] = sums[block] + one if block in sums else one
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "part", "counts"])

    form = "block int, part int, counts binary"
    sums = docs.select(text).mapInArrow(count, form).repartition("block", "part").mapInArrow(add, form)
    rows = sums.repartition(SKETCH_BLOCKS + 1, "block").mapInArrow(add, form).collect()  # SKETCH counters, whatever the input
    counts, sizes = np.zeros(SKETCH, np.int64), {}
    for r in rows:
        values = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["block"] < 0:
            sizes = {n: int(c) for n, c in enumerate(values[:255]) if c}
        else:
            counts[r["block"] * width : (r["block"] + 1) * width] = values
    return (np.log2(counts + 1.0) * (1 << 14)).astype(np.uint32), sizes  # 20 bits: the order matters, not the counts


def class_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Two independent hashes of each shingle of the concatenated sets, and each set's 16-byte key."""
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    m1, m2 = mix(flat, 11), mix(flat, 23)
    with np.errstate(over="ignore"):
        c1, c2 = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(m)]) for m in (m1, m2))
        ends = np.cumsum([len(s) for s in sets])
        starts = ends - [len(s) for s in sets]
        h1, h2 = c1[ends] - c1[starts], c2[ends] - c2[starts]
    return m1, m2, [int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big") for a, b in zip(h1, h2, strict=True)]


def parity(hashes: np.ndarray) -> np.ndarray:
    """One bit for each bucket: is its number of shingles odd?  As many buckets as shingles, to the next power of two."""
    size = max(LEAST_BITS, 1 << (max(1, len(hashes)) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8))


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Parity sketches (along the last axis) with fewer buckets: ``size`` of their elements each."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def nameless(key: bytes) -> int:
    """A negative stand-in for the missing doc_id of a class."""
    return -1 - (int.from_bytes(key[:8], "big") >> 2)


def subset_keys(h: bytes, m1: np.ndarray, m2: np.ndarray, most: int) -> list[bytes]:
    """Keys of the subsets that leave out up to ``most`` shingles."""
    h1, h2, n, top = int.from_bytes(h[:8], "big"), int.from_bytes(h[8:], "big"), len(m1), (1 << 64) - 1
    a, b, out = m1.tolist(), m2.tolist(), []
    for j in range(most + 1):
        for left in combinations(range(n), j):
            x, y = (h1 - sum(a[i] for i in left)) & top, (h2 - sum(b[i] for i in left)) & top
            out.append(x.to_bytes(8, "big") + y.to_bytes(8, "big") + (n - j).to_bytes(2, "big"))
    return out


def _signatures(docs: DataFrame, k: int, p: int, q: int, sketch, boundary: int, text: str) -> DataFrame:
    """Each document's class, set size, prefix and, where small, subset keys."""
    least = -(-p * (boundary + 1) // q)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                for a, b in batches_of(texts):
                    sets = [np.unique(r) for r in shingle_runs(texts[a:b], k)]
                    m1, m2, keys = class_keys(sets)
                    prefixes, subsets, briefs, sketches, first = [], [], [], [], 0
                    for s, h in zip(sets, keys, strict=True):
                        n = len(s)
                        if n >= max(1, least):
                            rank = (counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20))
                            length = prefix_length(n, p, q)
                            prefixes.append(s[np.argpartition(rank, length - 1)[:length]].view(np.int64))
                            whole = parity(m1[first : first + n])
                            briefs.append(folded(whole, BRIEF_BITS // 8).tobytes())
                            sketches.append(whole.tobytes() if 8 * len(whole) > BRIEF_BITS else None)
                        else:
                            prefixes.append(None)
                            briefs.append(None)
                            sketches.append(None)
                        subsets.append(subset_keys(h, m1[first : first + n], m2[first : first + n], deletions(n, p, q)) if 0 < n <= boundary else None)
                        first += n
                    ids = part.column(0).slice(a, b - a)
                    stand = [nameless(h) if i is None else i for i, h in zip(ids.to_pylist(), keys, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(stand, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                         pa.array(prefixes, pa.list_(pa.int64())), pa.array(subsets, pa.list_(pa.binary())), pa.array(briefs, pa.binary()), pa.array(sketches, pa.binary())],
                        ["doc_id", "doc", "cls", "n", "prefix", "subsets", "brief", "parity"],
                    )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(sign, "doc_id long, doc long, cls binary, n long, prefix array<long>, subsets array<binary>, brief binary, parity binary")


def _light_links(classes: DataFrame, p: int, q: int) -> DataFrame:
    """Links of small sets: each key's sets to the smallest of them."""
    rows = classes.filter("subsets is not null").select("cls", "n", F.explode("subsets").alias("key"))
    least = rows.groupBy("key").agg(F.min(F.struct("n", "cls")).alias("least"), F.count("*").alias("c")).filter("c > 1").drop("c")
    size = F.conv(F.hex(F.substring("key", 17, 2)), 16, 10).cast("long")
    met = rows.join(least, "key").filter(F.col("cls") != F.col("least.cls")).filter(q * size >= p * (F.col("n") + F.col("least.n") - size))
    return met.select(F.col("cls").alias("u"), F.col("least.cls").alias("v"))


def _blocks(sets: str, items: str) -> Column:
    most = F.greatest(F.lit(float(CELL_SETS)), BLOCK_ROOTS * F.sqrt(sets))
    return F.ceil(F.greatest(F.col(sets) / most, F.col(items) / CELL_ITEMS)).cast("long")


def _hot(members: DataFrame) -> DataFrame | None:
    """(pivot, c, blocks) of the hot cells of ``members`` (pivot, doc, n); None if there are none."""
    cells = members.groupBy("pivot").agg(F.count("*").alias("c"), F.sum("n").alias("items")).filter(F.col("c") > SMALL_CELL)
    hot = materialize(cells.select("pivot", "c", _blocks("c", "items").alias("blocks")).filter("blocks > 1"), "jaccard-hot")
    many = hot.count()
    return (F.broadcast(hot) if many <= HOT_CELLS else hot) if many else None


def _block(of: Column | str) -> Column:
    return F.pmod(F.xxhash64("doc"), of)


def _first_deal(members: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc, pivot, part, side): hot cells in blocks; the pivot and about ANCHORS more sets, of side 0, are in each of them."""
    rows = members.join(hot, "pivot")
    anchor = (F.col("doc") == F.col("pivot")) | (F.pmod(F.xxhash64(F.lit(7), "doc"), F.col("c")) < ANCHORS)
    parts = F.when(anchor, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(_block("blocks")))
    return rows.select("doc", "pivot", F.explode(parts).alias("part"), F.when(anchor, 0).otherwise(-1).alias("side"))


def _deal(members: DataFrame, hot: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """(doc, pivot, part, side): ``members`` (pivot, doc, n) with hot cells as pairs of blocks.

    A cell is (pivot, part); side is the set's block where the cell is a pair of blocks, else -1.  In a hot
    cell, sets of its largest component by ``known`` (doc, comp) don't meet one another.
    """
    if hot is None:
        return members.select("doc", "pivot", F.lit(0).cast("long").alias("part"), F.lit(-1).alias("side"))
    cold = members.join(hot, "pivot", "left_anti").select("doc", "pivot", F.lit(0).cast("long").alias("part"), F.lit(-1).alias("side"))
    rows = members.join(hot.select("pivot"), "pivot")
    rows = rows.join(known, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")) if known is not None else rows.withColumn("comp", F.col("doc"))
    parts = rows.groupBy("pivot", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    cells = parts.groupBy("pivot").agg(F.max(F.struct("c", "items", "comp")).alias("main"), F.sum("c").alias("all_c"), F.sum("items").alias("all_items"))
    cells = cells.select("pivot", F.col("main.comp").alias("main"), F.col("main.c").alias("c"), F.col("main.items").alias("items"), (F.col("all_c") - F.col("main.c")).alias("rest_c"), (F.col("all_items") - F.col("main.items")).alias("rest_items"))
    cells = materialize(cells.select("pivot", "main", _blocks("c", "items").alias("mains"), _blocks("rest_c", "rest_items").alias("rests")), "jaccard-parts")
    cells = F.broadcast(cells) if cells.count() <= HOT_CELLS else cells
    rows = rows.join(cells, "pivot")
    rest, main = rows.filter("comp != main").withColumn("block", _block("rests")), rows.filter("comp = main and rests > 0").withColumn("block", _block("mains"))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")

    low, high = F.least("block", "other"), F.greatest("block", "other")
    among = rest.select("*", each("rests")).select("doc", "pivot", (1 + low * F.col("rests") + high).alias("part"), F.when(low != high, F.col("block").cast("int")).otherwise(-1).alias("side"))
    out = rest.select("*", each("mains")).select("doc", "pivot", (-1 - F.col("block") * F.col("mains") - F.col("other")).alias("part"), F.lit(0).alias("side"))
    back = main.select("*", each("rests")).select("doc", "pivot", (-1 - F.col("other") * F.col("mains") - F.col("block")).alias("part"), F.lit(1).alias("side"))
    return cold.unionAll(among).unionAll(out).unionAll(back)


def groups_of(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow one another with the same first two fields."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:2] != row[:2]:
            yield held[0][:2], held
            held = []
        held.append(row)
    if held:
        yield held[0][:2], held


def union_find(m: int) -> tuple[Callable[[int], int], Callable[[int, int], bool]]:
    """Finder of the least element of a component, and joiner of two elements, which says whether they were apart."""
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: int, j: int) -> bool:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
        return a != b

    return find, join


def roots_of(m: int, links: list[tuple[int, int]]) -> list[int]:
    find, join = union_find(m)
    for i, j in links:
        join(i, j)
    return [find(i) for i in range(m)]


def differences(a: bytes, b: bytes) -> int:
    """In how many bits two parity sketches differ, the longer one folded."""
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = (folded(np.frombuffer(x, np.uint8), size).tobytes() for x in (a, b))
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def candidate_roots(sizes: list[int], sketches: list[bytes], sides: list[int], p: int, q: int) -> list[int]:
    """For each set the least set of its component under pairs that size and parity don't rule out."""
    m = len(sizes)
    find, join = union_find(m)

    if m <= 24:
        for i in range(m):
            for j in range(i):
                a, b = sizes[i], sizes[j]
                if q * min(a, b) >= p * max(a, b) and (sides[i] < 0 or sides[i] != sides[j]) and differences(sketches[i], sketches[j]) * (p + q) <= (a + b) * (q - p):
                    join(i, j)
        return [find(i) for i in range(m)]
    n, side = np.array(sizes), np.array(sides)
    lengths = np.array([len(x) for x in sketches]) // 8
    seen, words = np.zeros(0, np.int64), np.zeros((0, int(lengths.max())), np.uint64)
    for length in sorted(set(lengths.tolist()), reverse=True):  # longer sketches are folded to those of each length
        own = np.flatnonzero(lengths == length)
        words = np.concatenate([folded(words, length), np.frombuffer(b"".join(sketches[i] for i in own.tolist()), np.uint64).reshape(len(own), length)])
        at, seen = len(seen), np.concatenate([seen, own])
        for k, i in enumerate(own.tolist(), at):
            before = seen[:k]
            differ = np.bitwise_count(words[:k] ^ words[k]).sum(axis=1, dtype=np.int64)
            ok = (differ * (p + q) <= (n[before] + n[i]) * (q - p)) & (q * np.minimum(n[before], n[i]) >= p * np.maximum(n[before], n[i]))
            if sides[i] >= 0:
                ok &= side[before] != side[i]
            for j in before[ok].tolist():
                join(i, j)
    return [find(i) for i in range(m)]


def band_keys(items: np.ndarray, sizes: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each item with the size band of its set, and with the next: sets that may link share a key with one of its own band."""
    band = np.floor(np.log(np.maximum(sizes, 1)) / (math.log(q / p) * (1 + 1e-9))).astype(np.uint64) if p < q else sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        return tuple(mix(items.view(np.uint64) + mix(band + np.uint64(i), 41), 43).view(np.int64) for i in (0, 1))


def _members(classes: DataFrame, p: int, q: int) -> DataFrame:
    """(pivot, doc, n): classes that share a prefix shingle with one of like size, by the least of them."""
    spark = classes.sparkSession
    prefixes = classes.filter("prefix is not null")
    items = prefixes.select(F.explode("prefix").alias("item")).groupBy("item").agg(F.count("*").alias("c")).filter("c > 1").select("item")
    bits = spark.sparkContext.broadcast(_bitmap(items, ITEM_BITMAP))  # ITEM_BITMAP bits, whatever the input
    release(spark)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, n, key, own) of items that may stand in more than one prefix."""
        held = bits.value
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            docs, sizes = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())) for i in (0, 1))
            word, bit = bitmap_places(values, ITEM_BITMAP)
            keep = (held[word] & bit) != 0
            docs, sizes = docs[keep], sizes[keep]
            for key, own in zip(band_keys(values[keep], sizes, p, q), (True, False), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(sizes), pa.array(key), pa.array(np.full(len(key), own))], ["doc", "n", "key", "own"])
        give_back()

    rows = prefixes.select("doc", "n", "prefix").mapInArrow(thin, "doc long, n long, key long, own boolean")
    pivots = rows.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("c"), F.max("own").alias("own")).filter("c > 1 and own").select("key", "pivot")
    members = materialize(rows.join(pivots, "key").select("pivot", "doc", "n").distinct(), "jaccard-members")
    release(spark)
    return members


def _sift(dealt: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """(pivot, doc, n): sets of ``dealt`` cells with some partner that size and sketches (doc, n, sketch) don't rule out, by candidate component."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple[int, int, int]] = []
        for _, held in groups_of(rows):
            docs = [r[2] for r in held]
            roots = candidate_roots([r[3] for r in held], [r[4] for r in held], [r[5] for r in held], p, q)
            used = {r for i, r in enumerate(roots) if r != i}
            out += [(docs[r], docs[i], held[i][3]) for i, r in enumerate(roots) if r in used]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["pivot", "doc", "n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["pivot", "doc", "n"])
        give_back()

    rows = dealt.join(sketches, "doc").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "doc")
    found = rows.select("pivot", "part", "doc", "n", "sketch", "side").mapInArrow(sift, "pivot long, doc long, n long").distinct()
    found = materialize(found, "jaccard-candidates")
    release(dealt.sparkSession)
    return found


def forest(sets: list[np.ndarray], sides: list[int], p: int, q: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with two sides, of those across."""
    m = len(sets)
    join = union_find(m)[1]
    out = []
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if q * sizes.min() >= p * sizes.max() else 0
        return [(1, 0)] if common and q * common >= p * (int(sizes.sum()) - common) else []
    side = np.array(sides)
    _, items, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    lists = np.argsort(items, kind="stable")
    posting, starts = owner[lists], np.concatenate([[0], np.cumsum(counts)])
    first = 0
    for i in range(m):
        own = items[first : first + sizes[i]]
        first += sizes[i]
        own = own[counts[own] > 1]
        lengths = counts[own]
        if not len(own):
            continue
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(posting[at], minlength=m)[:i]
        met = q * common >= p * (sizes[i] + sizes[:i] - common)
        met &= common > 0
        if side[i] >= 0:
            met &= side[:i] != side[i]
        for j in np.flatnonzero(met).tolist():
            if join(i, j):
                out.append((i, j))
    return out


def bitmap_places(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each 64-bit value in a bitmap of ``size`` bits."""
    h = mix(values.view(np.uint64), 31) & np.uint64(size - 1)
    return (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))


def _bitmap(values: DataFrame, size: int) -> np.ndarray:
    """One bit for the hash of each of ``values``: what isn't set is not among them.  Joins that follow are exact; this spares them rows."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = bitmap_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    rows = values.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # size / 64 rows at most
    out = np.zeros(size >> 6, np.uint64)
    out[rows.column(0).to_numpy().astype(np.int64)] = rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out


def _heavy_links(docs: DataFrame, classes: DataFrame, k: int, p: int, q: int, text: str) -> DataFrame:
    members = _members(classes, p, q)
    hot = _hot(members)
    first = known = None
    if hot is not None:
        first = materialize(_exact_links(docs, _first_deal(members, hot), k, p, q, text, anchored=True), "jaccard-first")
        release(docs.sparkSession)
        known = first.filter("comp is not null").groupBy("doc").agg(F.min("comp").alias("comp"))
    left = _sift(_deal(members, hot, known), classes.select("doc", "n", F.col("brief").alias("sketch")), p, q)
    discard(members)
    if not left.filter(F.col("n") > BRIEF_BITS).isEmpty():  # else the whole sketches are the brief ones
        left, last = _sift(_deal(left, _hot(left), known), classes.select("doc", "n", F.coalesce("parity", "brief").alias("sketch")), p, q), left
        discard(last)
    links = _exact_links(docs, _deal(left, _hot(left), known), k, p, q, text)
    links = links.select("u", "v")
    return links if first is None else links.unionAll(first.filter("u is not null").select("u", "v"))


def _exact_links(docs: DataFrame, dealt: DataFrame, k: int, p: int, q: int, text: str, anchored: bool = False) -> DataFrame:
    """(u, v) of a spanning forest of the links in each of the cells ``dealt`` (doc, pivot, part, side).

    Where cells are ``anchored``, side 0 marks anchors, and rows (doc, comp) name the least anchor to which each set is joined.
    """
    cells = materialize(dealt, "jaccard-cells")
    release(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(cells.select("doc"), BITMAP))  # BITMAP bits, whatever the input

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that may be in a cell; those without an id get their stand-in."""
        held = bits.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            missing = np.flatnonzero(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            if len(missing):
                keys = [class_keys([np.unique(r) for r in shingle_runs([batch.column(1)[i].as_py()], k)])[2][0] for i in missing.tolist()]
                ids = np.where(np.isin(np.arange(len(ids)), missing), 0, ids).astype(np.int64)
                ids[missing] = [nameless(h) for h in keys]
            ids = ids.astype(np.int64)
            word, bit = bitmap_places(ids, BITMAP)
            keep = pa.array((held[word] & bit) != 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids).filter(keep), batch.column(1).filter(keep)], ["doc", "text"])
        give_back()

    named = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(pick, "doc long, text string")
    # texts travel, not sets: compressed they are less than half as large
    dealt = named.join(cells, "doc").repartition("pivot", "part").sortWithinPartitions("pivot", "part")

    form = "u binary, v binary, doc long, comp long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    sets = [np.unique(r) for r in shingle_runs(part.column(3).to_pylist(), k)]
                    yield from zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), class_keys(sets)[2], sets, strict=True)

        def links(held: dict[bytes, tuple]) -> list[tuple]:
            if len(held) < 2:
                return []
            keys, values = list(held), list(held.values())
            found = forest([v[0] for v in values], [-1 if anchored else v[1] for v in values], p, q)
            out: list[tuple] = [(max(keys[i], keys[j]), min(keys[i], keys[j]), None, None) for i, j in found]
            if anchored:
                roots = roots_of(len(values), found)
                least: dict[int, int] = {}
                for root, (_, side, doc) in zip(roots, values, strict=True):
                    if side == 0:
                        least[root] = min(doc, least.get(root, doc))
                out += [(None, None, doc, least[root]) for root, (_, _, doc) in zip(roots, values, strict=True) if root in least]
            return out

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["u", "v", "doc", "comp"])

        out, held, cell = [], {}, None
        for pivot, part, doc, side, key, items in rows():
            if (pivot, part) != cell:
                out += links(held)
                held, cell = {}, (pivot, part)
                if len(out) > 5000:
                    yield batch(out)
                    out = []
            held.setdefault(key, (items, side, doc))  # rows that repeat a document add nothing
        out += links(held)
        if out:
            yield batch(out)
        give_back()

    return dealt.select("pivot", "part", "doc", "text", "side").mapInArrow(scan, form)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the least node of its component."""
    # links are made once, here
    stars = materialize(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        both = stars.select("u", "v", F.lit(1).alias("above")).unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("above")))
        least = both.groupBy("u").agg(F.min("v").alias("w"), F.sum("above").alias("above"), F.count("*").alias("all"))
        if least.filter("above > 1 or above between 1 and all - 1").isEmpty():
            break  # who has a lesser neighbour has no other
        large = both.join(least.select("u", F.least("u", "w").alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        last, stars = stars, materialize(small.filter("u != v").distinct(), "stars")
        discard(last)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_documents(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; threshold p/q on k-word shingles."""
    spark = docs.sparkSession
    counts, sizes = _sketch(docs, k, text)
    boundary = choose_boundary(sizes, p, q)
    sketch = spark.sparkContext.broadcast(counts)  # SKETCH counters of 4 bytes, whatever the input
    signed = materialize(_signatures(docs, k, p, q, sketch, boundary, text), "jaccard-signed")
    classes = signed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("doc")).alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("subsets").alias("subsets"), F.first("brief").alias("brief"), F.first("parity").alias("parity"))
    classes = materialize(classes, "jaccard-classes")
    release(spark)
    roots = components(_light_links(classes, p, q).unionAll(_heavy_links(docs, classes, k, p, q, text)))
    ids = classes.select("cls", "doc_id")
    linked = materialize(roots.join(ids, F.col("node") == F.col("cls")).select("cls", "root", "doc_id"), "jaccard-linked")
    # both are written before they are joined: a component may hold a third of all classes, a class a third of all rows, and
    # only joins of plain tables are split at a hot key
    least = materialize(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    named = ids.join(linked.join(least, "root").select("cls", "component_id"), "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = materialize(named, "jaccard-components")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    return rows.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """``docs`` without those whose component has a document of smaller doc_id; of repeated rows one stays."""
    linked = link_documents(docs, k, p, q)
    kept = linked.filter((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull()).select("doc_id").distinct()
    left = docs.join(kept.filter("doc_id is not null"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, p=9, q=10)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.y, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
