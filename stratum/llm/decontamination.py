"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

Pass one counts, over all documents, how often each word of the benchmark occurs.  An alignment that reaches
``threshold`` of an item's own score matches a least number of the item's words, so it can pass by only so
many of them: of the rarest words, a few more than that, at least ``need`` are matched, all within a stretch
of ``reach`` words of the document.  These rarest words are the item's seeds.  Pass two finds the stretches
that hold enough seeds, joins those that overlap, and Smith-Waterman aligns the item's words with each.  A
document is reported with an item where the best alignment reaches the threshold; the seeds only spare
work, so the result is that of aligning every item with every whole document.

The benchmark is a stated query set: it is taken in blocks of BLOCK_BYTES, each held by every task, and
each block is held against all documents.

Defined results: words are compared without regard to case, by Unicode's case folding; null and empty texts
and items match nothing; an item of fewer than SEED_WORDS words, which stands in many a clean text, is held by
documents that consist of just its words; of an item with several null or equal ids each row is an item of its own; repeated documents are each reported; documents without a
doc_id are reported with a null and stay in ``drop_leaks``; an empty table gives an empty table;
extra columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, materialize, table
from .shingles import batches_of, hash_words

SEED_WORDS = 3
#: Benchmark text that one pass holds in each task.
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Cells of one alignment row, over all windows that are aligned together.
ALIGN_CELLS = 1 << 16
#: One in so many of the words that an alignment must match is asked for among the seeds.
NEED_SHARE = 4
#: Characters of text that are looked through together: the more, the more windows an alignment takes at once.
BATCH_CHARS = 1 << 20
#: Seeds found that are looked through together, in whole documents.
HITS = 1 << 20
LEAK = "doc_id long, item_id long, score double, start_word long, end_word long"


def folded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``hash_words`` of the texts without regard to case."""
    return hash_words([t and t.casefold() for t in texts])


class Items:
    """A block of benchmark items: words, the items of each word, and after counting those it is a seed of."""

    def __init__(self, rows: list[tuple[int | None, str | None]], n: int):
        self.ids = [r[0] for r in rows]
        words, ends = folded_words([r[1] for r in rows])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(rows) else ends
        self.words = [words[a:b] for a, b in zip(starts, ends, strict=True)]
        self.long = [k for k, w in enumerate(self.words) if len(w) >= n]
        self.short: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < n:
                self.short.setdefault(w.tobytes(), []).append(k)
        self.shortest = n
        self.grams, flat = np.unique(np.concatenate([*(self.words[k] for k in self.long), np.zeros(0, np.uint64)]), return_inverse=True)
        self.places = np.split(flat, np.cumsum([len(self.words[k]) for k in self.long])[:-1]) if self.long else []
        self._file(self.places)

    def _file(self, seeds: list[np.ndarray]) -> None:
        """File the items under their words in ``seeds``."""
        owner = np.repeat(np.array(self.long, np.int64), [len(s) for s in seeds])
        pairs = np.unique(np.stack([np.concatenate([*seeds, np.zeros(0, np.int64)]), owner]).astype(np.int64), axis=1)
        self.owner = pairs[1]
        self.first, self.last = (np.searchsorted(pairs[0], np.arange(len(self.grams)), side) for side in ("left", "right"))
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.grams[self.first < self.last] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def choose_seeds(self, counts: np.ndarray, threshold: float) -> None:
        """Of each item the rarest words that an alignment of ``threshold`` can't do without.

        A score of s takes s / MATCH matched words or more, and other words of the document cost 1 each: of m
        words at most m - least go unmatched, and the alignment spans at most m + MATCH * m - s words.
        """
        self.need, self.reach = np.ones(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        seeds = []
        for k, place in zip(self.long, self.places, strict=True):
            m = len(place)
            least = max(math.ceil(threshold * m - 1e-9), 1)
            self.need[k] = need = -(-least // NEED_SHARE)
            self.reach[k] = m + math.floor(MATCH * m * (1 - threshold) + 1e-9)
            seeds.append(place[np.argsort(counts[place], kind="stable")][: max(m - least + need, 0)] if least <= m else place[:0])
        self._file(seeds)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, word of the benchmark) of every filed word."""
        at = np.flatnonzero(self.mask[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.grams, words[at]), max(len(self.grams) - 1, 0))
        keep = (self.grams[gram] == words[at]) & (self.first[gram] < self.last[gram]) if len(at) else np.zeros(0, bool)
        return at[keep], gram[keep]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window: score, and the window's words up to its end."""
    c, wide, tall = len(items), max(map(len, windows)), max(map(len, items))
    a, b = np.zeros((c, tall), np.uint64), np.ones((c, wide), np.uint64)  # 0 and 1 fill up and never meet
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    ramp = np.arange(wide, dtype=np.int32) * -GAP
    row, best, end = np.zeros((c, wide), np.int32), np.zeros(c, np.int32), np.zeros(c, np.int64)
    lines = np.arange(c)
    for i in range(tall):
        step = np.where(b == a[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
        step[:, 1:] += row[:, :-1]
        np.maximum(step, row + np.int32(GAP), out=step)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + ramp, axis=1) - ramp
        at = row.argmax(axis=1)
        top = row[lines, at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def _windows(items: Items, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, word after the last) of every stretch with seeds enough for an item."""
    at, gram = items.hits(words)
    many = items.last[gram] - items.first[gram]
    doc = np.searchsorted(ends, at, "right")
    upto = np.cumsum(many)
    out: list[tuple[int, int, int, int]] = []
    a = 0
    while a < len(at):
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")), a + 1)
        b = int(np.searchsorted(doc, doc[b - 1], "right")) if doc[b - 1] == doc[a] else b if b == len(at) else int(np.searchsorted(doc, doc[b], "left"))
        out += _stretches(items, at[a:b], gram[a:b], many[a:b], len(words), ends)
        a = b
    return out


def _stretches(items: Items, at: np.ndarray, gram: np.ndarray, many: np.ndarray, n: int, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    pick = np.repeat(items.first[gram] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    item, at = np.divmod(np.sort(items.owner[pick] * n + np.repeat(at, many)), n)
    doc = np.searchsorted(ends, at, "right")
    here = np.arange(len(at))
    there = here + items.need[item] - 1
    here, there = here[there < len(at)], there[there < len(at)]
    keep = (item[there] == item[here]) & (doc[there] == doc[here]) & (at[there] - at[here] < items.reach[item[here]])
    here, there = here[keep], there[keep]
    if not len(here):
        return []
    doc, item, lo, hi = doc[here], item[here], at[there] - items.reach[item[here]] + 1, at[here] + items.reach[item[here]]
    lo, hi = np.maximum(lo, np.concatenate([[0], ends])[doc]), np.minimum(hi, ends[doc])
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])]))
    return list(zip(doc[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist(), strict=True))


def leaks_in(items: Items, texts: list[str | None], threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of the best alignment of each leaked item."""
    words, ends = folded_words(texts)
    todo = sorted(_windows(items, words, ends), key=lambda w: (w[3] - w[2], w))
    best: dict[tuple[int, int], tuple] = {}
    at = 0
    while at < len(todo):
        upto, wide = at, 0
        while upto < len(todo) and (upto == at or (upto - at + 1) * max(wide, todo[upto][3] - todo[upto][2]) <= ALIGN_CELLS):
            wide = max(wide, todo[upto][3] - todo[upto][2])
            upto += 1
        part = todo[at:upto]
        at = upto
        scores, finish = align([items.words[k] for _, k, _, _ in part], [words[lo:hi] for _, _, lo, hi in part])
        good = [j for j, (_, k, _, _) in enumerate(part) if scores[j] >= threshold * MATCH * len(items.words[k])]
        if not good:
            continue
        _, back = align([items.words[part[j][1]][::-1] for j in good], [words[part[j][2] : part[j][2] + finish[j]][::-1] for j in good])
        for j, b in zip(good, back.tolist(), strict=True):
            d, k, lo, _ = part[j]
            first = int(ends[d - 1]) if d else 0
            stop = lo + int(finish[j]) - first
            found = (scores[j] / (MATCH * len(items.words[k])), -(stop - b), stop)
            best[d, k] = max(best.get((d, k), found), found)
    first = np.concatenate([[0], ends]).astype(np.int64)
    for d in np.flatnonzero((np.diff(first) < items.shortest) & (np.diff(first) > 0)).tolist() if items.short else ():
        own = words[first[d] : first[d + 1]]
        best |= {(d, k): (1.0, 0, len(own)) for k in items.short.get(own.tobytes(), ())}
    return [(d, k, float(s), -start, stop) for (d, k), (s, start, stop) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in blocks of about BLOCK_BYTES."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.select("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = SEED_WORDS) -> DataFrame:
    """One row for each document and item that it holds."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], LEAK)
    for rows in _blocks(benchmark):
        items = Items(rows, n)
        if not len(items.grams) and not items.short:
            continue
        held = spark.sparkContext.broadcast(items)  # BLOCK_BYTES of text at most

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            sums = np.zeros(len(items.grams), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    texts = batch.column(0).slice(at, 1024).to_pylist()
                    for a, b in batches_of(texts, BATCH_CHARS):
                        sums += np.bincount(items.hits(folded_words(texts[a:b])[0])[1], minlength=len(sums))
            some = np.flatnonzero(sums)
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["gram", "n"])

        counts = np.zeros(len(items.grams), np.int64)
        for r in own.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            counts[r["gram"]] = r["n"]
        items.choose_seeds(counts, threshold)
        seeded = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], held=seeded) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    for a, b in batches_of(texts, BATCH_CHARS):
                        rows = [(ids[a + d], items.ids[k], s, x, y) for d, k, s, x, y in leaks_in(items, texts[a:b], threshold)]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])
            give_back()

        out = out.unionAll(own.mapInArrow(find, LEAK))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    leaked = materialize(find_leaks(docs, benchmark, threshold).select("doc_id").filter("doc_id is not null").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
