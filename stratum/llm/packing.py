"""Cost-balanced packing of documents into sequences of at most ``capacity`` tokens.

A document costs ``linear * tokens + quadratic * tokens ** 2`` (attention stays inside a document).
Documents are taken in descending cost, each to the sequence of lowest cost so far that has token
capacity left; what does not fit is cut off and takes its turn again by its own cost.  Every sequence of
a block is thus filled to the last token, and what a block leaves over goes to the next one.  The last
few tokens of an input partition fill sequences whose lengths are powers of two, which need no padding.

A partition is packed as a stream of bounded blocks: memory is bounded by BLOCK_TOKENS and the largest
document, nothing is shuffled, and a partition that is read again gives the same sequences.

Tokenising goes through a cache of white-space-free chunks, since the tokenizer never joins across white
space; a chunk that is not in the cache goes to the tokenizer itself.

Defined results: a null or empty text is the one closing token; repeated rows are packed one by one; an
empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, table

CAPACITY = 4096
BLOCK_TOKENS = 256 * CAPACITY
CLOSING_ID = 2
#: Chunks that each of the two generations of the cache holds.
CACHE_CHUNKS = 250_000

_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")


class Encoder:
    """Token ids of a text as little-endian 32-bit integers, by way of cached chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        encode = Tokenizer.from_file(path).encode

        class Cache(dict):
            older: dict = {}

            def __missing__(self, chunk: bytes) -> bytes:
                ids = self.older.get(chunk)
                if ids is None:
                    ids = b"".join(i.to_bytes(4, "little") for i in encode(chunk.decode(), add_special_tokens=False).ids)
                if len(self) >= CACHE_CHUNKS:
                    self.older = dict(self)
                    self.clear()
                self[chunk] = ids
                return ids

        self.cache = Cache()

    def __call__(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        if b"<|" not in raw:  # else it may hold a special token, which is matched as written
            raw = _STOP.sub(rb" \1", raw.lower())
        return b"".join(map(self.cache.__getitem__, raw.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


def balance(pieces: list[Piece], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences filled to ``capacity``, and the pieces left over (fewer tokens than ``capacity``)."""
    full, items, order = [], [], 0
    for p in pieces:
        while len(p) > capacity:
            head, p = p.cut(capacity)
            full.append([head])
        items.append((-len(p), order, p))
        order += 1
    heapq.heapify(items)
    count = sum(-n for n, _, _ in items) // capacity
    made: list[list[Piece]] = [[] for _ in range(count)]
    room = [capacity] * count
    costs = [(0.0, k) for k in range(count)]
    while costs:
        _, _, p = heapq.heappop(items)
        cost, k = costs[0]
        if len(p) > room[k]:
            p, rest = p.cut(room[k])
            heapq.heappush(items, (-len(rest), order, rest))
            order += 1
        made[k].append(p)
        room[k] -= len(p)
        if room[k]:
            heapq.heapreplace(costs, (cost + linear * len(p) + quadratic * len(p) ** 2, k))
        else:
            heapq.heappop(costs)
    return full + made, [p for _, _, p in sorted(items, key=lambda x: x[:2])]


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are the powers of two in the sum of the pieces, largest first."""
    total, out, left = sum(map(len, pieces)), [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                p = left.pop()
                if len(p) > room:
                    p, rest = p.cut(room)
                    left.append(rest)
                own.append(p)
                room -= len(p)
            out.append(own)
    return out


def pack_partition(docs: Iterator[tuple[int, bytes]], capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> Iterator[list[list[Piece]]]:
    held: list[Piece] = []
    size = 0
    for doc_id, ids in docs:
        held.append(Piece(doc_id, 0, ids, len(ids) // 4))
        size += len(held[-1])
        if size >= block_tokens:
            made, held = balance(held, capacity)
            size = sum(map(len, held))
            yield made
    made, held = balance(held, capacity)
    yield made + powers_of_two(held)


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, text: str = "text") -> DataFrame:
    """One row a piece.  ``tokenizer``: a file's path, or its name among the public tokenizers."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode, close = encoder(tokenizer), closing_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 40

        def encoded() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        yield doc_id, encode(t or "") + close

        for sequences in pack_partition(encoded(), capacity):
            rows = []
            for s in sequences:
                at = 0
                for p in s:
                    rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, at))
                    at += len(p)
                number += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, FIELDS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
