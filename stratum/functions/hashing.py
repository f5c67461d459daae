"""Canonical forms and digests, for driver values and as columns.

A table's *state* is a sum: each row's SHA-256 is read as four 64-bit lanes, and lanes are added up modulo
2**64 over all rows.  Sums need neither order nor a sort, are combined on the map side, and follow a
commit from its row effects alone: take the before-images away, add the after-images.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES, LANE = 4, 1 << 64
Lanes = tuple[int, ...]
EMPTY: Lanes = (0,) * (LANES + 1)  # the last is the count of rows


def canonical_json(value: Any) -> str:
    """Compact JSON, keys in code-point order at every level."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_hex(value: Any) -> str:
    text = value if isinstance(value, str) else canonical_json(value)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_cell(name: str, kind: T.DataType) -> Column:
    """Storage class and value of a cell as text: ``i``, ``r``, ``d``, ``t`` or ``b``, or ``n`` for null."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        made = F.concat(F.lit("t:"), F.hex(c))
    elif isinstance(kind, T.BinaryType):
        made = F.concat(F.lit("b:"), F.hex(c))
    elif isinstance(kind, T.IntegralType):
        made = F.concat(F.lit("i:"), c.cast("string"))
    elif isinstance(kind, T.DecimalType):
        made = F.concat(F.lit("d:"), c.cast("string"))
    elif isinstance(kind, T.FractionalType):
        made = F.concat(F.lit("r:"), c.cast("double").cast("string"))
    else:
        made = F.concat(F.lit("t:"), F.hex(c.cast("string")))
    return F.coalesce(made, F.lit("n"))


def decode_cell(cell: Column, kind: T.DataType) -> Column:
    body = F.substr(cell, F.lit(3))
    if isinstance(kind, T.StringType):
        made = F.decode(F.unhex(body), "UTF-8")
    elif isinstance(kind, T.BinaryType):
        made = F.unhex(body)
    else:
        made = body.cast(kind)
    return F.when(cell != "n", made)


def _plain(name: str) -> bool:
    """Is ``name`` written in JSON as it is?"""
    return name.replace("$", "_").isidentifier()


def encoded(schema: T.StructType, names: list[str] | None = None) -> Column:
    """The named cells of a row as one JSON object of encoded cells, in order of name."""
    kinds = {f.name: f.dataType for f in schema}
    cells = {n: encode_cell(n, kinds[n]) for n in sorted(names or kinds)}
    if not all(map(_plain, cells)):
        return F.to_json(F.struct(*[c.alias(n) for n, c in cells.items()]))
    # cells hold nothing that JSON escapes, so the object is put together as text
    parts = [part for n, c in cells.items() for part in (F.lit(f'","{n}":"'), c)]
    return F.concat(F.lit(f'{{"{next(iter(cells))}":"'), *parts[1:], F.lit('"}'))


def cell(image: Column, name: str, kind: T.DataType) -> Column:
    """One typed column of an encoded image; null where the image has no such cell."""
    if not _plain(name):
        return decode_cell(F.element_at(F.from_json(image, T.MapType(T.StringType(), T.StringType())), name), kind)
    mark = f'"{name}":"'  # a cell's text has no quotes, so it stands nowhere else
    found = F.substring_index(F.substring_index(image, mark, -1), '"', 1)
    return F.when(F.contains(image, F.lit(mark)), decode_cell(found, kind))


def decoded(image: Column, schema: T.StructType) -> list[Column]:
    """Typed columns of an encoded image."""
    if not all(_plain(f.name) for f in schema):
        cells = F.from_json(image, T.MapType(T.StringType(), T.StringType()))
        return [decode_cell(F.element_at(cells, f.name), f.dataType).alias(f.name) for f in schema]
    return [cell(image, f.name, f.dataType).alias(f.name) for f in schema]


#: Letters of the types whose cells read back and written again are the same text.
LETTERS = {T.LongType: "i", T.DoubleType: "r", T.StringType: "t", T.BinaryType: "b"}


def form(schema: T.StructType) -> str | None:
    """A pattern of the images that ``encoded`` makes for ``schema``; None where types or names allow no such check."""
    kinds = {f.name: LETTERS.get(type(f.dataType)) for f in schema}
    if not all(kinds.values()) or not all(map(_plain, kinds)):
        return None
    return r"^\{" + ",".join(f'"{re.escape(n)}":"(?:{kinds[n]}:[^"]*|n)"' for n in sorted(kinds)) + r"\}$"


def digest(image: Column) -> Column:
    return F.sha2(image.cast("binary"), 256)


def lane_sum(hash_column: Column, k: int, sign: Column | None = None) -> Column:
    """Aggregate: the exact sum of a lane, by halves of 32 bits in longs (2**31 rows; more raise an overflow)."""

    def half(at: int) -> Column:
        word = F.conv(F.substring(hash_column, at, 8), 16, 10).cast("long")
        return F.coalesce(F.sum(word if sign is None else word * sign), F.lit(0)).cast("decimal(19,0)")

    return half(16 * k + 1) * F.lit(1 << 32).cast("decimal(10,0)") + half(16 * k + 9)


def lane_sums(hash_column: Column) -> list[Column]:
    """Aggregates: the four lanes of a hexadecimal digest, and how many there are."""
    return [*[lane_sum(hash_column, k).alias(f"lane{k}") for k in range(LANES)], F.count(hash_column).alias("n")]


def collect_lanes(df: DataFrame, hash_column: str) -> Lanes:
    return lanes_of(df.agg(*lane_sums(F.col(hash_column))).first())


def lanes_of(row: Row) -> Lanes:
    return (*(int(row[f"lane{k}"]) % LANE for k in range(LANES)), int(row["n"]))


def add(a: Lanes, b: Lanes, sign: int = 1) -> Lanes:
    return (*((x + sign * y) % LANE for x, y in zip(a[:LANES], b[:LANES], strict=True)), a[LANES] + sign * b[LANES])


def lanes_hex(lanes: Lanes) -> str:
    return sha256_hex(":".join(map(str, lanes)))


def state_hash(tables: dict[str, Lanes]) -> str:
    return sha256_hex({name: list(lanes) for name, lanes in tables.items()})
