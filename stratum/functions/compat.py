"""Column functions whose meaning follows the embedded database rather than Spark's ANSI rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def spark_type(declared: str) -> T.DataType:
    """The column type of a declared type, by its affinity."""
    name = declared.upper()
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\((\d+)(?:,(\d+))?\)", name.replace(" ", "")):
        if int(m[1]) <= 38:
            return T.DecimalType(int(m[1]), int(m[2] or 0))
    if "INT" in name or name == "BOOLEAN":
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT", "STRING", "DATE", "TIME", "JSON", "UUID")):
        return T.StringType()
    if "BLOB" in name or name == "BINARY":
        return T.BinaryType()
    return T.DoubleType()


def to_number(text: Column) -> Column:
    """The leading number of a text, 0 where there is none."""
    found = F.regexp_extract(F.ltrim(text), r"^[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", 0)
    return F.coalesce(F.when(found != "", found).cast("double"), F.lit(0.0))


def to_integer(text: Column) -> Column:
    found = F.regexp_extract(F.ltrim(text), r"^[+-]?\d+", 0)
    return F.when(text.isNotNull(), F.coalesce(F.when(found != "", found).try_cast("bigint"), F.lit(0)))


def cast_like(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """CAST: text to number takes the leading number, real to integer cuts off, null stays null."""
    if source == target:
        return c
    if isinstance(target, T.StringType):
        return F.decode(c, "UTF-8") if isinstance(source, T.BinaryType) else c.cast("string")
    if isinstance(target, T.BinaryType):
        return F.encode(c if isinstance(source, T.StringType) else c.cast("string"), "UTF-8")
    if isinstance(source, T.BinaryType):
        c, source = F.decode(c, "UTF-8"), T.StringType()
    if isinstance(source, T.StringType):
        return to_integer(c) if isinstance(target, T.LongType) else F.when(c.isNotNull(), to_number(c)).cast(target)
    if isinstance(target, T.LongType) and isinstance(source, T.FractionalType):
        edge = F.lit(9.223372036854775e18)
        cut = F.greatest(F.least(c.cast("double"), edge), -edge)
        return F.when(F.isnan(c.cast("double")), F.lit(0)).when(c.isNotNull(), cut.cast("bigint"))
    return c.cast(target)


def contains_text(c: Column, value: str) -> Column:
    """``LIKE '%value%'`` without wildcards, blind to ASCII case only."""
    return lower_ascii(c.cast("string")).contains(value.translate(str.maketrans(UPPER, LOWER)))


def glob(c: Column, pattern: str) -> Column:
    made = re.sub(r"\\\[(\^?)(.*?)\\\]", r"[\1\2]", re.escape(pattern)).replace(r"\*", ".*").replace(r"\?", ".")
    return c.rlike(f"(?s)\\A{made}\\z")


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def group_concat(c: Column, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_list(c)), separator)


def substr(c: Column, start: int, length: int | None = None) -> Column:
    """Position 0 stands before the first character."""
    if start == 0 and length is not None:
        return F.substr(c, F.lit(1), F.lit(max(0, length - 1)))
    return F.substr(c, F.lit(start)) if length is None else F.substr(c, F.lit(start), F.lit(length))


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def integer_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.floor(F.abs(a) / F.abs(b)) * F.signum(a.cast("double")) * F.signum(b.cast("double"))).cast("bigint")


def scalar_min(*cs: Column) -> Column:
    """Null where any argument is null."""
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(~some, F.least(*cs))


def scalar_max(*cs: Column) -> Column:
    some = cs[0].isNull()
    for c in cs[1:]:
        some = some | c.isNull()
    return F.when(~some, F.greatest(*cs))


# Date format letters and their Spark patterns.
DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def strftime(pattern: str, c: Column) -> Column:
    made = "".join(DATE_LETTERS.get(x) or ("'" + x.replace("'", "''") + "'" if x.isalpha() else x) for x in re.findall(r"%.|.", pattern))
    return F.date_format(c, made)


def julianday(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(86_400_000_000) + F.lit(2440587.5)


def date_shift(c: Column, *modifiers: str) -> Column:
    """A timestamp moved by modifiers in order: ``+3 days``, ``-1 month``, ``start of year``, ``weekday 0`` (Sunday; the day itself or the next such).

    Months and years keep the day's number, so days past a month's last are counted on: January 31 and one month is early in March.
    """
    at = c.cast("timestamp_ntz")
    for modifier in modifiers:
        text = modifier.strip().lower()
        if m := re.fullmatch(r"([+-]?\d+)\s+(second|minute|hour|day)s?", text):
            unit = {"second": "secs", "minute": "mins", "hour": "hours", "day": "days"}[m[2]]
            at = at + F.make_dt_interval(**{unit: F.lit(int(m[1]))})
        elif m := re.fullmatch(r"([+-]?\d+)\s+(month|year)s?", text):
            first = F.date_trunc("month", at).cast("timestamp_ntz")
            at = first + F.make_ym_interval(F.lit(0), F.lit(int(m[1]) * (12 if m[2] == "year" else 1))) + (at - first)
        elif m := re.fullmatch(r"start of (day|month|year)", text):
            at = F.date_trunc(m[1], at).cast("timestamp_ntz")
        elif m := re.fullmatch(r"weekday ([0-6])", text):
            at = at + F.make_dt_interval(F.pmod(F.lit(int(m[1]) + 1) - F.dayofweek(at), F.lit(7)))
        else:
            raise ValueError(f"no such modifier: {modifier}")
    return at


def storage_class(c: Column, kind: T.DataType) -> Column:
    """null, integer, real, text or blob."""
    name = "text" if isinstance(kind, T.StringType) else "blob" if isinstance(kind, T.BinaryType) else "real" if isinstance(kind, T.FractionalType) else "integer"
    return F.when(c.isNull(), "null").otherwise(name)


def quote(c: Column, kind: T.DataType) -> Column:
    """A cell as a literal of SQL text."""
    if isinstance(kind, T.StringType):
        made = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(kind, T.BinaryType):
        made = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    else:
        made = (c.cast("long") if isinstance(kind, T.BooleanType) else c).cast("string")
    return F.coalesce(made, F.lit("NULL"))


def equal_by_affinity(text: Column, number: Column) -> Column:
    """A text against a column of numbers: equal where the whole text is a number of that value."""
    return F.when(text.isNotNull() & number.isNotNull(), F.coalesce(F.trim(text).try_cast("decimal(38,10)") == number, F.lit(False)))


def json_valid(c: Column) -> Column:
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())


def json_extract(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def normalize_cell(c: Column, kind: T.DataType) -> Column:
    """A cell as shown: non-finite numbers null, bytes as base64, nested values as JSON text."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c)
    return c
