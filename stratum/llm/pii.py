"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier
cues.  From each anchor a deterministic local parser walks outwards to the boundaries of an e-mail
address, network address, card number, telephone number, account or secret, and validates it (octet
range, Luhn, digit count, IBAN checksum).  Parsers advance past what they have read, so the work is
linear in the text.

``email``, ``ip``, ``card`` and ``phone`` are the leftmost, non-overlapping matches of the base forms,
kept where valid and not retried otherwise.  ``account``, ``iban`` and ``url`` (credentials in a URL)
are what the method adds.

Defined results: a null text counts as empty (no spans); offsets are code points, ends exclusive; a text
of any length is read whole; repeated rows each get their own result; an empty table gives an empty
table; extra columns stay in ``mask_documents`` and are left out of ``find_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "url")
#: Words that announce an identifier; looked for in lower case, capitalised and in upper case.
CUES = ("token", "password", "passwd", "api_key", "apikey", "secret", "account", "iban", "ssn", "passport")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_VALUE = re.compile(r"[\x20_a-zA-Z]{0,12}[\x20]?[:=#][\x20]?[\"']?([A-Za-z0-9_./+=-]{6,})")
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
_made: dict = {}


def automaton():
    if "a" not in _made:
        import ahocorasick

        a = ahocorasick.Automaton()
        for mark in ("@", "+", "://", *"0123456789"):
            a.add_word(mark, (mark if mark in ("@", "+", "://") else "0", len(mark)))
        for cue in CUES:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, ("iban" if cue == "iban" else "cue", len(form)))
        a.make_automaton()
        _made["a"] = a
    return _made["a"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of ``text``, by kind as listed and then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = ip_end = card_end = phone_end = 0
    for last, (mark, width) in automaton().iter(text):
        if mark == "0":
            if last >= card_end:
                m = _DIGITS.match(text, last)
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if last >= ip_end:
                m = _QUAD.match(text, last)
                if m is None:
                    ip_end = _RUN.match(text, last).end()
                else:
                    ip_end = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                        found["ip"].append(m.span())
        elif mark == "@":
            start = last
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                found["email"].append((start, m.end()))
                mail_end = m.end()
        elif mark == "+":
            if last >= phone_end and (m := _PHONE.match(text, last + 1)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append((last, m.end()))
        elif mark == "://":
            if m := _USERINFO.match(text, last + 1):
                found["url"].append(m.span())
        elif mark == "iban":
            if (m := _IBAN.match(text, last + 1)) and iban_ok(m[1]):
                found["iban"].append(m.span(1))
        else:
            start = last - width + 1
            if (not start or not text[start - 1].isalnum()) and (m := _VALUE.match(text, last + 1)) and any(c.isdigit() for c in m[1]):
                if not found["account"] or m.start(1) >= found["account"][-1][1]:
                    found["account"].append(m.span(1))
    return [(k, a, b) for k in KINDS for a, b in sorted(found[k])]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    runs: list[tuple[int, int, str]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if runs and a < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]), runs[-1][2])
        else:
            runs.append((a, b, k))
    out, at = [], 0
    for a, b, k in runs:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by the kind's name; nulls stay null."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t and ((s := find_spans(t)) and mask(t, s) or t) for t in part.column(where).to_pylist()]
                columns = [pa.array(texts, part.column(where).type) if k == where else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_documents(table(spark, sf_dir, "documents"))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
