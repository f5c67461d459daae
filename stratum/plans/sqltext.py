"""Lexical work on SQL text: tokens, normal form, identifier search and the guards.

One regular expression splits a text into tokens; everything else looks at tokens, so that literals,
quoted names and comments are never mistaken for code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..errors import EngineError

_TOKEN = re.compile(
    r"""(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<string>'(?:[^']|'')*(?:'|(?P<open1>\Z)))
      | (?P<quoted>"(?:[^"]|"")*(?:"|(?P<open2>\Z))|`(?:[^`]|``)*(?:`|(?P<open3>\Z)))
      | (?P<bracket>\[[^\]]*\])
      | (?P<word>[^\W\d][\w$]*|\$[\w$]+)
      | (?P<number>\d[\w.]*)
      | (?P<space>\s+)
      | (?P<other>\*/|.)""",
    re.X | re.S,
)

# Words that no read statement may contain outside literals.
FORBIDDEN = (
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "CREATE",
    "REPLACE",
    "TRUNCATE",
    "ATTACH",
    "DETACH",
    "PRAGMA",
    "VACUUM",
    "BEGIN",
    "COMMIT",
    "ROLLBACK",
)
RESERVED_PREFIXES = ("_stratum_", "sqlite_")
_TYPE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\s*\(\s*\d+\s*(,\s*\d+\s*)?\))?\Z")


def tokens(sql: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, terminated) of every token."""
    for m in _TOKEN.finditer(sql):
        kind = m.lastgroup if m.lastgroup and not m.lastgroup.startswith("open") else ("string" if m["string"] is not None else "quoted")
        ended = m["open1"] is None and m["open2"] is None and m["open3"] is None and not (m["comment"] or "--").startswith("/*") or (m["comment"] or "").endswith("*/")
        yield kind, m[0], ended


def fold(name: str) -> str:
    """ASCII case folding, as names are matched."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def normalize_sql(sql: str, tight: bool = False) -> str:
    """Comments gone, white space collapsed, upper case outside quotes; ``tight`` drops space at punctuation."""
    out: list[str] = []
    for kind, text, _ in tokens(sql):
        if kind in ("comment", "space"):
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(text if kind in ("string", "quoted", "bracket") else text.upper())
    made = "".join(out).strip()
    if tight:
        made = "".join(t if k != "other" else f"\0{t}\0" for k, t, _ in tokens(made))
        made = re.sub(r" *\0 *", "", made)
    return made


def mentions(sql: str, name: str) -> bool:
    """Does ``sql`` use ``name`` as an identifier, quoted or not?"""
    want = fold(name)
    return any(
        (kind == "word" and fold(text) == want) or (kind in ("quoted", "bracket") and fold(text[1:-1].replace(text[0] * 2, text[0])) == want)
        for kind, text, _ in tokens(sql)
    )


def check_identifier(name: str, label: str) -> str:
    parts = name[:1].replace("$", "_"), name[1:].replace("$", "_")
    if not name or not (parts[0] + "a").isidentifier() or not ("a" + parts[1]).isidentifier():
        raise EngineError("INVALID_IDENTIFIER", f"{label}: not an identifier: {name!r}")
    if fold(name).startswith(RESERVED_PREFIXES):
        raise EngineError("INVALID_IDENTIFIER", f"{label}: reserved name: {name}")
    return name


def check_type(text: str, label: str) -> str:
    if not _TYPE.match(text.strip()):
        raise EngineError("INVALID_OPERATION", f"{label}: not a column type: {text!r}")
    return re.sub(r"\s+", "", text).upper()


def check_expression(text: str, label: str) -> str:
    """A single scalar expression: no comment, semicolon, top-level comma, open parenthesis or literal."""

    def refuse(why: str) -> None:
        raise EngineError("INVALID_OPERATION", f"{label}: {why}")

    body = text.strip()
    if not body:
        refuse("empty expression")
    if "\0" in body:
        refuse("NUL in expression")
    depth = 0
    for kind, token, ended in tokens(body):
        if kind == "comment" or token == "*/":
            refuse("comment in expression")
        if not ended:
            refuse("unterminated literal")
        if token == ";":
            refuse("more than one expression")
        if token == "," and not depth:
            refuse("comma at top level")
        depth += (token == "(") - (token == ")")
        if depth < 0:
            refuse("unbalanced parenthesis")
    if depth:
        refuse("unbalanced parenthesis")
    return body


def check_read_sql(sql: str) -> str:
    """One SELECT or WITH statement without forbidden words; a closing semicolon is dropped."""
    found = [(k, t) for k, t, _ in tokens(sql) if k not in ("comment", "space")]
    if found and found[-1] == ("other", ";"):
        found.pop()
        sql = sql[: sql.rindex(";")]
    if not found or found[0][0] != "word" or found[0][1].upper() not in ("SELECT", "WITH"):
        raise EngineError("INVALID_SQL", "only SELECT or WITH statements can be read")
    for kind, text in found:
        if text == ";" and kind == "other":
            raise EngineError("INVALID_SQL", "only one statement can be read")
        words = [text] if kind == "word" else re.findall(r"\w+", text) if kind == "bracket" else []
        for word in words:
            if word.upper() in FORBIDDEN:
                raise EngineError("INVALID_SQL", f"{word.upper()} is not allowed in a read statement")
    return sql.strip()
