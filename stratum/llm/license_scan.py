"""License scans by exact wording and conditional compression.

Texts with a licence cue are read as one run of words, whatever their lines, and each template is sought
wherever one of its first words stands.  It holds where at most MAX_MISSING of its words are missing and
MAX_ADDED are added within it, years and names after a copyright mark aside; what differs is reported.  The
words of such a span are compressed alone and with the template as raw Zstandard dictionary, and the share
saved has to reach LEAST_SAVING.  A template's own spans that overlap are told apart by their wording: the one
stays that agrees in most words, differing ones taken off.  Which template a span is of is for compression to
say: of spans that overlap the one stays whose template saves most bytes.  All others are reported, each with
its own place.  SPDX tags name their licences themselves:
each identifier is a block as it is written, with no saving and no differences.

Defined results: a null or empty text has no blocks, nor has a text without a cue (one parted by a line
break counts); a block reaches from a copyright mark before the notice on its line to the punctuation after
it; the rest of a line in which a cue stands outside all notices is reported as a block without a licence;
ties go to most words in common, differing ones taken off, to fewer differences, to the greater share saved, to
the longer template, then to its name; repeated rows
are scanned one by one; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# Customary licence notices.
TEMPLATES = {
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "ARR": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
CUES = ("licen", "copyright", "(c)", "\xa9", "rights reserved", "permission", "redistribution", "public domain", "creative commons", "cc by", "spdx")
#: Last words of cues that a line break may part.
PARTED = ("reserved", "domain", "commons")

#: Shares of a template's words that may be missing or added; least saving to be reported at all.
MAX_MISSING, MAX_ADDED, LEAST_SAVING = 0.1, 0.25, 0.15
LEVEL = 19
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")
_MARK = re.compile(r"copyright|\(c\)|\xa9", re.I)
_OWNER = re.compile(r"(?:copyright|\(c\)|\xa9)[^.\n]*?(?=all rights|\.|\n|$)", re.I)
#: An SPDX tag: identifiers joined by operators, parentheses allowed.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([(\t ]*[A-Za-z0-9.+:\-]*[A-Za-z0-9+][)\t ]*(?:(?<=[)\t ])(?:AND|OR|WITH)\b[(\t ]+[A-Za-z0-9.+:\-]*[A-Za-z0-9+][)\t ]*)*)", re.I)
_PART = re.compile(r"[A-Za-z0-9.+:\-]*[A-Za-z0-9+]")
_AFTER = re.compile(r"[.,;:!?)\]\"'\u201d\u2019]*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


_words = {k: words(v) for k, v in TEMPLATES.items()}
_known = {k: frozenset(v) for k, v in _words.items()}
_missing = {k: int(MAX_MISSING * len(v)) for k, v in _words.items()}
_added = {k: int(MAX_ADDED * len(v)) for k, v in _words.items()}
#: Templates by the words with which they can begin.
_opening: dict[str, list[str]] = defaultdict(list)
for _k, _v in _words.items():
    for _w in dict.fromkeys(_v[: _missing[_k] + 1]):
        _opening[_w].append(_k)
_made: dict = {}


def _compressors() -> dict:
    if not _made:
        import zstandard as z

        def make(raw: bytes | None):
            form = z.ZstdCompressionParameters.from_level(LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            return z.ZstdCompressor(compression_params=form, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT) if raw else None)

        _made[""] = make(None)
        _made.update({k: make(" ".join(w).encode()) for k, w in _words.items()})
    return _made


@lru_cache(maxsize=4096)
def saved(span: str, name: str) -> tuple[int, float]:
    """Bytes that the template saves of the span's own compressed size, and their share in it."""
    made, raw = _compressors(), span.encode()
    alone, given = len(made[""].compress(raw)), len(made[name].compress(raw))
    return alone - given, 1 - given / alone


def saving(span: str, name: str) -> float:
    """Share of the span's own compressed size that the template saves."""
    return saved(span, name)[1]


def fit(name: str, found: list[str]) -> tuple[int, int, list[str]] | None:
    """(words of ``found``, words in common, differences) of the template at the beginning of ``found``, where it holds."""
    want = _words[name]
    n = len(want)
    if found[:n] == want:
        return n, n, []
    found = found[: n + _added[name]]
    if sum(w in _known[name] for w in found) < n - _missing[name]:
        return None
    table = [[0] * (n + 1)]  # longest common subsequence of found[:j] and want[:i]
    end = 0
    for j, w in enumerate(found, 1):
        above, row = table[-1], [0]
        for i, x in enumerate(want):
            row.append(above[i] + 1 if w == x else max(above[i + 1], row[i]))
        table.append(row)
        if row[n] > above[n] and row[n] >= n - _missing[name] and j - row[n] <= _added[name] and (not end or 2 * row[n] - j > 2 * table[end][n] - end):
            end = j
    if not end:
        return None
    pairs, i, j = [], n, end
    while i and j:
        if want[i - 1] == found[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[j - 1][i] >= table[j][i - 1]:
            j -= 1
        else:
            i -= 1
    said, i, j = [], 0, 0
    for x, y in [*pairs[::-1], (n, end)]:
        if x > i or y > j:
            said.append(f"-{' '.join(want[i:x])} +{' '.join(found[j:y])}")
        i, j = x + 1, y + 1
    return end, len(pairs), said


def notices(text: str) -> list[tuple[int, int, str, float, str]]:
    """(start, end, licence, saving, differences) of each notice, in order."""
    every = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    owners = [(m.start(), m.end()) for m in _OWNER.finditer(text)]
    runs = [every]
    if owners:
        inside, k = [], 0
        for t in every:
            while k < len(owners) and owners[k][1] <= t[1]:
                k += 1
            inside.append(k < len(owners) and owners[k][0] <= t[1])
        runs.append([t for t, x in zip(every, inside, strict=True) if not x])
    held = []
    for run in runs:
        plain = [t[0] for t in run]
        there = set(plain)
        can = {k for k, known in _known.items() if len(known - there) <= _missing[k]}
        for k, w in enumerate(plain if can else []):
            for name in _opening.get(w, ()):
                got = name in can and fit(name, plain[k : k + len(_words[name]) + _added[name]])
                if got:
                    n, same, said = got
                    less, share = saved(" ".join(plain[k : k + n]), name)
                    if share >= LEAST_SAVING:
                        apart = len(_words[name]) + n - 2 * same
                        held.append((apart - same, len(said), -share, -len(_words[name]), name, run[k][1], run[k + n - 1][2], "; ".join(said), less))
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    best = [h for h in sorted(held) if _placed(places[h[4]], (h[5], h[6]))]  # of each template
    out = [b for m in _SPDX.finditer(text) for b in _tagged(m)]
    for _, _, share, _, name, start, end, said, _ in sorted(best, key=lambda h: (-h[8], *h)):
        _placed(out, (start, end, name, -share, said))
    return out


def _placed(out: list, found: tuple) -> bool:
    """Put ``found`` (start, end, ..) in its place in ``out``, unless it overlaps one that is there."""
    k = bisect(out, (found[0],))
    free = (not k or out[k - 1][1] <= found[0]) and (k == len(out) or found[1] <= out[k][0])
    if free:
        out.insert(k, found)
    return free


def _tagged(tag: re.Match) -> list[tuple[int, int, str, float, str]]:
    """The licences that an SPDX tag names; an exception after WITH stays with its licence."""
    out: list[tuple[int, int, str, float, str]] = []
    start, joined = tag.start(), ""
    for m in _PART.finditer(tag.string, tag.start(1), tag.end(1)):
        if m[0].upper() in ("AND", "OR", "WITH"):
            joined = m[0].upper()
        elif joined == "WITH" and out:
            first, _, name, *rest = out.pop()
            out.append((first, m.end(), f"{name} WITH {m[0]}", *rest))
        else:
            out.append((start, m.end(), m[0], 0.0, ""))
        start = m.end()
    return out


def has_cue(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES)


def scan(text: str) -> list[tuple[int, int, str | None, float, str]]:
    """(start, end, licence, saving, differences) of each block."""
    low = text.lower()
    if not any(c in low for c in (*CUES, *PARTED)):
        return []
    out: list[tuple[int, int, str | None, float, str]] = []
    at = 0
    for found in [*notices(text), None]:
        start = found[0] if found else len(text)
        begin = start
        while at <= start:
            end = text.find("\n", at, start)
            last = end < 0
            end = start if last else end
            piece = text[at:end]
            mark = _MARK.search(piece) if last and found else None
            if mark and not has_cue(_MARK.sub(" ", piece)):
                begin = at + mark.start()
            elif has_cue(piece):
                out.append((at, end, None, 0.0, ""))
            at = end + 1
        if found:
            at = _AFTER.match(text, found[1]).end()
            out.append((begin, at, *found[2:]))
    return out


FOUND = "doc_id long, blocks array<struct<start: long, end: long, license: string, saving: double, wording: string>>"


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("wording", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [[dict(zip(("start", "end", "license", "saving", "wording"), b, strict=True)) for b in scan(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "blocks"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, FOUND)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("blocks", lambda b: b["license"]), lambda x: x.isNotNull())))
    return found.select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.array_join(names, ",").alias("licenses"), "blocks")
