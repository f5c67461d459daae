"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is one Column that is true where a document is to be rejected.  ``plan_cascade`` measures what
each rule costs on a bounded sample and counts what it rejects there, then orders the rules by rejections
per cost; ``cascade`` nests them in that order, so that a document which an early rule rejects never
reaches the later, dearer ones.  The order changes the time taken and never the verdict.

A rule's cost is the time of many passes over the sample less that of few, so what a job costs anyhow and
the compilation of its code drop out, as does what all rules share (the words of a text).  Figures that are
asked for are computed for every row and cost a rule nothing more; in ``score_documents`` the cascade
spares those that no column shows, in ``filter_documents`` all of them.

Defined results: a null text counts as the empty text (no words, all counts 0, rejected by the length
rule); repeated rows each get their own verdict; an empty table gives an empty table; extra columns are
carried along and the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE_CLASS, let, table

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Rows of the sample on which cost and selectivity are estimated, and characters of each of its texts, both at
#: most; passes over it, in the long run and in the short one.  They bear on speed alone.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 4096
PASSES = (9, 1)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def count_symbols(text: Column) -> Column:
    others = "[^" + SYMBOLS + "]+"
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), others, "")).cast("long")


def count_exclaims(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long")


def count_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def _covered(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more.

    A window's hash (as many bits as there is room for) and position share one long, so that sorting puts
    equal windows side by side at the speed of a primitive sort.  Where neighbours agree in those bits but
    differ in the whole hash, and in texts of a million words and more, pairs of whole hash and position are
    sorted instead.
    """
    bits = 20
    mask = F.lit((1 << bits) - 1)
    zero = F.lit(0).cast("long")

    def spread(at: Column) -> Column:
        gaps = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1))),
            zero,
            lambda acc, j: acc + F.coalesce(F.least(F.lit(WINDOW).cast("long"), F.get(at, j) - F.get(at, j - 1)), F.lit(0)),
        )
        return F.when(F.size(at) == 0, zero).otherwise(gaps + WINDOW)

    def with_pairs() -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))

        def same(p: Column, j: Column) -> Column:
            return F.coalesce(F.get(p, j)["h"] == F.get(p, j + 1)["h"], F.lit(False))

        def places(p: Column) -> Column:
            return F.sort_array(F.transform(F.filter(p, lambda x, j: same(p, j) | same(p, j - 1)), lambda x: x["i"]))

        return let(let(F.sort_array(pairs), places), spread)

    def with_bits() -> Column:
        packed = F.transform(hashes, lambda h, i: F.shiftleft(h, bits).bitwiseOR(i.cast("long")))

        def same(p: Column, j: Column) -> Column:
            return F.coalesce(F.shiftrightunsigned(F.get(p, j), bits) == F.shiftrightunsigned(F.get(p, j + 1), bits), F.lit(False))

        def whole(x: Column) -> Column:
            return F.get(hashes, x.bitwiseAND(mask).cast("int"))

        def places(p: Column) -> Column:
            at = F.filter(p, lambda x, j: same(p, j) | same(p, j - 1))
            return F.sort_array(F.transform(at, lambda x: x.bitwiseAND(mask)))

        def mixed(p: Column) -> Column:
            return F.size(F.filter(p, lambda x, j: same(p, j) & (whole(x) != whole(F.get(p, j + 1))))) > 0

        return let(F.sort_array(packed), lambda p: F.when(mixed(p), with_pairs()).otherwise(let(places(p), spread)))

    return F.when(F.size(words) < (1 << bits), with_bits()).otherwise(with_pairs())


def count_repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that the text holds more than once, first occurrence included."""

    def from_words(w: Column) -> Column:
        last = F.size(w) - WINDOW
        hashes = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(w, h)).otherwise(F.lit(0).cast("long")))
        return F.when(last > 0, some).otherwise(F.lit(0).cast("long"))

    return let(words, from_words)


class Figures(dict):
    """Columns of one text's figures, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], Column]]):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> Column:
        self[name] = self.makers[name]()
        return self[name]


def statistics(text: Column, words: Column) -> Figures:
    """Figures of one text; ``words`` are its words, at hand as a column."""
    return Figures(
        {
            "n_words": lambda: F.size(words).cast("long"),
            "word_chars": lambda: F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": lambda: count_symbols(text),
            "n_exclaims": lambda: F.coalesce(count_exclaims(text), F.lit(0).cast("long")),
            "n_dup_lines": lambda: count_dup_lines(text),
            "n_repeat_words": lambda: count_repeat_words(words),
        }
    )


#: Production rules: what of the figures, columns at hand or expressions of the text, rejects a document.
RULES: dict[str, Callable[[dict], Column]] = {
    "short": lambda s: s["n_words"] < 50,
    "repetitive": lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"],
    "symbols": lambda s: 100 * s["n_symbols"] > 10 * s["n_words"],
    "shouting": lambda s: 100 * s["n_exclaims"] > 30 * s["n_words"],
    "word_length": lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"]),
    "dup_lines": lambda s: (s["n_dup_lines"] >= 5) & (15 * s["n_dup_lines"] > s["n_words"]),
}
BASE_RULES = ("short", "repetitive")


def default_rules(s: dict) -> list[Rule]:
    return [Rule(name, rejects(s)) for name, rejects in RULES.items()]


def sample_of(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Row]:
    """Up to ``sample_rows`` rows, from as few partitions as hold them; long texts are cut, since only costs are read off them."""
    cut = [F.substring(f"`{f.name}`", 1, SAMPLE_CHARS).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*cut).take(sample_rows)


def measure(df: DataFrame, rules: Sequence[Rule], shared: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, float]]:
    """For each rule what it rejects on the sample and the seconds that one pass over the sample takes it."""
    rows = sample_of(df, sample_rows)
    if not rows:
        return [(0, 0.0)] * len(rules)
    kind = T.StructType([*df.schema.fields, T.StructField("__passes", T.IntegerType())])
    many, few = (df.sparkSession.createDataFrame([(*r, k) for r in rows], kind).coalesce(1).cache() for k in PASSES)
    many.count()

    def run(sample: DataFrame, hit: Column) -> tuple[float, int]:
        started = time.perf_counter()
        found = sample.select("*", F.explode(F.sequence(F.lit(1), "__passes"))).agg(F.sum(F.coalesce(hit, F.lit(False)).cast("int"))).first()[0]
        return time.perf_counter() - started, found or 0

    def cost(hit: Column) -> tuple[float, int]:
        found = run(few, hit)[1]  # compiles what the next runs share
        long = min(run(many, hit)[0] for _ in range(2))
        return max(0.0, long - run(few, hit)[0]) / (PASSES[0] - PASSES[1]), found

    try:
        least = cost(shared)[0] if shared is not None else 0.0
        costs = [cost(rule.rejects) for rule in rules]
    finally:
        many.unpersist()
        few.unpersist()
    return [(found, max(seconds - least, 0.0)) for seconds, found in costs]


def plan_cascade(df: DataFrame, rules: Sequence[Rule], shared: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order rules by what they reject per cost, both measured on at most ``sample_rows`` rows; ``shared`` is what all of them need."""
    worth = [-(hit + 0.1) / (seconds + 1e-5) for hit, seconds in measure(df, rules, shared, sample_rows)]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (worth[k], k))]


def cascade(rules: Sequence[Rule]) -> Column:
    """True where some rule rejects; later rules run only on what earlier ones let through."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(True)).otherwise(verdict)
    return verdict


#: Figures that ``score_documents`` shows.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Figures that ``score_documents`` shows.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_documents(df: DataFrame, text: str = "text", ordered: bool = True, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with the figures SHOWN, ``base_failed`` and ``kept``; what else rules need is computed as the cascade reaches them."""
    figures = statistics(F.col(text), F.col("__words"))
    wide = df.drop(*[c for c in (*figures.makers, "base_failed", "kept") if c != text]).withColumn("__words", words_of(F.col(text)))
    wide = wide.withColumns({k: figures[k] for k in SHOWN}).drop("__words")
    rules = default_rules({k: F.col(k) if k in SHOWN else figures[k] for k in figures.makers})
    if ordered:
        rules = plan_cascade(wide.select(text, *SHOWN), rules, F.col("n_words") < 0, sample_rows)
    base = cascade([r for r in rules if r.name in BASE_RULES])
    return wide.withColumn("base_failed", base).withColumn("kept", ~cascade(rules))


def lazy_rules(text: str = "text") -> tuple[list[Rule], Column]:
    """The rules by themselves, from the text on, and what they share: its words."""
    words = words_of(F.col(text))

    def alone(name: str) -> Rule:
        return Rule(name, let(words, lambda w: RULES[name](statistics(F.col(text), w))))

    return [alone(name) for name in RULES], let(words, lambda w: F.size(w) < 0)


def lazy_cascade(order: Sequence[str], text: str = "text") -> Column:
    """True where some rule rejects, from the text on; words are bound once, since a column of their own would be
    computed again in each rule when a filter is pushed down."""
    return let(words_of(F.col(text)), lambda w: cascade([Rule(name, RULES[name](statistics(F.col(text), w))) for name in order]))


def filter_documents(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``df`` that no rule rejects, the rules evaluated lazily in cascade order."""
    order = plan_cascade(df.select(text), *lazy_rules(text), sample_rows)
    return df.filter(~lazy_cascade([r.name for r in order], text))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS s FROM t),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(text) - length(replace(text, '!', '')) AS n_exclaims,
         coalesce(n.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_exclaims > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_dup_lines >= 5 AND 15 * n_dup_lines > n_words)) AS kept
FROM f
"""
