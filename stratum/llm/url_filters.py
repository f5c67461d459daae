"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame expressions only.

A rule is a regular expression plus the literal tokens that every URL it matches must hold.  Token
frequencies are counted over all URLs; each rule is filed under its rarest token.  A URL's own tokens
fetch the rules filed under them, and only those run their regular expression.  Rules without any
literal token are filed under the empty token, which every URL holds.

Two notations compile to such rules: ``site_rule`` (host and path prefix, longest wins) and
``pattern_rule`` (``||`` domain anchor, ``|`` end anchor, ``^`` separator, ``*`` wildcard).

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and the verdict
``allow``; repeated rows are judged alike, each once; an empty table gives an empty table; ties between
rules of equal length go to the greater rule text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, table

#: Rule indexes up to this many rules are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 20_000
#: Longest regular expression of a broadcast rule; with BROADCAST_RULES it bounds the broadcast.
BROADCAST_REGEX = 2_000


@dataclass(frozen=True)
class UrlRule:
    name: str
    action: str
    target: str  # "site": host and path; "url": the URL in ASCII lower case
    regex: str
    tokens: tuple[str, ...]
    explicit: bool  # a stated rule: reported, and ahead of any pattern


def site_rule(action: str, text: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's path."""
    host, slash, path = text.partition("/")
    whole = re.findall(r"[a-z0-9]+", host.lower())
    parts = re.split(r"([A-Za-z0-9]+)", slash + path)
    whole += [x.lower() for x in parts[1:-2:2]] + ([parts[-2].lower()] if len(parts) > 1 and parts[-1] else [])
    return UrlRule(text, action, "site", rf"^(?:[^/]*\.)?\Q{host}{slash}{path}\E", tuple(dict.fromkeys(whole)), True)


def pattern_rule(action: str, text: str) -> UrlRule:
    body, start, end = text.lower(), "", ""
    if body.startswith("||"):
        body, start = body[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    made, tokens = "", []
    pieces = re.split(r"([a-z0-9]+)", body)
    for k, piece in enumerate(pieces):
        if k % 2:
            before, after = pieces[k - 1] or (start and "|"), pieces[k + 1] or end
            if before and after and before[-1] != "*" and after[0] != "*":
                tokens.append(piece)
            made += piece
        else:
            made += "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c) or re.escape(c) for c in piece)
    return UrlRule(text, action, "url", start + made + end, tuple(dict.fromkeys(tokens)), False)


#: Stated rules of the production query.
STATED_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
#: Pattern rules of the production query.
PATTERN_RULES = tuple(
    pattern_rule("block", x)
    for x in ("||cheap-pills.*", "||spam-farm.*", "||free-casino.*", "/adserver/*", "/banner-ads/*", "^affiliate-id=", "/wp-login.php^")
)


def split_url(url: Column) -> tuple[Column, Column]:
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, form, 1)), F.regexp_extract(text, form, 2)


def rules_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    fields = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.target).alias("target"), F.lit(r.regex).alias("regex"),
                       F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"), F.lit(r.explicit).alias("explicit")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*fields)))


def url_tokens(url: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def index_rules(rules: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """``rules`` with the token each is filed under: the rarest of its tokens over all of ``urls``."""
    pairs = rules.select("rule", "regex", F.explode("tokens").alias("token"))
    used = pairs.select("token").distinct()
    held = urls.select(F.explode(url_tokens(F.col(url))).alias("token"))
    if rules.count() <= BROADCAST_RULES:
        used = F.broadcast(used)
    counts = held.join(used, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        pairs.join(counts, "token", "left")
        .groupBy("rule", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
        .select("rule", "regex", F.col("best.token").alias("token"))
    )
    return rules.drop("tokens").join(rarest, ["rule", "regex"], "left").withColumn("token", F.coalesce("token", F.lit("")))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced."""
    index = index_rules(rules, pages, url)
    size = rules.agg(F.count("*").alias("n"), F.max(F.length("regex")).alias("w")).first()
    if size.n <= BROADCAST_RULES and (size.w or 0) <= BROADCAST_REGEX:
        index = F.broadcast(index)
    host, path = split_url(F.col(url))
    candidates = pages.filter(F.col(url).contains("://")).select(
        F.col(url).alias("__url"), F.concat(host, path).alias("site"), lower_ascii(F.col(url)).alias("low"), F.explode(url_tokens(F.col(url))).alias("token")
    )
    hits = candidates.join(index, "token").filter(F.rlike(F.when(F.col("target") == "site", F.col("site")).otherwise(F.col("low")), F.col("regex")))
    best = hits.groupBy("__url").agg(F.max(F.struct("explicit", F.length("rule").alias("w"), "rule", "action")).alias("__best"))
    wide = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]).join(best, F.col(url) == F.col("__url"), "left")
    return (
        wide.withColumn("host", host)
        .withColumn("path", path)
        .withColumn("rule", F.when(F.col("__best.explicit"), F.col("__best.rule")))
        .withColumn("verdict", F.coalesce("__best.action", F.lit(default)))
        .drop("__url", "__best")
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_table(spark, STATED_RULES + PATTERN_RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages
),
r(rule, host, path, action) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
j AS (
  SELECT p.*, (SELECT max(struct_pack(w := length(r.rule), rule := r.rule, action := r.action)) FROM r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS b
  FROM p
)
SELECT page_id, host, path, b.rule AS rule,
       CASE WHEN b.rule IS NOT NULL THEN b.action
            WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\.)?(cheap-pills|spam-farm|free-casino)\.') THEN 'block'
            WHEN contains(low, '://') AND (contains(low, '/adserver/') OR contains(low, '/banner-ads/') OR regexp_matches(low, '([^a-z0-9_.%-]|$)affiliate-id=')
                 OR regexp_matches(low, '/wp-login\.php([^a-z0-9_.%-]|$)')) THEN 'block'
            ELSE 'allow' END AS verdict
FROM j
"""
