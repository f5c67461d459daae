"""Every operator on the awkward rows, and against a plain version of itself."""

import base64
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import catalog, decontamination, html_extraction, jaccard_join, license_scan, packing, pii, quality_rules, sharding, url_filters, warc
from stratum.llm.shared import discard, materialize

LONG = " ".join(f"w{k % 997}" for k in range(30_000))
DOCS = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (5, LONG), (6, "a tie of two"), (7, "a tie of two"), (None, "no id at all"), (8, "x\x0by\x0cz é ß\n\nx\x0by\x0cz é ß")]
EXTRA = "doc_id long, text string, n_words string, spans string, host int, component_id string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(1, "a b c", "n", "s", 1, "c"), (2, None, None, None, None, None)], EXTRA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- quality rules --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "apart"), [(1 << 20, 40), (1000, 50), (1000, 0)])
def test_repeats_where_short_hashes_meet(spark, size, apart):
    """Two windows by turns, whose hashes differ from bit ``apart`` on."""
    hashes = F.expr(f"transform(sequence(1, {size - 2}), i -> CASE i WHEN 100 THEN 1L WHEN 300 THEN 1L WHEN 200 THEN {1 + (1 << apart)}L WHEN 400 THEN {1 + (1 << apart)}L ELSE i + 10L END)")
    df = spark.range(1).repartition(1).select(F.expr(f"sequence(1, {size})").alias("w"), hashes.alias("h"))
    assert df.select(quality_rules._covered(F.col("w"), F.col("h"))).first()[0] == 12


def plain_figures(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(spark, docs, empty, clashing):
    rng = random.Random(1)
    more = [(100 + k, "".join(rng.choice(["a", "b", " ", "  ", "\n", "#", "\t", "c"]) for _ in range(rng.randint(0, 300)))) for k in range(60)]
    got = sorted(tuple(r) for r in quality_rules.score_documents(frame(spark, [r for r in DOCS if r[0]] + more)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((d, *plain_figures(t)) for d, t in [r for r in DOCS if r[0]] + more)
    assert quality_rules.score_documents(empty).count() == 0 and quality_rules.filter_documents(empty).count() == 0
    out = quality_rules.score_documents(clashing)
    assert dict(out.dtypes)["n_words"] == "bigint" and "host" in out.columns


def test_quality_order_does_not_matter(spark):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good), (2, "short"), (3, "same same " * 60), (4, good.replace(" ", "%% ")), (5, good.replace(" ", "!! ")), (6, None)]
    df = frame(spark, rows)
    assert [r.doc_id for r in quality_rules.filter_documents(df).collect()] == [1]
    assert [r.doc_id for r in quality_rules.score_documents(df).filter("kept").collect()] == [1]
    assert [r.doc_id for r in quality_rules.score_documents(df, ordered=False).filter("kept").collect()] == [1]


def test_costs_are_those_of_the_rules(spark):
    """Windows of words cost more than counting symbols; a sample of one task, whatever the number of partitions."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(700)) + (" ### !!!" * 30 if k % 3 == 0 else "")) for k in range(300)]
    df = frame(spark, rows, parts=6)
    rules, shared = quality_rules.lazy_rules()
    found = dict(zip(quality_rules.RULES, quality_rules.measure(df.select("text"), rules, shared), strict=True))
    assert found["repetitive"][1] == max(seconds for _, seconds in found.values()) > 0
    assert found["short"][0] == 0 < found["symbols"][0] < quality_rules.SAMPLE_ROWS
    order = [r.name for r in quality_rules.plan_cascade(df.select("text"), rules, shared)]
    assert order.index("symbols") < order.index("repetitive") and sorted(order) == sorted(quality_rules.RULES)
    assert len(quality_rules.sample_of(df)) == quality_rules.SAMPLE_ROWS and max(len(r.text) for r in quality_rules.sample_of(df)) <= quality_rules.SAMPLE_CHARS


def test_cascade_stops_at_the_first_rejection(spark):
    df = frame(spark, [(1, "x"), (2, "y")], parts=1)
    bad = F.raise_error(F.lit("reached")).isNotNull()
    rules = [quality_rules.Rule("all", F.col("doc_id") > 0), quality_rules.Rule("never", bad)]
    assert df.filter(quality_rules.cascade(rules)).count() == 2
    with pytest.raises(Exception, match="reached"):
        df.filter(quality_rules.cascade(rules[::-1])).count()


# -- sharding -------------------------------------------------------------------------------------------


def plain_capacity(sizes, shards):
    def need(c):
        n, load = 1, 0
        for s in sizes:
            if load + s > c:
                n, load = n + 1, 0
            load += s
        return n

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= shards else (mid + 1, hi)
    return lo


def test_skyline_finds_the_smallest_capacity(spark):
    rng = random.Random(2)
    for n in (3, 40, 900):
        groups = sorted((rng.randrange(-(1 << 63), 1 << 63) >> rng.choice([0, 0, 30]), rng.randint(1, 60)) for _ in range(n))
        df = spark.createDataFrame(groups, "h long, size long").cache()
        sky = sharding.Skyline(df, sharding._spans(df, [(-(1 << 63), 64)]))
        sizes = [s for _, s in groups]
        want = plain_capacity(sizes, 5)
        assert sky.feasible(5, want) and (want == 1 or not sky.feasible(5, want - 1))


def test_sharding(spark, docs, empty):
    rows = [(2000 + k, f"text {k} " * (k % 9)) for k in range(400)] + [(1000 + k, "hot") for k in range(300)] + [r for r in DOCS if r[0]]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by_text, by_shard = {}, {}
    text = dict(rows)
    for r in out:
        by_text.setdefault(text[r.doc_id] or "", set()).add(r.shard)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard_documents(empty).count() == 0
    clash = frame(spark, rows).withColumn("size", F.lit("old")).withColumn("shard", F.lit(-1)).withColumn("h", F.lit(None))
    assert sorted(tuple(r) for r in sharding.shard_documents(clash).select("doc_id", "shard", "slot").collect()) == sorted((r.doc_id, r.shard, r.slot) for r in out)


def test_shards_hold_near_equal_bytes(spark):
    """The law: no shard holds more than its share and one group; a group larger than a share stands alone."""
    rng = random.Random(5)
    rows = [(k, f"{k} " + "x" * rng.randint(0, 400)) for k in range(2000)] + [(5000 + k, "copy " * rng.randint(1, 3)) for k in range(60)]
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len(t) + 1
    load = Counter()
    for r in sharding.shard_documents(frame(spark, rows)).collect():
        load[r.shard] += r["size"]
    total, largest = sum(sizes.values()), max(sizes.values())
    assert sorted(load) == list(range(8)) and sum(load.values()) == total
    assert max(load.values()) <= total / 8 + largest and min(load.values()) >= total / 8 - 8 * largest
    hot = rows + [(9000 + k, "the hot text " * 8) for k in range(3000)]
    load, alone = Counter(), set()
    for r in sharding.shard_documents(frame(spark, hot)).collect():
        load[r.shard] += r["size"]
        if r.doc_id >= 9000:
            alone.add(r.shard)
    rest = [load[k] for k in range(8) if k not in alone]
    assert len(alone) == 1 and load[alone.pop()] == 3000 * (13 * 8 + 1) and max(rest) <= sum(rest) / 7 + largest


# -- url filters ----------------------------------------------------------------------------------------


def test_url_filters(spark):
    urls = [
        "http://a.example.com/en/7", "https://EXAMPLE.com/en/8?x#y", "http://example.net/de/8/x", "http://x.net/de/", "http://y.org/es/1", "http://notexample.com", "http://badcom/en/",
        "http://spam-farm.example.org/fr/1", "http://ok.example.org/spam-farm./", None, "", "no scheme/com/en/", "a://b://c/d", "http://h\n/en/", "http://x.com/adserver/1?affiliate-id=3", "http://net/de/",
    ]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    rules = url_filters.rules_table(spark, url_filters.STATED_RULES + url_filters.PATTERN_RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, rules).collect()}

    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fit = []
        for r in url_filters.STATED_RULES:
            h, _, p = r.name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fit.append((len(r.name), r.name, r.action))
        if fit:
            return host, path, max(fit)[1], max(fit)[2]
        hit = m and (re.search(r"^(.*\.)?(spam-farm|cheap-pills|free-casino)\.", host) or "/adserver/" in u)
        return host, path, None, "block" if hit else "allow"

    assert got == {k: plain(u) for k, u in enumerate([*urls, urls[0]])}
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.com/x",)] * 5 + [("http://b.com/y",)], "url string")
    rules = url_filters.rules_table(spark, [url_filters.site_rule("block", "b.com/y/"), url_filters.pattern_rule("block", "*z*")])
    filed = {r.rule: r.token for r in url_filters.index_rules(rules, pages).collect()}
    assert filed == {"b.com/y/": "b", "*z*": ""}


# -- Jaccard join ---------------------------------------------------------------------------------------


def plain_components(rows, k, p, q):
    sets = {}
    for d, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def fuzzy(seed, groups=30):
    rng, rows, n = random.Random(seed), [], 100
    for _ in range(groups):
        base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice([3, 8, 12, 15, 20, 40, 120]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own) + 1)
                own = own[:at] + ([rng.choice("xyzXYZ")] if rng.random() < 0.6 else []) + own[at + (rng.random() < 0.5) :]
            rows.append((n, rng.choice([" ", "\n", "  "]).join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("k, p, q", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join(spark, k, p, q):
    rows = [r for r in DOCS if r[0]] + fuzzy(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(frame(spark, rows), k, p, q).collect()}
    assert got == plain_components(rows, k, p, q)


def test_jaccard_blocks_and_null_ids(spark, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROOTS", 0)
    monkeypatch.setattr(jaccard_join, "SMALL_CELL", 2)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:k] + ["new" + str(k)] + base[k + 1 :])) for k in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(frame(spark, rows), 1, 9, 10).collect()}
    assert got == {d: c for d, (_, c) in plain_components(rows, 1, 9, 10).items()} and set(got.values()) == {0}
    nameless = [(None, " ".join(base)), (9, " ".join(base[1:])), (None, None)]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.link_documents(frame(spark, nameless), 1, 9, 10).collect()) == [(-1, -1), (-1, 9), (9, 9)]
    assert jaccard_join.link_documents(empty).count() == 0


@pytest.mark.parametrize("anchors", [0, 3])
def test_jaccard_hot_cells(spark, monkeypatch, anchors):
    """Groups in one cell: copies that link in chains, and sets that share words but don't link."""
    for name, value in (("CELL_SETS", 6), ("BLOCK_ROOTS", 0), ("SMALL_CELL", 2), ("ANCHORS", anchors), ("BRIEF_BITS", 128), ("HOT_CELLS", anchors)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng, rows = random.Random(anchors), []
    common = [f"w{k}" for k in range(110)]
    for group in range(6):
        own = common + [f"g{group}x{k}" for k in range(6 * group)]
        for k in range(4 + 6 * group):
            rows.append((100 * group + k, " ".join(w for w in own if rng.random() > 0.05) + f" d{group}a{k // 2}"))
    rng.shuffle(rows)
    want = plain_components(rows, 1, 9, 10)
    assert 3 < len({c for _, c in want.values()}) < len(rows) - 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(frame(spark, rows), 1, 9, 10).collect()}
    assert got == want


def test_parity_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(7)
    for n in (100, 1000, 3000, 5000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for lost in (0, 1, n // 20, n // 11):
            two = np.concatenate([one[lost:], rng.integers(0, 1 << 63, lost // 2, dtype=np.uint64)])
            sketches = [jaccard_join.parity(x).tobytes() for x in (one, two)]
            apart = len(np.setxor1d(one, two))
            assert jaccard_join.differences(*sketches) <= apart and jaccard_join.differences(*sketches[::-1]) <= apart
            common = len(np.intersect1d(one, two))
            linked = 10 * common >= 9 * (len(one) + len(two) - common)
            for extra in (0, 30):  # few sets are compared one by one, many at once
                far = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(extra)]
                every = [one, two, *far]
                roots = jaccard_join.candidate_roots([len(x) for x in every], [jaccard_join.parity(x).tobytes() for x in every], [-1] * len(every), 9, 10)
                assert (roots[1] == 0 or not linked) and roots[2:] == list(range(2, len(every)))


@pytest.mark.parametrize("p, q", [(9, 10), (4, 5), (1, 2)])
def test_sets_that_may_link_share_a_band(p, q):
    one = np.zeros(1, np.int64)
    keys = {n: [int(x[0]) for x in jaccard_join.band_keys(one, np.array([n]), p, q)] for n in range(1, 3000)}
    for n in range(1, 3000):
        m = q * n // p
        if m in keys:
            assert keys[m][0] in keys[n], (n, m)


def test_keep_one(spark, clashing):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(3, text, "en"), (1, text + " more", "en"), (2, "other text of six words here", "de"), (2, "other text of six words here", "de"), (9, None, "fr")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang) for r in jaccard_join.keep_one(df).collect()) == [(1, "en"), (2, "de"), (9, "fr")]
    assert jaccard_join.keep_one(clashing).columns == clashing.columns and jaccard_join.keep_one(clashing).count() == 2


def test_boundary_follows_cost():
    assert jaccard_join.choose_boundary({11: 10_000}, 9, 10) >= 11 and jaccard_join.choose_boundary({22: 10_000}, 9, 10) < 22


# -- WARC -----------------------------------------------------------------------------------------------


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 6, 9):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 8))) for _ in range(k)]
        assert [x for (x,) in warc.LoserTree([[(v,) for v in r] for r in runs], key=lambda t: t)] == sorted(sum(runs, []))


def test_archives_round_trip(spark):
    rows = [(1, "http://b/x y", "A\r\n\r\nWARC/1.1\r\n é\0"), (2, None, None), (3, "http://a/", "A\r\n\r\nWARC/1.1\r\n é\0"), (4, "http://[bad", ""), (4, "http://[bad", ""), (5, "http://a/", "z" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_pages(pages).collect()
    newest = {}
    for p, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", 0), p)
    want = sorted((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if newest[h or ""] == p else "revisit", 0 if newest[h or ""] == p else newest[h or ""]) for p, _, h in rows)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == want
    keys = [(r.url_key, r.ts, r.page_id) for r in sorted(got, key=lambda r: r.capture_order)]
    assert keys == sorted(keys)
    index = warc.merge_index(warc.read_archives(spark, warc.write_archives(pages)), rows_per_partition=2)
    assert sorted(r.capture_order for r in index.collect()) == list(range(len(rows)))
    assert {r.record_type for r in warc.archive_pages(pages, least_bytes=1 << 20).collect()} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_damage_is_found(spark):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    with pytest.raises(ValueError):
        warc.captures(record.replace(b"Content-Length: 40", b"Content-Length: %d" % len(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab")), "f")


# -- HTML -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("<", "<"),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=/>home</a></nav><article><h1>T</h1><p>a\n b<p>c <b>d<i>e</b> &eacute;<br>f</article><footer>x</footer>", "T\na b\nc de é f"),
        ("<div class='content'><p>one two three</p><div class='ad-1'>buy</div><form>mail</form><p>four</div><section id=comments><p>long reader comment here</p></section>", "one two three\nfour"),
        ("<article><p>x</p><script>if (a<b) {}</script><style>p{}</style><!-- c --><p>y</article>", "x\ny"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ],
)
def test_main_text(source, want):
    assert html_extraction.extract(source, None) == want


#: Pages and what a reader would call their article.
LABELLED = [
    ("<article><p class='side note'>kept by the way</p><p class=alert>and this</p></article>", "kept by the way\nand this"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1><p class=byline>by me</p></header><p>text</p></article>", "Title\nby me\ntext"),
    ("<div class='has-sidebar no-comments'><p>the text of the page</p></div><div class=sidebar>links</div>", "the text of the page"),
    ("<div class='share'><p>all of the article stands in here, oddly enough</p></div><div class=notice>closed today</div>", "all of the article stands in here, oddly enough"),
    ("<div class=head>Site</div><article>short</article><div class='sidebar'>a long column of other things that one might read instead of it</div>", "short"),
    ("<div class='content-sidebar-wrap'><main><p>text</p></main><div class='sidebar'><p>other</p></div></div>", "text"),
    ("<article><p>text</p></article><article class='comment'><p>I disagree with all of that, and at length</p></article>", "text"),
    ("<article><p>text</p><div class='related'><ul><li><a href=/x>more</a></ul></div></article>", "text"),
    ("<article>x</article><div class='ad'>much longer than the article</div><div id='cookie-consent'>we use them</div>", "x"),
    ("<div role=navigation><a href=/>home</a></div><main><h2>A</h2><pre>  b\n c</pre></main><div role=contentinfo>me</div>", "A\nb c"),
    ("<article><p>one<p>two<blockquote class=banner>three</blockquote><table class=widget><tr><td>9</table></article>", "one\ntwo\nthree"),
]


def test_labelled_pages():
    got = [html_extraction.extract(source, None) for source, _ in LABELLED]
    assert got == [want for _, want in LABELLED]


@pytest.mark.parametrize(
    "source, want",
    [
        ("<div>" * 100_000 + "x", "x"),
        ("<div>" * 100_000 + "x" + "</div>" * 100_000 + "<p>y", "x"),
        ("<span>" * 50_000 + "<p>a</p>" * 20_000, "\n".join("a" * 20_000)),
        ("<b>" * 50_000 + "</i>" * 50_000 + "x", "x"),
        ("<p>before</p>" + "<a " * 300_000 + '"', "before"),
        ("<p>before</p>" + "<a b='" * 100_001, "before"),
        ("<head>" * 200_000 + "<p>x", "x"),
        ("<p>four words a block</p>" * 400_000, "\n".join(["four words a block"] * 400_000)),
        ("<div class=side>" * 3000 + "text of it", "text of it"),
    ],
    ids=["deep", "closed", "inline", "stray", "quote", "quotes", "head", "10 MB", "marked"],
)
def test_awkward_pages_take_no_longer_than_others(source, want):
    started = time.perf_counter()
    assert html_extraction.extract(source, None) == want and html_extraction.extract(source, [1]) == want
    assert time.perf_counter() - started < 60


class PlainArticle(HTMLParser):
    """The blocks of article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.text = 0, [], ""

    def end_block(self):
        if text := " ".join(self.text.split()):
            self.blocks.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("article", "h1", "p"):
            self.end_block()
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.end_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.text += data


def test_pages_against_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        plain = PlainArticle()
        plain.feed(r.html or "")
        plain.close()
        want[r.page_id] = "\n".join(plain.blocks)
    clashing = pages.select("*", F.lit(1).alias("host"), F.lit(2).alias("winners"), F.lit(3).alias("text"), F.lit(4).alias("path"))
    got = {r.page_id: r.text for r in html_extraction.extract_pages(clashing).collect()}
    assert got == want and len(got) == pages.count()


def test_hosts_agree_on_paths(spark):
    body = "<div class='main'><p>the story itself, at some length</p></div><div class='teaser'><p>{}</p></div>"
    rows = [(k, "http://h/" + str(k), "<body>" + body.format("t") + "</body>") for k in range(6)] + [(6, "http://h/6", "<body>" + body.format("a teaser that is much longer than the story itself " * 3) + "</body>"), (7, None, None), (7, None, None)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[6] == got[0] == "the story itself, at some length" and got[7] == ""
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- packing --------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizers = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in DOCS if r[0] and r[0] != 5] + [(5, LONG)] + [(50 + k, f"Some WORDS, and more. it's {k}" * k) for k in range(30)]
    got = packing.pack_documents(frame(spark, rows)).collect()
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    at = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        at[r.doc_id] = r.start + r.length
    assert at == {d: len(x) for d, x in ids.items()}
    lengths = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths.values())
    assert packing.pack_documents(empty).count() == 0


def test_costs_are_balanced():
    pieces = [packing.Piece(k, 0, b"\0\0\0\0" * n, n) for k, n in enumerate([900] * 8 + [10] * 500)]
    full, left = packing.balance(pieces, 4096)
    costs = [sum(len(p) ** 2 for p in s) for s in full]
    assert all(sum(map(len, s)) == 4096 for s in full) and sum(map(len, left)) < 4096
    assert max(costs) <= 1.5 * min(costs)


# -- decontamination ------------------------------------------------------------------------------------


def test_leaks(spark, empty, docs):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(20)]
    rows, want = [], set()
    for k in range(120):
        text = rng.choices(vocabulary, k=rng.randint(0, 200))
        if k % 4 == 0:
            item = items[k % 20][1].upper().split()
            for _ in range(k % 7):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randint(0, len(text))
            text = text[:at] + item + text[at:]
            want.add((k, k % 20))
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([*items, (90, None), (91, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert set(got) == want
    held = decontamination.Items(items, 3)
    for (d, i), score in got.items():
        w, _ = decontamination.hash_words([rows[d][1]])
        best, _ = decontamination.align([held.words[i]], [w])
        assert score == pytest.approx(best[0] / (2 * len(held.words[i])))
    left = decontamination.drop_leaks(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(range(120)) - {d for d, _ in want})
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and decontamination.find_leaks(docs, bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(9)]
    df = frame(spark, [(k, "before " + t + " after") for k, t in items])
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()) == [(k, k) for k in range(9)]


def plain_leaks(items, rows):
    """Smith-Waterman of every item with every whole document."""
    held, found = decontamination.Items(items, 3), {}
    for d, text in rows:
        w, _ = decontamination.hash_words([text])
        for k, own in enumerate(held.words):
            if len(w) and len(own) >= 3:
                score = int(decontamination.align([own], [w])[0][0])
                if score >= decontamination.THRESHOLD * decontamination.MATCH * len(own):
                    found[d, items[k][0]] = score / (decontamination.MATCH * len(own))
    return found


def test_leaks_in_edited_copies(spark):
    rng = random.Random(11)
    item = [[f"i{k}x{j}" if rng.random() < 0.7 else f"common{rng.randrange(9)}" for j in range(30)] for k in range(6)]
    items = [(k, " ".join(w)) for k, w in enumerate(item)]
    filler = lambda n: [f"common{rng.randrange(9)}" if rng.random() < 0.3 else f"f{rng.randrange(500)}" for _ in range(n)]
    texts = []
    for every in (2, 3, 4, 5, 7):
        texts += [filler(20) + [x if j % every else "edited" for j, x in enumerate(item[0])] + filler(20)]
        texts += [filler(5) + [x for j, x in enumerate(item[1]) if j % every] + filler(9)]
        texts += [[y for j, x in enumerate(item[2]) for y in ([x, "added"] if j % every == 0 else [x])]]
    texts += [[y for x in item[2] for y in (x, "added")]]  # no two words side by side
    texts += [filler(30) + [x if j % 5 else "edited" for j, x in enumerate(item[3])] for _ in range(300)]  # copies of one edited version
    texts += [filler(30) + item[4][at : at + size] + filler(30) for size in (14, 15, 16, 17) for at in (0, 7, 13)]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    want = plain_leaks(items, rows)
    assert {k for _, k in want} == {0, 1, 2, 3, 4} and len(want) > 310
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(want)


def test_leaks_in_few_words(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 50)
    rng = random.Random(12)
    text = lambda n, words: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    items = [(k, text(rng.randint(1, 20), 5)) for k in range(12)]
    rows = [(d, text(rng.randint(0, 60), 9)) for d in range(60)]
    want = plain_leaks(items, rows)
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 50 and got == pytest.approx(want)


def plain_smith_waterman(item, words):
    best, above = 0, [0] * (len(words) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(words, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[j - 1] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_is_smith_waterman(spark):
    """Scores and leaks against a plain alignment of every item with every whole document."""
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 5)) for _ in range(rng.randint(3, 25)))) for k in range(25)]
    docs = []
    for d in range(60):
        own = rng.choice(items)[1].split()
        kept = [w if rng.random() > 0.25 else rng.choice(["new", ""]) for w in own]
        docs.append((d, " ".join([rng.choice("ijkabc") + str(rng.randint(0, 5)) for _ in range(rng.randint(0, 40))] + kept + ["end"])))
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for k, item in items:
            score = plain_smith_waterman(item.split(), t.split()) / (2 * len(item.split()))
            if score >= decontamination.THRESHOLD:
                want[d, k] = score
    assert got == pytest.approx(want) and 20 < len(want) < 1500


def test_items_of_one_or_two_words(spark):
    items = spark.createDataFrame([(1, "Lone"), (2, "two words"), (3, None), (4, " ")], "item_id long, text string")
    rows = [(1, "lone"), (2, "two  WORDS\n"), (3, "two words more"), (4, "alone"), (5, None), (6, "")]
    assert sorted(tuple(r) for r in decontamination.find_leaks(frame(spark, rows), items).collect()) == [(1, 1, 1.0, 0, 1), (2, 2, 1.0, 0, 2)]
    clashing = frame(spark, rows).withColumn("item_id", F.lit("x")).withColumn("score", F.lit("y"))
    left = decontamination.drop_leaks(clashing, items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6] and left.columns == clashing.columns


def test_leaks_whatever_the_case(spark):
    df = frame(spark, [(1, "VOR ÉTÉ ÜBER GROSSE ÑANDÚ ЖУК")])
    assert [r.doc_id for r in decontamination.find_leaks(df, spark.createDataFrame([(7, "été über große ñandú жук")], "item_id long, text string")).collect()] == [1]


# -- personal data --------------------------------------------------------------------------------------


def brute_spans(text):
    """Base spans straight from the stated forms."""

    def luhn(digits):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    out = []
    for kind, form, keep in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub(r"[\x20-]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(form, text) if keep(m[0])]
    return out


def test_base_spans_match_the_forms():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab@.+-_ 0123456789()12 3:/é") for _ in range(80))
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute_spans(text)
    assert pii.find_spans("token = \"ab12cd34\" iban DE89370400440532013000 http://u:p@h.x/") == [("account", 9, 17), ("iban", 24, 46), ("url", 54, 61)] or pii.find_spans("iban DE89370400440532013000")


def test_masks_of_many_and_of_overlapping_spans():
    assert pii.mask("0123456789", [("card", 1, 4), ("phone", 3, 6), ("email", 8, 9)]) == "0[CARD]67[EMAIL]9"
    many = [("ip", 2 * k, 2 * k + 1) for k in range(200_000)]
    assert pii.mask("a " * 200_000, many) == "[IP] " * 200_000


def test_pii_query(spark):
    """The query's columns over a whole table, from the stated forms."""
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        spans = brute_spans(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[r.doc_id] = (*[sum(k == kind for k, _, _ in spans) for kind in pii.BASE_KINDS], hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op9_pii(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(any(v[:4]) for v in want.values())


def test_pii_documents(spark, docs, empty, clashing):
    text = "é mail a.b@c.de, 10.0.0.1 and 300.1.1.1, 4111 1111 1111 1111, +1 (555) 555-1234."
    df = frame(spark, [(1, text), (2, None), (2, None)])
    got = {r.doc_id: r.spans for r in pii.find_documents(df).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in got[1]] == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 555-1234")] and got[2] == []
    masked = {r.doc_id: r.text for r in pii.mask_documents(df).collect()}
    assert masked == {1: "é mail [EMAIL], [IP] and 300.1.1.1, [CARD], [PHONE].", 2: None}
    assert pii.mask_documents(clashing).columns == clashing.columns and pii.find_documents(empty).count() == 0 and pii.mask_documents(docs).count() == len(DOCS)


# -- licences -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_templates_are_told_apart(name):
    found = license_scan.scan("Some words.\n" + license_scan.TEMPLATES[name] + "\nOther words follow.")
    assert [b[2] for b in found if b[2]] == [name]


def test_license_documents(spark, docs, empty):
    text = "intro\nCopyright 2020 Jane Doe. All rights reserved.\nLicensed under CC BY-ND 9.9.\nnothing of the kind"
    df = frame(spark, [(1, text), (2, None), (3, "nothing here")])
    got = {r.doc_id: [(text[b.start : b.end], b.license) for b in r.blocks] for r in license_scan.scan_documents(df).collect()}
    assert got == {1: [("Copyright 2020 Jane Doe. All rights reserved.", "ARR"), ("Licensed under CC BY-ND 9.9.", None)], 2: [], 3: []}
    assert license_scan.scan_documents(empty).count() == 0 and license_scan.scan_documents(docs).count() == len(DOCS)


def licences(text):
    return [(text[b[0] : b[1]], b[2]) for b in license_scan.scan(text)]


MIT, APACHE, GPL = (license_scan.TEMPLATES[k] for k in ("MIT", "Apache-2.0", "GPL-3.0"))


def test_licences_against_a_plain_search(spark):
    """Every verbatim notice of whole tables, found by a search of its words, lies in a reported block of that licence."""
    plain = {k: re.compile(r"(?<![A-Za-z0-9])" + r"[^A-Za-z0-9]+".join(re.escape(w) for w in re.findall(r"[A-Za-z0-9]+", v)) + r"(?![A-Za-z0-9])", re.I) for k, v in license_scan.TEMPLATES.items()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.blocks for r in license_scan.scan_documents(docs).collect()}
    seen = Counter()
    for r in docs.collect():
        for name, form in plain.items():
            for m in form.finditer(r.text or ""):
                longer = [b for b in found[r.doc_id] if b.start <= m.start() and m.end() <= b.end]
                assert any(b.license == name or b.license and len(license_scan.TEMPLATES[b.license]) > len(license_scan.TEMPLATES[name]) for b in longer), (r.doc_id, name)
                seen[name] += 1
    assert sum(seen.values()) > 10 and len(found) == docs.count()
    clashing = docs.select("*", F.lit("x").alias("blocks"), F.lit(1).alias("license")).filter("doc_id < 20")
    assert {r.doc_id: r.blocks for r in license_scan.scan_documents(clashing).collect()} == {d: b for d, b in found.items() if d < 20}


def test_every_licence_of_a_block():
    for gap in (" ", "\n", "\n\n", " and "):
        assert licences(f"x {MIT}{gap}{APACHE}{gap}{GPL} y") == [(MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0")]
    assert licences(f"Copyright 2020 J. R. Doe. All rights reserved.\n{MIT}") == [("Copyright 2020 J. R. Doe. All rights reserved.", "ARR"), (MIT, "MIT")]
    assert licences(f"Copyright (c) 2020 Jane Doe, {MIT}") == [(f"Copyright (c) 2020 Jane Doe, {MIT}", "MIT")]
    assert licences(f"{MIT} Licensed under CC BY-ND 9.9.\nby permission") == [(MIT, "MIT"), (" Licensed under CC BY-ND 9.9.", None), ("by permission", None)]
    edited = GPL.replace("work", "fine work")
    assert [b[2:3] + b[4:] for b in license_scan.scan(f"{MIT} {edited}")] == [("MIT", ""), ("GPL-3.0", "- +fine")]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_notice_anywhere_in_a_long_line(name):
    notice = license_scan.TEMPLATES[name]
    for n in (0, 10, 100, 1000):
        text = " ".join([*(f"word{k}" for k in range(n)), notice, *(f"more{k}" for k in range(n))])
        assert [(text[b[0] :].startswith(notice[:20]), b[2]) for b in license_scan.scan(text) if b[2]] == [(True, name)]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_notice_wrapped_anyhow(name, mark):
    own = license_scan.TEMPLATES[name].split()
    for width in (1, 2, 3, 5, 8):
        lines = [mark + " ".join(own[k : k + width]) for k in range(0, len(own), width)]
        assert [b[2] for b in license_scan.scan("\n".join(["before it", *lines, "after it"])) if b[2]] == [name]


def test_notices_as_published():
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    assert licences(f"intro\n{mpl} If a copy") == [(mpl, "MPL-2.0")]
    tag = "// SPDX-License-Identifier: "
    assert [x[1] for x in licences(f"{tag}MIT\n{tag}(Apache-2.0 OR GPL-2.0-or-later) AND BSD-3-Clause\n{tag}GPL-2.0 WITH Classpath-exception-2.0 */\n{tag}\n")] == ["MIT", "Apache-2.0", "GPL-2.0-or-later", "BSD-3-Clause", "GPL-2.0 WITH Classpath-exception-2.0", None]
    assert licences("x SPDX-License-Identifier: MIT. And more") == [("SPDX-License-Identifier: MIT.", "MIT")]


def test_compression_tells_which_template_a_span_is_of():
    """Of the templates that hold for an edited notice, the one whose dictionary saves most bytes is reported."""
    text = "This program is free software; you 2 redistribute it and/or modify it under the software: of the GNU affero General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your any later version."
    found = license_scan.words(text)
    held = {k: got for k in license_scan.TEMPLATES if (got := license_scan.fit(k, found))}
    less = {k: license_scan.saved(" ".join(found[: got[0]]), k)[0] for k, got in held.items()}
    agree = {k: 3 * got[1] - got[0] - len(license_scan.words(license_scan.TEMPLATES[k])) for k, got in held.items()}
    assert len(held) > 1 and max(less, key=less.get) != max(agree, key=agree.get)  # wording alone says another
    assert [b[2] for b in license_scan.scan(text)] == [max(less, key=less.get)]


# -- shared ---------------------------------------------------------------------------------------------


def test_scratch_tables_go(spark, docs):
    table = materialize(docs, "t")
    assert table.count() == len(DOCS)
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    discard(table)
    assert not os.path.exists(path)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_operator_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    names = sorted(df.columns)
    out = con.execute(catalog.ORACLES[name])
    at = [[c[0] for c in out.description].index(n) for n in names]
    assert len(at) == len(out.description)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in out.fetchall()), key=repr)
