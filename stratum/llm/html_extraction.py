"""Main text of web pages by consensus host paths.

Pass one parses each page into blocks, scores its containers by the text they hold outside links and
markup noise, and reports the generalised tag-class path of the best one (digits in class names become
``#``).  Spark adds up the votes of each host.  Pass two parses each page again and takes the blocks
under the host's winning paths; a page in which no winning path occurs falls back to its own best
container.

Votes are grouped by (host, path) before they are ranked by host, so a host with a third of all pages
costs one row for each of its distinct paths.  The winners are joined to the pages by host; a hot host
is a skewed join key there, which adaptive execution splits.

Boilerplate is told by tags and by class words.  Words for adverts, comments, consent and menus decide by
themselves.  Words that also name parts of layouts or kinds of paragraphs are weighed: on a text element of
an article they mean nothing, and a container that bears one stays where it holds all articles of the page
or, in a page without article elements, most of its text outside links.  Words after ``has``, ``no`` and the
like in one class name (``has-sidebar``) tell nothing of the element.  A ``header`` inside an article is the
article's own.

All passes go over elements in order or in reverse, and a path is known by a hash of its parent's and its
own name, so depth costs no more than length.

Defined results: null and empty pages have the empty text; pages without a URL or host vote as the empty
host; a page with no container at all takes all its unboilerplated blocks; repeated rows are extracted
one by one; unclosed and stray tags are tolerated; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import materialize, table
from .url_filters import split_url

#: Elements whose whole content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe svg canvas object select textarea head title math audio video".split())
#: Elements that are boilerplate wherever they stand; ``header`` is, outside articles.
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu".split())
#: Class, id and role words that mark boilerplate by themselves.
DECISIVE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promoted cookie cookies consent gdpr popup modal newsletter subscribe
    signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager comment comments disqus replies respond""".split()
)
#: Words that mark boilerplate unless what bears them is the text of the page.
WEIGHED_WORDS = frozenset(
    """banner promo notice sidebar side aside widget widgets footer foot header head masthead share sharing social related recommended
    recommendations toolbar search alert dialog reply complementary contentinfo""".split()
)
#: Words of a class name that say what the element has, not what it is.
ABOUT_OTHERS = frozenset("has have with without no hide hidden disable enable".split())
ARTICLES = frozenset("article main".split())
BLOCK_TAGS = frozenset(
    """html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
CONTAINERS = frozenset("article main section div body td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these tags.
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
HINTS = {"article": 1.6, "main": 1.5}
_HINT_WORD = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|text)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its path's hash, its place among the elements before it, and what it holds itself."""

    __slots__ = ("article", "block", "boost", "chars", "container", "inside", "linked", "mark", "noise", "parent", "path", "tag")

    def __init__(self, tag: str, path: int, parent: Node | None, mark: int, boost: float):
        self.tag, self.path, self.parent, self.mark, self.boost = tag, path, parent, mark, boost
        self.chars = self.linked = 0
        self.noise = self.inside = False
        self.block = self if tag in BLOCK_TAGS or parent is None else parent.block
        self.container = self if tag in CONTAINERS else parent and parent.container
        self.article = tag in ARTICLES or bool(parent and parent.article)


#: What an element's tag and names say: nothing, boilerplate for certain, or boilerplate unless it is the text.
PLAIN, DECIDED, WEIGHED = 0, 1, 2


@dataclass
class Page:
    blocks: list[tuple[str, Node]] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)  # parents before children


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _marks(names: str) -> int:
    """PLAIN, DECIDED or WEIGHED by the words of class names, ids and roles."""
    found = PLAIN
    for name in names.split():
        said = [w.lower() for w in _WORDS.findall(name)]
        for k, w in enumerate(said):
            if k and said[k - 1] in ABOUT_OTHERS:
                continue
            if w in DECISIVE_WORDS:
                return DECIDED
            if w in WEIGHED_WORDS:
                found = WEIGHED
    return found


def parse(source: str) -> Page:
    """Blocks in page order, each with the innermost open block element."""
    page, root = Page(), Node("", 0, None, PLAIN, 1.0)
    stack, buffer, linked, at, n = [root], [], 0, 0, len(source)
    open_: dict[str, int] = {}
    endless: set[str] = set()
    in_link = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        if text:
            node = stack[-1].block
            page.blocks.append((text, node))
            node.chars += len(text)
            node.linked += min(linked, len(text))
        buffer.clear()
        linked = 0

    def close(upto: Node) -> None:
        """Close ``upto`` and all within it."""
        nonlocal in_link
        if stack[-1].block is not upto.parent.block:
            flush()
        while True:
            x = stack.pop()
            open_[x.tag] -= 1
            in_link -= x.tag == "a"
            if x is upto:
                return

    while at < n:
        m = _TOKEN.search(source, at)
        upto = m.start() if m else n
        if upto > at:
            buffer.append(source[at:upto])
            if in_link:
                linked += upto - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                close(next(x for x in reversed(stack) if x.tag == tag))
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/"):
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else (n if tag not in ("head", "title") else at)
            if tag != "head":
                buffer.append(" ")
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            block = stack[-1].block  # a block ends an open paragraph and whatever inline elements it holds
            if block.tag == "p" or block.tag in CLOSED_BY.get(tag, ()):
                close(block)
        a = _attributes(m[3]) if m[3] else {}
        names, parent = " ".join(a.values()), stack[-1]
        mark = PLAIN if tag in ("body", "html", *ARTICLES) or not names else _marks(names)
        if tag in BOILERPLATE_TAGS or tag == "header" and not parent.article:
            mark = DECIDED
        elif mark == WEIGHED and parent.article and tag not in CONTAINERS and tag not in ("ul", "ol", "table"):
            mark = PLAIN
        elif names and tag in ARTICLES and _marks(names) == DECIDED:
            mark = DECIDED  # a comment, say, that is marked up as an article
        name = tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(a.get("class", "").split())))
        boost = HINTS.get(tag, 1.25 if names and _HINT_WORD.search(names) else 1.0)
        node = Node(tag, xxhash.xxh3_64_intdigest(f"{parent.path:x}/{name}") >> 1, parent, mark, boost)
        stack.append(node)
        page.nodes.append(node)
        open_[tag] = open_.get(tag, 0) + 1
        in_link += tag == "a"
    flush()
    _weigh(page)
    return page


def _weigh(page: Page) -> None:
    """Settle which elements are boilerplate."""
    weighed = any(x.mark == WEIGHED for x in page.nodes)
    if weighed:  # what each element holds, within it and outside boilerplate for certain
        held = {id(x): [max(0, x.chars - x.linked), x.linked, int(x.tag in ARTICLES)] for x in page.nodes}
        every = [0, 0, 0]
        for x in reversed(page.nodes):
            own = held[id(x)] if x.mark != DECIDED else [0, 0, 0]
            above = held.get(id(x.parent), every)
            for k in range(3):
                above[k] += own[k]
    for x in page.nodes:
        x.noise = x.parent.noise or x.mark == DECIDED
        if x.mark == WEIGHED and not x.noise:
            text, links, articles = held[id(x)]
            whole = articles == every[2] if every[2] else 2 * text > every[0] and links < text
            x.noise = not whole


def best_path(page: Page) -> tuple[int, float] | None:
    """The container of highest score: its own text at full worth, nested text at a discount for depth."""
    score = {id(x): 0.0 for x in page.nodes if x.tag in CONTAINERS}
    for text, node in page.blocks:
        if not node.noise and node.container is not None:
            score[id(node.container)] += len(text) - node.linked * len(text) / max(node.chars, 1)
    ranked = []
    for k in range(len(page.nodes) - 1, -1, -1):
        x = page.nodes[k]
        if x.tag in CONTAINERS and score[id(x)] > 0:
            ranked.append((score[id(x)] * x.boost, -k, x.path))
            if x.parent.container is not None:
                score[id(x.parent.container)] += 0.75 * score[id(x)]
    return (max(ranked)[2], max(ranked)[0]) if ranked else None


def text_under(page: Page, paths: set[int] | None) -> str:
    """Blocks outside boilerplate and, where given, under a node of one of ``paths``."""
    for x in page.nodes:
        x.inside = paths is not None and (x.parent.inside or x.path in paths)
    return "\n".join(text for text, node in page.blocks if not node.noise and (paths is None or node.inside))


def extract(source: str, winners: list[int] | None) -> str:
    page = parse(source)
    here = {x.path for x in page.nodes if x.tag in CONTAINERS}
    taken = {p for p in winners or () if p in here}
    if not taken:
        own = best_path(page)
        taken = {own[0]} if own else None
    return text_under(page, taken)


#: A path wins where it has at least this share of its host's votes.
WINNING_SHARE = 0.2


def vote(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Each page's host and the hash of its best path, as one vote, with its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                found = [s and best_path(parse(s)) for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] if f else None for f in found], pa.int64()), pa.array([f[1] if f else None for f in found], pa.float64())], ["host", "path", "score"]
                )

    host, _ = split_url(F.col(url))
    return pages.select(host.alias("host"), source).mapInArrow(run, "host string, path long, score double").filter("path is not null")


def winning_paths(votes: DataFrame, share: float = WINNING_SHARE) -> DataFrame:
    """host and its winning paths: those with ``share`` of its votes, the strongest first."""
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    host = W.Window.partitionBy("host")
    ranked = counted.withColumn("all", F.sum("n").over(host)).withColumn("most", F.max("n").over(host))
    kept = ranked.filter((F.col("n") >= share * F.col("all")) | (F.col("n") == F.col("most")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")))
    return kept.groupBy("host").agg(F.transform(order, lambda s: s["path"]).alias("winners"))


def extract_pages(pages: DataFrame, url: str = "url", source: str = "html", key: str = "page_id") -> DataFrame:
    """``key``, ``url`` and the main ``text`` of every page."""
    host, _ = split_url(F.col(url))
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host.alias("host"))
    winners = materialize(winning_paths(vote(pages, url, source)), "winning-paths")  # its size is known from here on: a small table is broadcast, a large one shuffled
    joined = own.join(winners, "host", "left").select("page_id", "url", "html", "winners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                texts = [extract(s, w) if s else "" for s, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
