"""Main text of web pages from streaming parser events.

The standard library's parser turns a page into lines, a line for each block, in an element tree. Each
line has its text-to-tag ratio; the ratios of all lines, menus and notices included, are smoothed by a
Gaussian and split into two clusters by a threshold. The lines of the upper cluster choose the regions:
article elements (or main elements) that hold most of the cluster's text, as deep as the one with most of
it, and with their siblings of that kind. Without them the region is the smallest element around the whole
cluster; where that is the whole page, its sections without a line of the cluster go if they are mostly
links, or lie before the first or behind the last line of the cluster and have neither a heading nor a sentence.

Lists only take out of the regions what ratios can't tell from the article: elements that by their tag,
role or whole name are menus, headers, footers, sidebars, notices, adverts, forms or reader comments. A name
counts if all its parts name page parts or their places, so "left-sidebar" does and "market-share" doesn't.
Lines that lists take out count in the clusters, but choose no region. All other lines of the regions are the result.

Time and memory grow with the page's length, whatever its nesting. Edge cases: null, empty and text-free
pages give an empty string; rows keep their multiplicity; only the named columns are read, so other
columns can't clash. Unclosed and misnested elements are closed as browsers do. Long pages are handled whole.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var".split())
FORMULA = frozenset("annotation maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas audio video button select textarea dialog menu".split())
#: Of these, elements that show no text of their own: they give no lines at all.
SILENT = frozenset("head script style noscript template iframe object svg canvas audio video select textarea".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar comment comments commentlist disqus respond replies reply discussion"
    " share sharing social related recommended newsletter subscribe subscription signup login pagination pager skip siteheader pageheader topheader globalheader mainheader".split()
)
#: A name with one of these before its last part tells the layout around an element ("has-sidebar"), not what it is.
LAYOUT = frozenset("has have with without no".split())
#: Ids that sections of an article have too; as classes they stay names of page parts.
SECTION_IDS = frozenset("discussion reply replies social related notice notices consent promotion recommended subscription notification registration navigation".split())
#: What may follow a page part's name in a longer one: "ad-box" is an advert, "related-work" is a section.
SUFFIXES = frozenset(
    "area author avatar bar block body bottom box btn button buttons center col column container content date desktop end feed footer form grid group head header heading holder icon icons image images inner item items"
    " label layer left link links list main message meta mobile module name outer overlay page panel post posts right row section sections site slot sticky text thread title top unit wrap wrapper zone articles stories sign up in".split()
)
#: What may stand before a page part's name: where it is, or whose.
PREFIXES = frozenset("left right top bottom upper lower main site page global primary secondary inner outer sticky fixed mobile desktop header footer article post story entry blog user reader my the first last js wp uk mw".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table article section div main body html td th aside nav header footer blockquote form".split())
BLOCKS, OPENERS = CLOSES_P | SCOPES, frozenset(("article", "body"))
_word = re.compile(r"[a-z0-9]+")


def unwanted(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is no part of the article by its tag, role, names or being hidden."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main"):
        attrs = [(k, v) for k, v in attrs if k in ("class", "hidden") and tag == "article" and "comment" in (v or "")]
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id"):
            for name in value.split():
                parts = _word.findall(name)
                if parts == ["header"] and not in_article:
                    return True
                if LAYOUT.intersection(parts[:-1]) or (key == "id" and len(parts) == 1 and parts[0] in SECTION_IDS):
                    continue
                while len(parts) > 1 and parts[0] in PREFIXES and parts[0] not in NAMES:
                    parts = parts[1:]
                placed = all(p in NAMES or p in SUFFIXES or p.isdigit() or re.fullmatch(r"\d+x\d+", p) for p in parts[1:])
                if parts and (parts[0] in NAMES and placed or "".join(parts) in NAMES):
                    return True
    return False


class LineParser(HTMLParser):
    """Collects lines: (text, tags in it, characters of links, element, whether lists take it out); silent elements give none.

    Elements are numbered as they open; ``kind`` and ``parent`` hold the tree, with 0 for the page. Inline elements are
    in it only within a dropped one of theirs.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.kind, self.parent = [""], [0]
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, dropped
        self.places: dict[str, list[int]] = {}  # where each tag is in the stack
        self.dropped: list[int] = []  # where dropped elements are in the stack
        self.parts: list[str] = []
        self.beside: list[str] = []  # text of dropped elements
        self.tags = self.articles = self.linked = self.hard = self.silent = 0
        self.in_link = False

    def flush(self) -> None:
        for parts, listed in ((self.parts, False), (self.beside, True)):
            text = " ".join("".join(parts).split())
            if text:
                self.lines.append((text, self.tags, 0 if listed else self.linked, self.stack[-1][1] if self.stack else 0, listed))
                self.tags = 0
        self.parts, self.beside, self.linked = [], [], 0

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            tag, _, drop = self.stack.pop()
            self.places[tag].pop()
            if drop:
                self.dropped.pop()
                self.hard -= tag in ("aside", "dialog", "template")
                self.silent -= tag in SILENT

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def find(self, tags, scope: frozenset) -> int:
        """Place of the innermost of ``tags`` that is open within the innermost element of ``scope``, -1 without one."""
        at = self.last(tags)
        return at if at >= self.last(scope) else -1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                (self.beside if self.dropped else self.parts).append(" ")
            return
        if tag == "a":
            self.in_link = True
        if tag in FORMULA and self.places.get("math") or self.places.get("svg") and tag not in BLOCKS and tag not in DROPPED:
            return  # all of a formula is text of its line, and nothing in a drawing begins one
        if tag not in INLINE:
            self.flush()
            self.in_link = False
            if tag == "body" or (tag == "main" or (tag == "article" and not self.articles)) and self.dropped and not self.hard:
                # an unclosed menu or notice ends where the main part begins
                if self.dropped:
                    self.pop_to(self.dropped[0])
            if tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":
                self.pop_to(len(self.stack) - 1)
            if tag in CLOSES_P and (i := self.find(("p",), SCOPES)) >= 0:
                self.pop_to(i)
            if tag in SAME_CLOSES and (i := self.find(SAME_CLOSES[tag].split(), frozenset(("ul", "ol", "dl", "table", "select")))) >= 0:
                self.pop_to(i)
        if tag in VOID:
            return
        drop = unwanted(tag, attrs, bool(self.places.get("article") or self.places.get("main")))
        if tag in INLINE and tag != "math" and not drop and not (self.stack and self.stack[-1][0] in INLINE):
            return
        self.articles += tag == "article" and not drop
        self.kind.append(tag)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        if drop:
            self.dropped.append(len(self.stack))
            self.hard += tag in ("aside", "dialog", "template")
            self.silent += tag in SILENT
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, len(self.kind) - 1, drop))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.in_link = False
        if self.places.get("svg") and tag not in BLOCKS and tag not in DROPPED:
            return
        inline = tag in INLINE or tag in FORMULA and bool(self.places.get("math"))
        if not inline:
            self.flush()
        scope = BLOCKS if inline else OPENERS if tag not in ("article", "body", "html") else frozenset()
        if (i := self.find((tag,), scope)) >= 0:
            self.pop_to(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.silent:
            return
        (self.beside if self.dropped else self.parts).append(data)
        if self.in_link and not self.dropped:
            self.linked += len(data)

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing over ``radius`` lines to both sides, weights renewed at the ends."""
    weights = [math.exp(-(k * k) / (2 * (radius / 2) ** 2)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(weights[k + radius], ratios[i + k]) for k in range(-radius, radius + 1) if 0 <= i + k < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of the two cluster means (Lloyd's algorithm on a line from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        under, over = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not under or not over:
            break
        moved = sum(under) / len(under), sum(over) / len(over)
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """Text of the article: its blocks in page order, one a line."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    return "\n".join(line[0] for line, kept in zip(parser.lines, chosen(parser), strict=True) if kept)


def upper_cluster(lines: list[tuple]) -> list[bool]:
    """Which lines have a smoothed ratio of text to tags in the upper of two clusters."""
    even = smoothed([len(line[0]) / max(1, line[1]) for line in lines])
    cut = threshold(even)
    return [value >= cut for value in even]


def chosen(parser: LineParser) -> list[bool]:
    """Which lines are the article: those of the regions that the upper cluster chooses, without those that lists take out."""
    lines = parser.lines
    if all(line[4] for line in lines):
        return [False] * len(lines)
    upper = upper_cluster(lines)
    if not any(high and not line[4] for high, line in zip(upper, lines, strict=True)):
        # what lists take out has the whole upper cluster: the rest is clustered alone
        rest = iter(upper_cluster([line for line in lines if not line[4]]))
        upper = [not line[4] and next(rest) for line in lines]
    keep = content_lines(parser, upper)
    return [kept and not line[4] for kept, line in zip(keep, lines, strict=True)]


def content_lines(parser: LineParser, upper: list[bool]) -> list[bool]:
    """Which lines are in the regions that the lines of the upper cluster choose."""
    lines, kind, parent = parser.lines, parser.kind, parser.parent
    upper = [high and not line[4] for high, line in zip(upper, lines, strict=True)]
    sizes = [len(line[0]) * high for line, high in zip(lines, upper, strict=True)]
    for tag in ("article", "main"):
        regions, share = outermost(parser, sizes, tag)
        if 2 * share >= sum(sizes):
            inside = [False] * len(kind)
            for n in range(len(kind)):  # parents come before their elements
                inside[n] = n in regions or (n > 0 and inside[parent[n]])
            return [inside[at] for *_, at, _ in lines]
    # the innermost element around the cluster
    whole, high = [0] * len(kind), [0] * len(kind)
    for (text, _, _, at, _), size in zip(lines, sizes, strict=True):
        whole[at] += len(text)
        high[at] += size
    for n in range(len(kind) - 1, 0, -1):
        whole[parent[n]] += whole[n]
        high[parent[n]] += high[n]
    around = max(n for n in range(len(kind)) if high[n] == high[0] and (kind[n] in SCOPES or not n))
    section = [n if n and parent[n] == around else 0 for n in range(len(kind))]
    inside = [n == around for n in range(len(kind))]
    for n in range(1, len(kind)):
        inside[n] = inside[n] or inside[parent[n]]
        section[n] = section[n] or section[parent[n]]
    keep = [inside[at] for *_, at, _ in lines]
    if whole[around] < whole[0]:
        return keep
    # sections of a whole page
    links, headed, first, last = {}, set(), {}, {}
    for i, (text, _, linked, at, listed) in enumerate(lines):
        if listed:
            continue
        part = section[at]
        links[part] = links.get(part, 0) + linked
        first.setdefault(part, i)
        last[part] = i
        n = at
        while n and kind[n] in INLINE:
            n = parent[n]
        if kind[n] in HEADINGS or text.endswith((".", "!", "?", "…", ":", "。", "！", "？")) and 2 * linked < len(text):
            headed.add(part)
    begin, end = upper.index(True), len(upper) - 1 - upper[::-1].index(True)
    gone = {n for n in first if n and not high[n] and (2 * links[n] >= whole[n] or (kind[n] in ("div", "section", "center", "table") and n not in headed and (last[n] < begin or first[n] > end)))}
    return [kept and section[at] not in gone for kept, (*_, at, _) in zip(keep, lines, strict=True)]


def outermost(parser: LineParser, sizes: list[int], tag: str) -> tuple[set[int], int]:
    """Outermost elements of a kind that hold text of the cluster, as deep as the one with most of it, and siblings of those; how much they hold."""
    kind, parent = parser.kind, parser.parent
    top, depth = [0] * len(kind), [0] * len(kind)
    for n in range(1, len(kind)):
        depth[n] = depth[parent[n]] + 1
        top[n] = top[parent[n]] or (n if kind[n] == tag else 0)
    held: dict[int, int] = {}
    for (*_, at, _), size in zip(parser.lines, sizes, strict=True):
        if top[at] and size:
            held[top[at]] = held.get(top[at], 0) + size
    if not held:
        return set(), 0
    deep = depth[max(held, key=lambda n: (held[n], -n))]
    chosen = {n for n in held if depth[n] == deep}
    parents = {parent[n] for n in chosen}
    near = {n for n in range(1, len(kind)) if top[n] == n and depth[n] == deep and parent[n] in parents}
    return chosen | near, sum(held[n] for n in chosen)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
