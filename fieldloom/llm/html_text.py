"""Main text of web pages: text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser hands over tags and texts; no tree is built. Texts between block tags form
lines, each with its ratio of characters to tags. The smoothed ratios of a page are cut at a share of their spread;
consecutive lines above it form clusters, and the innermost element that holds nearly all of the clusters' text is the
content region. All its lines are kept, short ones too, but for those inside elements that are no article text by
their tag, role, class or id (inside an article only if all their words say so), and for lines that are links only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import shared

SIGMA = 1.5  # lines
CUT = 0.5  # of the standard deviation of the smoothed ratios
MOST_OF = 0.9  # of the clusters' text that the content region holds
LINKS = 0.8  # share of a line's characters in links from which on it is a menu entry

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
NOT_TEXT = set("script style noscript template head title svg math iframe object canvas audio video map select textarea button datalist".split())
FURNITURE = set("nav footer aside form menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|gdpr|notice|newsletter|subscri[a-z]*|signup|sidebar|menu|nav|navbar|"
    r"navigation|breadcrumbs?|share|sharing|social|related|recommend[a-z]*|comments?|commentlist|disqus|repl(?:y|ies)|footer|header|masthead|popup|modal|"
    r"overlay|pagination|pager|widget|login|toolbar|teaser|skip)(?![a-z])"
)
REGIONS = set("body main article section div td center".split())
HEADINGS = set("h1 h2 h3".split())
NEVER = set("html body article main h1 h2 h3 h4 h5 h6".split())
# An opening tag that ends an open element of these kinds, as long as none of the walls stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


# Inside an article a class or id counts only if all its words are names or these.
NEUTRAL = re.compile(
    r"(?:^|[^a-z])(?:box|block|list|item|items|bar|area|section|container|wrapper|wrap|inner|outer|content|links?|buttons?|form|panel|unit|slot|"
    r"top|bottom|left|right|side|main|site|page|post|posts|article|articles|story|stories|more|us|and|the|by|on|js|col|row)(?![a-z])"
)


class Region:
    """An open or closed element that may hold the article; elements are numbered as they open."""

    __slots__ = ("number", "tag", "parent", "last", "mass", "plain")

    def __init__(self, number: int, tag: str, parent: Region | None):
        self.number, self.tag, self.parent = number, tag, parent
        self.last = math.inf  # largest number inside it, once it is closed
        self.mass = self.plain = 0  # text of clusters in it, and its lines that are neither headings nor links

    def holds(self, line: Line) -> bool:
        return line.region is not None and self.number <= line.region.number <= self.last


class Line:
    __slots__ = ("text", "tags", "linked", "region", "heading", "paragraph")

    def __init__(self, region: Region | None, heading: bool, paragraph: bool):
        self.text, self.tags, self.linked = [], 0, 0
        self.region, self.heading, self.paragraph = region, heading, paragraph


class Lines(HTMLParser):
    """Collects the lines of a page that may be article text, with the innermost region around each.

    Open elements are a stack with a count per tag, so that a page of any depth takes time in proportion to its length.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Region | None, bool]] = []  # tag, innermost region, is the text inside dropped?
        self.count: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.regions: list[Region] = []
        self.line: Line | None = None
        self.made = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a section of an unknown kind: skipped like a comment
            return self.rawdata.find(">", i) + 1 or -1

    def _dropped(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def _break(self) -> None:
        self.line = None

    def _pop(self, at: int) -> None:
        for tag, region, _ in self.open[at:]:
            self.count[tag] -= 1
            if tag in REGIONS and region is not None:
                region.last = min(region.last, self.made)
        del self.open[at:]

    def _imply(self, tag: str) -> None:
        ended, walls = CLOSES.get(tag, ({"p"}, {"li", "td", "th", "div", "section", "article", "main", "blockquote", "button", "body"}))
        if not any(self.count[t] for t in ended):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in ended:
                self._pop(at)
                return
            if self.open[at][0] in walls:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data("\n")
        if tag in INLINE:
            if self.line:
                self.line.tags += 1
        else:
            self._break()
            self._imply(tag)
        if tag in VOID:
            return
        self.made += 1
        dropped = self._dropped() or self._furniture(tag, dict(attrs))
        region = self.open[-1][1] if self.open else None
        if tag in REGIONS:
            region = Region(self.made, tag, region)
            self.regions.append(region)
        self.count[tag] += 1
        self.open.append((tag, region, dropped))

    def _furniture(self, tag: str, attrs: dict) -> bool:
        if tag in NOT_TEXT or tag in FURNITURE:
            return True
        inside = bool(self.count["article"] or self.count["main"])
        if tag == "header":
            return not inside
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        if tag in NEVER:
            return False
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        if not inside:
            return bool(NAMES.search(names))
        return any(NAMES.search(n) and not re.search("[a-z]", NEUTRAL.sub(" ", NAMES.sub(" ", NAMES.sub(" ", n)))) for n in names.split())

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if tag in INLINE and self.open[at][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self._dropped():
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(self.open[-1][1] if self.open else None, any(self.count[h] for h in HEADINGS), self.count["p"] > 0)
            self.lines.append(self.line)
        self.line.text.append(data)
        if self.count["a"]:
            self.line.linked += len("".join(data.split()))


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the page's ends the kernel is cut and rescaled."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - reach), min(len(ratios), i + reach + 1)
        part = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * r for w, r in zip(part, ratios[lo:hi])) / sum(part))
    return out


def _region(regions: list[Region], total: int) -> Region | None:
    """The innermost article, or else the innermost element, that holds nearly all of the clusters' text.

    Of nested elements the innermost has the largest number. An element that adds nothing but headings and links to
    the region becomes the region.
    """
    holding = [r for r in regions if total and r.mass >= MOST_OF * total]
    articles = [r for r in holding if r.tag in ("article", "main")]
    if articles or not holding:
        return articles[-1] if articles else None
    region = holding.pop()
    while holding and holding[-1].plain == region.plain:
        region = holding.pop()
    return region


def clusters(ratios: list[float]) -> list[bool]:
    """Which lines belong to a cluster: their smoothed ratio reaches a share of the spread of all."""
    level = smoothed(ratios)
    mean = sum(level) / len(level)
    cut = min(CUT * math.sqrt(sum((x - mean) ** 2 for x in level) / len(level)), max(level))
    return [x >= cut for x in level]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, blanks squeezed, joined by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    rows = [(" ".join("".join(line.text).split()), line) for line in parser.lines]
    # A line of links is a menu entry; a paragraph that says more than its links is none.
    rows = [(text, line, line.linked >= (1 if line.paragraph else LINKS) * len("".join(text.split()))) for text, line in rows if text]
    if not rows:
        return ""
    chosen = clusters([0.0 if linked else len(text) / (line.tags + 1) for text, line, linked in rows])
    total = 0
    for (text, line, linked), inside in zip(rows, chosen):
        if inside and not linked:
            total += len(text)
            if line.region:
                line.region.mass += len(text)
        if line.region and not (line.heading or linked):
            line.region.plain += 1
    for r in reversed(parser.regions):  # every element after those inside it
        if r.parent:
            r.parent.mass += r.mass
            r.parent.plain += r.plain
    region = _region(parser.regions, total)
    kept = [(text, linked) for text, line, linked in rows if region is None or region.holds(line)]
    if any(not linked for _, linked in kept):
        kept = [(text, linked) for text, linked in kept if not linked]
    return " ".join(text for text, _ in kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row.

    * Null, empty and blank pages, and pages without text outside dropped elements, give an empty text.
    * Broken markup is read as far as it goes; a page never fails. Repeated rows give repeated results.
    * Other columns are ignored. An empty table gives an empty result.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(shared.table(spark, sf_dir, "pages"))
