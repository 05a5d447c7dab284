"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each under its root-to-leaf path of block elements. Lengths
of text and counts of punctuation are summed by path and divided by the path's blocks; these ratios
are smoothed over neighbouring blocks, the more the nearer their paths, and fused. Paths above a
threshold that follows from the page's own spread select the content blocks; what stands with them
in the article, or between the first and the last of them where a page has no such element, is the
main text. Elements that are by their name, role or class no part of an article are left out before.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A path counts as content from this many standard deviations of the page's fused ratios on.
THRESHOLD = 0.8
#: Weights of a block and of its neighbours at distances 1 and 2.
KERNEL = (1.0, 0.6, 0.14)
#: Deeper elements stand beside their parent, as in browsers.
DEPTH = 512
#: The least share of the selected text that the smallest element around it must hold, where nothing is marked as article.
SHARE = 0.8

# Elements of HTML and what their names say about their place in a page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main "
    "menu nav noscript object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
BREAKS = frozenset(("br", "hr"))
NO_CONTENT = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("head nav aside footer form button select option optgroup fieldset legend label dialog menu search noscript object".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tooltip status".split())
#: Words of class names and ids for parts that hold no article; the first kind holds even where an article element is inside.
ALWAYS = frozenset("comment comments commentlist disqus replies reply respond ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored cookie cookies consent gdpr".split())
MOSTLY = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer sidebar widget promo promotion banner notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations toolbar pagination pager copyright disclaimer form search skip".split()
)
#: Class names that begin or end so describe what stands elsewhere; headers of these belong to the article.
ELSEWHERE_FIRST, ELSEWHERE_LAST = frozenset("has with no without is not".split()), frozenset("open closed enabled disabled free".split())
OWN_HEADER = frozenset("article post entry content section story".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。！，：；？؟،।]")

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+')?|["'])*+)>""")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What an element closes when it opens, and the elements that this doesn't reach beyond.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
}
P_REACH = ("button", "td", "th", "caption", "object", "label")


@dataclass
class Element:
    """A block element, or an inline one that its class puts outside the article."""

    tag: str
    parent: int
    path: int
    outside: bool
    mostly: bool
    article: bool
    holds_article: bool = False


@dataclass
class Block:
    """Text between two boundaries, and how much of it stands in links."""

    element: int
    text: str
    links: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, False, False, False)])
    blocks: list[Block] = field(default_factory=list)


def hints(attributes: str) -> tuple[bool, bool, str, bool]:
    """Whether class, id and role say "never part of an article", "mostly not"; a label for the path; whether they mark the article."""
    always = mostly = article = False
    label = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        if name == "role":
            mostly, article = mostly or value.lower() in ROLES, article or value.lower() in ("main", "article")
        elif name == "itemprop":
            article = article or value.lower() == "articlebody"
        else:
            for given in value.split():
                words = [w.lower() for w in WORDS.findall(given)]
                if name == "class" and not label:
                    label = "-".join(words)
                if not words or words[0] in ELSEWHERE_FIRST or words[-1] in ELSEWHERE_LAST:
                    continue
                always = always or not ALWAYS.isdisjoint(words)
                mostly = mostly or not MOSTLY.isdisjoint(words) and not ("header" in words and not OWN_HEADER.isdisjoint(words))
    return always, mostly, label, article


class Reader:
    """Reads one page from left to right; each character is looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.page = source, Page()
        self.open, self.count = [0], {"": 1}
        self.paths: dict[tuple[int, str], int] = {}
        self.pieces: list[str] = []
        self.in_link, self.links = False, 0

    def text(self, raw: str) -> None:
        raw = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(raw)
        if self.in_link:
            self.links += len(raw)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.close(("head",), tuple(OUTSIDE))  # text ends an open head, unless it is a fallback's
                self.page.blocks.append(Block(self.open[-1], text, min(self.links, len(text))))
            self.pieces, self.links = [], 0

    def pop(self, to: int) -> None:
        """Close all open elements from place ``to`` of the stack on."""
        for e in self.open[to:]:
            self.count[self.page.elements[e].tag] -= 1
        del self.open[to:]

    def close(self, names: tuple[str, ...], reach: tuple[str, ...]) -> None:
        """Close the innermost of ``names`` and all inside it, unless one of ``reach`` is nearer."""
        if any(self.count.get(n) for n in names):
            for at in range(len(self.open) - 1, 0, -1):
                tag = self.page.elements[self.open[at]].tag
                if tag in names:
                    return self.pop(at)
                if tag in reach:
                    return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        always, mostly, label, article = hints(attributes) if "=" in attributes and tag not in ("html", "body") else (False, False, "", False)
        if tag in BREAKS:
            self.end_block()
        if tag in NO_CONTENT:
            return
        if tag == "a":
            self.in_link = True
        if tag not in BLOCKS and not (always or mostly):
            return
        self.end_block()
        if tag in BLOCKS:
            self.close(("p",), P_REACH)
            if tag not in ("head", "noscript"):
                self.close(("head",), ())
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if len(self.open) > DEPTH:
            self.pop(DEPTH)
        parent = self.open[-1]
        elements = self.page.elements
        article = not always and (article or tag in ("article", "main"))
        # headers at the top of an article are part of it
        outside = always or tag in OUTSIDE or tag == "header" and not (self.count.get("article") or self.count.get("main"))
        path = self.paths.setdefault((elements[parent].path, f"{tag}.{label}"), len(self.paths) + 1)
        elements.append(Element(tag, parent, path, outside, mostly and not article, article))
        if article:
            for e in self.open:
                elements[e].holds_article = True
        self.open.append(len(elements) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in BLOCKS:
            self.end_block()
        if self.count.get(tag):
            self.end_block()
            self.close((tag,), ())

    def read(self) -> Page:
        source, at, quoted = self.source, 0, True
        while at < len(source):
            tag_at = source.find("<", at)
            if tag_at < 0:
                tag_at = len(source)
            if tag_at > at:
                self.text(source[at:tag_at])
            at = tag_at
            if at >= len(source):
                break
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 2)
                at = len(source) if stop < 0 else stop + 3
                continue
            after = source[at + 1 : at + 2]
            if not (after.isascii() and after.isalpha() or after in ("!", "?", "/")):
                self.text("<")
                at += 1
                continue
            found = TAG.match(source, at) if quoted and after not in "!?" else None
            if found:
                closing, tag, attributes, at = found[1], found[2].lower(), found[3], found.end()
            else:
                stop = source.find(">", at)
                if stop < 0:
                    break  # an unfinished tag at the end of the page is no text
                known = NAME.match(source, at)
                if known is None:  # document types, instructions and the like
                    at = stop + 1
                    continue
                quoted = False  # a quote that never ends: from here on a tag ends at the next angle bracket
                closing, tag, attributes, at = known[1], known[2].lower(), source[known.end() : stop], stop + 1
            if closing:
                self.end(tag)
            elif tag in RAW:
                stop = RAW_END[tag].search(source, at)
                at = stop.start() if stop else len(source)
            else:
                self.start(tag, attributes)
        self.end_block()
        return self.page


def path_ratios(paths: list[int], parents: list[int], blocks: list[Block]) -> list[float]:
    """Each block's fused ratio: the geometric mean of text length and (one more than) punctuation by path, both smoothed over neighbours."""
    sums: dict[int, list[float]] = {}
    for p, b in zip(paths, blocks, strict=True):
        own = sums.setdefault(p, [0.0, 0.0, 0.0])
        own[0] += 1
        own[1] += len(b.text)
        own[2] += len(PUNCTUATION.findall(b.text))
    ratios = [(sums[p][1] / sums[p][0], sums[p][2] / sums[p][0]) for p in paths]
    out = []
    for i in range(len(blocks)):
        weight = length = marks = 0.0
        for j in range(max(0, i - 2), min(len(blocks), i + 3)):
            near = 1.0 if paths[i] == paths[j] else 0.5 if parents[i] == parents[j] else 0.1
            w = KERNEL[abs(i - j)] * near
            weight, length, marks = weight + w, length + w * ratios[j][0], marks + w * ratios[j][1]
        out.append((length / weight * (1 + marks / weight)) ** 0.5)
    return out


def link_lists(page: Page, kept: list[Block]) -> set[int]:
    """Lists of three links or more with hardly any other text: menus without a name."""
    found: dict[int, list[int]] = {}
    for b in kept:
        e = b.element
        while e > 0 and page.elements[e].tag not in ("ul", "ol"):
            e = page.elements[e].parent
        if e > 0:
            own = found.setdefault(e, [0, 0, 0])
            own[0] += b.links > 0
            own[1] += b.links
            own[2] += len(b.text)
    return {e for e, (n, links, all_text) in found.items() if n >= 3 and links >= 0.9 * all_text and all_text < 40 * n}


def main_blocks(page: Page) -> list[str]:
    """The texts of the page's content blocks, in page order."""
    elements = page.elements
    dropped, roots = [False] * len(elements), [-1] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        dropped[i] = dropped[e.parent] or e.outside or e.mostly and not e.holds_article
    kept = [b for b in page.blocks if not dropped[b.element]]
    if not kept:
        return []
    paths = [elements[b.element].path for b in kept]
    parents = [elements[max(0, elements[b.element].parent)].path for b in kept]
    fused = path_ratios(paths, parents, kept)
    mean = sum(fused) / len(fused)
    spread = (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    by_path: dict[int, list[float]] = {}
    for p, x in zip(paths, fused, strict=True):
        by_path.setdefault(p, []).append(x)
    content = {p for p, x in by_path.items() if sum(x) / len(x) >= min(THRESHOLD * spread, max(fused))}
    chosen = [p in content for p in paths]

    # the outermost article of each block; main elements count where no article holds text
    for wanted in (("article",), ("",)):
        for i, e in enumerate(elements[1:], 1):
            roots[i] = roots[e.parent] if roots[e.parent] >= 0 else i if e.article and (not wanted[0] or e.tag == "article") else -1
        if any(roots[b.element] >= 0 for b in kept):
            break
    lists = link_lists(page, kept)

    def in_list(e: int) -> bool:
        while e > 0:
            if e in lists:
                return True
            e = elements[e].parent
        return False

    if any(roots[b.element] >= 0 for b in kept):
        articles = {roots[b.element] for b, c in zip(kept, chosen, strict=True) if c and roots[b.element] >= 0}
        own = [b for b in kept if (roots[b.element] in articles if articles else roots[b.element] >= 0)]
    else:
        own = between(page, kept, chosen)
    return [b.text for b in own if not (lists and in_list(b.element))]


def between(page: Page, kept: list[Block], chosen: list[bool]) -> list[Block]:
    """Blocks of the smallest element with ``SHARE`` of the selected text, from the first selected one (and headings before it) to the last."""
    elements, weight = page.elements, [0] * len(page.elements)
    for b, c in zip(kept, chosen, strict=True):
        weight[b.element] += len(b.text) * c
    for i in range(len(elements) - 1, 0, -1):
        weight[elements[i].parent] += weight[i]
    root = max((i for i in range(len(elements)) if weight[i] >= SHARE * weight[0]), default=0)
    while root > 0 and elements[root].tag in HEADINGS | {"p", "li", "td", "th", "tr", "dd", "dt", "blockquote", "pre"}:
        root = elements[root].parent
    inside = [False] * len(elements)
    inside[root] = True
    for i in range(root + 1, len(elements)):
        inside[i] = inside[elements[i].parent]
    own = [(b, c) for b, c in zip(kept, chosen, strict=True) if inside[b.element]]
    places = [i for i, (_, c) in enumerate(own) if c]
    if not places:
        return []
    first = places[0]
    while first > 0 and elements[own[first - 1][0].element].tag in HEADINGS:
        first -= 1
    return [b for b, _ in own[first : places[-1] + 1]]


def main_text(source: str | None) -> str:
    """The main text of one page; empty for none."""
    return " ".join(main_blocks(Reader(source).read())) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html); no shuffle.

    Null and empty pages, and pages without text outside menus and the like, give an empty text; rows
    that repeat are read each by itself, an empty table gives no rows; other columns aren't carried.
    Time grows with a page's length, however it is nested.
    """
    small_batches(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.as_py()) for source in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
