"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks: the texts between the starts and ends of
block elements, each with its path from the root (tag names with their classes).
What a page says of itself to be no article goes first: navigation, forms,
scripts and the like, and elements whose class, id or role names such a part.
For the others, text length and punctuation are added up per path and divided by
the number of blocks that share it: articles have few paths with much text and
punctuation a block, link lists and notes many blocks with little of either.
The two ratios, discounted by the share of link text, are smoothed over
neighbouring blocks (a Gaussian window), fused by their product, and paths at or
over a threshold (the standard deviation of the fused values over paths, at most
half of the largest) are content.  The article is the smallest section that
holds the content; within it nothing but marked parts and bare link lists is
left out, so headings and short paragraphs stay.

Character references are decoded, white space inside a block is one space, and
blocks are joined in page order by one newline.

Defined results: a null, empty or blank page, and one without any text that
counts, has the empty text.  A page without tags is one block.  Unclosed
elements, comments and tags end with the page.  Rows keep their number, also
repeated ones, and all their columns; columns named ``text`` and ``n_chars`` give
way to the new ones.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append

# ---- FIXED VALUES: element names of HTML and names of parts of pages --------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
#: Elements that are no article.
PARTS = frozenset("nav footer aside form button select option dialog menu head script style noscript template iframe object svg canvas map "
                  "fieldset datalist audio video".split())
SECTIONS = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element of the first kind ends when it starts, up to the second kind.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Words of a class, id or role that mark a part which is no article.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
                  "consent copyright disclaimer disqus footer gdpr menu menubar modal nav navbar navigation newsletter notice notices pager pagination "
                  "paywall popup promo promoted promotion recommended related replies respond rail share sharing sidebar sidenav signup skip skyscraper "
                  "social sponsor sponsored subscribe subscription tags toolbar complementary contentinfo search alert alertdialog login".split())
#: Those that an article may bear itself (a reader's comment, an advertisement).
ARTICLE_MARKS = frozenset("ad ads advert advertisement comment comments promo promoted related replies sponsored".split())
HEADERS = frozenset("header masthead".split())
#: Joined spellings that mark one, too.
MARKED = re.compile(r"side-?bar|comment-?(?:list|section|area|form)|nav-?bar|site-?(?:header|footer|nav)|page-?(?:header|footer)|(?:reader|user)-?comments?|"
                    r"cookie-?(?:bar|notice|banner)|ad-?(?:box|slot|unit|banner|container|wrapper)|share-?(?:bar|buttons?)")
#: Spellings that say of a part that it is, or isn't, beside the element.
BESIDE = re.compile(r"\b(?:no|not|has|with|without)[-_]+\w+")
#: What a document's head may hold.
HEAD = frozenset("base link meta noscript script style template title".split())
# ---- end of fixed values ----------------------------------------------------

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+|\d+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،؛।]")
SPACE = re.compile(r"\s+")
#: Blocks to each side that take part in smoothing, and the window's spread.
REACH, SPREAD = 2, 1.0
MOST_LINKS = 0.7
#: Share of the content's text that its section holds at least.
MOST_TEXT = 0.8
#: Elements beyond this depth are leaves of their ancestor's path.
DEPTH = 512

FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@dataclass(slots=True)
class Element:
    """An open or closed element: its name, path step, and whether it is marked as no article."""

    tag: str
    step: str
    parent: "Element | None"
    out: bool
    header: bool
    depth: int


@dataclass(slots=True)
class Leaf:
    element: Element
    text: str
    links: int
    path: tuple[str, ...] = field(default=())


def marked(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element says of itself that it is no article, whether it is a
    header, and its class."""
    out, header, name = tag in PARTS, tag == "header", ""
    for key, *values in NAMED.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
            out = True
        elif key in ("class", "id", "role"):
            low = HUMP.sub("-", value).lower()
            if key == "class":
                name = ".".join(sorted(low.split()))
            if tag not in ("html", "body", "main"):
                low = BESIDE.sub(" ", low)
                words = set(WORDS.findall(low))
                out = out or not words.isdisjoint(ARTICLE_MARKS if tag == "article" else MARKS) or tag != "article" and MARKED.search(low) is not None
                header = header or tag not in HEADINGS and not words.isdisjoint(HEADERS)
    return out, header, name


class Page:
    """The blocks of a page, read in one pass."""

    def __init__(self, source: str) -> None:
        self.root = self.at = Element("", "", None, False, False, 0)
        self.leaves: list[Leaf] = []
        self.parts: list[str] = []
        self.links = 0
        self.anchors = 0
        place = 0
        while (token := TOKEN.search(source, place)) is not None:
            self.say(source[place:token.start()])
            place = token.end()
            closing, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self.close(tag)
                continue
            self.open(tag, attributes or "")
            if tag in RAW and not (attributes or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, place)
                place = end.end() if end else len(source)
                self.close(tag)
        self.say(source[place:])
        self.end_block()

    def say(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.anchors:
                self.links += len(raw.strip())

    def end_block(self) -> None:
        if self.parts:
            # references are decoded in the whole block; markup that they spell is text
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.leaves.append(Leaf(self.at, text, min(self.links, len(text))))
        self.parts, self.links = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if self.at.tag == "head" and tag not in HEAD:
            self.end_block()
            self.at = self.at.parent
        if tag in INLINE:
            if tag == "br" or tag == "wbr":
                self.parts.append(" " if tag == "br" else "")
            elif tag == "a":
                self.anchors = 1  # links don't nest
            return
        self.end_block()
        self.anchors = 0
        if tag in VOID:
            return
        ends = CLOSES.get(tag)
        if ends:
            self.end_open(*ends)
        elif tag != "html":
            self.end_open(frozenset(["p"]), SECTIONS)  # a paragraph holds no block
        out, header, name = marked(tag, attributes)
        if self.at.depth < DEPTH:
            self.at = Element(tag, f"{tag}.{name}" if name else tag, self.at, self.at.out or out, header, self.at.depth + 1)

    def end_open(self, tags: frozenset[str], within: frozenset[str]) -> None:
        at, last = self.at, None
        while at.parent is not None and at.tag not in within:
            if at.tag in tags:
                last = at
            at = at.parent
        if last is not None:
            self.at = last.parent

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.anchors = 0
            return
        self.end_block()
        self.anchors = 0
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.at = at.parent


def chain(element: Element) -> list[Element]:
    """The element and its ancestors, the root last."""
    out = []
    while element is not None:
        out.append(element)
        element = element.parent
    return out


def outside(leaf: Leaf) -> bool:
    """Marked parts, and page headers; an article's own header keeps its headings."""
    if leaf.element.out:
        return True
    up = chain(leaf.element)
    header = next((i for i, e in enumerate(up) if e.header), None)
    if header is None:
        return False
    article = any(e.tag in ("article", "main") for e in up[header:])
    return not (article and any(e.tag in HEADINGS for e in up[:header]))


def path_ratios(leaves: list[Leaf]) -> dict[tuple[str, ...], float]:
    """Fused value of every path: smoothed text ratio times smoothed punctuation ratio."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for leaf in leaves:
        own = sums.setdefault(leaf.path, [0.0, 0.0, 0.0])
        own[0] += len(leaf.text) - leaf.links
        own[1] += len(PUNCTUATION.findall(leaf.text)) * (1 - leaf.links / len(leaf.text))
        own[2] += 1
    ratio = {p: (chars / n, marks / n) for p, (chars, marks, n) in sums.items()}
    window = [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in range(-REACH, REACH + 1)]
    smooth: dict[tuple[str, ...], list[float]] = {}
    for i, leaf in enumerate(leaves):
        near = [(w, ratio[leaves[j].path]) for w, j in zip(window, range(i - REACH, i + REACH + 1), strict=True) if 0 <= j < len(leaves)]
        total = sum(w for w, _ in near)
        own = smooth.setdefault(leaf.path, [0.0, 0.0, 0.0])
        own[0] += sum(w * r[0] for w, r in near) / total
        own[1] += sum(w * r[1] for w, r in near) / total
        own[2] += 1
    # a path without punctuation counts by its length alone, at a tenth of a mark
    return {p: (chars / n) * (marks / n + 0.1) for p, (chars, marks, n) in smooth.items()}


def content_paths(values: dict[tuple[str, ...], float]) -> set[tuple[str, ...]]:
    mean = sum(values.values()) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values.values()) / len(values))
    bar = min(spread, max(values.values()) / 2)
    return {p for p, v in values.items() if v >= bar}


def article(leaves: list[Leaf], chosen: set[tuple[str, ...]]) -> Element:
    """The element that holds the content: the outermost ``article`` or else
    ``main`` with half of its text or more, or else the smallest section with
    nearly all of it and with every block of the path that has most text."""
    weight: dict[int, int] = {}
    elements: dict[int, Element] = {}
    texts: dict[tuple[str, ...], int] = {}
    for leaf in leaves:
        if leaf.path in chosen:
            texts[leaf.path] = texts.get(leaf.path, 0) + len(leaf.text)
            for e in chain(leaf.element):
                weight[id(e)] = weight.get(id(e), 0) + len(leaf.text)
                elements[id(e)] = e
    total = sum(texts.values())
    for tag in ("article", "main"):
        own = [e for i, e in elements.items() if e.tag == tag and 2 * weight[i] >= total and not any(x.tag == tag for x in chain(e)[1:])]
        if own:
            return max(own, key=lambda e: weight[id(e)])
    most = max(texts, key=texts.get)
    shared = set(elements)
    for leaf in leaves:
        if leaf.path == most:
            shared &= {id(e) for e in chain(leaf.element)}
    whole = [elements[i] for i in shared if weight[i] >= MOST_TEXT * total and (elements[i].tag in SECTIONS or elements[i].parent is None)]
    return max(whole, key=lambda e: e.depth)


def main_text(source: str) -> str:
    """The article of one page, its blocks joined by newlines."""
    leaves = [x for x in Page(source).leaves if not outside(x)]
    if not leaves:
        return ""
    for leaf in leaves:
        leaf.path = tuple(e.step for e in reversed(chain(leaf.element)))
    top = article(leaves, content_paths(path_ratios(leaves)))
    inside = [any(e is top for e in chain(x.element)) for x in leaves]
    first = inside.index(True)
    if first and leaves[first - 1].element.tag == "h1" and not any(x.element.tag == "h1" for x, held in zip(leaves, inside, strict=True) if held):
        inside[first - 1] = True  # the headline stands right before its article
    held = [x for x, own in zip(leaves, inside, strict=True) if own]
    bare = link_lists(held)
    return "\n".join(x.text for x in held if not any(id(e) in bare for e in chain(x.element)))


def link_lists(leaves: list[Leaf]) -> set[int]:
    """Lists of which nearly all text is links (menus without a mark)."""
    sums: dict[int, list[int]] = {}
    for leaf in leaves:
        for e in chain(leaf.element):
            if e.tag in ("ul", "ol", "dl", "table"):
                own = sums.setdefault(id(e), [0, 0, 0])
                own[0] += leaf.links
                own[1] += len(leaf.text)
                own[2] += 1
    return {i for i, (links, chars, n) in sums.items() if n > 1 and links > MOST_LINKS * chars}


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the article) and ``n_chars`` in place of the html; page by page, without a shuffle."""

    def each():
        def run(batch: list[bytes]) -> list:
            texts = [main_text(x.decode("utf-8", "replace")) for x in batch]
            return [texts, [len(t) for t in texts]]
        return run

    return append(pages, source, FIELDS, each).drop(source)
