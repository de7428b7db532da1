"""Main text of web pages by tag-path ratios.

A page is cut into text nodes with their root-to-leaf tag paths (structural tags and classes; inline
markup isn't part of a path). Text length and punctuation are summed for each path and divided by its
nodes; the two ratios are smoothed over neighbouring nodes in page order with a Gaussian window and fused
as their product. Paths that reach a share of the series' deviation, with a node of theirs and without smoothing too, are content.

Nodes are selected by their paths:

* a content path's nodes are selected;
* headings, list items, cells and short paragraphs have low ratios. Nodes of other paths are selected inside outermost
  article and main elements that hold content; on pages without those, below an element that holds content paths' nodes
  itself, and headings anywhere in the deepest element around all content;
* except link labels: elements without content, mostly of links, several of them, and under the threshold or without punctuation and of a few words each.

What is never article text takes no part: menus, headers and footers (but an article's own header is its title), sidebars,
notices, adverts, forms, scripts and styles, reader comments, and what a browser shows in place of scripts, frames and pictures,
by their tags, roles and whole class or id names.

Blocks are separated by block-level tags. Character references are decoded, white space in a block
becomes one space, and blocks are joined by a line feed.

The parser forgives: unclosed, misnested and cut-off tags and comments; end tags without a start are ignored. Paths and
elements are numbers with parents, so memory grows with a page's size however deep it is.

Defined results: null or empty html, or a page without content, gives an empty text and 0 characters;
repeated rows are extracted each for itself; null ids and urls are carried through; bytes that aren't UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.shared import map_arrow, slices, valid_text

# fixed values: HTML element names by role
RAW = "script style noscript template iframe textarea title svg select noembed noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img math mi mn mo ms mrow msup msub mfrac msqrt mtext".split())
APART = frozenset("nav header footer aside form button dialog menu head fieldset".split())
#: Of these, those that may be around a whole page.
WRAPPERS = frozenset(["form", "fieldset"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Words of a class, id or role that mark what isn't article text; a name counts if all its words are of these or of BESIDE.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments respond reply replies discussion disqus "
    "cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead share sharing social related recommended recommendations pagination pager widget toolbar login search complementary contentinfo".split()
)
BESIDE = frozenset("site page main global top bottom left right primary secondary inner list box bar block area section container wrapper slot item items links".split())
MAIN = frozenset(["article", "main"])

TOKEN = re.compile(
    rf"""<!--(?:.*?(?:-->|\Z)) | <(?P<raw>{"|".join(RAW.split())})(?=[\s/>])[^>]*> .*? (?:</(?P=raw)\s*> | \Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*) (?P<attributes>(?:[^<>"'] | "[^"]*" | '[^']*')*) >
    | </?[a-zA-Z!?][^>]*(?:>|\Z) | (?P<text>[^<]+ | <)""",
    re.S | re.X | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["']""")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、·«»¿¡]")
WORD = re.compile(r"[a-z]+")
#: Standard deviation of the smoothing window in nodes, and the share of the series' deviation that content reaches.
SMOOTH = 1.0
SHARE = 0.5
#: Linked texts without punctuation and of fewer words than this on average are labels of a menu; so many make one.
LABEL_WORDS, LABELS = 4, 2


@dataclass
class Page:
    # tag paths: parent, tag and class; number of each (parent, tag and class)
    path_parent: list[int] = field(default_factory=list)
    path_name: list[str] = field(default_factory=list)
    path_number: dict[tuple[int, str], int] = field(default_factory=dict)
    # elements: tag, parent, path, whether never article text, whether boilerplate unless it holds the page's content, whether a main part
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    apart: list[bool] = field(default_factory=list)
    doubtful: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    # text nodes: element, block number, text, inside a link
    nodes: list[tuple[int, int, str, bool]] = field(default_factory=list)

    def add(self, tag: str, named: str, parent: int, apart: bool, doubtful: bool, main: bool) -> int:
        key = (self.path[parent] if self.path else -1, f"{tag}.{named}" if named else tag)
        if key not in self.path_number:
            self.path_number[key] = len(self.path_parent)
            self.path_parent.append(key[0])
            self.path_name.append(key[1])
        for values, x in ((self.tag, tag), (self.parent, parent), (self.path, self.path_number[key]), (self.apart, apart), (self.doubtful, doubtful), (self.main, main)):
            values.append(x)
        return len(self.tag) - 1

    def full_path(self, path: int) -> str:
        names = []
        while path > 0:
            names.append(self.path_name[path])
            path = self.path_parent[path]
        return "/".join(reversed(names))


def is_boilerplate(name: str) -> bool:
    words = WORD.findall(name)
    return not BOILERPLATE.isdisjoint(words) and all(w in BOILERPLATE or w in BESIDE for w in words)


def described(attributes: str) -> tuple[str, bool, bool, bool]:
    """(class of the element, whether it is hidden, whether it is boilerplate by name, whether it is named as the main part)."""
    named, hidden, apart, main = "", False, False, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
        elif name in ("class", "id", "role"):
            apart |= any(map(is_boilerplate, value.split()))
            main |= name == "role" and value == "main"
            named = " ".join(value.split()) if name == "class" else named
        elif name == "itemprop":
            main |= value == "articlebody"
    return named, hidden, apart, main


def parse(source: str) -> Page:
    page = Page()
    nodes, stack, block, links = page.nodes, [page.add("", "", -1, False, False, False)], 0, 0
    open_tags: Counter[str] = Counter()
    within_main = 0  # open main parts

    def close() -> None:
        nonlocal within_main
        e = stack.pop()
        open_tags[page.tag[e]] -= 1
        within_main -= page.main[e]

    for m in TOKEN.finditer(source):
        if (text := m["text"]) is not None:
            nodes.append((stack[-1], block, text, links > 0))
            continue
        if m["raw"] or not m["tag"]:
            block += bool(m["raw"]) and m["raw"].lower() != "svg"
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            elif tag == "br":
                nodes.append((stack[-1], block, " ", False))
            continue
        block, links = block + 1, 0
        if m["end"]:
            if open_tags[tag] > 0:
                while page.tag[stack[-1]] != tag:
                    close()
                close()
            continue
        if tag in VOID:
            continue
        closing = CLOSES.get(tag, "p").split() if tag in CLOSES or tag == "p" else ["p"]
        while len(stack) > 1 and (page.tag[stack[-1]] in closing or page.tag[stack[-1]] == "p"):
            close()
        attributes = m["attributes"]
        named, hidden, apart, main = described(attributes) if attributes.strip() else ("", False, False, False)
        main |= tag in MAIN
        # the page's own elements are never boilerplate by name or hidden, nor are its main parts by name
        doubtful = (apart and not main and tag not in ("html", "body")) or tag in WRAPPERS
        own_header = tag == "header" and within_main
        apart = (hidden and tag not in ("html", "body")) or (tag in APART and tag not in WRAPPERS and not own_header) or page.apart[stack[-1]]
        stack.append(page.add(tag, named, stack[-1], apart, doubtful, main))
        open_tags[tag] += 1
        within_main += main
    return page


def smoothed(values: list[float]) -> list[float]:
    reach = max(1, round(2 * SMOOTH))
    window = [math.exp(-(k * k) / (2 * SMOOTH * SMOOTH)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(window[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_paths(page: Page) -> tuple[set[int], float]:
    """Paths whose fused ratio passes the threshold, and the threshold."""
    shown = [(page.path[e], text, linked) for e, _, text, linked in page.nodes if not page.apart[e] and not text.isspace()]
    if not shown:
        return set(), 0.0
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, text, linked in shown:
        count[path] = count.get(path, 0) + 1
        if not linked:
            length[path] = length.get(path, 0) + len(text.strip())
            marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
    text_ratio = smoothed([length.get(p, 0) / count[p] for p, _, _ in shown])
    mark_ratio = smoothed([1 + marks.get(p, 0) / count[p] for p, _, _ in shown])
    fused = [math.sqrt(t * k) for t, k in zip(text_ratio, mark_ratio, strict=True)]
    mean = sum(fused) / len(fused)
    best: dict[int, float] = {}
    for (path, _, _), f in zip(shown, fused, strict=True):
        best[path] = max(best.get(path, 0.0), f)
    for p in best:
        best[p] = min(best[p], math.sqrt(length.get(p, 0) / count[p] * (1 + marks.get(p, 0) / count[p])))
    threshold = min(SHARE * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(best.values()))
    return {p for p, f in best.items() if f >= threshold and length.get(p, 0)}, threshold


def content_held(page: Page, paths: set[int]) -> list[int]:
    """Characters of content that each element holds, with those below it."""
    held = [0] * len(page.tag)
    for e, _, text, linked in page.nodes:
        if not page.apart[e] and page.path[e] in paths and not linked:
            held[e] += len(text.strip())
    for e in range(len(held) - 1, 0, -1):  # parents come before their children
        held[page.parent[e]] += held[e]
    return held


def part_boilerplate(page: Page) -> None:
    """Sets doubtful elements apart, except those that hold most of the content; of article and main elements' content at most
    a headline may be outside those that are doubtful by name, so that comments longer than their article go."""
    if not any(x and not y for x, y in zip(page.doubtful, page.apart, strict=True)):
        return
    held, size = content_held(page, content_paths(page)[0]), len(page.tag)
    # content of outermost article and main elements below each element
    main, within = [0] * size, [False] * size
    for e in range(1, size):
        up = page.parent[e]
        within[e] = page.main[e] or within[up]
        main[e] = held[e] if page.main[e] and not within[up] else 0
    for e in range(size - 1, 0, -1):
        main[page.parent[e]] += main[e]
    for e in range(1, size):
        outside = main[0] - (held[e] if within[e] else main[e])
        kept = 2 * held[e] > held[0] and (page.tag[e] in WRAPPERS or 10 * outside <= held[0])
        page.apart[e] |= (page.doubtful[e] and not kept) or page.apart[page.parent[e]]


def link_labels(page: Page, held: list[int], threshold: float) -> list[bool]:
    """Whether each element is of link labels, or is part of one."""
    size = len(page.tag)
    sums = [[0, 0, 0, 0, 0] for _ in range(size)]  # characters, linked characters, marks, words, blocks
    last = [-1] * size
    for e, block, text, linked in page.nodes:
        if not page.apart[e] and (n := len(text.strip())):
            for k, x in enumerate((n, n * linked, len(PUNCTUATION.findall(text)), len(text.split()), block != last[e])):
                sums[e][k] += x
            last[e] = block
    for e in range(size - 1, 0, -1):
        for k in range(5):
            sums[page.parent[e]][k] += sums[e][k]
    found = [False] * size
    for e in range(1, size):
        n, linked, marks, words, blocks = sums[e]
        found[e] = found[page.parent[e]]
        if not held[e] and 2 * linked > n and blocks >= LABELS:
            labels = linked == n and not marks and words < LABEL_WORDS * blocks
            found[e] |= labels or math.sqrt(n / blocks * (1 + marks / blocks)) < threshold
    return found


def selected(page: Page) -> list[bool]:
    """Whether each element's own text nodes are main text."""
    paths, threshold = content_paths(page)
    held, size = content_held(page, paths), len(page.tag)
    if not held[0]:
        return [False] * size
    labels = link_labels(page, held, threshold)
    around = [page.main[e] and not page.apart[e] and held[e] > 0 for e in range(size)]
    marked = any(around)
    # without article and main elements: the deepest element around all content, and those that hold content themselves
    root = max(e for e in range(size) if held[e] == held[0])
    below = [0] * size
    for e in range(1, size):
        if not marked and page.path[e] in paths and held[e]:
            around[e] = around[page.parent[e]] = True
    for e in range(1, size):
        around[e] |= around[page.parent[e]] and not labels[e]
        below[e] = e == root or below[page.parent[e]]
    heading = lambda e: not marked and (below[e] or root == 0) and page.tag[e] in HEADINGS
    return [not page.apart[e] and (page.path[e] in paths or (not labels[e] and (around[e] or heading(e)))) for e in range(size)]


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = parse(source)
    part_boilerplate(page)
    chosen = selected(page)
    out: list[list[str]] = []
    last = -1
    for e, block, text, _ in page.nodes:
        if not chosen[e]:
            continue
        if block != last:
            out.append([text])
            last = block
        else:
            out[-1].append(text)
    return "\n".join(t for t in (" ".join(html.unescape("".join(x)).split()) for x in out) if t)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 4_000_000):
                found = [extract(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), valid_text(html_col).alias("html"))
    return map_arrow(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
