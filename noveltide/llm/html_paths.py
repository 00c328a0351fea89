"""Main text of web pages by tag-path ratios.

Every text node of a page has a root-to-leaf tag path.  Per path, the text length and the punctuation of its nodes
(outside links) are summed and divided by the number of nodes; both ratios are fused into one score, doubled below an
article or main element and cut to a tenth below elements whose names say that they are something else.  The scores
are smoothed along the page with a Gaussian window; the geometric means of own and smoothed scores are averaged per
path again.  A block of text whose nodes' paths score, weighted by length, at least ``strength`` standard deviations of the scores is a content block.

Content blocks make the text.  Weaker blocks (headings, list items, short lines) join them if they stand in an article
element with content, between two content blocks, as headings right before one, or as list items, table cells, captions
and the like in the same element; but none that its names mark, and none of which more than half is link text.

What is no text by construction is never read: scripts, styles, forms, media, navigation, asides, footers, dialogs,
hidden elements.  Names (class, id) mark an element unless it holds the article itself.

Defined results: null or empty html gives an empty text; a page without content gives an empty text; broken markup is
read as browsers do (unclosed elements end with their parent, unclosed comments at the end of the page); repeated rows
give repeated results; other columns are left alone.  Work and memory are linear in the page, at any depth; a worker
holds one Arrow batch of pages and the tree of one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from noveltide.llm.common import small_batches

# Elements that hold no article text by construction, and how elements nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
SKIP = frozenset("head script style noscript template title nav footer aside form button select textarea iframe object embed svg canvas audio video map dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("li dt dd td th caption figcaption blockquote pre".split())
FINE = PARTS | HEADINGS | frozenset("p ul ol dl table tbody thead tr figure".split())
ROOTS = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Opening one of the first closes the outermost open one of the second, up to the nearest of the third.
CLOSES = {
    "li": ("li", {"li"}, {"ul", "ol", "menu"}),
    "dt": ("d", {"dt", "dd"}, {"dl"}),
    "dd": ("d", {"dt", "dd"}, {"dl"}),
    "tr": ("tr", {"tr", "td", "th"}, {"table"}),
    "td": ("td", {"td", "th"}, {"tr", "table"}),
    "th": ("td", {"td", "th"}, {"tr", "table"}),
    "option": ("option", {"option"}, {"select"}),
}
SCOPES = {name: (own, stop) for name, own, stop in CLOSES.values()}
SCOPED = {tag: [name for name, (own, stop) in SCOPES.items() if tag in own or tag in stop] for tag in {t for own, stop in SCOPES.values() for t in own | stop}}
# Words of names (class, id) that mark an element as something else than the article ...
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended recommendations widget widgets comment comments commentlist disqus replies "
    "respond pagination pager toolbar hidden copyright".split()
)
# ... those of readers' comments and teasers, which may be articles and long ...
OTHERS = frozenset("comment comments commentlist disqus replies respond related recommended recommendations".split())
# ... and words that say that a name is about what the element holds or lacks besides.
ABOUT = frozenset("has with without no not enabled disabled layout".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hidden(attributes: str) -> bool:
    """Whether an element's attributes say that it is not shown, or no part of the text."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and HIDDEN.search(value) or name == "role" and value.lower() in ROLES:
            return True
    return False


def names(attributes: str) -> frozenset[str]:
    """The words of an element's names (class and id) that say that it is something else than the article."""
    found: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for one in value.strip("\"'").split():
                own = {x.lower() for x in WORD.findall(one)}
                if not own & ABOUT:
                    found |= own & NAMES
    return frozenset(found)


@dataclass
class Tree:
    """The elements of a page by number (a parent before its children), and its text nodes in order."""

    tags: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    marks: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    owner: list[int] = field(default_factory=lambda: [0])  # the nearest element that is not inline
    inside: list[bool] = field(default_factory=lambda: [False])  # in an article or main element
    linked: list[bool] = field(default_factory=lambda: [False])
    texts: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)


def parse(page: str) -> Tree:
    """The page's elements and text nodes; what is no text by construction is left out."""
    t = Tree()
    skip, scope, open_ = [False], [dict.fromkeys(SCOPES, 0)], {}
    here, block, end = 0, 0, 0

    def text(upto: int) -> None:
        if upto > end and not skip[here]:
            t.texts.append(entities.unescape(page[end:upto]))
            t.at.append(here)
            t.block.append(block)

    def close(upto: int) -> None:
        """Ends all elements from the current one up to this."""
        nonlocal here
        stop = t.parent[upto]
        while here != stop:
            open_[t.tags[here]] -= 1
            here = t.parent[here]

    scan = TOKEN.scanner(page)
    while m := scan.search():
        text(m.start())
        end = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_.get(tag):
                x = here
                while t.tags[x] != tag:
                    x = t.parent[x]
                close(x)
            if tag not in INLINE:
                block += 1
            continue
        if tag not in INLINE:
            if tag != "br":
                block += 1
                if t.tags[t.owner[here]] == "p":  # a block ends an open paragraph
                    close(t.owner[here])
            elif not skip[here]:
                t.texts.append(" ")
                t.at.append(here)
                t.block.append(block)
        if tag in CLOSES and (x := scope[here][CLOSES[tag][0]]):
            close(x)
        attributes = m[3] or m[6] or ""
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        gone = skip[here] or tag in SKIP or tag not in ROOTS and bool(attributes) and hidden(attributes)
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(page, end)
            if not gone:
                t.texts.append(entities.unescape(page[end : shut.start() if shut else len(page)]))
                t.at.append(here)
                t.block.append(block)
            end = shut.end() if shut else len(page)
            scan = TOKEN.scanner(page, end)
            continue
        own = len(t.tags)
        t.tags.append(tag)
        t.parent.append(here)
        t.marks.append(frozenset({"header"}) if tag == "header" else names(attributes) if attributes and tag not in ROOTS else frozenset())
        t.owner.append(t.owner[here] if tag in INLINE else own)
        t.inside.append(t.inside[here] or tag in ("article", "main"))
        t.linked.append(t.linked[here] or tag == "a")
        skip.append(gone)
        if tag in SCOPED:
            s = dict(scope[here])
            for name in SCOPED[tag]:
                s[name] = 0 if tag in SCOPES[name][1] else s[name] or own
            scope.append(s)
        else:
            scope.append(scope[here])
        open_[tag] = open_.get(tag, 0) + 1
        here = own
    text(len(page))
    return t


def apply_marks(t: Tree, sizes: list[int]) -> list[bool]:
    """Whether each element counts as marked by its names or an ancestor's.

    A mark is void on an element that holds the article: a main element, an article element or most of the page's text,
    if no unmarked article elsewhere holds text.  Marks of comments and teasers are void only if all text is there.
    """
    n = len(t.tags)
    mass, main, article = [0] * n, [False] * n, [False] * n
    for k, e in enumerate(t.at):
        mass[e] += sizes[k]
    named = [False] * n
    for e in range(1, n):
        named[e] = named[t.parent[e]] or bool(t.marks[e])
    for e in range(n - 1, 0, -1):
        p = t.parent[e]
        mass[p] += mass[e]
        main[p] |= main[e] or t.tags[e] == "main" and mass[e] > 0
        article[p] |= article[e] or t.tags[e] in ("article", "main") and mass[e] > 0
    apart = any(t.tags[e] in ("article", "main") and mass[e] and not named[e] for e in range(n))
    out = [False] * n
    for e in range(1, n):
        own = bool(t.marks[e])
        if own and mass[e]:
            most = mass[e] > mass[0] / 2 and (article[e] or not apart)
            holds = mass[e] >= mass[0] if t.marks[e] & OTHERS else main[e] or most or article[e] and not apart
            own = not holds
        # An article's own title stays, though it stands in the article's header.
        out[e] = (out[t.parent[e]] or own) and not (t.tags[e] in HEADINGS and not own and t.inside[e] and _in_header(t, e))
    return out


def _in_header(t: Tree, e: int) -> bool:
    """Whether a heading stands in a header that is right below (a header of) its article."""
    p = t.parent[e]
    return "header" in t.marks[p] and (t.tags[p] == "header" or t.tags[t.parent[p]] in ("article", "main", "header"))


def path_scores(t: Tree, sizes: list[int], marked: list[bool], width: int) -> tuple[list[int], list[float]]:
    """The path number of each element, and the smoothed, fused score of each path."""
    paths: dict[tuple[int, str, bool], int] = {}
    path = [0] * len(t.tags)
    for e in range(1, len(t.tags)):
        path[e] = paths.setdefault((path[t.parent[e]], t.tags[e], marked[e]), len(paths) + 1)
    n = len(paths) + 1
    chars, points, nodes, prior = [0] * n, [0] * n, [0] * n, [1.0] * n
    line = []
    for k, e in enumerate(t.at):
        if sizes[k]:
            p = path[e]
            line.append(p)
            nodes[p] += 1
            prior[p] = (2.0 if t.inside[e] else 1.0) * (0.1 if marked[e] else 1.0)
            if not t.linked[e]:
                chars[p] += sizes[k]
                points[p] += len(PUNCTUATION.findall(t.texts[k]))
    fused = [prior[p] * math.sqrt(chars[p] / nodes[p] * (1 + points[p] / nodes[p])) if nodes[p] else 0.0 for p in range(n)]
    weights = [math.exp(-(d * d) / 2) for d in range(-width, width + 1)]
    total = [0.0] * n
    for i, p in enumerate(line):
        near = [(fused[line[i + d]], w) for d, w in zip(range(-width, width + 1), weights, strict=True) if 0 <= i + d < len(line)]
        total[p] += math.sqrt(fused[p] * sum(v * w for v, w in near) / sum(w for _, w in near))
    return path, [total[p] / nodes[p] if nodes[p] else -1.0 for p in range(n)]


@dataclass
class Block:
    """A run of text below one element that is not inline."""

    element: int
    text: str
    score: float
    link: float  # the share of its text that is link text


def blocks(t: Tree, sizes: list[int], path: list[int], scores: list[float]) -> list[Block]:
    out: list[Block] = []
    k = 0
    while k < len(t.at):
        z = k
        while z < len(t.at) and t.block[z] == t.block[k] and t.owner[t.at[z]] == t.owner[t.at[k]]:
            z += 1
        size = sum(sizes[k:z])
        if size:
            score = sum(sizes[i] * scores[path[t.at[i]]] for i in range(k, z)) / size
            link = sum(sizes[i] for i in range(k, z) if t.linked[t.at[i]]) / size
            out.append(Block(t.owner[t.at[k]], " ".join("".join(t.texts[k:z]).split()), score, link))
        k = z
    return out


def main_text(page: str | None, *, strength: float = 0.5, width: int = 1) -> str:
    """The article of one page: its blocks, joined by one space."""
    if not page:
        return ""
    t = parse(page)
    sizes = [len("".join(x.split())) for x in t.texts]
    marked = apply_marks(t, sizes)
    path, scores = path_scores(t, sizes, marked, width)
    seen = [s for s in scores if s >= 0]
    if not seen:
        return ""
    mean = sum(seen) / len(seen)
    limit = strength * math.sqrt(sum((s - mean) ** 2 for s in seen) / len(seen))
    found = blocks(t, sizes, path, scores)
    free = [not marked[b.element] and b.link <= 0.5 for b in found]
    strong = [f and b.score >= limit for f, b in zip(free, found, strict=True)]
    if not any(strong):
        return ""
    # The outermost article of each element, and the article elements that hold content.
    article = [0] * len(t.tags)
    for e in range(1, len(t.tags)):
        article[e] = article[t.parent[e]] or (e if t.tags[e] in ("article", "main") else 0)
    held = {article[b.element] for b, s in zip(found, strong, strict=True) if s} - {0}
    in_articles = sum(len(b.text) for b, s in zip(found, strong, strict=True) if s and article[b.element])
    if 2 * in_articles >= sum(len(b.text) for b, s in zip(found, strong, strict=True) if s):
        keep = [f and article[b.element] in held for f, b in zip(free, found, strict=True)]
    else:
        keep = between(t, found, free, strong)
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def between(t: Tree, found: list[Block], free: list[bool], strong: list[bool]) -> list[bool]:
    """The content blocks and the weaker ones that belong to them, on a page whose article elements do not tell."""
    first, last = strong.index(True), len(strong) - 1 - strong[::-1].index(True)
    keep = [s or f and first < i < last for i, (s, f) in enumerate(zip(strong, free, strict=True))]
    for i in range(first - 1, -1, -1):  # headings right before the content
        if not (free[i] and t.tags[found[i].element] in HEADINGS):
            break
        keep[i] = True
    homes = {t.parent[b.element] for b, s in zip(found, strong, strict=True) if s}
    homes = {e for e in homes if t.tags[e] not in ("", "html", "body")}
    base = [0] * len(t.tags)  # the nearest element that is no part of a list or table
    for e in range(1, len(t.tags)):
        base[e] = base[t.parent[e]] if t.tags[e] in FINE else e
    for i, b in enumerate(found):  # lists, tables and captions beside the content
        if free[i] and t.tags[b.element] in FINE:
            keep[i] |= base[b.element] in homes
    return keep


def extract(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html", strength: float = 0.5) -> DataFrame:
    """``df`` without ``html_col`` and with ``text``, the main text of each page (any ``text`` of its own is replaced)."""
    other = [c for c in df.columns if c not in (html_col, "text")]
    kept = df.select(*[df[c] for c in other], df[html_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x.as_py(), strength=strength) for x in part.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=b.schema.names)

    return small_batches(kept).mapInArrow(run, kept.schema)
