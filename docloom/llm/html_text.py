"""Main text of web pages by tag-path ratios.

Each text node belongs to the root-to-leaf tag path (names with their classes) of its nearest block element, so links and other inline elements
are judged with the text around them. For each path, text per block (less its links) and punctuation per block are aggregated, smoothed over the
neighbouring blocks of the page, fused, and thresholded; the blocks of the paths above the threshold are the first content nodes. The innermost section
that holds nearly all their text is the content's. In it short blocks (captions, items, cells) stay with the long ones: paths are judged by the
logarithms of the same ratios, a list or table by all its text, and only lists of links go. Outside of it a path must reach a higher threshold.
What elements and classes say of themselves (article, nav, class="ad" and so on) are weights of these ratios.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import tidy

# Elements by role in a page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head script style noscript template iframe svg canvas button select textarea option audio video title datalist".split())
BESIDE_ARTICLE = frozenset("nav footer aside menu dialog".split())
SECTIONS = frozenset("html body div section article main td center table tbody tr form fieldset details dialog".split())
LISTS = frozenset("table ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}, "thead": set(), "tfoot": {"tr", "td", "th", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
P_FENCES = frozenset("article body button caption div html main section table td th".split())
# Words of a class, id or role that say a subtree is no article, and such as make it doubtful.
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo
    cookie cookies copyright disqus footer gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices notification pagination
    popup promo promoted promotion reader-comments related replies reply sidebar signup skip sponsor sponsored subscribe subscription toolbar""".split()
)
NOISE_STARTS = ("advert", "adsby", "adslot", "adunit", "adbox", "cookie", "sidebar", "sponsor", "newsletter", "subscri", "breadcrumb", "commentlist", "commentform", "commentbox")
DOUBTFUL = frozenset("dialog form modal pager respond search share sharing social widget widgets".split())
# Words by which a class says what lies beside an element, or is of the article itself where it stands in one.
BESIDE, OF_ARTICLE = frozenset("has with no without".split()), frozenset(["header", "masthead", "banner"])
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，、؟،]")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NEAR = (1.0, 2.0, 1.0)
#: Weights: of what says it is no article, of what is doubtful, and of the text of an article or main when the content's section is looked for.
NO_ARTICLE, DOUBT, ARTICLE = 0.02, 0.3, 10.0
#: A path is content if its fused ratios are at least this share of the page's mean, weighted by text: of the products, to begin with; of the products of paths
#: outside the content's section; and of the sums of logarithms within it.
SHARE, SHARE_OUTSIDE, SHARE_INSIDE = 0.15, 0.5, 0.15
#: The content's section holds this share of the weighted text of the first content nodes.
MASS = 0.9
#: A path is a list of links if they hold this share of its text, separators left out.
LINKS = 0.9


@dataclass
class Page:
    """Text nodes (path, element, text, whether in a link, block) in page order, and what is known of each path and element. Paths and elements are numbers, so a
    deep page takes no more memory than a flat one."""

    nodes: list[tuple[int, int, str, bool, int]]
    doubt: list[float]  # of a path: 1, less for what says it is no article
    boost: list[float]
    group: list[int]  # of a path: the innermost list or table, -1 for none
    heading: list[bool]
    parent: list[int]  # of an element
    section: list[bool]


def _weight(name: str, attributes: str, inside_article: bool) -> tuple[float, str]:
    """(weight of the element, its label in paths); a weight of 0 is that of hidden elements."""
    weight = NO_ARTICLE if name in BESIDE_ARTICLE or name == "header" and not inside_article else DOUBT if name == "form" else 1.0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return weight, name
    classes = ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" and not m[2] or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            weight = 0.0
        elif key in ("class", "id", "role"):
            words = [w.lower() for w in NAME_WORDS.findall(value)]
            if name not in ("html", "body", "article", "main") and BESIDE.isdisjoint(words):
                if any((w in NOISE or w.startswith(NOISE_STARTS)) and not (inside_article and w in OF_ARTICLE) for w in words):
                    weight = min(weight, NO_ARTICLE)
                elif not DOUBTFUL.isdisjoint(words):
                    weight = min(weight, DOUBT)
            classes += "." + value.lower()
    return weight, name + classes


def read_page(page: str) -> Page:
    """The text nodes that are shown, in page order."""
    out = Page([], [1.0], [1.0], [-1], [False], [-1], [True])
    paths: dict[tuple[int, str], int] = {}
    open_: dict[str, int] = {}
    stack: list[tuple[str, int, int, int]] = []  # name, path, path of the nearest block, element
    skipped = 0
    block, at, end = 0, 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal skipped
        for name, path, _, _ in stack[depth:]:
            open_[name] -= 1
            skipped -= name in SKIPPED or out.doubt[path] == 0
        del stack[depth:]

    def take(text: str) -> None:
        if skipped:
            return
        path, element = (stack[-1][2], stack[-1][3]) if stack else (0, 0)
        if text and not text.isspace():
            out.nodes.append((path, element, html.unescape(text) if "&" in text else text, open_.get("a", 0) > 0, block))
        elif text and out.nodes and out.nodes[-1][4] == block:
            out.nodes.append((*out.nodes[-1][:2], " ", False, block))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name not in INLINE:
            block += 1
        if closing:
            if open_.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                pop_to(depth)
            continue
        ends = CLOSES.get(name, ())
        if name in CLOSES_P and open_.get("p") or any(open_.get(x) for x in ends):
            fences = FENCES.get(name, ())
            depth, cut = len(stack) - 1, None
            while depth >= 0:
                own = stack[depth][0]
                if own in ends or own == "p" and name in CLOSES_P:
                    cut = depth
                if own in fences or name in CLOSES_P and own in P_FENCES:
                    break
                depth -= 1
            if cut is not None:
                pop_to(cut)
        if name in VOID or attributes.endswith("/") and name not in RAW:
            continue
        article = open_.get("article", 0) + open_.get("main", 0) > 0
        weight, label = _weight(name, attributes, article)
        _, above, block_path, element = stack[-1] if stack else ("", 0, 0, 0)
        path = paths.setdefault((above, label), len(out.doubt))
        if path == len(out.doubt):
            out.doubt.append(out.doubt[above] * weight)
            out.boost.append(ARTICLE if name in ("article", "main") or ".main" in label else out.boost[above])
            out.group.append(path if name in LISTS else out.group[above])
            out.heading.append(name in HEADINGS or out.heading[above] and name in INLINE)
        out.parent.append(element)
        out.section.append(name in SECTIONS)
        stack.append((name, path, block_path if name in INLINE and weight == 1 else path, len(out.parent) - 1))
        open_[name] = open_.get(name, 0) + 1
        skipped += name in SKIPPED or out.doubt[path] == 0
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
    return out


def _smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        near = [(w, values[i + k - 1]) for k, w in enumerate(NEAR) if 0 <= i + k - 1 < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


@dataclass
class Ratios:
    """Blocks (path, element, characters) and, of each path, its scores and whether it is a list of links."""

    blocks: list[tuple[int, int, int]]
    product: dict[int, float]
    damped: dict[int, float]
    linked: dict[int, bool]


def ratios(p: Page) -> Ratios:
    """Text and punctuation a block of each path, smoothed over the page's blocks, and fused: multiplied, and as a sum of logarithms."""
    stats: dict[int, list[int]] = {}  # of a path: characters, marks, blocks, characters in links and of all words
    held: dict[int, list[int]] = {}  # of a list or table: characters, times that text of it begins
    blocks: list[list[int]] = []
    last, group = None, -1
    for path, element, text, link, block in p.nodes:
        n = len(text.strip())
        if not n:
            continue
        s = stats.setdefault(path, [0, 0, 0, 0, 0])
        s[0] += n
        s[1] += len(PUNCTUATION.findall(text))
        if any(map(str.isalnum, text)):
            s[3] += n * link
            s[4] += n
        if last != (path, block):
            blocks.append([path, element, 0])
            s[2] += 1
            last = (path, block)
        blocks[-1][2] += n
        if (g := p.group[path]) >= 0:
            h = held.setdefault(g, [0, 0])
            h[0] += n
            h[1] += g != group
        group = g
    linked = {q: 0 < a and a >= LINKS * t for q, (_, _, _, a, t) in stats.items()}
    size = {q: held[g][0] / held[g][1] if (g := p.group[q]) >= 0 else s[0] / s[2] for q, s in stats.items()}
    length = {q: size[q] * (1 - s[3] / max(s[4], 1)) for q, s in stats.items()}
    marks = {q: s[1] / s[2] for q, s in stats.items()}
    sums: dict[int, list[float]] = {}
    for (path, _, _), x, y in zip(blocks, _smooth([length[b[0]] for b in blocks]), _smooth([marks[b[0]] for b in blocks])):
        if p.doubt[path] < 1:  # what says it is no article gains nothing by its neighbours
            x, y = length[path], marks[path]
        own = sums.setdefault(path, [0.0, 0.0, 0.0])
        own[0] += x * (1 + y)
        own[1] += log1p(x) + log1p(y)
        own[2] += 1
    keep = {q: not linked[q] for q in stats}
    return Ratios([tuple(b) for b in blocks], {q: v[0] / v[2] * keep[q] for q, v in sums.items()}, {q: v[1] / v[2] * keep[q] for q, v in sums.items()}, linked)


def _mean(score: dict[int, float], blocks: list[tuple[int, int, int]], doubt: list[float]) -> float:
    return sum(score[q] * n * doubt[q] for q, _, n in blocks) / (sum(n * doubt[q] for q, _, n in blocks) or 1)


def section_of(p: Page, r: Ratios) -> list[bool]:
    """Whether an element lies in the content's section."""
    mean = _mean(r.product, r.blocks, p.doubt)
    mass = [0.0] * len(p.parent)
    for path, element, n in r.blocks:
        if r.product[path] >= SHARE * mean and not r.linked[path]:
            mass[element] += n * p.doubt[path] * p.boost[path]
    heaviest = [-1] * len(p.parent)
    for e in range(len(p.parent) - 1, 0, -1):
        up = p.parent[e]
        mass[up] += mass[e]
        if heaviest[up] < 0 or mass[e] >= mass[heaviest[up]]:
            heaviest[up] = e
    at = 0
    while (e := heaviest[at]) >= 0 and mass[e] > 0 and mass[e] >= MASS * mass[0] and p.section[e]:
        at = e
    inside = [False] * len(p.parent)
    inside[at] = True
    for e in range(1, len(p.parent)):
        inside[e] = inside[e] or inside[p.parent[e]]
    return inside


def content(p: Page) -> list[bool]:
    """Whether each text node is content."""
    r = ratios(p)
    if not r.blocks:
        return [False] * len(p.nodes)
    inside = section_of(p, r)
    low, high = SHARE_INSIDE * _mean(r.damped, r.blocks, p.doubt), SHARE_OUTSIDE * _mean(r.product, r.blocks, p.doubt)

    def good(path: int, element: int) -> bool:
        if r.linked[path]:
            return False
        return r.damped[path] * p.doubt[path] >= low if inside[element] else r.product[path] * p.doubt[path] >= high

    own = [path in r.linked and good(path, element) for path, element, _, _, _ in p.nodes]
    behind = False
    for i in range(len(own) - 1, -1, -1):  # a heading goes with the text behind it
        path, _, text, _, _ = p.nodes[i]
        if text == " ":
            continue
        if p.heading[path] and behind and p.doubt[path] == 1:
            own[i] = True
        behind = own[i]
    return own


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, white space in them single, joined by one space."""
    if not page:
        return ""
    p = read_page(page)
    keep = content(p)
    parts, last = [], None
    for i, (_, _, text, _, block) in enumerate(p.nodes):
        if keep[i] or text == " ":
            parts.append(text if last in (None, (block, i - 1)) else " " + text)
            last = (block, i)
    return " ".join("".join(parts).split())


def extract(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """The rows of df with `text`, the main text of the whole page; a column of that name is replaced.

    Null or empty page, or one without text: the empty string. Broken markup is read as far as it goes (missing end tags, cut tags and references).
    Rows map one to one, repeated rows alike; nothing is shuffled.
    """
    keep = [c for c in df.columns if c.lower() != text.lower()]
    base = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*base.schema.fields, T.StructField(text, T.StringType(), False)])
    at = keep.index(next(c for c in keep if c.lower() == page.lower()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(x.as_py()) for x in batch.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return base.mapInArrow(tidy(run), schema)
