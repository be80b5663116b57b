"""Main text of web pages by tag-path ratios.

1. A page becomes text nodes, each with its root-to-leaf path of tags. Scripts, styles, forms, navigation and elements whose
   class, id or role names say advert, notice, comment and the like are left out, with all that is in them.
2. For each path: text length and punctuation marks per node. In page order, both series are smoothed with a Gaussian window
   and fused by multiplication.
3. Nodes above a threshold (a part of the fused series' standard deviation) are content. The deepest element around all of
   them is the container, widened to an enclosing article or main element. Without one, the text runs from the first content
   node to the last, and takes in the rest of the deepest element with 85% of the content. Nodes between belong to the text too,
   so that short paragraphs and headings aren't lost. Blocks made of links are left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lanthorn.llm.scratch import ready

# HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style head title noscript template textarea iframe noembed noframes xmp svg math canvas object applet audio video map nav footer aside form fieldset button select option datalist input dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}
# Words in class, id or role names of what isn't the article.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar footer bottom colophon copyright comment comments commentlist respond replies reply discussion disqus share sharing social follow related recommended recommendations newsletter subscribe subscription signup login search widget toolbar skip tags tagcloud contentinfo complementary".split())
# Those of them that also stand in names of content (bottom-line, side-effects). They count as a whole name or, outside
# an article, as the last word of one (site-header, right-rail).
AMBIGUOUS = frozenset("alert banner bottom discussion follow header menu notice notification overlay promotion rail reply search side skip social tags widget".split())
PUNCTUATION = ",.;:!?¡¿…、。，！？"

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--|<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Za-z]+")
_SCOPED = frozenset().union(*SIBLINGS.values(), *SCOPES.values())


class _Element:
    # begin and end: the numbers of the element and of the last one in it, in page order; within: the nearest article or main
    # element; open_p: the paragraph that a block would close; outermost: for each key of SIBLINGS, what its start tag closes
    __slots__ = ("tag", "parent", "path", "depth", "skipped", "main", "link", "listed", "begin", "end", "within", "open_p", "outermost")

    def __init__(self, tag: str, parent: _Element | None, attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.path = self.begin = self.end = 0
        self.listed = tag in ("li", "ul", "ol", "dl", "table") or bool(parent and parent.listed)
        self.open_p = self if tag == "p" else parent.open_p if parent and tag in INLINE else None
        self.outermost = parent.outermost if parent else {}
        if tag in _SCOPED:
            self.outermost = {k: e for k, e in self.outermost.items() if tag not in SCOPES[k]}
            for k in SIBLINGS:
                if tag in SIBLINGS[k] and tag not in SCOPES[k]:
                    self.outermost.setdefault(k, self)
        self.skipped = parent.skipped if parent else False
        self.link = tag == "a" or bool(parent and parent.link)
        self.main = tag in ("article", "main")
        whole: list[str] = []
        if attributes and "=" in attributes or "hidden" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value, kind = (m[2] or m[3] or m[4] or "").lower(), m[1].lower()
                if kind == "hidden" or kind == "aria-hidden" and value == "true":
                    self.skipped = True
                elif kind == "itemprop":
                    self.main |= value == "articlebody"
                elif kind == "role" and value in ("main", "article"):
                    self.main = True
                else:
                    whole += (m[2] or m[3] or m[4] or "").split()
        inside = parent.within if parent else None
        self.within = self if self.main else inside
        if tag in SKIPPED or tag == "header" and not inside or whole and not self.main and tag not in ("html", "body") and any(_boilerplate(name, bool(inside)) for name in whole):
            self.skipped = True


def _boilerplate(name: str, in_article: bool) -> bool:
    """Whether a class, id or role says that the element isn't the article."""
    if name.lower() in BOILERPLATE:
        return True
    words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    return any(w in BOILERPLATE and (w not in AMBIGUOUS or not in_article and i and i == len(words) - 1) for i, w in enumerate(words))


def text_nodes(page: str) -> list[tuple[_Element, str, int]]:
    """(element, decoded text, block) of every text node outside skipped elements."""
    root = _Element("", None)
    top, out, block, at, n = root, [], 0, 0, len(page)
    made, paths, opened = 0, {}, Counter()

    def add(raw: str) -> None:
        if raw and not top.skipped:
            out.append((top, html.unescape(raw) if "&" in raw else raw, block))

    def close(e: _Element) -> None:
        nonlocal top
        while top is not e.parent:
            top.end = made
            opened[top.tag] -= 1
            top = top.parent

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        for q in ('"', "'"):
            if q in attributes and attributes.count(q) % 2 and "=" + q in attributes.replace(" ", ""):  # a > in a quoted value
                end = page.find(q, at)
                close = page.find(">", end) if end >= 0 else -1
                if close >= 0:
                    attributes, at = attributes + page[at - 1 : close], close + 1
                break
        if tag not in INLINE:
            block += 1
        if m[1]:
            if opened[tag]:
                e = top
                while e.tag != tag:
                    e = e.parent
                close(e)
            continue
        if tag in CLOSES_P and top.open_p:
            close(top.open_p)
        if tag in SIBLINGS and tag in top.outermost:
            close(top.outermost[tag])
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            if tag == "br" and not top.skipped:
                out.append((top, "\n", block))
            continue
        element = _Element(tag, top, attributes)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = n if not end else page.find(">", end.end())
            at = n if stop < 0 or not end else stop + 1
            continue
        made += 1
        element.begin = made
        element.path = paths.setdefault((top.path, tag), len(paths) + 1)
        opened[tag] += 1
        top = element
    while top is not None:
        top.end, top = made, top.parent
    return out


def _smoothed(series: list[float], radius: int = 1) -> list[float]:
    weights = [math.exp(-(d * d) / (2 * max(1, radius) ** 2)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(series)):
        total = scale = 0.0
        for d, w in zip(range(-radius, radius + 1), weights, strict=True):
            if 0 <= i + d < len(series):
                total += w * series[i + d]
                scale += w
        out.append(total / scale)
    return out


def _holds(outer: _Element, e: _Element) -> bool:
    return outer.begin <= e.begin <= outer.end


def main_text(page: str | None, part: float = 0.5) -> str:
    """The text of the main content, one space between words and blocks; empty if there is none or the page is null."""
    nodes = text_nodes(page or "")
    places = [i for i, (_, s, _) in enumerate(nodes) if s.strip()]
    if not places:
        return ""
    full = [nodes[i][:2] for i in places]
    # ratios of each path
    sums: dict[int, list[float]] = {}
    for e, s in full:
        own = sums.setdefault(e.path, [0, 0, 0])
        own[0] += 1
        own[1] += 0 if e.link else len(s.strip())
        own[2] += 0 if e.link else sum(map(s.count, PUNCTUATION))
    length = _smoothed([sums[e.path][1] / sums[e.path][0] for e, _ in full])
    marks = _smoothed([sums[e.path][2] / sums[e.path][0] for e, _ in full])
    fused = [a * (1 + b) for a, b in zip(length, marks, strict=True)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    least = min(part * spread, max(fused)) if spread > 0 else max(fused)
    content = [i for i, x in enumerate(fused) if x >= least and not full[i][0].link] or [max(range(len(fused)), key=fused.__getitem__)]
    # the element around all of the content, and the deepest one that holds nearly all of it
    content_elements = sorted((full[i][0].begin, n, fused[i] * len(full[i][1])) for n, i in enumerate(content))
    begins = [b for b, _, _ in content_elements]
    sums_before = [0.0, *accumulate(w for _, _, w in content_elements)]
    total = sums_before[-1]
    container = full[content[content_elements[0][1]]][0]
    while not container.begin <= begins[-1] <= container.end or container.tag in INLINE:
        container = container.parent
    inner = full[content[content_elements[min(len(begins) - 1, bisect_left(sums_before, total / 2, 1) - 1)][1]]][0]
    while inner is not container and (inner.tag in INLINE or sums_before[bisect_right(begins, inner.end)] - sums_before[bisect_left(begins, inner.begin)] < 0.85 * total):
        inner = inner.parent
    if container.within:
        container = inner = container.within
    elif inner.tag in ("p", "li", "h1", "h2", "td") and inner.parent is not None:
        inner = inner.parent
        container = inner if _holds(inner, container) else container
    lo, hi = 0, len(nodes)
    if inner is not container or container.tag in ("", "html", "body"):  # from the first content node, or the headings right before it, to the last
        first = content[0]
        while first and full[first - 1][0].tag in ("h1", "h2", "h3"):
            first -= 1
        lo, hi = places[first], places[content[-1]] + 1
    whole = inner is not container and inner.tag not in ("", "html", "body")
    chosen = [x for i, x in enumerate(nodes) if lo <= i < hi and _holds(container, x[0]) or whole and _holds(inner, x[0])]
    # blocks made of links go
    sizes: dict[int, list[int]] = {}
    for e, s, b in chosen:
        own = sizes.setdefault(b, [0, 0])
        own[0] += len(s.strip())
        own[1] += len(s.strip()) if e.link else 0
    blocks: dict[int, list[str]] = {}
    for e, s, b in chosen:
        if not (sizes[b][1] and sizes[b][1] >= 0.8 * sizes[b][0] and e.listed):
            blocks.setdefault(b, []).append(s)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: ``id_col``, ``url_col``, text, n_chars (code points).

    A null or empty page, and one without main content, has an empty text. Other columns are ignored.
    """
    ready(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
