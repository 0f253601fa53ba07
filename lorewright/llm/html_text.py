"""Main text of web pages by tag-path ratios.

A tolerant scanner turns a page into text leaves, each with its root-to-leaf tag path. For every path the characters and
punctuation marks of its leaves are added up and divided by its number of leaves, its links' characters are taken off, the
ratios are smoothed over the neighbours in page order, the smoothed text and punctuation ratios are fused by product, and a
threshold at a share of the mean tells content paths from the rest. Paths under scripts, styles, forms, navigation, headers,
footers, asides, or under elements whose class, id or role names an advert, menu, notice, sidebar or comments are out before
that. The container is the nearest element that spans all content blocks; where an article or main is around it, the outermost
such. Within it every block is kept, short ones and links too: the threshold chooses the container, not sentences. An article
or main elsewhere on the page is no reason to leave content blocks out.

Blocks are maximal runs of text without a block element's tag between; white space inside becomes one space, character
references are decoded once, and blocks are joined by two line feeds in page order.

Defined results: null, empty and text-free pages give the empty string; a page without markup is one block; a page cut off
in the middle is read as if all elements were closed; nothing is capped; rows keep their ids, null or repeated.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import light, pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("""html body article aside section nav header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
pre blockquote figure figcaption form fieldset legend address details summary hr option select noscript dialog""".split())
_OUT = set("head script style noscript template nav header footer aside form button select option textarea iframe svg canvas object dialog menu label input title".split())
_HINT = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|header|footer|masthead|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|alert|copyright|legal)(?:$|[\s_-])")
_ATTR = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
_WRAPS = {"div", "section", "td", "body", "html", "center", "blockquote", "dd"}
_MARKED = {"article", "main"}
_MARK = re.compile(r"[.,;:!?…。、，！？؟]")
THRESHOLD = 0.5


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in _OUT:
        return True
    for name, *values in _ATTR.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and _HINT.search(value):
            return True
    return False


def leaves(page: str) -> list[tuple[tuple[str, ...], tuple[int, ...], int, str, bool, bool]]:
    """(tag path, elements' numbers, block number, raw text, wanted, in a link) of every text leaf in page order."""
    stack: list[tuple[str, bool, int]] = []
    out, at, block, opened = [], 0, 0, 0
    bad = 0  # unwanted elements that are open

    def pop() -> None:
        nonlocal bad
        bad -= stack.pop()[1]

    def text(raw: str) -> None:
        if raw:
            own = [(t, k) for t, _, k in stack if t not in _INLINE]
            out.append((tuple(t for t, _ in own), tuple(k for _, k in own), block, raw, not bad, any(t == "a" for t, _, _ in stack)))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        block += tag in _BLOCK
        if m[1]:
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            text(" ")
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK and tag not in _INLINE and tag not in _RAW:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in ("noscript", "template") or tag == "title":
                pass
            at = end.end() if end else len(page)
            continue
        if tag in _BLOCK and any(t == "p" for t, *_ in stack) and tag not in ("html", "body"):
            while stack[-1][0] != "p":  # an open paragraph ends, with what is open inside
                if stack[-1][0] in _BLOCK:
                    break
                pop()
            if stack[-1][0] == "p":
                pop()
        if tag in _CLOSES:
            names = [t for t, *_ in stack]
            for k in range(len(names) - 1, -1, -1):
                if names[k] in _SCOPE[tag] and names[k] not in _CLOSES[tag]:
                    break
                if names[k] in _CLOSES[tag]:
                    while len(stack) > k:
                        pop()
                    break
        unwanted = _unwanted(tag, m[3])
        opened += 1
        stack.append((tag, unwanted, opened))
        bad += unwanted
    return out


def _squeezed(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def extract(page: str) -> str:
    """The main text of one page."""
    blocks: list[list] = []  # path, element numbers, raw text, its part in links
    number = None
    for path, numbers, block, raw, wanted, link in leaves(page):
        if not wanted:
            continue
        if block != number:
            blocks.append([path, numbers, [], 0])
            number = block
        own = blocks[-1]
        if not raw.isspace() and not "".join(own[2]).strip():
            own[:2] = path, numbers
        own[2].append(raw)
        own[3] += len(_squeezed(raw)) * link
    rows = [(path, numbers, t, linked) for path, numbers, raw, linked in blocks if (t := _squeezed("".join(raw)))]
    if not rows:
        return ""
    ratio: dict[tuple[str, ...], list[float]] = {}
    for path, _, t, linked in rows:
        r = ratio.setdefault(path, [0, 0, 0])
        r[0] += max(len(t) - linked, 0)
        r[1] += len(_MARK.findall(t))
        r[2] += 1
    text, marks = [ratio[p][0] / ratio[p][2] for p, *_ in rows], [ratio[p][1] / ratio[p][2] + 0.5 for p, *_ in rows]
    smooth = lambda v: [(v[max(i - 1, 0)] + 2 * v[i] + v[min(i + 1, len(v) - 1)]) / 4 for i in range(len(v))]
    fused = [a * b for a, b in zip(smooth(text), smooth(marks))]
    level = THRESHOLD * sum(fused) / len(fused)
    # text that stands in a division itself has it as its container, a paragraph or item the element around it
    around = [numbers if not path or path[-1] in _WRAPS else numbers[:-1] for path, numbers, *_ in rows]
    chosen = [c for c, f, (_, _, t, linked) in zip(around, fused, rows) if f >= level and len(t) > 2 * linked]
    chosen = chosen or [c for c, (path, *_) in zip(around, rows) if not _MARKED.isdisjoint(path)]
    if not chosen:
        return "\n\n".join(r[2] for r in rows)
    span = os.path.commonprefix(chosen)
    path = next(path for path, numbers, *_ in rows if numbers[: len(span)] == span)
    span = span[: next((k + 1 for k, tag in enumerate(path[: len(span)]) if tag in _MARKED), len(span))]
    return "\n\n".join(t for _, numbers, t, _ in rows if numbers[: len(span)] == span)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            out = [extract(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return light(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
