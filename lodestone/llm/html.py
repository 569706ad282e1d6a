"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text.  Every block of text has a path of open block elements from the root,
each with its first class or id.  For each path the text-to-path ratio (characters in its blocks by number of
blocks) and the punctuation-to-path ratio are aggregated; both are smoothed over the page's order of blocks, fused
by multiplication, and paths above the standard deviation are content.  Then

- the region is the innermost element that holds nine tenths of the content's characters, or the elements around it
  where it is a mere paragraph; `article` and `main` are hints: the outermost of them around it or in it, with those
  beside it that hold content, are the region;
- in the region a block goes whose innermost container (div, section, table and the like) has a path beneath which
  no content path lies: a box beside the text.  Inside an `article` nothing goes by that rule, as short text is
  text there too.

Never content, before ratios are taken, are elements of the kinds that are not the article by their nature: menus,
headers, footers, sidebars, forms and such by their names, and containers one of whose classes, ids or roles, as a
whole, names such a kind (`site-footer`, `cookie-notice`, but not `related-work`).  Paragraphs, headings, lists'
items and quotes are never judged by their class.

Reading: character references are decoded; comments, scripts, styles and other elements without readable text are
dropped; an unclosed paragraph, list item or cell ends where the next begins; white space in a block, `<br>`
included, becomes one space; blocks are joined in page order by an empty line.

Defined results: a null or empty page, or one without text, has the empty text; broken markup, unclosed or
stray tags, and pages cut short are read as far as they go; repeated rows each get a result.  Elements are kept
once, with a pointer to the one around them, so time and memory are in proportion to the page at any depth.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of elements.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("audio canvas head iframe noembed noframes script style svg template textarea title video".split())
#: Elements whose text is read without looking for tags.
VERBATIM = frozenset("xmp plaintext listing".split())
NEVER = frozenset("aside button dialog footer form header menu nav noscript search select".split())
#: Elements that may be boxes; others hold text, and are not judged by class or by what lies beneath them.
CONTAINERS = frozenset("aside center details div dl fieldset figure form menu ol section table ul".split())
#: Words that name what is never content, where all words of a class, id or role are such words or say where it is.
MARKS = frozenset("""ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments contentinfo
cookie cookies disqus footer gdpr header masthead menu menubar nav navbar navigation newsletter notice notices notification
pager pagination popup promo promoted promotion promotions replies sharing sidebar sidebars sponsor sponsored subscribe toolbar""".split())
PLACES = frozenset("""1 2 3 4 area bar block bottom box center col column consent container content global group inner item items
left list main outer page panel primary right row secondary section side site sticky sub text thread top unit widget wrap wrapper""".split())
#: What a start of these closes, and the elements that such closing doesn't reach beyond.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table".split())
ARTICLES = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)>?", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")


@dataclass(slots=True)
class Element:
    name: str
    parent: Element | None
    #: Number of the path from the root, counted from 0 as paths are first met, and of the path of the innermost container.
    path: int
    box: int
    never: bool
    article: bool
    #: Characters of content in it.
    weight: int = 0


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int


def _names(attributes: str) -> tuple[str, bool]:
    """The first class or id of an element, and whether it names what is never content."""
    if not attributes or attributes.isspace():
        return "", False
    label, marked = "", False
    for m in _NAMED.finditer(attributes):
        for value in html.unescape(m[2] or m[3] or m[4] or "").split():
            label = label or value
            words = set(_WORD.findall(value.lower()))
            marked = marked or (not words.isdisjoint(MARKS) and words <= MARKS | PLACES)
    return label, marked


@dataclass
class Page:
    blocks: list[Block]
    #: Of each path the one around it, -1 around the first.
    above: list[int]


def read(page: str) -> Page:
    """The blocks of text of a page, in order, those that are never content left out."""
    found: list[Block] = []
    root = Element("", None, 0, 0, False, False)
    stack, opened, text = [root], Counter(), []
    numbers, above = {(-1, ""): 0}, [-1]
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined and not stack[-1].never:
            found.append(Block(stack[-1], joined, linked))
        text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        part = html.unescape(part) if "&" in part else part
        text.append(part)
        if links:
            linked += len(part.strip())

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    def innermost(names: Container[str], until: Container[str] = ()) -> int:
        """The place of the innermost open element of these names; 0 if there is none, or one of `until` lies within."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in until:
                return 0
        return 0

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in RAW or name in VERBATIM:
            if closing or (name != "head" and attributes.rstrip().endswith("/")):
                continue
            end = re.compile(rf"</{name}\s*>" + (r"|(?=<body[\s>])" if name == "head" else ""), re.I).search(page, at)
            if name in VERBATIM:
                flush()
                text.append(page[at : end.start() if end else size])
                flush()
            if end:
                at = end.end()
            elif name != "head":
                at = size
        elif name in ("br", "wbr", "img"):
            text.append(" " * (name == "br"))
        elif name == "a":
            links = 0 if closing else 1
        elif name in BLOCKS or name == "button":
            flush()
            if closing:
                if opened[name]:
                    close(innermost((name,)))
                continue
            if stack[-1].name == "p":
                close(len(stack) - 1)
            closes = CLOSES.get(name, ())
            if any(opened[c] for c in closes) and (k := innermost(closes, HOLDERS)):
                close(k)
            if name in VOID or (name in ("html", "body") and opened[name]):
                continue
            label, marked = _names(attributes)
            marked = marked and name in CONTAINERS or bool(_HIDDEN.search(attributes))
            inside = stack[-1]
            allowed = name in ("header", "noscript") and inside.article
            path = numbers.setdefault((inside.path, f"{name}.{label}"), len(numbers))
            if path == len(above):
                above.append(inside.path)
            never = inside.never or (marked and name not in ("html", "body", "article", "main")) or (name in NEVER and not allowed)
            opened[name] += 1
            stack.append(Element(name, inside, path, path if name in CONTAINERS else inside.box, never, inside.article or name in ARTICLES))
    flush()
    return Page(found, above)


def _smoothed(values: list[float]) -> list[float]:
    """Each value with half the weight of its neighbours."""
    out = []
    for i, v in enumerate(values):
        total, weight = v, 1.0
        for j in (i - 1, i + 1):
            if 0 <= j < len(values):
                total += values[j] / 2
                weight += 0.5
        out.append(total / weight)
    return out


def content_paths(found: list[Block]) -> set[int]:
    """Paths whose fused, smoothed ratios pass the threshold, and half of whose text at least is outside of links."""
    chars, marks, many, plain = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        path = b.element.path
        chars[path] += len(b.text)
        marks[path] += len(_PUNCTUATION.findall(b.text))
        many[path] += 1
        plain[path] += max(0, len(b.text) - b.linked)
    text_ratio = _smoothed([chars[b.element.path] / many[b.element.path] for b in found])
    mark_ratio = _smoothed([(marks[b.element.path] + 0.5) / many[b.element.path] for b in found])
    fused = [t * p for t, p in zip(text_ratio, mark_ratio, strict=True)]
    mean = sum(fused) / len(fused)
    deviation = (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    score = defaultdict(float)
    for b, x in zip(found, fused, strict=True):
        score[b.element.path] += x / many[b.element.path]
    limit = min(deviation, max(score.values()))
    return {p for p in score if score[p] >= limit and plain[p] * 2 >= chars[p]}


def _region(found: list[Block], content: list[bool]) -> set[int]:
    """Ids of the elements whose blocks are the article, but for boxes."""
    elements: dict[int, Element] = {}
    # Sums go up from the last element met to the first, so each is added to the one around it when it is whole.
    for k, b in enumerate(found):
        e: Element | None = b.element
        b.element.weight += len(b.text) * content[k]
        while e is not None and id(e) not in elements:
            elements[id(e)] = e
            e = e.parent
    order = sorted(elements.values(), key=_depths(elements), reverse=True)
    for e in order:
        if e.parent is not None:
            e.parent.weight += e.weight
    total = sum(len(b.text) for k, b in enumerate(found) if content[k])
    best = next(e for e in order if 10 * e.weight >= 9 * total)  # the deepest: two cannot hold nine tenths each
    while best.parent is not None and best.name not in CONTAINERS | ARTICLES | {"body", "html", "td"}:
        best = best.parent
    outer, e = best, best
    while e is not None:
        outer = e if e.name in ARTICLES else outer
        e = e.parent
    if outer.name in ARTICLES:
        # With it others that stand at the same path and hold content.
        beside = outer.parent and outer.parent.path
        return {id(outer)} | {id(e) for e in order if e.name in ARTICLES and e.weight and e.parent and e.parent.path == beside}
    # No article around it: the outermost ones within that hold content, if they hold what a region must.
    inner = [e for e in order if e.name in ARTICLES and e.weight and not (e.parent and e.parent.article)]
    return {id(e) for e in inner} if 10 * sum(e.weight for e in inner) >= 9 * total else {id(best)}


def _depths(elements: dict[int, Element]):
    depth: dict[int, int] = {}
    for e in elements.values():
        chain = []
        while e is not None and id(e) not in depth:
            chain.append(e)
            e = e.parent
        d = depth[id(e)] if e is not None else -1
        for x in reversed(chain):
            d += 1
            depth[id(x)] = d
    return lambda e: depth[id(e)]


def main_text(page: str | None) -> str:
    got = read(page or "")
    found = got.blocks
    if not found:
        return ""
    paths = content_paths(found) or {b.element.path for b in found}
    region = _region(found, [b.element.path in paths for b in found])
    # A path with content beneath it; of each, those around it have been marked with it.
    fertile: set[int] = set()
    for path in paths:
        while path >= 0 and path not in fertile:
            fertile.add(path)
            path = got.above[path]
    inside: dict[int, bool] = {}

    def within(e: Element | None) -> bool:
        chain = []
        while e is not None and id(e) not in inside and id(e) not in region:
            chain.append(id(e))
            e = e.parent
        got = e is not None and inside.get(id(e), True)
        inside.update(dict.fromkeys(chain, got))
        return got

    return "\n\n".join(b.text for b in found if within(b.element) and (b.element.article or b.element.box in fertile))


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
