"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags and classes from
the root.  Per path, text length and punctuation are averaged over its blocks.
Both ratios are smoothed with those of the paths around it (beneath the same
container, weighted by length), fused with the container's share of the page's
text, and thresholded: the blocks of the paths that reach the threshold are the
content.  Parts that HTML itself, a class, an id or a role names as not content
(navigation, footers, forms, adverts, comments, ...) are fused with a small
weight, so that they count only where nothing else is prose.  Only what a
browser does not show as text (scripts, styles, hidden parts) never counts.

All steps are linear in the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Tag names by what they do, and the words in a class, id or role that mark a part as not content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "noframes", "xmp"}
ASIDE = {"nav", "footer", "aside", "form", "header", "head", "button", "select", "menu", "dialog", "label", "canvas", "audio", "video", "map"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P_INSIDE = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul", "p"}
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "html", "td", "th", "blockquote"}
# Tags that shape text rather than contain parts of a page.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
ARTICLE = {"article", "main"}
MARKED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adslot|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|paywall|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|taboola|toolbar|widget)(?:$|[\s_-])", re.I)
# Names that say what a part has or allows, not what it is: has-sidebar, no-sidebar, comments-open.
STATE = re.compile(r"(?<!\S)(?:(?:has|no|with)-\S+|\S+-(?:open|closed))(?!\S)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")

# A quote opens a value only after "=", and only if what follows its end can follow a value;
# an unclosed one therefore ends with its tag instead of swallowing the text behind it.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s\"'>][^\s>]*+)?+|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|\Z))", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")

#: Share of the page's best fused value that a path must reach.
THRESHOLD = 0.2
#: Length and punctuation of a block at which the ratios are half of prose, and the weight of a block without punctuation.
HALF_LENGTH, HALF_MARKS, BARE = 100, 1, 0.25
#: Weight of each part named as not content, and length times punctuation from which such a part alone can be the content.
PART, PROSE = 1e-3, 5000


def _attributes(attrs: str) -> tuple[str, str, bool]:
    """(class, words of class, id and role that may mark the part, hidden)."""
    kind, words, hidden = "", [], False
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "role":
            words.append(("role", value))
        elif key in ("class", "id"):
            words.append(("name", value))
            if key == "class":
                kind = " ".join(sorted(value.split()))
    return kind, words, hidden


def _not_content(name: str, words: list, in_article: bool) -> bool:
    if name in ASIDE and not (name == "header" and in_article):  # an article's own header holds its title
        return True
    return any(value.lower() in ROLES if key == "role" else name not in ("html", "body", "article", "main") and MARKED.search(STATE.sub(" ", value)) for key, value in words)


class _Paths:
    """The tree of distinct paths: for each, its container and how many parts named as not content it lies in."""

    def __init__(self):
        self.child: dict[tuple[int, str, str, bool], int] = {}
        self.group, self.parts, self.article = [0], [0], [False]

    def below(self, at: int, name: str, kind: str, part: bool) -> int:
        key = (at, name, kind, part)
        if key not in self.child:
            self.child[key] = new = len(self.group)
            inside = self.article[at] and not part
            joins = inside or name in TEXT and not part
            self.group.append(self.group[at] if joins else new)
            self.parts.append(self.parts[at] + part)
            self.article.append(inside or name in ARTICLE and not part)
        return self.child[key]


def blocks(page: str) -> tuple[_Paths, list[tuple[int, str, int]]]:
    """The page's paths, and (path, text, characters inside links) of each block in page order."""
    paths = _Paths()
    stack: list[tuple[str, bool, int]] = []  # (tag, whether hidden, path)
    open_at: dict[str, list[int]] = {}  # places of each tag in the stack
    hidden, links, linked, at, end = 0, 0, 0, 0, len(page)
    held: list[str] = []
    path = 0
    out: list[tuple[int, str, int]] = []

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((path, text, linked))
        held.clear()
        linked = 0

    def last(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def pop(to: int):
        nonlocal hidden, links
        while len(stack) > to:
            name, bar, _ = stack.pop()
            open_at[name].pop()
            hidden -= bar
            links -= name == "a"

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hidden:
            text = html.unescape(page[at:stop])
            if not held and text.strip():
                path = stack[-1][2] if stack else 0
            if held or text.strip():
                held.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            i = last((name,))
            if name not in INLINE or i >= 0 and stack[i][2] != (stack[i - 1][2] if i else 0):
                flush()
            if i >= 0 and (name in ("body", "html") or i >= last(("table", "body"))):
                pop(i)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "br" or name == "wbr":
            if held:
                held.append(" " if name == "br" else "")
            continue
        if name not in INLINE:
            flush()
            scope = last(SCOPES)
            if name in CLOSED_BY and (i := last(CLOSED_BY[name])) >= 0 and i >= scope:
                pop(i)
                scope = last(SCOPES)
            if name in NO_P_INSIDE and (i := last(("p",))) >= 0 and i > scope:
                pop(i)
        if name in VOID or name in INLINE and _EMPTY.search(m["attrs"]):
            continue
        above = stack[-1][2] if stack else 0
        kind, words, bar = _attributes(m["attrs"])
        part = _not_content(name, words, paths.article[above])
        if part and name in INLINE:
            flush()
        stack.append((name, bar, paths.below(above, name, kind, part) if part or name not in INLINE else above))
        open_at.setdefault(name, []).append(len(stack) - 1)
        hidden += bar
        links += name == "a"
    flush()
    return paths, out


def content(page: str | None, threshold: float = THRESHOLD, part: float = PART) -> str:
    """Main text: the chosen blocks, one to a line; empty for null or where no block is content.

    ``threshold`` 0 keeps all blocks; ``part`` 1 leaves the choice to the ratios alone.
    """
    if not page:
        return ""
    paths, found = blocks(page)
    total: dict[int, list[float]] = {}  # path: characters, punctuation, characters in links, blocks
    for p, text, linked in found:
        t = total.setdefault(p, [0, 0, 0, 0])
        t[0] += len(text)
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += min(linked, len(text))
        t[3] += 1
    # Outside an article, what is mostly links does not belong to the text around it.
    group = {p: -1 - p if t[2] > t[0] / 2 and not paths.article[p] else paths.group[p] for p, t in total.items()}
    length = {p: (t[0] - t[2]) / t[3] for p, t in total.items()}
    marks = {p: t[1] / t[3] for p, t in total.items()}
    long = {p: x / (x + HALF_LENGTH) for p, x in length.items()}
    dotted = {p: x / (x + HALF_MARKS) for p, x in marks.items()}
    around: dict[int, list[float]] = {}  # container: characters, and both ratios weighted by them
    for p, t in total.items():
        g = around.setdefault(group[p], [0, 0.0, 0.0])
        g[0] += t[0]
        g[1] += t[0] * long[p]
        g[2] += t[0] * dotted[p]
    weight = {p: part ** paths.parts[p] for p in total}
    most = max((around[group[p]][0] * weight[p] for p in total), default=1)
    fused = {}
    for p in total:
        mass, a, b = around[group[p]]
        a, b = (long[p] + a / mass) / 2, (dotted[p] + b / mass) / 2
        fused[p] = weight[p] * a * (BARE + (1 - BARE) * b) * (min(1.0, mass / most)) ** 0.5
    best = max(fused, key=lambda p: (fused[p], -p), default=None)
    if best is None or weight[best] < 1 and threshold > 0 and length[best] * (1 + marks[best]) < PROSE:
        return ""
    return "\n".join(text for p, text, _ in found if fused[p] >= threshold * fused[best])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            text = [content(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page", "url", "text", "n_chars"])


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page, url, text, n_chars) per page row, without a shuffle.

    Null or empty html gives an empty text; ids and urls pass through, null or
    not; repeated rows each get a row; extra columns are ignored.
    """
    p = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(source).alias("html"))
    kind = pages.schema[page].dataType.simpleString()
    return p.mapInArrow(_extract, f"page {kind}, url string, text string, n_chars long").withColumnsRenamed({"page": page, "url": url})
