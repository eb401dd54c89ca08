"""Main text against a plain version over tuples of tags, what the ratios do alone, and damaged or deep pages."""

import os
import random
import time
from html.parser import HTMLParser

import pytest

from lossweave.llm import html_extract as H

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Plain(HTMLParser):
    """Blocks of a page whose only omitted end tags are those of p, with whole paths as tuples."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text, self.raw = [], [], [], 0
        self.feed(page)
        self.close()
        self.flush()

    def path(self):
        return tuple(x for x in self.stack if x[0] not in H.INLINE)

    def flush(self):
        text = " ".join("".join(t for t, _, _ in self.text).split())
        if text:
            first = next(i for i, t in enumerate(self.text) if t[0].strip())
            self.blocks.append((self.text[first][1], text, sum(len(t.strip()) for t, _, link in self.text if link)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append((" ", self.path(), False))
        elif tag in H.RAW:
            self.raw += 1
        elif tag not in H.VOID:
            if tag not in H.INLINE:
                self.flush()
                near = next((t for t, _, _ in reversed(self.stack) if t == "p" or t in H.SCOPES), None)
                if tag in H.NO_P_INSIDE and near == "p":
                    while self.stack.pop()[0] != "p":
                        pass
            words = [dict(attrs).get(k) or "" for k in ("class", "id")]
            part = tag in H.ASIDE or tag not in ("html", "body", "article", "main") and any(H.MARKED.search(w) for w in words)
            self.stack.append((tag, words[0], part))

    def handle_endtag(self, tag):
        if tag in H.RAW:
            self.raw -= 1
        elif any(t == tag for t, _, _ in self.stack):
            if tag not in H.INLINE:
                self.flush()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.raw:
            self.text.append((data, self.path(), any(t == "a" for t, _, _ in self.stack)))


def container(path):
    """The path's container: from the deepest part or container on, or the outermost article around it."""
    at = 0
    inside = False
    for i, (tag, _, part) in enumerate(path):
        if part or not inside and tag not in H.TEXT:
            at = i + 1
            inside = tag in H.ARTICLE and not part
    return path[:at], inside


def plain_content(page, threshold=H.THRESHOLD):
    blocks = Plain(page).blocks
    paths = {p for p, _, _ in blocks}
    if not paths:
        return ""
    of = {p: [(t, min(k, len(t))) for q, t, k in blocks if q == p] for p in paths}
    chars = {p: sum(len(t) for t, _ in of[p]) for p in paths}
    linked = {p: sum(k for _, k in of[p]) for p in paths}
    length = {p: (chars[p] - linked[p]) / len(of[p]) for p in paths}
    marks = {p: sum(len(H.PUNCTUATION.findall(t)) for t, _ in of[p]) / len(of[p]) for p in paths}
    group = {p: p if linked[p] > chars[p] / 2 and not container(p)[1] else ("", container(p)[0]) for p in paths}
    ratio = {p: (length[p] / (length[p] + H.HALF_LENGTH), marks[p] / (marks[p] + H.HALF_MARKS)) for p in paths}
    weight = {p: H.PART ** sum(x[2] for x in p) for p in paths}
    mass = {p: sum(chars[q] for q in paths if group[q] == group[p]) for p in paths}
    fused = {}
    for p in paths:
        near = [q for q in paths if group[q] == group[p]]
        a, b = ((ratio[p][k] + sum(chars[q] * ratio[q][k] for q in near) / mass[p]) / 2 for k in (0, 1))
        fused[p] = weight[p] * a * (H.BARE + (1 - H.BARE) * b) * min(1, mass[p] / max(mass[q] * weight[q] for q in paths)) ** 0.5
    best = max(fused.values())
    if all(weight[p] < 1 and length[p] * (1 + marks[p]) < H.PROSE for p in paths if fused[p] == best):
        return ""
    return "\n".join(t for p, t, _ in blocks if fused[p] >= threshold * best * (1 - 1e-12))


def made_page(rng):
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".", "; "]) for _ in range(rng.randint(1, n)))

    def inner(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(8)
            if kind < 3 or depth > 3:
                out.append(f"<p>{prose(80)}" + rng.choice(["</p>", ""]))
            elif kind == 3:
                out.append(f"<h2>{prose(6)}</h2>")
            elif kind == 4:
                out.append("<ul>" + "".join(f"<li><a href='/x'>{prose(3)}</a> {rng.choice(['', prose(5)])}</li>" for _ in range(3)) + "</ul>")
            else:
                tag = rng.choice(["div", "section", "article", "main", "nav", "footer", "aside"])
                out.append(f"<{tag}{rng.choice(['', ' class=box', ' class=sidebar', ' id=comments'])}>{inner(depth + 1)}</{tag}>")
        return "".join(out)

    return f"<html><head><title>{prose(4)}</title></head><body>{inner(0)}<script>a < b</script></body></html>"


def test_pages_equal_the_plain_version():
    rng = random.Random(21)
    for _ in range(300):
        page = made_page(rng)
        assert H.content(page) == plain_content(page), page
    if os.path.exists(PAGES):
        import pyarrow.parquet as pq

        for page in pq.read_table(PAGES)["html"].to_pylist():
            assert H.content(page) == plain_content(page)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no pages here")
def test_the_ratios_select():
    """Thresholding changes every page; without the named parts, the ratios alone remove most of what is not content."""
    import pyarrow.parquet as pq

    pages = pq.read_table(PAGES)["html"].to_pylist()
    other = left = lost = total = 0
    for page in pages:
        kept, every, alone = (x.split("\n") for x in (H.content(page), H.content(page, threshold=0), H.content(page, part=1)))
        assert kept != every
        other += len(every) - len(kept)
        left += sum(x not in kept for x in alone)
        lost += sum(x not in alone for x in kept)
        total += len(kept)
    assert left < 0.1 * other and lost < 0.01 * total


LONG = "Long words of the article, which go on and on, and say much; really. " * 8


@pytest.mark.parametrize("page,want", [
    (f"<main><p>Teaser, here.</p></main><div><p>{LONG}</p><p>Yes.</p></div>", f"{LONG.strip()}\nYes."),
    (f"<div>Login</div><p>{LONG}</p><div>junk 1</div>", LONG.strip()),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><footer>by me</footer></article>", f"Title\n{LONG.strip()}"),
    (f"<form><div class=nav>Home</div><div class=c><p>{LONG * 3}</p></div></form>", (LONG * 3).strip()),
    (f"<ul class=top><li><a href=/>Home page of all</a></li></ul><p>{LONG}</p><ul><li>point</li></ul>", f"{LONG.strip()}\npoint"),
    ('<p title="x>Hello', "Hello"),
    ('<p title="x>Hello</p><p title="y">World, here.</p>', "Hello\nWorld, here."),
    ("<p data=it's>Hello</p><p>there, it's</p>", "Hello\nthere, it's"),
    ('<p title="a > b" data-x=\'<b>"</b>\'>Hello', "Hello"),
    ('<p>Some <span hidden>not </span>text, <span class="ad">Buy</span> here.</p>', "Some text,\nhere."),
    ("<nav>Home</nav><footer>Me, you.</footer>", ""),
    ("<script>x", ""),
])
def test_cases(page, want):
    assert H.content(page) == want


@pytest.mark.parametrize("page", ["<div>" * 20000 + "x" + "</b>" * 20000, "<div>a" * 20000 + "</p>" * 20000, "<table><p>" + "<td>a" * 20000 + "</p>" * 20000, "<p title=\"" * 20000, "".join(f"<div class=c{i}>a, " for i in range(20000))])
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    H.content(page)
    assert time.perf_counter() - began < 5
