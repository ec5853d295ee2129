"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

1. The standard library's parser streams events; block-level tags cut the page into
   lines.  A light tree of container elements remembers where each line stands.
2. Lines in navigation, headers, footers, asides, forms, scripts, hidden elements, and
   in elements named (class, id, role) as menus, notices, adverts, sidebars or
   reader comments, are boilerplate, inline ones as well.  A name does not count on an
   element that holds the article or its title, nor a header inside an article, nor a name
   other than a comment's on an element that is nearly all (``MOST``) of its article, or of a
   page without one, and no list of links.  An article that is named as a comment is one.
   Outside articles, an element of several links and hardly any other text is a menu.
3. Each line's ratio of characters to tags is smoothed with a Gaussian over the
   lines; lines above the standard deviation of the page's ratios are content.
4. The content region is the smallest element that holds all content lines, widened to the
   outermost article or main it stands in; on a page that has none, it also holds the
   page's titles (h1).  All its lines but the boilerplate are the text, so short paragraphs stay.

Cases: a null or empty page, or one without text, gives the empty text; broken markup is
read as the parser does, a head ends with the first text or tag of the body, a p with the
next block, other unclosed elements end with the page; repeated rows
are extracted each; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page (HTML standard).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = set("head script style noscript template iframe object svg math canvas audio video title".split())
AROUND = set("nav footer aside form button select textarea menu dialog fieldset".split())
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
IN_P = SILENT | VOID - {"hr"} | set("button select textarea label".split())  # do not end an open p
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMED = re.compile(r"(?:ad|ads|adv|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookie\w*|consent\w*|gdpr|notices?|alert|newsletter|subscribe|subscription|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|related|recommend\w*|share|sharing|social|footer|masthead|toolbar|widgets?|pagination|pager|skip|login|signup)")
COMMENT = re.compile(r"(?:comments?|commentlist|discussions?|disqus|replies|respond)")
ONE_COMMENT = re.compile(r"(?:(?:user-?|reader-?)?comment|reply|comment-(?:\d+|body|item|entry))")  # on an article
PROSE = re.compile(r"related[-_](?:works?|research|literature|studies)")  # sections of articles
HEADING = re.compile(r"(?:header|topbar|site-?header|page-?header)")
LAYOUT = re.compile(r"(?:with|has|no|without|is|show|hide)[-_]")  # says what stands beside it
SIGMA = 1.0
MOST, LINKED = 0.75, 0.9  # shares of characters


class Lines(HTMLParser):
    """Lines of a page: text, tags and the container element of each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.kind = [-1], ["#page"], [""]  # kind: "", "silent", "around", "comment", "named" or "header"
        self.open = [0]
        self.muted: list[tuple[str, int]] = []  # open inline elements from a boilerplate one on, and the depth they stand at
        self.text: list[str] = []
        self.lines: list[tuple[str, int, int]] = []
        self.linked: list[tuple[int, int]] = []  # characters in links and links of each line
        self.link = 0  # depth at which a link is open
        self.in_links, self.links = 0, 0
        self.tags = 0

    def end_line(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1]))
            self.linked.append((self.in_links, self.links))
            self.tags = 0
        self.text, self.in_links, self.links = [], 0, 0

    def close_from(self, k):
        self.end_line()
        del self.open[k:]
        if self.link > k:
            self.link = 0
        while self.muted and self.muted[-1][1] > k:
            self.muted.pop()

    def end_head(self, tag):
        """Head's end tag may be left out: its end is the body or the first thing that cannot stand in it."""
        tops = [self.tag[k] for k in self.open[:4]]
        if "head" in tops and (tag == "body" or (self.tag[self.open[-1]] == "head" and tag not in IN_HEAD)):
            self.close_from(tops.index("head"))

    def handle_starttag(self, tag, attrs):
        self.end_head(tag)
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.link = len(self.open)
                self.links += 1
            if tag not in VOID and (self.muted or self.kind_of(tag, dict(attrs)) not in ("", "header")):
                self.muted.append((tag, len(self.open)))
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in IN_P and self.tag[self.open[-1]] == "p":
            self.close_from(len(self.open) - 1)
        self.end_line()
        if tag in VOID:
            return
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.kind.append(self.kind_of(tag, dict(attrs)))
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in INLINE or tag in VOID:
            if tag == "a":
                self.link = 0
            for k in range(len(self.muted) - 1, -1, -1):
                if self.muted[k] == (tag, len(self.open)):
                    del self.muted[k:]
                    break
            return
        self.end_line()
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                self.close_from(k)
                break

    def handle_data(self, data):
        if self.tag[self.open[-1]] == "head" and data.strip():
            self.end_head("#text")
        if not self.muted:
            self.text.append(data)
            if self.link:
                self.in_links += len(" ".join(data.split()))

    def above(self, tags: tuple[str, ...]) -> list[bool]:
        """For each element, whether one of ``tags`` stands in it."""
        out = [False] * len(self.tag)
        for k in range(len(self.tag)):
            up = self.parent[k] if self.tag[k] in tags and self.kind[k] != "comment" else -1
            while up >= 0 and not out[up]:
                out[up] = True
                up = self.parent[up]
        return out

    @staticmethod
    def kind_of(tag: str, attrs: dict) -> str:
        if tag in SILENT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return "silent"
        if tag in AROUND or (attrs.get("role") or "").lower() in ROLES:
            return "around"
        words = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        parts = [p for w in words.split() if not LAYOUT.match(w) for p in (w, *re.split(r"[-_]+", w))]
        if tag in ("body", "html", "article", "main"):
            return "comment" if tag == "article" and any(ONE_COMMENT.fullmatch(w) for w in words.split()) else ""
        if any(COMMENT.fullmatch(p) for p in parts):
            return "comment"
        parts = [p for w in words.split() if not LAYOUT.match(w) and not PROSE.fullmatch(w) for p in (w, *re.split(r"[-_]+", w))]
        if any(NAMED.fullmatch(p) for p in parts):
            return "named"
        if tag == "header" or any(HEADING.fullmatch(p) for p in parts):
            return "header"
        return ""


def _sums(page: Lines, out: list[bool], of_lines: list[int]) -> list[int]:
    """For each element, the sum over the lines in it that are not ``out``."""
    total = [0] * len(page.tag)
    for (_, _, node), x in zip(page.lines, of_lines, strict=True):
        total[node] += 0 if out[node] else x
    for k in range(len(total) - 1, 0, -1):  # parents come before their children
        total[page.parent[k]] += total[k]
    return total


def content(page: Lines) -> list[str]:
    """The lines of the content region, boilerplate left out."""
    n = len(page.tag)
    inside = [False] * n  # stands in an article
    scope = [0] * n  # the innermost article it stands in, else the page
    for k in range(1, n):
        top = page.tag[k] in ("article", "main") and page.kind[k] == ""
        inside[k], scope[k] = top or inside[page.parent[k]], k if top else scope[page.parent[k]]
    holds, titled = page.above(("article", "main")), page.above(("article", "main", "h1"))
    out = [False] * n
    for k in range(1, n):
        kind = page.kind[k]
        comment = kind == "comment" and (page.tag[k] == "article" or not titled[k])
        own = kind in ("silent", "around") or comment or (kind == "header" and not holds[k] and not inside[page.parent[k]])
        out[k] = own or out[page.parent[k]]
    size, linked, links = (_sums(page, out, x) for x in ([len(t) for t, _, _ in page.lines], [c for c, _ in page.linked], [c for _, c in page.linked]))
    has_article = any(inside[node] and not out[node] for _, _, node in page.lines)
    for k in range(1, n):
        most = size[k] >= MOST * size[scope[page.parent[k]]] and 2 * linked[k] < size[k] and (inside[page.parent[k]] or not has_article)
        named = page.kind[k] == "named" and not titled[k] and not most
        menu = links[k] > 1 and linked[k] >= LINKED * size[k] and not inside[k] and not titled[k] and page.tag[k] not in ("body", "html", "p", "h1")
        out[k] |= named or menu or out[page.parent[k]]
    lines = [(text, tags, node) for text, tags, node in page.lines if not out[node]]
    if not lines:
        return []
    size = np.array([len(text) for text, _, _ in lines], float)
    ratio = size / np.maximum([tags for _, tags, _ in lines], 1)
    x = np.arange(-3, 4)
    kernel = np.exp(-x ** 2 / (2 * SIGMA ** 2))
    smooth = np.convolve(ratio, kernel, "full")[3:3 + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[3:3 + len(ratio)]
    chosen = smooth >= min(ratio.std(), smooth.max())
    has_article = any(inside[node] for _, _, node in lines)
    mass = np.zeros(n)
    for (_, _, node), s, yes in zip(lines, size, chosen, strict=True):
        mass[node] += s if yes or (page.tag[node] == "h1" and not has_article) else 0
    for k in range(n - 1, 0, -1):  # parents come before their children
        mass[page.parent[k]] += mass[k]
    region = max(k for k in range(n) if mass[k] == mass[0] and page.tag[k] not in ("p", "h1"))
    up = region
    while up >= 0:
        if page.tag[up] in ("article", "main"):
            region = up
        up = page.parent[up]
    within = [k == region for k in range(n)]
    for k in range(1, n):
        within[k] |= within[page.parent[k]]
    return [text for text, _, node in lines if within[node]]


def extract(html: str) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    return " ".join(content(page))


def _extract_batches(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            text = [extract(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    got = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return got.mapInArrow(_extract_batches, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
