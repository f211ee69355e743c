"""HTML extraction by composite text density.

A tolerant parser builds the tree of a page: raw-text elements by their tag, implied end tags, comments. On this whole
tree, menus and all, each node gets its composite text density: its characters per tag, scaled by how many of its
characters and tags are not links. The sum of its children's densities peaks at the node that holds the paragraphs;
that node is the content. Off the path from body to it, what stands beside it counts as content when its density
reaches the threshold, the least density on that path. Where an article or main element, or else a container whose class
or id says `post` or the like, is around the content, the path begins there, and what is not mostly links counts too. Tags and class names only take things away from that: elements that are never article text by
their tag (nav, footer), and containers whose whole class or id names a known part of a page (`comments`,
`related-posts`) are no candidates and go inside and beside the content; a class that merely holds such a word
(`social-impact`) goes beside the content only, an id that does stays."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>"
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|{_PLAIN_TAG}", re.S)
_TOKEN_UNQUOTED = re.compile(rf"<!--(?:.*?-->|.*+)|(?!)()()()|{_PLAIN_TAG}", re.S)
#: Tags with an odd quote, each of which costs a look at the rest of the page; after so many quotes mean nothing.
MOST_ODD = 16
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD, _CAMEL = re.compile(r"[a-z]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_DISPLAY = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
PASSED_OVER = set("noscript template svg select".split())
CONTAINERS = set("div section article ul ol dl table tr td fieldset figure details center".split())
NEVER = RAW | PASSED_OVER | set("head nav footer aside form button dialog menu object audio video canvas map datalist".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class or an id that mark what is not the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies respond responses "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: How longer words begin or end that mark the same.
MARK_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "navbar", "pagination", "sidebar", "sponsor")
MARK_ENDS = ("comments", "sidebar", "navbar", "footer", "cookies")
#: Words beside a mark in the names of parts of a page.
PARTS = set(
    "site page post posts article articles entry entries story stories main top bottom left right center middle inner outer upper lower primary secondary "
    "global sticky fixed floating mobile desktop section container wrapper wrap box block area region zone panel pane bar row column col list item items "
    "link links button buttons btn icon icons group holder slot unit form title header heading content body user users reader readers thread toggle tab tabs "
    "sub wide small large mini horizontal vertical email follow js ui div gpt google dfp wp".split()
)
#: Words that make a class name one of state or genre, not of place; whose header a header is.
STATES = {"has", "with", "without", "no", "open", "closed", "enabled", "disabled", "commentary", "commentaries"}
OWN_HEADERS = {"article", "post", "entry", "content", "story", "section"}
#: Classes, ids and a role that say that an element is an article.
ARTICLE_NAMES = {"article", "post", "entry", "story", "hentry", "blogpost", "blog-post", "news-article", "article-wrapper", "post-wrapper"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "form", "toolbar"}
#: Open elements that a start tag ends: (those ended, those that keep them open).
_LISTS, _TABLE = {"ul", "ol", "menu", "dir"}, {"table"}
ENDS = {
    "li": ({"li"}, _LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, _TABLE), "td": ({"td", "th"}, _TABLE | {"tr"}), "th": ({"td", "th"}, _TABLE | {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, _TABLE), "thead": ({"tbody", "caption"}, _TABLE), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, _TABLE), "option": ({"option"}, {"select"}),
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_OF_TABLES = {"tr", "table", "tbody", "thead", "tfoot", "body", "html", "td", "th"}
#: Least base of the logarithm in a density.
LEAST_BASE = 2.0
_HOLDS_P = {"td", "th", "table", "caption", "html", "object", "button"}
_ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}


def _is_mark(word: str) -> bool:
    """Whether a word names a part of a page, alone or written together with other words of such names."""
    if word in MARKS:
        return True
    rest = [word[len(m) :] for m in MARK_STARTS if word.startswith(m)] + [word[: -len(m)] for m in MARK_ENDS if word.endswith(m)]
    return any(r in ("", "s") or r in PARTS or r in MARKS for r in rest)


def _names_part(name: str, tag: str, in_article: bool) -> bool:
    """Whether a whole class or id names a part of a page that is not the article."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    if not name.isascii() or not STATES.isdisjoint(words):
        return False
    if tag == "article":
        words = [w for w in words if w not in MARKS or w.startswith("comment")]
    marks = [_is_mark(w) or w == "header" and not in_article and OWN_HEADERS.isdisjoint(words) for w in words]
    return any(marks) and all(m or w in PARTS for m, w in zip(marks, words))


@lru_cache(1 << 14)
def _marked(value: str, tag: str, is_id: bool, in_article: bool) -> int:
    """Whether a class or id says that an element is not part of the article: 2 by a whole name, 1 by a word."""
    found = 0
    for name in [value] if is_id else value.split():
        words = {*_WORD.findall(name.lower()), *(w.lower() for w in _CAMEL.findall(name))}
        if not STATES.isdisjoint(words):
            continue
        if tag == "article":  # an article may be named after anything but comments, and cards that point elsewhere
            hit = any(w.startswith("comment") for w in words)
            if name.lower() in ("related", "ad", "advert", "advertisement", "promo"):
                return 2
        else:
            hit = any(w in MARKS or w.startswith(MARK_STARTS) or w.endswith(MARK_ENDS) for w in words)
            hit = hit or "header" in words and not in_article and OWN_HEADERS.isdisjoint(words)
        if hit and tag in CONTAINERS and _names_part(name, tag, in_article):
            return 2
        found = max(found, int(hit and not is_id))
    return found


_ARTICLE_NAME = re.compile("article|post|entry|story", re.I)


def _is_article(tag: str, attributes: str) -> bool:
    """Whether an element that is no article element says that it is an article."""
    if tag not in CONTAINERS or not attributes or not _ARTICLE_NAME.search(attributes):
        return False
    values = ((m[1].lower(), (m[2] or "").strip("\"'").lower()) for m in _ATTRIBUTE.finditer(attributes))
    return any(name in ("class", "id", "role") and not ARTICLE_NAMES.isdisjoint(value.split()) for name, value in values)


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """2: never article text; 1: none outside the content."""
    if tag in NEVER or (tag == "header" and not in_article):
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "role" and value.lower() in ROLES or name == "style" and _NO_DISPLAY.search(value):
            return 2
        if name in ("class", "id"):
            found = max(found, _marked(value, tag, name == "id", in_article))
    return found


def tokens(html: str):
    """(text before, tag or None, whether it is an end tag, attributes) in page order, in time linear in the page: raw-text
    elements and comments are left out, and a `<` after the last `>` is text."""
    at, find, odd, last = 0, _TOKEN.search, 0, html.rfind(">") + 1
    while m := find(html, at, last):
        text = html[at : m.start()]
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                yield text, None, False, ""
                return
            yield text, None, False, ""
            continue
        if m[5]:
            odd += 1
            if odd == MOST_ODD:
                find = _TOKEN_UNQUOTED.search
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if tag in RAW and not (m[1] or m[4] or attributes.endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            yield text, None, False, ""
        else:
            yield text, tag, bool(m[1] or m[4]), attributes
    comment = html.find("<!--", at)
    yield html[at : comment if comment >= 0 else len(html)], None, False, ""


def _passed_over(read: list) -> dict[int, int]:
    """Tokens at which elements that are passed over start, with the token of their own end tag."""
    ends, started = {}, {t: [] for t in PASSED_OVER}
    for i, (_, tag, is_end, attributes) in enumerate(read):
        if tag in PASSED_OVER:
            if is_end:
                if started[tag]:
                    ends[started[tag].pop()] = i
            elif not attributes.endswith("/"):
                started[tag].append(i)
    return ends


class Page:
    """The tree of a page: for each node its parent, tag, mark, and characters of its own; pieces of text in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.own, self.mark = [-1], ["#page"], [0], [0]
        self.named: set[int] = set()  # containers that say they are an article
        self.pieces: list[tuple[int, str]] = []  # (node, text); node -1: a block begins or ends here
        self._stack, self._hidden = [0], [False]
        self._depths: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are
        self._blocks: list[int] = []
        self._read(html)

    def _text(self, s: str) -> None:
        node = self._stack[-1]
        if "&" in s:
            s = unescape(s)
        self.own[node] += len(s) - s.count(" ") if s.strip() else 0
        self.pieces.append((node, s))

    def _deepest(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self._depths.get(t))), default=0)

    def _pop_to(self, depth: int) -> None:
        if self._blocks and self._blocks[-1] >= depth:
            self.pieces.append((-1, ""))
        for node in self._stack[depth:]:
            self._depths[self.tag[node]].pop()
            if self.tag[node] in BLOCK:
                self._blocks.pop()
        del self._stack[depth:]
        del self._hidden[depth:]

    def _end_open(self, ended: set, held: set) -> None:
        depth = self._deepest(ended)
        if depth and depth >= self._deepest(held):
            self._pop_to(depth)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._end_open({"p"}, _HOLDS_P)
            if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
                self._pop_to(len(self._stack) - 1)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        up = self._stack[-1]
        in_article = bool(self._depths.get("article") or self._depths.get("main"))
        mark = _unwanted(tag, attributes, in_article)
        self.parent.append(up)
        self.tag.append(tag)
        self.own.append(0)
        self.mark.append(mark)
        if _is_article(tag, attributes):
            self.named.add(len(self.tag) - 1)
        hidden = self._hidden[-1] or mark == 2 and tag != "form"
        if tag in ("main", "article") and not hidden and not mark:  # a part of a page doesn't hold its article
            for node in reversed(self._stack):
                if self.tag[node] in ("main", "article"):
                    break
                if self.mark[node] == 1:
                    self.mark[node] = 0
        if tag in BLOCK:
            self.pieces.append((-1, ""))
        elif tag in ("br", "annotation"):
            self.pieces.append((up, " "))
        if tag not in VOID:
            depth = len(self._stack)
            self._depths.setdefault(tag, []).append(depth)
            if tag in BLOCK:
                self._blocks.append(depth)
            self._stack.append(len(self.tag) - 1)
            self._hidden.append(hidden)

    def _end(self, tag: str) -> None:
        depth = self._deepest((tag,))
        if not depth or tag not in BLOCK and self._blocks and self._blocks[-1] > depth:
            return
        if tag not in _OF_TABLES and self._deepest(("td", "th")) > depth:
            return
        self._pop_to(depth)

    def _read(self, html: str) -> None:
        read = list(tokens(html))
        ends, i = _passed_over(read), 0
        while i < len(read):
            text, tag, is_end, attributes = read[i]
            if text:
                self._text(text)
            if tag is None:
                pass
            elif is_end:
                self._end(tag)
            elif tag in PASSED_OVER:  # without an end tag, only the start tag and options are
                if i in ends:
                    i = ends[i]
                elif tag == "select":
                    while i + 1 < len(read) and read[i + 1][1] in ("option", "optgroup") and not read[i + 1][0].strip():
                        i += 1
                        if i + 1 < len(read):  # the words of an option
                            read[i + 1] = ("", *read[i + 1][1:])
            else:
                self._start(tag, attributes)
            i += 1


def density_of(c: float, t: float, lc: float, lt: float, body_c: float, body_lc: float) -> float:
    """Composite text density of c characters under t tags, lc and lt of them in links, on a page of body_c characters,
    body_lc of them in links. The base of the logarithm is at least 2; without that it would go to 1, and the
    density beyond all bounds, as the links of a page get few."""
    if c <= 0:
        return 0.0
    t, lc1, lt1, plain = max(t, 1), max(lc, 1), max(lt, 1), max(c - lc, 1)
    base = max(LEAST_BASE, log(c / plain * lc + body_lc / max(body_c, 1) * c + e))
    return c / t * max(0.0, log(max(c / lc1 * (t / lt1), 1.0)) / log(base))


class Measured:
    """Characters and tags under each node of a page, and those of them in links; densities, and whether marks rule a
    node out."""

    def __init__(self, page: Page):
        self.page = page
        n, parent, tag = len(page.tag), page.parent, page.tag
        self.chars, self.tags, self.link_chars, self.link_tags = list(page.own), [0] * n, [0] * n, [0] * n
        self.inline = [t not in BLOCK for t in tag]  # neither a block nor holding one
        for i in range(n - 1, 0, -1):
            if tag[i] == "a":
                self.link_chars[i], self.link_tags[i] = self.chars[i], self.tags[i] + 1
            p = parent[i]
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i] + 1
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i]
            self.inline[p] = self.inline[p] and self.inline[i]
        self.mark = list(page.mark)
        for i in range(1, n):  # a form around the page is no form
            if tag[i] == "form" and 2 * (self.chars[i] - self.link_chars[i]) >= self.chars[0] - self.link_chars[0]:
                self.mark[i] = 0
        self.out = self._within(1)
        if not any(own for own, o in zip(page.own, self.out) if not o):
            self.out = self._within(2)
        self.density = [density_of(*x, self.chars[0], self.link_chars[0]) for x in zip(self.chars, self.tags, self.link_chars, self.link_tags)]

    def _within(self, least: int) -> list[bool]:
        out = [m >= least for m in self.mark]
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.page.parent[i]]
        return out

    def sums(self) -> tuple[list[float], list[float]]:
        """(for each node the sum of the densities of its children that no mark rules out, the part of it that its own
        text has). Text that stands between the blocks of a node, with the inline elements in it, is as one child."""
        n, parent, block_inside = len(self.out), self.page.parent, [False] * len(self.out)
        plain, links = list(self.page.own), [0] * n
        for i in range(1, n):
            p = parent[i]
            if not self.inline[i]:
                block_inside[p] = True
            elif not self.out[i]:
                plain[p] += self.chars[i]
                links[p] += self.link_chars[i]
        sums, own = [0.0] * n, [0.0] * n
        for i in range(n):
            if block_inside[i]:
                own[i] = density_of(plain[i], 1, links[i], int(links[i] > 0), self.chars[0], self.link_chars[0])
                sums[i] += own[i]
        for i in range(1, n):
            if not self.out[i] and not (self.inline[i] and block_inside[parent[i]]):
                sums[parent[i]] += self.density[i]
        return sums, own


def select(m: Measured) -> tuple[int, list[float]]:
    """(the node of the greatest sum of densities, the densities of each node's own text). Of equal sums the outer."""
    sums, own = m.sums()
    best = max((i for i in range(len(sums)) if not m.out[i]), key=lambda i: (sums[i], -i))
    return (best if sums[best] else 0), own


def _content(page: Page) -> tuple[list[bool], list[bool]]:
    """For each node whether all of it is content, and whether the text between its blocks is."""
    m = Measured(page)
    n, parent, tag = len(page.tag), page.parent, page.tag
    keep, own_kept = [False] * n, [False] * n
    if not m.chars[0]:
        return keep, own_kept
    best, own = select(m)
    path, node = [best], best
    while node:
        node = parent[node]
        path.append(node)
    around = [k for k, i in enumerate(path) if tag[i] == "article"] or [k for k, i in enumerate(path) if tag[i] == "main"]
    if not around:  # the nearest one around the content, else the content itself
        around = [k for k, i in enumerate(path) if k and i in page.named][:1] or [0] * (best in page.named)
    in_article = bool(around)
    above = set(path[1 : around[-1] + 1] if in_article else path[1:])
    least = min(m.density[i] for i in path if i == best or tag[i] not in ("html", "#page"))
    keep[best] = True
    for p in above:
        own_kept[p] = in_article or own[p] >= least > 0
    has_title, title = False, 0
    for i in range(1, n):
        p = parent[i]
        keep[i] = keep[i] or keep[p]
        if p in above and i != best and i not in above and not m.out[i]:
            if m.inline[i]:
                keep[i] = own_kept[p]
            else:
                keep[i] = m.density[i] >= least > 0 or in_article and 2 * m.link_chars[i] < m.chars[i]
        if (tag[i] == "h1" or in_article and tag[i] == "h2") and not m.out[i]:
            has_title = has_title or keep[i]
            title = i if i < best and tag[i] == "h1" else title
        if m.mark[i] == 2:
            keep[i] = False
    if title and not has_title:  # the title that stands before the content; an article may have its own in an h2
        keep[title] = True
        for i in range(title + 1, n):
            keep[i] = keep[i] or keep[parent[i]] and m.mark[i] < 2
    return keep, own_kept


def extract(html: str | None) -> str:
    """The main text of a page: its blocks in page order, one a line; empty if there is none."""
    page = Page(html or "")
    keep, own_kept = _content(page)
    lines, line = [], []
    for node, s in page.pieces:
        if node < 0:
            if line:
                lines.append(" ".join("".join(line).split()))
                line = []
        elif keep[node] or own_kept[node]:
            line.append(s)
    lines.append(" ".join("".join(line).split()))
    return "\n".join(x for x in lines if x)


def _run(batches):
    for b in batches:
        for i in range(0, len(b), 500):
            part = b.slice(i, 500)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([extract(h) for h in part.column("html").to_pylist()], pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of each page, from the whole html.

    Null, empty and blank html, and pages with nothing but menus and the like, have an empty text. A page without
    any tags is one block. Repeated rows are extracted each; a null page_id or url stays null. No rows: an empty table.
    Other columns are not read. Nothing is shuffled: each row depends on itself alone."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return src.mapInArrow(_run, "page_id long, url string, text string")
