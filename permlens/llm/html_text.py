"""Operator 6: main text of web pages by composite text density.

A page becomes a tree. Elements that are never article text (scripts, styles, forms, menus, page headers and footers, sidebars, adverts,
notices, reader comments; by element, role, or a whole word of class or id) are cut. Ids of headings and sections, and of all that stands in
an article, main or heading, are often slugs of their text, so of these only a whole id counts, on elements that group others. So it is with
classes in an article, main or heading and on paragraphs: only a class that is a listed name (or one with words for boxes) cuts; of other
elements that group, those with a listed word in a class go where they hold no heading and their density is below the threshold. Lists
of links are cut as menus outside an article or main. For every remaining element the composite text density is characters per tag, adjusted for the share of link characters against the whole body's. The element whose children's densities
have the largest sum holds the article; the smallest density on its path to the body is the threshold that other parts along the path
must reach to belong to it too. An article or main element around the chosen one is taken whole.

Extraction is per page, without a shuffle, and without recursion, so depth and length of a page do not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.llm.common import Out, rows, text_of

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CUT = RAW | set("head nav aside footer form header button select option input menu dialog object embed canvas audio video map".split())
CUT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended pagination pager widget toolbar login search skip "
    "copyright disclaimer hidden".split()
)
ARTICLE_NAMES = set("comment comments ad ads advert sponsored related".split())
BOXES = set(
    "area bar block box button buttons container cta form group holder icon icons inner item items label link links list outer panel post posts reader row section "
    "site slot thread top bottom left right unit user wrap wrapper".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SLUGGED = HEADINGS | {"section", "article"}
PROSE = HEADINGS | {"p", "blockquote", "pre"}
GROUPS = set("article center details div dl figure ol section table ul".split())
CLOSES = {  # an open element that ends where one of these begins
    "p": BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "li", "dd", "dt", "legend", "summary", "figcaption"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
SCOPE = set("table td th ul ol dl article section main div body html blockquote figure caption".split())  # an implied end does not reach beyond

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+/?>|[^>]*>)""",
    re.S,
)
UNENDED = re.compile("<[a-zA-Z/!?]")  # after the last >
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[\s_\-:]+")
NUMBER = re.compile(r"[\s_\-:]*\d+$")  # ad-1
MENU_LINKS, MENU_SHARE = 2, 0.9  # a list of at least so many links that make up so much of it is a menu


class Page:
    """Elements in page order, each after its parent, and the texts between them."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.cut, self.doubtful = ["#root"], [0], [False], [False]
        self.slugs = [False]  # whether ids inside the element are taken for slugs of text
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, position = [0], 0, 0
        last = source.rfind(">") + 1  # no tag ends beyond
        while found := TOKEN.search(source, position, last):
            if found.start() > at:
                self._text(stack[-1], source[at : found.start()])
            at = position = found.end()
            end, start = found.group(1), found.group(2)
            if found.group().startswith("<!--") and not found.group().endswith(("-->", "--!>")):
                return  # a comment without an end hides the rest
            if start:
                tag = start.lower()
                self._open(stack, tag, found.group(3))
                if tag in RAW and not found.group(3).endswith("/>"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = position = close.end() if close else len(source)
                    stack.pop()
            elif end:
                self._close(stack, end.lower())
        if at < len(source):
            cut = UNENDED.search(source, at)
            self._text(stack[-1], source[at : cut.start() if cut else len(source)])

    def _text(self, element: int, text: str) -> None:
        self.events.append((element, html.unescape(text) if "&" in text else text))

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        tags = self.tag
        for i in range(len(stack) - 1, 0, -1):
            open_tag = tags[stack[i]]
            if tag in CLOSES.get(open_tag, ()):
                del stack[i:]
                break
            if open_tag in SCOPE:
                break
        number = len(tags)
        tags.append(tag)
        self.parent.append(stack[-1])
        slugs = self.slugs[stack[-1]]
        verdict = CUT_OUT if tag in CUT else _named_out(tag, attributes, slugs) if len(attributes) > 6 else KEEP
        self.cut.append(verdict == CUT_OUT)
        self.doubtful.append(verdict == DOUBTFUL)
        self.slugs.append(slugs or tag in HEADINGS or tag in ("article", "main"))
        if tag in BLOCK:
            self.events.append((number, None))
        elif tag == "br":
            self.events.append((stack[-1], " "))
        if tag not in VOID and not (attributes.endswith("/>") and tag in RAW):
            stack.append(number)

    def _close(self, stack: list[int], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[i]]
            if open_tag == tag:
                if tag in BLOCK:
                    self.events.append((self.parent[stack[i]], None))
                del stack[i:]
                return
            if open_tag in BLOCK and tag not in BLOCK:
                return


KEEP, CUT_OUT, DOUBTFUL = 0, 1, 2


def _plain_name(token: str, names: set[str]) -> bool:
    """Whether a class is a listed name, or listed names with words for boxes around them (`share-buttons`, `ad-1`)."""
    parts = [p for p in NAME_PARTS.split(NUMBER.sub("", token)) if p]
    return "-".join(parts) in names or not names.isdisjoint(parts) and names.union(BOXES).issuperset(parts)


def _named_out(tag: str, attributes: str, slugs: bool) -> int:
    """What an element's id, class, role and style say of it. Class words are slugs of text too where they stand in an article, and on headings
    and paragraphs; there only a class that is nothing but a name counts, and the density decides the other elements that group others."""
    if tag in ("html", "body", "article", "main"):
        wanted = ARTICLE_NAMES if tag == "article" else set()
    else:
        wanted = CUT_NAMES
    verdict = KEEP
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "").lower()
        name = name.lower()
        if name == "id" and (slugs or tag in SLUGGED):
            if tag in GROUPS and NUMBER.sub("", value.strip()) in wanted:
                return CUT_OUT
        elif name in ("class", "id"):
            if wanted.isdisjoint(NAME_PARTS.split(value)):
                continue
            if tag in PROSE or slugs and tag not in GROUPS:
                if all(_plain_name(t, wanted - {"header"}) for t in value.split()):
                    return CUT_OUT
            elif not slugs and tag != "article" or any(_plain_name(t, wanted - {"header"}) for t in value.split()):
                return CUT_OUT
            elif tag != "article":
                verdict = DOUBTFUL
        elif name == "role" and value in CUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return CUT_OUT if tag not in ("html", "body") else KEEP
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return CUT_OUT
    return verdict


def extract(source: str | None) -> str:
    """The article's blocks in page order, one per line."""
    if not source:
        return ""
    page = Page(source)
    tag, parent, events = page.tag, page.parent, page.events
    n = len(tag)
    inside = list(range(n))  # the nearest article or main that is not cut, else the element itself
    kept = [True] * n
    has_head, in_article = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        has_head[i] = has_head[i] or tag[i] in ("h1", "article", "main") and not page.cut[i]
        has_head[parent[i]] = has_head[parent[i]] or has_head[i]
    for i in range(1, n):
        p = parent[i]
        in_article[i] = in_article[p] or tag[i] in ("article", "main")
        cut = page.cut[i]
        if cut and has_head[i] and tag[i] not in CUT:
            cut = False  # a wrapper named after what it also holds
        if cut and tag[i] == "header" and in_article[p]:
            cut = not has_head[i]  # the article's own title
        kept[i] = kept[p] and not cut
        inside[i] = inside[p] if tag[inside[p]] in ("article", "main") else i
    own = [0] * n  # characters that are not white space
    for e, text in events:
        if text and kept[e]:
            own[e] += len(text) - text.count(" ") - text.count("\n")
    chars, links, tags, link_tags = own[:], [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not kept[i]:
            continue
        if tag[i] == "a":
            links[i], link_tags[i] = chars[i], link_tags[i] + 1
        if tag[i] in ("ul", "ol", "dl", "table") and not in_article[i] and link_tags[i] >= MENU_LINKS and links[i] >= MENU_SHARE * chars[i]:
            kept[i] = False
            continue
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i]
    for i in range(1, n):
        kept[i] = kept[i] and kept[parent[i]]
    share = links[0] / max(1, chars[0])

    def density(i: int) -> float:
        c, t = chars[i], max(1, tags[i])
        if not c:
            return 0.0
        base = math.log(c / max(1, c - links[i]) * links[i] + share * c + math.e)
        value = c / max(1, links[i]) * t / max(1, link_tags[i])
        return c / t * (math.log(value) / math.log(base) if base > 1 + 1e-9 and value > 0 else math.log(value) if value > 0 else 0.0)

    densities = [density(i) if kept[i] else 0.0 for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if kept[i]:
            sums[parent[i]] += densities[i]
    best = max(range(n), key=lambda i: (sums[i], -i))
    if not sums[best]:
        best = 0
    path, threshold, i = {best}, densities[best], best
    while i:
        i = parent[i]
        if tag[i] not in ("#root", "html"):
            threshold = min(threshold, densities[i])
        path.add(i)
    if any(page.doubtful):
        headed = [t in HEADINGS for t in tag]
        for i in range(n - 1, 0, -1):
            headed[parent[i]] = headed[parent[i]] or headed[i]
        for i in range(1, n):
            thin = page.doubtful[i] and not headed[i] and i not in path and densities[i] < threshold
            kept[i] = kept[i] and kept[parent[i]] and not thin
    whole = inside[best] if tag[inside[best]] in ("article", "main") else best
    taken = [False] * n
    taken[0] = whole == 0
    for i in range(1, n):
        p = parent[i]
        beside = whole == best and p in path and i not in path and (densities[i] >= threshold or tag[i] in HEADINGS)
        taken[i] = kept[i] and (taken[p] or i == whole or beside)
        if whole == best and i in path:
            taken[i] = taken[i] or tag[i] in HEADINGS
    own_text = {p for p in path if p != 0 and whole == best}  # loose text of the elements on the path
    blocks, held = [], []
    for e, text in [*events, (0, None)]:
        if text is None:
            if held:
                if block := " ".join("".join(held).split()):
                    blocks.append(block)
                held = []
        elif taken[e] or e in own_text and kept[e]:
            held.append(text)
    return "\n".join(blocks)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points). A null or empty page has an empty text; null ids and urls stay null;
    repeated rows give repeated rows; other columns are not looked at; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(TEXTS)
        for page_id, url, source in rows(batches, "page_id", "url", "html"):
            text = extract(source)
            if out.add(page_id, url, text, len(text), weight=len(text)):
                yield out.take()
        yield from out.rest()

    wanted = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), text_of(html_column).alias("html"))
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")
