"""The main text of web pages by tree scoring.

Each page is read into a tree of its blocks.  Paragraphs earn points for their length and their commas, less the
share of their text that stands in links, and pass them on: all to their parent, half to the grandparent, and less to
three blocks above that.  A block's score is what it was passed and what its tag and names are worth, less the share of links
in all its text.  The best block is the container; if it is part of an ``article`` or ``main`` element, that element is, else
its siblings are kept that score a fifth of it or that are paragraphs of text themselves.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go before the scores:
elements that are such by their tag, role, or a word of their class or id, and hidden ones.  A block that is so by a name or
is a form but holds most of the page's points is a wrapper and stays, unless it is one of comments, adverts and the like.  Lists of links inside
the container go as well.  Of a header inside an article the headings stay.

Texts: character references are decoded, runs of white space (line breaks, no-break spaces) in a block become one space, blocks follow in page order with one
space between, and nothing is cut.

Defined results: null, empty and text-free pages give an empty text; broken markup (unclosed or stray tags, quotes, comments)
is read as far as it goes; repeated rows are read alike; ties go to the first block of the page; an empty table gives an
empty one; columns may have any name, those that clash with the added ones are replaced.  All steps are linear in the page; blocks more than ``DEEPEST``
levels down are read as siblings.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, own_columns, unboxed
from .periods import sliced

DEEPEST, ODD_TAGS = 256, 64
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|$)")
OTHER = re.compile(r"<[!?/][^>]*+(?:>|$)")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; none of it is page text.
RAW = set("script style title textarea iframe xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {f"h{i}" for i in range(1, 7)}
GONE_TAGS = set(
    "aside audio button canvas datalist dialog footer header menu nav noscript object optgroup option search select svg template video".split()
)
GONE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tablist".split())
#: Words of class and id names of what goes even if it holds most of the page, and of what may turn out to be a wrapper.
GONE_NAMES = set(
    "ad ads adbox adsbygoogle adsense adslot adunit advert adverts advertisement advertising adwrap breadcrumb breadcrumbs captcha comment commentlist comments consent cookie cookies dfp disqus "
    "copyright footer gdpr lightbox login masthead menu modal nav navbar navigation navigations newsletter outbrain overlay pager paginate pagination paywall popular popup promo promoted promotion promotions reactions related "
    "replies reply respond skip share shares sharing signin signup search searchbox searchform social sponsor sponsored sponsors subscribe subscription taboola tagcloud topbar trending".split()
)
#: How such words begin or end when they are written as one.
GONE_ENDS, GONE_STARTS = ("nav", "menu", "footer", "comments"), ("advert", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "sponsor")
DOUBTFUL_NAMES = set(
    "alert aside banner bottombar header notice notices notification notifications rail recommended recommendations sidebar sidebars sitemap toolbar widget widgets".split()
)
GOOD_NAMES = set("article articlebody body content entry hentry main page post prose story text".split())
NOT_SUCH = set("enabled has no open with without".split())
#: In compounds of these the other word says only what it belongs to.
HEADER_WORDS = {"header", "heading", "headline", "title"}
SITE_WORDS = {"main", "page"}
#: What a tag is worth to a container.
WORTH = {"article": 25, "main": 25, "div": 5, "section": 3, "td": 3, "pre": 3, "blockquote": 3, "form": -3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5}
#: Blocks whose own text is a paragraph of their parent; the own text of any other block is one of that block.
PARAGRAPHS = {"p", "pre", "blockquote", "li", "dd", "dt", "figcaption", "address", "summary", "caption"}
KEPT, GONE, DOUBTFUL = range(3)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
WALLS = {"td", "th", "caption", "table"}
TABLE_PARTS = WALLS | {"tr", "tbody", "thead", "tfoot"}


def _fate(tag: str, given: str) -> tuple[int, int, bool]:
    """(fate, worth, holds article) of an element by its tag and attributes."""
    worth, fate, body = WORTH.get(tag, 0), GONE if tag in GONE_TAGS else DOUBTFUL if tag == "form" else KEPT, tag in ("article", "main")
    if not given or tag in ("html", "body"):
        return fate, worth, body
    attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(given)}
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return GONE, worth, False
    role = attributes.get("role", "").lower()
    if role in GONE_ROLES:
        return GONE, worth, False
    if role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower():
        worth, body = worth + 25, True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if words & NOT_SUCH:
            continue
        good = words & GOOD_NAMES
        if good:
            worth += 25
            if words & HEADER_WORDS and not words & SITE_WORDS:
                continue
        gone = words & GONE_NAMES or any(w.endswith(GONE_ENDS) or w.startswith(GONE_STARTS) for w in words)
        if gone and tag != "main":
            if not good or NAME_WORD.findall(name)[-1].lower() not in good:
                return GONE, worth, False
            fate, body = max(fate, DOUBTFUL) if fate != GONE else GONE, False
        if (words & DOUBTFUL_NAMES or any(w.startswith("sidebar") for w in words)) and not body:
            fate, worth = max(fate, DOUBTFUL) if fate != GONE else GONE, worth - 25
    return fate, worth, body


class Page:
    """The blocks of one page in page order; lists hold one entry for each."""

    def __init__(self, source: str):
        self.tags, self.parents, self.fates, self.worths, self.bodies = ["html"], [-1], [KEPT], [0], [False]
        self.items: list[list[str | int | None]] = [[]]  # texts, blocks, and None for a break
        self.own, self.linked, self.links, self.commas = [0], [0], [0], [0]
        self._read(source)

    def _opened(self, tag: str, parent: int, given: str) -> int:
        fate, worth, body = _fate(tag, given)
        node = len(self.tags)
        for column, value in ((self.tags, tag), (self.parents, parent), (self.fates, fate), (self.worths, worth), (self.bodies, body), (self.items, []), (self.own, 0), (self.linked, 0), (self.links, 0), (self.commas, 0)):
            column.append(value)
        self.items[parent].append(node)
        return node

    def _read(self, source: str) -> None:
        stack, tags, at, odd, link = [0], self.tags, 0, 0, 0  # link: the depth at which a link was opened
        inline: set[str] = set()  # inline elements that were read as blocks, as they go
        n = len(source)
        while at < n:
            mark = source.find("<", at)
            if mark != at:
                self._text(source[at : mark if mark >= 0 else n], stack[-1], link)
                if mark < 0:
                    break
            if source.startswith("<!--", mark):
                stop = source.find("-->", mark + 2)
                at = stop + 3 if stop >= 0 else n
                continue
            found = TAG.match(source, mark) if odd < ODD_TAGS else None
            if found is None:
                found = LOOSE_TAG.match(source, mark)
                odd += found is not None
            if found is None:
                other = OTHER.match(source, mark)
                if other is None:
                    self._text("<", stack[-1], link)
                at = other.end() if other else mark + 1
                continue
            at = found.end()
            closing, tag, given = found[1], found[2].lower(), found[3]
            if tag in ("br", "hr"):
                self.items[stack[-1]].append(None)
            elif tag == "a":
                link = len(stack) if not closing and "href" in given.lower() else 0
                self.links[stack[-1]] += link > 0
            elif closing:
                if tag in BLOCKS or tag in GONE_TAGS or tag in inline:
                    closed = self._close(stack, {tag}, set() if tag in TABLE_PARTS else WALLS)
                    if tag == "p" and not closed:
                        self.items[stack[-1]].append(None)
            elif tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                at = stop.start() if stop else n if tag in ("script", "style") else at
            elif tag not in VOID and tag not in ("html", "body", "head"):
                if tag in BLOCKS:
                    self._close_paragraph(stack)
                    if tag in CLOSES:
                        while self._close(stack, *CLOSES[tag]):
                            pass
                elif tag not in GONE_TAGS:
                    if not given or _fate(tag, given)[0] != GONE:
                        continue
                    inline.add(tag)
                node = self._opened(tag, stack[-1], given)
                if len(stack) < DEEPEST and (tag in BLOCKS or not given.endswith("/")):
                    stack.append(node)
            if len(stack) < link:
                link = 0

    def _close_paragraph(self, stack: list[int]) -> None:
        depth = len(stack) - 1
        while self.tags[stack[depth]] not in BLOCKS:
            depth -= 1
        if self.tags[stack[depth]] == "p":
            del stack[depth:]

    def _close(self, stack: list[int], names: set[str], walls: set[str]) -> bool:
        """Close the innermost element of these names, and all in it, unless a wall stands before it."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in names:
                del stack[depth:]
                return True
            if tag in walls:
                return False
        return False

    def _text(self, text: str, node: int, link: int) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.items[node].append(text)
        size = len(text.strip()) if len(text) < 200 else len(text)
        self.own[node] += size
        self.commas[node] += text.count(",") + text.count("，") + text.count("、") + text.count("،")
        if link:
            self.linked[node] += size

    def decide(self) -> None:
        """Settle which blocks go, from the names and the points they hold."""
        n, parents = len(self.tags), self.parents
        self._spread()
        held = [0.0 if g else self.points(i) for i, g in enumerate(self.gone)]
        for i in range(n - 1, 0, -1):
            held[parents[i]] += held[i]
        for i in range(1, n):
            if self.fates[i] == DOUBTFUL and 2 * held[i] <= held[0]:
                self.fates[i] = GONE
        self._spread()

    def _spread(self) -> None:
        """What goes takes all in it along, but for the headings of a header inside an article."""
        n, parents, tags = len(self.tags), self.parents, self.tags
        self.gone, self.headers, inside = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = parents[i]
            inside[i] = inside[up] or self.bodies[i]
            if self.headers[up]:
                self.headers[i] = tags[i] in ("header", "hgroup", "div") and self.fates[i] == KEPT
                self.gone[i] = tags[i] not in HEADINGS or self.fates[i] == GONE
            else:
                self.gone[i] = self.gone[up] or self.fates[i] == GONE
                self.headers[i] = tags[i] == "header" and inside[up] and not self.gone[up]

    def points(self, node: int) -> float:
        """What the own text of a block is worth as a paragraph."""
        size, tag = self.own[node], self.tags[node]
        if not size or tag in HEADINGS or tag == "th":
            return 0.0
        return (min(size / 25, 1.0) + min(size / 100, 3.0) + self.commas[node]) * (1 - self.linked[node] / size)

    def container(self) -> int:
        """The block of the best score; its score, links and text sizes stay for the siblings."""
        n, parents = len(self.tags), self.parents
        passed = [0.0] * n
        for i in range(n):
            if self.gone[i] or not (p := self.points(i)):
                continue
            at = parents[i] if self.tags[i] in PARAGRAPHS and i else i
            for level in range(5):
                passed[at] += p / (1 if level == 0 else 2 if level == 1 else 3 * level)
                at = parents[at]
                if at < 0:
                    break
        self.size = [0 if g else s for s, g in zip(self.own, self.gone, strict=True)]
        self.in_links = [0 if g else s for s, g in zip(self.linked, self.gone, strict=True)]
        self.n_links = [0 if g else s for s, g in zip(self.links, self.gone, strict=True)]
        for column in (self.size, self.in_links, self.n_links):
            for i in range(n - 1, 0, -1):
                column[parents[i]] += column[i]
        self.scores = [(p + self.worths[i]) * (1 - self.in_links[i] / max(1, self.size[i])) if p and not self.gone[i] else 0.0 for i, p in enumerate(passed)]
        self.passed = passed
        best = max(range(n), key=lambda i: (passed[i] > 0 and not self.gone[i], self.scores[i]))
        if not passed[best]:
            best = next((i for i in range(1, n) if self.bodies[i] and not self.gone[i]), 0)
        return best

    def kept(self) -> list[int]:
        """The blocks whose text is the page's."""
        best = self.container()
        at = best
        while at > 0 and not self.bodies[at]:
            at = self.parents[at]
        if at > 0:
            return [at]
        if best == 0:
            return [0]
        parent, out = self.parents[best], []
        for i in self.items[parent]:
            if isinstance(i, int) and not self.gone[i] and self._goes_with(i, best, parent):
                out.append(i)
        return out

    def _goes_with(self, node: int, best: int, parent: int) -> bool:
        if node == best or self.tags[node] in HEADINGS and self.size[node] > 2 * self.in_links[node]:
            return True
        alike = self.tags[node] == self.tags[best] and self.worths[node] == self.worths[best]
        if self.scores[node] > 0 and self.passed[node] >= max(2.0, 0.0 if alike else 0.2 * self.passed[best]):
            return True
        density = self.in_links[node] / max(1, self.size[node])
        if self.tags[node] not in PARAGRAPHS and self.tags[node] not in ("ul", "ol", "table", "figure"):
            return False
        return self.size[node] > 80 and density < 0.25 or parent > 0 and density == 0 and self.size[node] > 0

    def text(self) -> str:
        self.decide()
        tops = self.kept()
        out: list[str] = []
        line: list[str] = []
        for top in tops:
            todo: list[tuple[int, int]] = [(top, 0)]
            while todo:
                node, k = todo.pop()
                items, silent = self.items[node], self.gone[node]
                while k < len(items):
                    item = items[k]
                    k += 1
                    if isinstance(item, str):
                        if not silent:
                            line.append(item)
                        continue
                    if line and (item is None or self.tags[item] in BLOCKS):
                        out.append(" ".join("".join(line).split()))
                        line = []
                    if item is not None and (not self.gone[item] and not self._is_menu(item) or self.headers[item]):
                        todo.append((node, k))
                        node, k, items, silent = item, 0, self.items[item], self.gone[item]
                if line:
                    out.append(" ".join("".join(line).split()))
                    line = []
        return " ".join(x for x in out if x)

    def _is_menu(self, node: int) -> bool:
        """A list or box that is links, three or more, and little else."""
        if self.tags[node] not in ("ul", "ol", "dl", "div", "section", "table") or self.n_links[node] < 3:
            return False
        return self.in_links[node] >= 0.8 * self.size[node] and self.size[node] < 60 * self.n_links[node]


def main_text(source: str) -> str:
    """The main text of one page."""
    return Page(source.replace("\0", "")).text() if source else ""


def main_texts(df: DataFrame, source: str = "html") -> DataFrame:
    """df with text (its page's main text) and n_chars (the text's code points) added."""
    own = own_columns(df, "text", "n_chars")
    keyed = boxed(df, own, page=F.col(f"`{source}`"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                texts = [main_text(page.as_py() or "") for page in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])

    schema = T.StructType([keyed.schema["row"]]).add("text", "string").add("n_chars", "long")
    return keyed.mapInArrow(extracted, schema).select(*unboxed(own), "text", "n_chars")
