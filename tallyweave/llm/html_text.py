"""HTML extraction by composite text density.

A page becomes a tree of elements. Parts that are no text of the page (scripts, styles, forms, menus, page headers and
footers, sidebars, adverts, notices, reader comments, by tag, role and the words of class and id) are cut off. Each other
element has a density: its characters for each tag in it, adjusted for links by a logarithm whose base grows with the
share of linked characters, so that link lists come out low. The sum of its children's densities shows where dense
elements stand together: the element with the largest sum is the main text. The least density on the way from it up to
the body is the threshold: outside of it, an element no less dense gives its own subtree of the largest sum to the text. An article or element named so
around the main text is taken whole, and so is a page's only first-level heading.

Text is cut into blocks at block-level elements; character references are decoded, white space inside a block (line breaks
too) becomes one space, and blocks in page order are joined by line breaks. Nothing is dropped for its length. Null and
empty pages, and pages without text, give an empty text. Unclosed and misnested tags are mended as browsers do for the
common cases; whole pages are read, in time that grows with their length. Repeated rows are rows of their own.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import small_batches, table

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: read up to their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in "script style textarea title xmp iframe noembed noframes noscript".split()}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of these ends where one of the tags begins.
_ENDS = {
    "p": _BLOCK - {"body", "caption", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
}
_ENDED_BY = {tag: [name for name, by in _ENDS.items() if tag in by] for tag in frozenset().union(*_ENDS.values())}
#: Beyond these an implied end does not look.
_FENCE = {"p": frozenset("table td th button object caption".split()), "li": frozenset("ul ol menu".split()), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "option": frozenset({"select"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"})}
_IN_HEAD = frozenset("html head title meta link script style base noscript template".split())

_NO_TEXT = frozenset("head script style noscript template iframe object embed applet svg canvas math audio video map form input button select textarea option datalist fieldset label nav aside footer menu dialog noembed noframes title xmp".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
#: Words of class and id for parts beside the text.
_BESIDE = frozenset(
    "ad ads advert advertisement advertising adbox adsense adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond "
    "rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Names made of these words alone mark the text itself; an element with one stays whatever else its class says.
_TEXT = frozenset("article body content entry main post story text".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user)s?['’]?\s+)?(?:comments?|responses?|replies|leave a (?:comment|reply))(?:\s*\(?\d*\)?)?\W*", re.I)


class Page:
    """The elements of a page in order of their start tags; 0 is the root. items: texts and places of child elements."""

    def __init__(self, text: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.items: list[list[str | int]] = [[]]
        self.beside: list[bool] = [False]
        self.header: list[bool] = [False]
        self.article: list[bool] = [False]
        self._open, self._count = [0], Counter({"#root": 1})
        self._read(text)

    def _read(self, text: str) -> None:
        at = 0
        while m := _TOKEN.search(text, at):
            if m.start() > at:
                self._text(text[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                    continue
                self._start(tag, m[3])
                if tag in _RAW and self._open[-1]:
                    close = _RAW[tag].search(text, at)
                    at = close.end() if close else len(text)
                    self._end(tag)
        if at < len(text):
            self._text(text[at:])

    def _text(self, text: str) -> None:
        if self._count["head"] and not text.isspace():
            self._close("head", frozenset())
        self.items[self._open[-1]].append(html.unescape(text))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._count[tag]:
            return
        if self._count["head"] and tag not in _IN_HEAD:
            self._close("head", frozenset())
        for name in _ENDED_BY.get(tag, ()):
            if self._count[name]:
                self._close(name, _FENCE[name])
        me, above = len(self.tag), self._open[-1]
        self.tag.append(tag), self.parent.append(above), self.items.append([])
        self.items[above].append(me)
        beside, header, article = self._kind(tag, attributes)
        self.beside.append(beside), self.header.append(header), self.article.append(article)
        if tag not in _VOID:
            self._open.append(me)
            self._count[tag] += 1

    def _end(self, tag: str) -> None:
        if self._count[tag] and tag not in ("html", "body"):
            # A stray end of an inline element doesn't close the block that it stands in.
            self._close(tag, frozenset() if tag in _BLOCK else _BLOCK)

    def _close(self, tag: str, fence: frozenset[str]) -> None:
        at = len(self._open) - 1
        while at and self.tag[self._open[at]] != tag:
            if self.tag[self._open[at]] in fence:
                return
            at -= 1
        for i in self._open[at:] if at else []:
            self._count[self.tag[i]] -= 1
        if at:
            del self._open[at:]

    def _kind(self, tag: str, attributes: str) -> tuple[bool, bool, bool]:
        """(beside the text, a header, the article itself) by tag, role and the words of class and id."""
        if tag in _NO_TEXT:
            return True, False, False
        article, header = tag in ("article", "main"), tag == "header"
        if "=" not in attributes or tag in ("html", "body", "main"):
            return False, header, article
        values = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        if values.get("role", "").lower() in _NO_ROLE or values.get("aria-hidden", "").lower() == "true":
            return True, False, False
        names = [{w.lower() for w in _WORD.findall(x)} for x in f"{values.get('class', '')} {values.get('id', '')}".split()]
        text = values.get("itemprop", "").lower() == "articlebody" or any(x and x <= _TEXT for x in names)
        words = set().union(*(x for x in names if not x & {"has", "no", "with"}))
        return bool(words & _BESIDE) and not text, header or ("header" in words and not text), article or text

    def ancestors(self, i: int) -> Iterator[int]:
        while i > 0:
            i = self.parent[i]
            yield i


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def _comments(page: Page) -> set[int]:
    """Elements with reader comments: those that a heading which says so opens, or that follow it up to the next such heading."""
    out = set()
    for i, tag in enumerate(page.tag):
        if tag in _HEADINGS and _COMMENTS.fullmatch("".join(x for x in page.items[i] if isinstance(x, str)).strip()):
            above = page.parent[i]
            around = [x for x in page.items[above] if not isinstance(x, str) or x.strip()]
            if page.tag[above] in ("div", "section") and around[0] == i:
                out.add(above)
                continue
            out.add(i)
            for x in around[around.index(i) + 1 :]:
                if not isinstance(x, str):
                    if page.tag[x] in _HEADINGS and page.tag[x] <= tag:
                        break
                    out.add(x)
    return out


def kept_elements(page: Page) -> list[bool]:
    """Whether each element is part of the page proper: not beside it, not in a page header or among reader comments."""
    n = len(page.tag)
    keep, inside = [True] * n, [False] * n  # inside: in an article
    comments = _comments(page)
    for i in range(1, n):
        above = page.parent[i]
        inside[i] = inside[above] or page.article[i]
        keep[i] = keep[above] and not page.beside[i] and not (page.header[i] and not inside[above]) and i not in comments
    return keep


def densities(page: Page, keep: list[bool]) -> tuple[list[float], list[float]]:
    """(composite density, sum of the children's) of each element, over what is kept."""
    n = len(page.tag)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n):
        if keep[i]:
            chars[i] = sum(_length(x) for x in page.items[i] if isinstance(x, str))
    for i in range(n - 1, 0, -1):  # children come after their parents
        if keep[i]:
            if page.tag[i] == "a":
                linked[i], links[i] = chars[i], links[i] + 1
            up = page.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            linked[up] += linked[i]
            links[up] += links[i]
    density, total = [0.0] * n, [0.0] * n
    body_share = linked[0] / max(1, chars[0])
    for i in range(n):
        if keep[i] and chars[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, linked[i]), max(1, links[i])
            base = math.log(c / max(1, c - linked[i]) * linked[i] + body_share * c + math.e)
            # ln(base) is 0 where nothing is linked: the adjustment is at its largest there.
            density[i] = c / t * math.log(max(c / lc * t / lt, 1.0) + 1) / max(math.log(base), 0.1)
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    return density, total


def main_elements(page: Page, keep: list[bool]) -> set[int]:
    """The elements whose whole subtrees are the main text."""
    n = len(page.tag)
    density, total = densities(page, keep)
    best = list(range(n))  # the place of the largest sum in each subtree, the first of equal ones
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if keep[i] and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
            best[up] = best[i]
    top = best[0]
    way = [top, *page.ancestors(top)]
    whole = [i for i in way if page.tag[i] == "article"] or [i for i in way if page.article[i]]
    threshold = min(density[i] for i in way)
    chosen, todo, way = {whole[-1] if whole else top}, [0], set(way)  # the outermost article around it, if any
    while todo:
        i = todo.pop()
        if i in chosen or not keep[i]:
            continue
        if i not in way and density[i] >= threshold > 0:
            chosen.add(best[i])
            if best[i] == i:
                continue
        todo.extend(x for x in page.items[i] if not isinstance(x, str))
    titles = [i for i in range(n) if page.tag[i] == "h1" and keep[i]]
    return chosen | set(titles) if len(titles) == 1 else chosen


def blocks(page: Page, keep: list[bool], chosen: set[int]) -> list[str]:
    """Texts of the chosen subtrees, cut at block-level elements, in page order."""
    out, part = [], []

    def cut() -> None:
        if text := " ".join("".join(part).split()):
            out.append(text)
        part.clear()

    todo: list[tuple[str | int, bool]] = [(0, False)]
    while todo:
        item, on = todo.pop()
        if isinstance(item, str):
            if on:
                part.append(item)
        elif item < 0:
            cut()
        elif keep[item]:
            on = on or item in chosen
            if page.tag[item] == "br":
                part.append("\n")
            if page.tag[item] in _BLOCK:
                cut()
                todo.append((-1, on))
            todo.extend((x, on) for x in reversed(page.items[item]))
    cut()
    return out


def main_text(source: str | None) -> str:
    """The main text of a page: its blocks joined by line breaks."""
    if not source:
        return ""
    page = Page(source)
    keep = kept_elements(page)
    return "\n".join(blocks(page, keep, main_elements(page, keep)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with the columns text and n_chars in place of any of these names, and without the html."""
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*rest, F.col(html_col).alias("__html"))
    schema = rows.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s) for s in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return rows.mapInArrow(read, schema)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
