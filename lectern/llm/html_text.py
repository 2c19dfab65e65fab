"""Main text of HTML pages by line-block distribution.

The markup is stripped into lines, one for each block of text.  Scripts, controls, embedded media and
hidden elements give no lines, nor do lists made of links.

Menus, footers, sidebars, notices, adverts, forms, reader comments and the like, known by tag, role or name, only make
their lines suspect; like siblings are judged together, the heaviest first.  They are cleared when the articles in them
hold more text than those outside, or when, in a page or article that has no other article, they outweigh the
text that is not suspect.  Comments, adverts, notices and the like are then only cleared if nothing but headings is left, or if
they hold the page's headline; menus and the like known by their tag only if nothing but headings is left.

The text lengths of the other lines, links not counted, are summed over a sliding window of lines: where the sum
surges the main text begins, where it dives it ends.  The heaviest stretch between a surge and a dive
shows which element holds the article; it is widened to elements around it, and to like siblings, as long as what they add
is mostly text of further stretches or headings.  All lines of that element are the main text, so short first and last
lines stay.  Only when no element but the page itself holds the stretch, the text is cut at the surge and the dive.

Inside a block all white space, line breaks too, becomes one space.

Reading is linear in a page's length: at most DEPTH elements are open at once, deeper ones count as parts of the last.

Defined cases: null or empty html, and pages without text, give an empty text; cut-off pages,
unclosed and stray tags and marked sections are read as browsers do, roughly; a null id or url is kept; rows that
repeat are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that are summed, and the length that a sum must reach (or half of the largest sum).
WINDOW, SURGE = 3, 86

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head title script style noscript template button select textarea input "
                    "iframe object canvas svg math audio video map datalist".split())
STRONG = frozenset("nav footer aside menu dialog".split())
SUSPECT = STRONG | frozenset("form fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
HOLDERS = frozenset("article main section div td body blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that mark what is no text of the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
                  "menu menubar breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar header comment comments "
                  "commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification alert popup "
                  "modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing "
                  "social widget widgets toolbar pagination pager skip form search copyright disclaimer".split())
#: Names of what others than the author add: it is never the article beside other text, however long, unless it holds the headline.
ADDED = frozenset("comment comments commentlist disqus respond replies reply ad ads advert adverts advertisement advertising sponsor "
                  "sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
                  "newsletter subscribe subscription signup".split())
#: Elements that may be open at once; deeper ones count as parts of the last, as in browsers.
DEPTH = 512


def _dropped(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marks(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> frozenset[str]:
    """Tag, role and parts of names that make an element suspect; headers only outside of articles."""
    if tag in ("html", "body", "article", "main"):
        return frozenset()
    marks = {tag} & (SUSPECT | {"header"})
    for name, value in attrs:
        value = (value or "").lower()
        if name == "role" and value in ROLES:
            marks.add("role")
        if name in ("class", "id"):
            marks |= NAMES.intersection(re.split(r"[^a-z]+", value))
    return frozenset(marks - {"header"} if in_article else marks)


class Line:
    __slots__ = ("parts", "linked", "path", "size")

    def __init__(self, path: tuple[int, ...]):
        self.parts: list[str] = []
        self.linked = self.size = 0
        self.path = path

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Lines(HTMLParser):
    """The lines of a page, each with the elements that hold it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: (tag, number, whether dropped), how many there are of each tag, and their numbers.
        self.open: list[tuple[str, int, bool]] = []
        self.counts: Counter[str] = Counter()
        self.path: tuple[int, ...] | None = ()
        self.tags: list[str] = []
        #: By number of an element: its tag and class.
        self.kinds: list[tuple[str, str]] = []
        #: By number of an element: tag, role and name parts that make it suspect, and whether its tag does.
        self.marks: dict[int, tuple[frozenset[str], bool]] = {}
        self.dropped = self.links = 0
        self.lines: list[Line] = []
        self.line: Line | None = None

    def parse_marked_section(self, i, report=1):
        """``<![`` of any kind is a comment up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.line = None
            if self.counts["p"] and tag not in ("body", "html"):
                self._close("p")
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self._close(tag, within=("ul", "ol", "dl", "table", "select"))
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID or len(self.open) >= DEPTH:
            return
        drop = _dropped(tag, attrs)
        if marks := _marks(tag, attrs, any(self.counts[t] for t in MAIN)):
            self.marks[len(self.tags)] = marks, tag in STRONG
        self.dropped += drop
        self.links += tag == "a"
        self.open.append((tag, len(self.tags), drop))
        self.counts[tag] += 1
        self.path = None
        self.tags.append(tag)
        self.kinds.append((tag, dict(attrs).get("class") or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.line = None
            self._close(tag)
        else:  # never past the block it stands in
            self._close(tag, within=BLOCK)

    def _close(self, tag: str, within=()) -> None:
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for t, _, drop in self.open[i:]:
                    self.dropped -= drop
                    self.links -= t == "a"
                    self.counts[t] -= 1
                del self.open[i:]
                self.path = None
                self.line = None if tag in BLOCK else self.line
                return
            if self.open[i][0] in within:
                return

    def handle_data(self, data):
        if self.dropped:
            return
        if self.line is None:
            if not data.strip():
                return
            if self.path is None:
                self.path = tuple(n for _, n, _ in self.open)
            self.line = Line(self.path)
            self.lines.append(self.line)
        self.line.parts.append(data)
        self.line.linked += len(data.strip()) if self.links else 0


def _stretches(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, weight): the lines between a surge of the window sums and the next dive."""
    sums = [sum(sizes[i:i + WINDOW]) for i in range(len(sizes))]
    least = min(SURGE, max(sums) / 2)
    found, start = [], None
    for i, s in enumerate([*sums, -1]):
        if start is None and s >= least and s > 0:
            start = i
        elif start is not None and s < least:
            while not sizes[start]:  # links that the window saw before the text
                start += 1
            found.append((start, i, sum(sizes[start:i])))
            start = None
    return found


def main_text(html: str | None) -> str:
    parser = Lines()
    html = html or ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"</?[a-zA-Z!]", html[cut:cut + 3]):
        html = html[:cut]  # a tag that the page's end cuts off
    parser.feed(html)
    parser.close()
    tags, lines = parser.tags, []
    lists: dict[int, list[Line]] = {}
    for line in parser.lines:
        if own := [n for n in line.path if tags[n] in ("ul", "ol")]:
            lists.setdefault(own[0], []).append(line)
    menus = {n for n, own in lists.items()
             if len(own) > 1 and all(x.linked >= 0.9 * len("".join(x.text().split())) for x in own)}
    for line in parser.lines:
        if menus.isdisjoint(line.path) and (text := line.text()):
            line.size = max(0, len(text) - line.linked)
            lines.append(line)
    suspect = _still_suspect(parser, lines)
    lines, every = [x for x in lines if suspect.isdisjoint(x.path)], lines
    if not lines:
        return ""
    stretches = _stretches([x.size for x in lines]) if any(x.size for x in lines) else []
    if not stretches:
        held = [x for x in lines if any(tags[n] in MAIN for n in x.path)]
        return "\n".join(x.text() for x in held or lines)
    first, last, weight = max(stretches, key=lambda s: s[2])
    holder = _holder(tags, lines[first:last], weight)
    texts = [x for a, b, _ in stretches for x in lines[a:b]]
    if holder is not None:
        holder = _widened(tags, lines, texts, holder)
        headers = {n for n in suspect if parser.marks[n][0] == {"header"}
                   and any(n in x.path and not x.linked and HEADINGS.intersection(tags[m] for m in x.path) for x in every)}
        lines = [x for x in every if suspect.isdisjoint(x.path) or holder in x.path and suspect.intersection(x.path) <= headers]
        inside = [i for i, x in enumerate(lines) if holder in x.path]
        first, last = inside[0], inside[-1] + 1
        around = _stretches([x.size for x in lines])
        stretches = [(a, min(b, first)) for a, b, _ in around if a < first] + [(max(a, last), b) for a, b, _ in around if b > last]
    else:
        stretches = [(a, b) for a, b, _ in stretches]
    kinds = [_kind(parser, x) for x in lines]
    own = kinds[first]
    if holder is None or own is not None and own[0] == holder and tags[holder] not in MAIN:  # alone under the page
        alike = sorted((a, b) for a, b in stretches
                       if (k := kinds[max(range(a, b), key=lambda i: lines[i].size)]) == own or k and own and k[1] == own[1])
        for a, b in alike:
            if a >= last and sum(len(x.text()) for x in lines[last:a]) <= sum(x.size for x in lines[a:b]):
                last = b
        for a, b in reversed(alike):
            if b <= first and sum(len(x.text()) for x in lines[b:first]) <= sum(x.size for x in lines[a:b]):
                first = a
    return "\n".join(x.text() for x in lines[first:last])


def _still_suspect(parser: Lines, lines: list[Line]) -> set[int]:
    """Elements whose marks hold: neither do they hold the page's article nor most of its text."""
    tags = parser.tags
    groups: dict = {}
    sizes: dict = {}
    for line in lines:
        in_article = line.size if any(tags[n] in MAIN for n in line.path) else 0
        for i, n in enumerate(line.path):
            if n in parser.marks:
                key = line.path[:i], parser.kinds[n], parser.marks[n]
                groups.setdefault(key, set()).add(n)
                size = sizes.setdefault(key, [0, 0, False])
                size[0] += line.size
                size[1] += in_article
                size[2] |= any(tags[m] == "h1" for m in line.path[i:])
    suspect = set().union(*groups.values())
    rests: dict = {}

    def rest(article: int | None) -> tuple[int, int, int]:
        """Unsuspected text: all, of articles, and without headings."""
        if article not in rests:
            clean = [x for x in lines if suspect.isdisjoint(x.path) and (article is None or article in x.path)]
            rests[article] = (sum(x.size for x in clean), sum(x.size for x in clean if any(tags[n] in MAIN for n in x.path)),
                              sum(x.size for x in clean if not any(tags[n] in HEADINGS for n in x.path)))
        return rests[article]

    for key in sorted(groups, key=lambda k: (-sizes[k][0], len(k[0]))):
        path, _, (marks, by_tag) = key
        if not suspect.isdisjoint(path):
            continue  # inside of what is suspect
        size, in_articles, headline = sizes[key]
        article = next((n for n in reversed(path) if tags[n] in MAIN), None)
        other, other_articles, no_headings = rest(article)
        if article is None and (in_articles or other_articles):
            cleared = in_articles > other_articles
        elif by_tag:
            cleared = size >= SURGE and not no_headings
        elif marks & ADDED:
            cleared = headline and size > other or not no_headings
        else:
            cleared = size > other and (size >= SURGE or not other)
        if cleared:
            suspect -= groups[key]
            rests.clear()
    return suspect


def _holder(tags: list[str], core: list[Line], weight: int) -> int | None:
    """The element, below the page, that holds the core, or the article that holds most of it."""
    shared = set(core[0].path).intersection(*[x.path for x in core[1:]])
    holders = [n for n in core[0].path if n in shared and tags[n] in HOLDERS and tags[n] != "body"]
    if named := [n for n in holders if tags[n] in MAIN]:
        return named[-1]
    sizes: dict[int, int] = {}
    for line in core:
        for n in line.path:
            if tags[n] in MAIN:
                sizes[n] = sizes.get(n, 0) + line.size
    most = [n for n, size in sizes.items() if 2 * size > weight]
    return max(most) if most else holders[-1] if holders else None


def _widened(tags: list[str], lines: list[Line], texts: list[Line], holder: int) -> int:
    """The outermost element around the holder that adds mostly stretches and headings to it."""
    texts = set(map(id, texts))
    path = next(x.path for x in lines if holder in x.path)
    in_main = any(tags[n] in MAIN for n in path[:path.index(holder) + 1])
    for outer in reversed(path[:path.index(holder)]):
        if tags[outer] not in HOLDERS or tags[outer] == "body":
            continue
        added = [x for x in lines if outer in x.path and holder not in x.path]
        if in_main and not any(tags[n] in MAIN for n in path[:path.index(outer) + 1]):
            if not all(any(tags[n] in MAIN for n in x.path) for x in added):
                break
        good = sum(x.size for x in added if id(x) in texts or not HEADINGS.isdisjoint(tags[n] for n in x.path))
        if 2 * good >= sum(len(x.text()) for x in added):
            holder = outer
    return holder


def _kind(parser: Lines, line: Line) -> tuple[int, tuple[str, str]] | None:
    """The outermost element below the page that holds the line: its number, tag and class."""
    for n in line.path:
        if parser.tags[n] in HOLDERS and parser.tags[n] != "body":
            return n, parser.kinds[n]
    return None


def text_of(html: Column) -> Column:
    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return extracted(html)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
