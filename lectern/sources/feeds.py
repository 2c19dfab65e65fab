"""Landed payloads -> paper rows: JSON API payloads (SRC4), RSS feeds (SRC5),
the RSS feed index (SRC6) and HTML paper pages (SRC7).

Payloads are parsed with the built-in ``from_json`` / ``from_xml`` and the
regex functions; only the full HTML parser form runs Python (``mapInPandas``
with the standard-library parser), one batch of pages at a time.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from typing import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as tx

FEED_SCHEMA = ("channel struct<item: array<struct<title: string, description: string, "
               "link: string, guid: string>>>")

# Link captions of a paper page and the paper field each one fills (fixed values).
PAGE_CAPTIONS = {"Software": "github_url", "Download PDF": "pmlr_pdf", "Supplementary PDF": "supplemental"}


# SRC4 ------------------------------------------------------------------------------------
def api_papers(payloads: DataFrame, payload_col: str = "payload", url_col: str = "url",
               keep: Sequence[str] = ()) -> DataFrame:
    """JSON API payload -> one row per result: ``paper_key = "{idx}_{name}"``, authors
    keyed ``"{i}_{fullname}"``, site-relative ``virtualsite_url`` prefixed with the
    request host, missing text fields as ``""`` (JSN3)."""
    p = payloads.select(*keep, F.col(url_col).alias("_url"),
                        F.from_json(F.col(payload_col), schemas.API_PAYLOAD).alias("_p"))
    r = p.select(*keep, "_url", F.posexplode("_p.results").alias("pos", "r"))
    host = tx.url_host(F.col("_url"))

    def txt(name: str) -> Column:
        return F.coalesce(F.col(f"r.{name}"), F.lit(""))

    authors = F.map_from_entries(F.transform(
        F.coalesce(F.col("r.authors"), F.array()),
        lambda a, i: F.struct(F.concat(i.cast("string"), F.lit("_"), a["fullname"]).alias("k"), a.alias("v"))))
    vurl = F.col("r.virtualsite_url")
    return r.select(
        *keep, "pos",
        F.concat(F.col("pos").cast("string"), F.lit("_"), F.col("r.name")).alias("paper_key"),
        txt("id").alias("id"), txt("name").alias("name"), authors.alias("author"),
        txt("abstract").alias("abstract"), F.coalesce(F.col("r.keywords"), F.array().cast("array<string>")).alias("keywords"),
        txt("topic").alias("topic"), txt("session").alias("session"), txt("event_type").alias("event_type"),
        F.when(F.coalesce(vurl, F.lit("")) != "", F.concat(F.lit("https://"), host, vurl)).otherwise(F.lit(""))
        .alias("virtualsite_url"),
        txt("url").alias("url"), txt("paper_url").alias("paper_url"), txt("paper_pdf_url").alias("paper_pdf_url"),
        txt("sourceurl").alias("sourceurl"))


# SRC5 ------------------------------------------------------------------------------------
def feed_items(feeds: DataFrame, xml_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """RSS text -> ``(pos, title, description, link, guid)`` in document order."""
    parsed = feeds.select(*keep, F.from_xml(F.col(xml_col), FEED_SCHEMA).alias("_f"))
    return parsed.select(*keep, F.posexplode("_f.channel.item").alias("pos", "it")) \
        .select(*keep, "pos", "it.title", "it.description", "it.link", "it.guid")


def items_to_papers(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Feed items -> papers: key = ``"{pos}_{title letters/numbers/spaces}"``."""
    return items.select(
        *keep, "pos",
        tx.paper_key(F.col("pos"), "title").alias("paper_key"),
        F.col("title"), F.col("description").alias("abstract"), F.col("link").alias("url"),
        F.col("guid").alias("id"), tx.derive_pdf_url("link").alias("pdf"))


def read_feeds(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """RSS files (one feed per file, read whole) -> paper rows with the feed name."""
    plist = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(plist, wholetext=True).select(
        F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.[^.]*$", "").alias("feed"),
        "value")
    return items_to_papers(feed_items(raw, keep=["feed"]), keep=["feed"])


# SRC6 ------------------------------------------------------------------------------------
def feed_index(items: DataFrame, conferences: Sequence[str], year_limit: int = 2010,
               order_col: str = "pos") -> DataFrame:
    """Index items -> ``(year, conference, link)``.

    A known conference name occurring in the description (substring) with the
    first year 1900-2100 of the description >= ``year_limit`` gives an entry;
    the last item in feed order wins per (year, conference).  The registry is a
    short literal list matched in-row (no join)."""
    confs = F.array(*[F.lit(c) for c in conferences])
    hits = items.select(order_col, "link", tx.extract_year("description").alias("year"),
                        F.explode(F.filter(confs, lambda c: F.col("description").contains(c))).alias("conference"))
    return (hits.filter(F.col("year") >= year_limit)
            .groupBy("year", "conference").agg(F.max_by("link", order_col).alias("link")))


#: Bytes of names that are broadcast at most; a larger registry is matched in groups.
REGISTRY_BYTES = 32 << 20


def _contained(names: list[str]):
    """A UDF: those of ``names`` that occur in a text, by one pass of an automaton over it whatever their number."""
    @F.pandas_udf("array<string>")
    def contained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([sorted({name for _, name in automaton.iter(text)}) if text else [] for text in batch], dtype=object)

    return contained


def feed_index_from(items: DataFrame, registry: DataFrame, name_col: str = "name", year_limit: int = 2010, order_col: str = "pos",
                    most: int = REGISTRY_BYTES) -> DataFrame:
    """``feed_index`` with the known names taken from a table, which may be large: (year, conference, link).

    The distinct names (null and empty ones match nothing) become an automaton that each worker builds once; it finds all
    names in a description in one pass, so the cost of an item does not grow with the registry.  Names
    beyond ``most`` bytes are taken in groups, each with a pass of its own over the items.  Texts without a year from ``year_limit`` on are
    not looked through."""
    names = registry.select(F.col(name_col).alias("name")).where(F.length("name") > 0).distinct().orderBy("name")
    dated = items.select(order_col, "link", "description", F.inline(F.array(F.struct(tx.extract_year("description").alias("year")))))
    dated = dated.where(F.col("year") >= year_limit)
    groups: list[list[str]] = [[]]
    size = 0
    for r in names.toLocalIterator():
        if size + len(r["name"].encode()) > most and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(r["name"])
        size += len(r["name"].encode())
    hits = None
    for group in groups:
        found = dated.select(order_col, "link", "year", F.explode(_contained(group)(F.col("description"))).alias("conference")) if group else \
            dated.limit(0).select(order_col, "link", "year", F.lit("").alias("conference"))
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy("year", "conference").agg(F.max_by("link", order_col).alias("link"))


# SRC7 ------------------------------------------------------------------------------------
LI_LINK = r'<li[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>\s*</li>'


def page_list_items(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """``<li><a href=...>caption</a></li>`` entries of each page, in order."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(LI_LINK), 1)
    caps = F.regexp_extract_all(F.col(html_col), F.lit(LI_LINK), 2)
    return (pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("href"), caps.alias("caption"))).alias("ord", "li"))
            .select(key, "ord", "li.href", "li.caption"))


def page_links(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """FLT8 + AGG10: known captions pivoted to paper fields (last link wins), ``""``
    when a page lacks one.  Every page appears once."""
    items = page_list_items(pages, html_col, key).filter(F.col("caption").isin(list(PAGE_CAPTIONS)))
    piv = items.groupBy(key).pivot("caption", list(PAGE_CAPTIONS)).agg(F.max_by("href", "ord"))
    base = pages.select(key).join(piv, key, "left")
    return base.select(key, *[F.coalesce(F.col(f"`{cap}`"), F.lit("")).alias(field)
                              for cap, field in PAGE_CAPTIONS.items()])


def paragraphs(html: Column) -> Column:
    """The contents of all ``<p>`` elements, one to a line (regex form)."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"<p[^>]*>(.*?)</p>"), 1), "\n")


def page_parts(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """Regex form of the page extract: title, first heading, all paragraphs,
    ``span.authors`` list and ``div#info`` text (``""`` when absent)."""
    h = F.col(html_col)
    authors = F.regexp_extract(h, r'<span class="authors">([^<]*)</span>', 1)
    return pages.select(
        key,
        F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(h, r"<h1[^>]*>([^<]*)</h1>", 1).alias("h1"),
        paragraphs(h).alias("paragraphs"),
        F.when(authors != "", tx.split_authors(authors)).otherwise(F.array()).alias("authors"),
        F.trim(F.regexp_extract(h, r'<div id="info">([^<]*)</div>', 1)).alias("conf_info"))


VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a new sibling of the same kind closes.
CLOSED_BY_SIBLING = frozenset(("li", "p"))


#: No caption is longer, so of a list item's text no more needs to be kept.
CAPTION_LENGTH = max(map(len, PAGE_CAPTIONS)) + 1


class _PageParser(HTMLParser):
    """Collects the first span.authors text, li captions with their first link, and the
    first div#info text.  End tags without an open match are ignored; void elements
    are not nested; an open ``li`` or ``p`` ends where its next sibling starts; a marked section
    (``<![``) is a comment.  Open elements are counted by tag, so that a page is read in linear time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.open: Counter[str] = Counter()
        self.roles: list[str] = []
        self.found: dict[str, list[str]] = {}
        self.items: list[tuple[str, str | None]] = []
        self._li: list[list] = []

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _pop(self) -> str:
        tag, role = self.stack.pop()
        self.open[tag] -= 1
        if role:
            self.roles.remove(role)
        if tag == "li":
            text, href = self._li.pop()
            self.items.append((text, href))
            self._add(text)
        return tag

    def _add(self, text: str) -> None:
        """To the innermost open list item, as far as it matters."""
        if self._li and len(self._li[-1][0]) < CAPTION_LENGTH:
            self._li[-1][0] += text[:CAPTION_LENGTH]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        a = dict(attrs)
        if tag in CLOSED_BY_SIBLING and self.open[tag]:
            for t, _ in reversed(self.stack):
                if t == tag:
                    self.handle_endtag(tag)
                    break
                if t in ("ul", "ol", "div"):
                    break
        role = None
        if tag == "span" and "authors" in (a.get("class") or "").split() and "authors" not in self.found:
            role = "authors"
        elif tag == "div" and a.get("id") == "info" and "info" not in self.found:
            role = "info"
        if role:
            self.found[role] = []
            self.roles.append(role)
        self.stack.append((tag, role))
        self.open[tag] += 1
        if tag == "li":
            self._li.append(["", None])
        elif tag == "a" and self._li and self._li[-1][1] is None:
            self._li[-1][1] = a.get("href")

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def close(self):
        super().close()
        while self.stack:
            self._pop()

    def handle_data(self, data):
        for role in self.roles:
            self.found[role].append(data)
        self._add(data)


def parse_page(html: str | None) -> dict:
    """One page -> the extras dict: authors map, link fields, conf_info."""
    out = {"authors": {}, "pmlr_pdf": "", "github_url": "", "conf_info": "", "supplemental": ""}
    if not html:
        return out
    p = _PageParser()
    p.feed(html)
    p.close()
    if p.found.get("authors"):
        for i, name in enumerate("".join(p.found["authors"]).split(",")):
            out["authors"][f"{i}_{name.strip()}"] = name.strip()
    for text, href in p.items:
        if text in PAGE_CAPTIONS and href is not None:
            out[PAGE_CAPTIONS[text]] = href
    out["conf_info"] = "".join(p.found.get("info", [])).strip()
    return out


PAGE_EXTRAS = ("authors map<string,string>", *(f"{c} string" for c in ("pmlr_pdf", "github_url", "conf_info", "supplemental")))


def parse_pages(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """SRC7 parser form: stdlib HTML parser over batches of pages (``mapInPandas``); the key keeps its name and type."""
    columns = [key, *(c.split()[0] for c in PAGE_EXTRAS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{key: k, **parse_page(h)} for k, h in zip(pdf[key], pdf[html_col])], columns=columns)

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html_col).mapInPandas(run, ", ".join((f"`{key}` {kind}", *PAGE_EXTRAS)))
