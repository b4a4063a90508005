"""HTML extraction: element subtrees that recur on a host are its template and go.

Subtrees are hashed twice: with their text, and by shape, that is names, classes, ids and roles
without text, so that a menu or advert whose words change from page to page recurs too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .url_rules import parts

LEAST_PAGES = 5  # different pages of a host on which a subtree recurs before it counts as template
LEAST_SHARE = 0.05  # and their share of the different pages of the host
SHAPE_SHARE = 0.3  # share of the different pages of the host that a shape needs
LARGE = 1 / 3  # part of a page's text beyond which a subtree is no template by shape
BROADCAST_TEMPLATES = 200_000  # templates (8 bytes each) sent to all tasks, counted first; more are joined by page

# Element names and class words, chosen for this operator.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "template", "tfoot", "th",
    "thead", "tr", "ul",
}
CONTAINERS = {"aside", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "menu", "nav", "ol", "section", "table", "ul"}
# elements that an opening tag ends when they are open, up to the elements that hold them
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select", "article", "main", "body", "div", "section"}
DROPPED = {
    "aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "menu", "nav", "noscript", "object", "search", "select",
    "svg", "template", "textarea", "audio", "video",
}
DROPPED_WORDS = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pager", "pagination", "popup", "promo", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
DROPPED_OUTSIDE = {"header", "masthead"}  # dropped unless inside the article
DROPPED_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>]|$)", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


LARGE_HOST = -1  # stands for a host whose pages suffice to count on
SHAPE = 0x5BD1E9955BD1E995  # tells hashes of shapes from hashes of texts


class Page:
    """Elements of a page in order (parent, name, dropped, inside an article, subtree hash) and its text blocks."""

    def __init__(self, html: str | None):
        self.parent, self.name, self.drop, self.main, self.hash = [-1], ["#"], [False], [False], [0]
        self.named, self.wrapped = [False], [False]  # by class or id: itself, itself or one around it
        self.shape, self.plain = [0], [True]  # hash without text; whether there is nothing to tell the shape by
        self.blocks: list[tuple[int, str]] = []
        self.mains: list[int] = []
        self.holds_main: set[int] = set()
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        stack: list[tuple[int, list[str], list[str]]] = [(0, [], [])]  # element, digests of what it holds, with and without text
        text: list[str] = []
        open_names: dict[str, int] = {}

        def flush() -> None:
            if text:
                words = unescape("".join(text)).split()
                if words:
                    block = " ".join(words)
                    self.blocks.append((stack[-1][0], block))
                    stack[-1][1].append(block)
                text.clear()

        def close() -> None:
            node, held, shapes = stack.pop()
            name = self.name[node]
            if name in BLOCKS or name == "a":  # runs of like children count as one
                once = [x for k, x in enumerate(shapes[1:]) if not k or x != shapes[k]]
                self.plain[node] = not shapes[0] and len(once) < 2 and name not in DROPPED | DROPPED_OUTSIDE
                self.shape[node] = xxhash.xxh64_intdigest(f"{name} {shapes[0]}({' '.join(once)})")
                stack[-1][2].append(f"{self.shape[node]:x}")
            open_names[name] -= 1
            self.hash[node] = xxhash.xxh64_intdigest(f"{name}\0" + "\0".join(held))
            if held:
                stack[-1][1].append(f"\1{self.hash[node]:x}")

        at, end = 0, len(html)
        while at < end:
            mark = html.find("<", at)
            if mark < 0:
                text.append(html[at:])
                break
            if mark > at:
                text.append(html[at:mark])
            after = html[mark + 1 : mark + 2]
            if after in ("!", "?"):
                stop = html.find("-->", mark + 4) if html.startswith("<!--", mark) else html.find(">", mark)
                at = end if stop < 0 else stop + (3 if html.startswith("<!--", mark) else 1)
                continue
            found = _TAG.match(html, mark)
            if not found:
                if not (after.isalpha() or (after == "/" and html[mark + 2 : mark + 3].isalpha())):
                    text.append("<")
                    at = mark + 1
                    continue
                stop = html.find(">", mark)  # quotes that never end: the tag ends at its first >
                at = end if stop < 0 else stop + 1
                continue
            at = found.end()
            name = found[2].lower()
            if found[1]:
                if open_names.get(name):
                    if name in BLOCKS:
                        flush()
                        while self.name[stack[-1][0]] != name:
                            close()
                        close()
                    else:
                        depth = next((k for k in range(len(stack) - 1, 0, -1) if self.name[stack[k][0]] == name or self.name[stack[k][0]] in BLOCKS), 0)
                        if depth and self.name[stack[depth][0]] == name:
                            flush_inline = self.drop[stack[depth][0]] or self.named[stack[depth][0]]
                            if flush_inline:
                                flush()
                            while len(stack) > depth:
                                close()
                elif name in BLOCKS:
                    flush()
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in BLOCKS:
                flush()
                if open_names.get("p"):
                    place = next((k for k in range(len(stack) - 1, 0, -1) if self.name[stack[k][0]] == "p"), 0)
                    while place and len(stack) > place:
                        close()
                for _ in range(len(stack)):
                    ended = next((k for k in range(len(stack) - 1, 0, -1) if self.name[stack[k][0]] in ENDS.get(name, ()) or self.name[stack[k][0]] in HOLDS), 0)
                    if not ended or self.name[stack[ended][0]] not in ENDS.get(name, ()):
                        break
                    while len(stack) > ended:
                        close()
            if name in VOID:
                continue
            node, up = len(self.name), stack[-1][0]
            inside = self.main[up]
            dropped = name in RAW or self._dropped(name, found[3], inside)
            named = not dropped and self._named(name, found[3], inside)
            if (dropped or named) and name not in BLOCKS:
                flush()
            self.parent.append(up)
            self.name.append(name)
            self.drop.append(self.drop[up] or dropped)
            self.named.append(named)
            self.wrapped.append(self.wrapped[up] or named)
            begins = name in ("article", "main") and not self.drop[-1] and not named
            self.main.append(inside or begins)
            self.hash.append(0)
            self.shape.append(0)
            self.plain.append(True)
            if begins:
                self.mains.append(node)
            if name in RAW:
                stop = _RAW_END[name].search(html, at)
                at = end if not stop else stop.start()
            if found[3].endswith("/") and name not in BLOCKS:
                continue
            open_names[name] = open_names.get(name, 0) + 1
            marks = _ATTRIBUTE.findall(found[3]) if found[3] else []
            stack.append((node, [], [" ".join(sorted(f"{a.lower()}={_DIGITS.sub('', v.strip(chr(34) + chr(39)).lower())}" for a, v in marks if a.lower() in ("class", "id", "role")))]))
        flush()
        while len(stack) > 1:
            close()
        for node in self.mains:
            while node >= 0 and node not in self.holds_main:
                self.holds_main.add(node)
                node = self.parent[node]
        # a name never drops what holds an article; beside articles names count on small hosts only
        self.listed = list(self.drop)
        for node in range(1, len(self.drop)):
            up, named = self.parent[node], self.named[node] and node not in self.holds_main
            self.listed[node] = self.listed[node] or self.listed[up] or named
            self.drop[node] = self.drop[node] or self.drop[up] or (named and self.main[node])

    @staticmethod
    def _dropped(name: str, attributes: str, inside: bool) -> bool:
        if name in DROPPED or (name == "header" and not inside):
            return True
        if not attributes or name in ("html", "body", "main"):
            return False
        for a, value in _ATTRIBUTE.findall(attributes):
            a, value = a.lower(), value.strip("\"'").lower()
            if a == "hidden" or (a == "aria-hidden" and value == "true") or (a == "style" and _HIDDEN.search(value)):
                return True
            if a == "role" and value in DROPPED_ROLES:
                return True
        return False

    @staticmethod
    def _named(name: str, attributes: str, inside: bool) -> bool:
        """Whether a class or id names boilerplate: a whole token, or one made of nothing but such words."""
        if not attributes or name in ("html", "body", "main"):
            return False
        for a, value in _ATTRIBUTE.findall(attributes):
            if a.lower() in ("class", "id"):
                tokens = (set(_WORD.findall(t)) for t in value.strip("\"'").lower().split())
                words = {w for t in tokens if t and (len(t) == 1 or t <= DROPPED_WORDS) for w in t}
                if name == "article":
                    if words & {"comment", "comments"}:
                        return True
                elif words & DROPPED_WORDS or (not inside and words & DROPPED_OUTSIDE):
                    return True
        return False

    def candidates(self) -> list[int]:
        """Elements that may be template: whole blocks outside the article, containers inside it."""
        out = []
        for node in range(1, len(self.name)):
            name = self.name[node]
            if node not in self.holds_main and name in (CONTAINERS if self.main[node] else BLOCKS - {"html", "body", "head"}):
                out.append(node)
        return out

    def shaped(self) -> list[int]:
        """Elements that may be template by shape: told by their name, a class, id, role or two unlike children, beside the article, once in the page, and short of a third of its text."""
        size = [0] * len(self.name)
        for node, block in self.blocks:
            size[node] += 0 if self.drop[node] and self.name[node] in RAW else len(block)
        for node in range(len(size) - 1, 0, -1):
            size[self.parent[node]] += size[node]
        may = [
            n for n in range(1, len(size))
            if not self.plain[n] and self.shape[n] and not self.main[n] and n not in self.holds_main and self.name[n] not in ("html", "body", "head") and size[n] <= LARGE * size[0]]
        seen: dict[int, int] = {}
        for n in may:
            seen[self.shape[n]] = seen.get(self.shape[n], 0) + 1
        return [n for n in may if seen[self.shape[n]] == 1]

    def text(self, template, by_names: bool = True, by_article: bool = True) -> str:
        """Blocks of the articles (of the main element or body where there is none), without ``template(hash)``.

        Where ``template(LARGE_HOST)`` holds, names and classes beside the article do not
        count. ``by_names`` and ``by_article`` turn off names and the choice of the article, to see what templates do alone.
        """
        if by_names:
            gone = list(self.drop if template(LARGE_HOST) else self.listed)
        else:
            gone = [n in RAW or n == "head" for n in self.name]
        may, shaped = set(self.candidates()), set(self.shaped())
        for node in range(1, len(gone)):
            gone[node] = gone[node] or gone[self.parent[node]] or (node in may and template(self.hash[node])) or (node in shaped and template(self.shape[node] ^ SHAPE))
        # an article in something named as boilerplate stays, but does not displace the text outside it
        clean = {n for n in self.mains if not self.wrapped[n]}
        articles = set(self.mains) if clean else set()
        if not by_article:
            articles = set()
        elif any(self.name[n] == "article" for n in clean):
            articles = {n for n in self.mains if self.name[n] == "article"}
        inside = [not articles] * len(gone)
        for node in range(1, len(gone)):
            inside[node] = inside[node] or inside[self.parent[node]] or node in articles
        return "\n\n".join(b for node, b in self.blocks if inside[node] and not gone[node])


def _key(host: str, subtree: int) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{subtree:x}")


def _keys(host: str, page: Page) -> tuple[set[int], set[int]]:
    """Keys of the subtrees of a page by text and by shape."""
    return {_key(host, page.hash[n]) for n in page.candidates()}, {_key(host, page.shape[n] ^ SHAPE) for n in page.shaped()}


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Rows (h): hashes of host and subtree, by text or shape, that recur on many different pages of the host, and one for each host with enough pages to count on.

    ``pages`` has (host, html). Pages with the same main text count once, so that
    copies of an article do not make it a template.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple[int, int, int, int]] = []
                for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                    page = Page(html)
                    sign = xxhash.xxh64_intdigest(page.text(lambda h: False))
                    site = _key(host, 0)
                    texts, shapes = _keys(host, page)
                    rows += [(site, site, sign, 2), (site, _key(host, LARGE_HOST), sign, 0)]
                    rows += [(site, h, sign, 0) for h in texts] + [(site, h, sign, 1) for h in shapes]
                table = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, k].copy()) for k in range(4)], names=["site", "h", "page", "kind"])

    found = pages.mapInArrow(hashes, "site long, h long, page long, kind long").distinct()
    is_site = F.col("kind") == 2
    counts = cut(found.groupBy("site", "h", "kind").agg(F.count("*").alias("n")).where((F.col("n") >= least_pages) | is_site))
    sites = counts.where(is_site).select("site", F.col("n").alias("of"))
    share = F.when(F.col("kind") == 1, SHAPE_SHARE).otherwise(least_share)
    return counts.where(~is_site & (F.col("n") >= least_pages)).join(sites, "site").where(F.col("n") >= share * F.col("of")).select("h").distinct()


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES,
            least_share: float = LEAST_SHARE, broadcast_most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(key, url, text) of every page: its article without the template of its site.

    A first pass hashes every element's subtree, from the leaves up, with its text and by its shape, and
    counts on how many different pages of its host each recurs. The second removes
    the recurring ones outside the article, recurring containers (by text only) inside it, and what
    its element name or role marks as menu, header, footer, sidebar, form or the like. Words in classes and
    ids mark boilerplate only inside articles and on hosts with fewer than ``least_pages`` different pages, which
    are too few to count on; a class or id counts as a whole token, and never drops what holds an article. The article's own paragraphs stay, however often they recur.
    Templates are sent to all tasks while they are few, else joined by page.

    Blocks are joined by two newlines, white space in a block becomes one space,
    character references are decoded. Null html and pages without text give the empty text; null
    urls are one host; broken markup ends where the page ends; repeated rows are
    extracted one by one; an empty table gives an empty result; other columns are left out.
    """
    host, _ = parts(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    known = cut(templates(rows.select("host", "html"), least_pages, least_share))
    if known.count() <= broadcast_most:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(r.h for r in known.toLocalIterator()))

        @F.pandas_udf(T.StringType())
        def text_of(hosts: pd.Series, pages_html: pd.Series) -> pd.Series:
            some = shared.value
            return pd.Series([Page(p).text(lambda s, h=h: np.uint64(_key(h, s)).view(np.int64) in some) for h, p in zip(hosts, pages_html)], dtype=object)

        return rows.select(F.col("_key").alias(key), F.col("_url").alias(url), text_of("host", "html").alias("text"))

    marked = rows.withColumn("p", F.xxhash64("host", "html"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, h, page_html in zip(*(batch.column(c).to_pylist() for c in ("p", "host", "html"))):
                page = Page(page_html)
                texts, shapes = _keys(h, page)
                keys = np.array([*texts, *shapes, _key(h, LARGE_HOST)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p)), pa.array(keys)], names=["p", "h"])

    hits = marked.select("p", "host", "html").mapInArrow(own, "p long, h long").join(known, "h").groupBy("p").agg(F.collect_set("h").alias("gone"))

    @F.pandas_udf(T.StringType())
    def text_without(hosts: pd.Series, pages_html: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for h, p, some in zip(hosts, pages_html, gone):
            some = set(some.tolist()) if some is not None else set()
            out.append(Page(p).text(lambda s, h=h, some=some: int(np.uint64(_key(h, s)).view(np.int64)) in some))
        return pd.Series(out, dtype=object)

    return marked.join(hits, "p", "left").select(F.col("_key").alias(key), F.col("_url").alias(url), text_without("host", "html", "gone").alias("text"))
