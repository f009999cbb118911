"""Main text of web pages by markup and nearest-URL page differencing (operator 8).

A page becomes lines of text: one per block element, white space collapsed, character references
decoded.  Elements that are never article text (menus, forms, scripts, adverts and the like, by tag,
role or class) are left out; an article or main element inside one that is so by class, id, role or
as a form is taken if it holds more text than the rest of the page.

All pages are compared; one with a marked article with the visible lines around it, which are what it
shares with its site.  Pages of one host with equal lines are compared as one.  They are put in order of host and path, and each is paired with whichever
neighbour of the same host shares the longer path prefix and is no copy.  The longest common
subsequence of the two pages' lines, compared by hash, is what the site repeats on every page: those
lines are deleted, but for those inside a marked article, since articles quote and copy each other.  Where one of the two pages has no line of its own beside the common ones, it is a
copy, or part, of the other and says nothing about the site's frame; if both neighbours are such,
the nearest page beyond them that is no copy is taken, from twice as far in each round until the
host ends.

All pages are ordered by one range partition, so a host of any size is spread; only line hashes move
to the neighbours.

Defined results: null and empty html give an empty text; pages without a usable URL are each other's
neighbours under the empty host; repeated rows each get a row; a page without neighbour keeps what
the markup leaves.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import exact_rank
from .common import UPPER, LOWER, only_tables_of, ship, written_table

#: Links fill a menu: a block outside an article with this share of linked characters is left out.
LINK_SHARE = 0.8
#: Kinds of lines: around a marked article, main text unless repeated, marked as article.
AROUND, UNMARKED, MARKED = 0, 1, 2

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
           "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "link", "meta", "base", "input"}
_NEVER = {"head", "title", "script", "style", "noscript", "template", "nav", "menu", "aside", "form", "button", "select", "option", "textarea", "fieldset", "iframe", "object", "svg", "canvas", "audio",
          "video", "dialog", "footer"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
          "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus", "replies",
          "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "masthead", "topbar", "skip", "search", "pagination", "pager", "copyright"}
#: Elements around whole pages at times: like names and roles, they do not settle what an article inside is.
_FORMS = {"form", "fieldset"}
#: Elements whose class says something about the page's layout rather than about themselves.
_FRAME = {"html", "body", "main"}


def _named(name: str) -> bool:
    """Is a class or id one of the names, or made of them alone ("cookie-notice", but not "no-ads")?"""
    return all(part in _NAMES for part in re.split("[-_]+", name))


class _Blocks(HTMLParser):
    """Collects (text, inside article, inside main, linked share, inside a hiding wrapper) per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, hides for good, hides unless an article is inside, what an article lifted
        self.open: list[tuple[str, bool, bool, int]] = []
        self.count: dict[str, int] = {}
        self.hidden = self.soft = self.lifted = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, bool, bool, float, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.count.get("article", 0) > 0, self.count.get("main", 0) > 0, self.linked / len(text), self.lifted > 0))
        self.parts, self.linked = [], 0

    def unwanted(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Hidden for good, hidden unless an article is inside."""
        if tag in _NEVER - _FORMS or tag == "header" and not self.count.get("article"):
            return True, False
        a = dict(attrs)
        if a.get("aria-hidden") == "true" or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style") or ""):
            return True, False
        if tag in _FRAME:
            return False, False
        if tag in _FORMS or (a.get("role") or "").lower() in _ROLES:
            return False, True
        names = f"{a.get('class') or ''} {a.get('id') or ''}".lower().split()
        if tag == "article":
            return any(n in ("comment", "comments", "related", "ad", "advert", "promo") for n in names), False
        return False, any(map(_named, names))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE:
            self.flush()
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        hides, soft = self.unwanted(tag, attrs)
        lifts = self.soft if tag in ("article", "main") and not soft else 0
        self.open.append((tag, hides, soft, lifts))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += hides
        self.soft += soft - lifts
        self.lifted += lifts

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # only void elements close themselves in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if not self.count.get(tag):
            return
        while True:
            name, hides, soft, lifts = self.open.pop()
            self.count[name] -= 1
            self.hidden -= hides
            self.soft -= soft - lifts
            self.lifted -= lifts
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.soft:
            self.parts.append(data)
            if self.count.get("a"):
                self.linked += len(data)


def _page_blocks(html: str | None) -> list[tuple[str, bool, bool, float, bool]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def _chosen(blocks: list) -> list[tuple[int, bool]]:
    """(place, marked as article) of the blocks that may be main text, in page order."""
    plain, lifted = ([i for i, b in enumerate(blocks) if b[4] == x] for x in (False, True))
    inside = lambda places, at: [(i, True) for i in places if blocks[i][at]]
    if any(blocks[i][1] for i in plain):
        return inside(plain, 1)
    own = inside(plain, 2) or [(i, False) for i in plain if blocks[i][3] < LINK_SHARE]
    wrapped = inside(lifted, 1) or inside(lifted, 2)
    # a layout's wrapper leaves little outside; a box of teasers stands beside the text
    return max(own, wrapped, key=lambda found: sum(len(blocks[i][0]) for i, _ in found))


def page_lines(html: str | None) -> list[tuple[str, bool]]:
    """(line, marked as article) in page order."""
    blocks = _page_blocks(html)
    return [(blocks[i][0], marked) for i, marked in _chosen(blocks)]


def compared_lines(html: str | None) -> list[tuple[str, int]]:
    """(line, kind) of all that is compared with other pages: a page with a marked article shows the lines around it too."""
    blocks = _page_blocks(html)
    chosen = dict(_chosen(blocks))
    if any(chosen.values()):
        return [(b[0], MARKED if i in chosen else AROUND) for i, b in enumerate(blocks)]
    return [(blocks[i][0], UNMARKED) for i in chosen]


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """For each line of ``a``: is it on a longest common subsequence with ``b``?

    Bit-parallel: row i holds, as bits over ``b``, where the length does not grow; n rows of one
    big-number addition each, so ten thousand lines a side take a fraction of a second.
    """
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, row = [], full
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    out = [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not (i and not rows[i - 1] >> (j - 1) & 1):
            out[i] = True
            j -= 1
    return out


def kept_lines(hashes: list[int], other: list[int]) -> list[bool] | None:
    """Which lines the other page does not repeat; None if one of the two is a copy or part of the other."""
    repeated = common_lines(hashes, other)
    return [not x for x in repeated] if sum(repeated) < min(len(hashes), len(other)) else None


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """rid, page_id, url, lines, kinds of every page."""
    ship(pages.sparkSession)
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", "html")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("html_text")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [compared_lines(x.as_py()) for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[k for _, k in f] for f in found], pa.list_(pa.int8()))],
                                                 names=["rid", "page_id", "url", "lines", "kinds"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("kinds", T.ArrayType(T.ByteType()))]))


def differenced(light: DataFrame) -> DataFrame:
    """host, key and keep (per line: not repeated on the paired page) of every distinct page that has a pair.

    ``light``: host, path, page_id, rid, key (of the lines) and hashes, rows with lines only.
    """
    one = light.groupBy("host", "key").agg(F.min(F.struct("path", "page_id", "rid", "hashes")).alias("p")).select("host", "key", "p.*")
    ranked = written_table(exact_rank(one, [], [F.col("host"), F.col("path"), F.col("page_id"), F.col("rid")]).select("rank", "host", "key", "path", "hashes"))

    other = ranked.select(F.col("rank").alias("at"), "host", F.col("path").alias("other_path"), F.col("hashes").alias("other"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("html_text")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = part.select(["path", "hashes", "other_path", "other"]).to_pylist()
                prefix = [len(os.path.commonprefix([r["path"], r["other_path"]])) for r in rows]
                keep = [kept_lines(r["hashes"], r["other"]) for r in rows]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(prefix, pa.int32()), pa.array(keep, pa.list_(pa.bool_()))], names=["host", "key", "far", "prefix", "keep"])

    todo, step, found = ranked, 1, None
    while not todo.isEmpty():
        places = F.sequence(F.lit(step), F.lit(2 * step - 1))
        pairs = todo.withColumn("by", F.explode(F.concat(places, F.transform(places, lambda x: -x)))).withColumn("at", F.col("rank") + F.col("by")).join(other, ["at", "host"])
        pairs = pairs.select("host", "key", F.abs("by").alias("far"), "path", "hashes", "other_path", "other")
        schema = T.StructType([*pairs.schema.fields[:3], T.StructField("prefix", T.IntegerType()), T.StructField("keep", T.ArrayType(T.BooleanType()))])
        nearest = F.min(F.when(F.col("keep").isNotNull(), F.struct("far", -F.col("prefix"), "keep"))).alias("best")
        tried = written_table(pairs.mapInArrow(run, schema).groupBy("host", "key").agg(nearest))
        done = tried.filter("best is not null").select("host", "key", "best.keep")
        found = done if found is None else found.unionByName(done)
        # pages that have met copies only look further
        todo, step = written_table(todo.join(tried.filter("best is null").select("host", "key"), ["host", "key"], "left_semi").select(*ranked.columns)), 2 * step
    return found if found is not None else light.select("host", "key", F.lit(None).cast("array<boolean>").alias("keep")).limit(0)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (lines that the paired page repeats) of every page.

    Every page is paired and compared.  What the markup says about a line then counts more than the
    comparison.  Pages are parsed a second time for their texts, since keeping these meanwhile would
    write them once more.
    """
    host, path = url_parts(F.col("url"))
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    table = parsed(pages).withColumns({"host": host, "path": path, "hashes": hashes}).withColumn("key", F.xxhash64("hashes"))
    light = written_table(table.filter(F.size("lines") > 0).select("host", "path", "page_id", "rid", "key", "hashes"))
    keep = differenced(light)
    marked = F.array_contains("kinds", F.lit(MARKED).cast("byte"))
    # of a marked page only the article goes on, joined already
    article = F.filter("lines", lambda x, i: F.get(F.col("kinds"), i) == MARKED)
    texts = table.select("page_id", "url", "host", "key", F.when(marked, F.array_join(article, "\n")).alias("article"), F.when(~marked, F.col("lines")).alias("lines"))
    own = F.filter("lines", lambda x, i: F.coalesce(F.get(F.col("keep"), i), F.lit(True)))
    repeated = F.coalesce(F.size(F.filter("keep", lambda x: ~x)), F.lit(0)).cast("long")
    # one plan at every size: the table grows with the pages
    out = texts.join(keep.hint("merge"), ["host", "key"], "left").select("page_id", "url", F.coalesce("article", F.array_join(own, "\n")).alias("text"), F.when(F.col("keep").isNull(), 0).otherwise(repeated).cast("long").alias("n_repeated"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
