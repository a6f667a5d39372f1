"""HTML extraction by nearest-URL page differencing.

A page is cut into its blocks of text (lines).  Within a host the pages
are ordered by URL path; a page is paired with the neighbour whose path
has the smaller edit distance.  The two pages' lines are aligned by a
longest common subsequence, and lines shared with the paired page are
deleted: menus, notices and footers repeat from page to page, articles
don't.  Markup that names its purpose decides before that: what stands in
navigation, header, footer, sidebar, advert, form, script, style or
comment elements (by tag, role, class or id) is not text, unless such an
element is a wrapper round the article or most of the page.  Where a page
has ``article`` or ``main`` elements, only they count, and of the shared
lines only those go that the host repeats, on three different pages at
least and on half of them, unless they are more than half of the article:
a passage quoted by two articles stays.  On other pages all shared lines
go; but if without the host's repeating lines more than half of either
page is shared, the pages are near copies, and only the repeating lines go.

Pairing uses a range-partitioned sort of (host, path), so a host with a
third of all pages is spread over many tasks; only line hashes are
shuffled, and of the deletions only those that change a page's text.

Defined results: null or empty html gives an empty text; a page alone in
its host has no pair and loses nothing by differencing, nor does a page
whose pair has the same lines; equal rows are
extracted alike and all returned; urls without ``://`` share the empty
host.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import BROADCAST_BYTES, table, with_python_columns, written
from tabloom.llm.neighbours import neighbours
from tabloom.llm.url_filter import url_host, url_path

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = set(
    "nav footer aside form script style noscript template head title svg iframe button select dialog menu object canvas audio video".split()
)
_INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup"
    " td th time tt u var wbr".split()
)
#: Elements that a start tag of the same kind closes.
_ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class or id that name something other than the article.
_ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu navbar nav navigation breadcrumb"
    " breadcrumbs cookie cookies consent gdpr notice notices alert comment comments commentlist disqus reply replies respond related recommended"
    " share sharing social newsletter subscribe subscription signup popup modal overlay footer header masthead topbar widget pagination pager"
    " toolbar skip hidden".split()
)
_ASIDE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words among them that name text by others or for sale, which may well be longer than the article.
_FOREIGN_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr comment comments commentlist"
    " disqus reply replies respond related recommended".split()
)
#: Elements set aside by tag that may hold an article, if only for want of an end tag.
_ASIDE_TAGS = set("nav footer aside header menu dialog".split())
_CUT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")

#: Least number of different pages of a host with a repeating line.
PAGES = 3

KEPT, ARTICLE, SKIPPED = 0, 1, 2
BY_TAG, BY_LAYOUT, FOREIGN = 0, 1, 2

#: Zone, elements set aside around it, and how many of these are outside the innermost article.
_State = tuple[int, tuple[int, ...], int]


class _Blocks(HTMLParser):
    """Collects (state, text) of a page's blocks, with those in elements set aside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, _State]] = []
        self.blocks: list[tuple[_State, str]] = []
        self.parts: list[str] = []
        self.aside: list[int] = []  # why each element is set aside

    @property
    def state(self) -> _State:
        return self.open[-1][1] if self.open else (KEPT, (), 0)

    def cut(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.state, text))
            self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.cut()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag == "body":
            self._close({"head"}, set())
        if tag in _ALONE:
            self._close(_ALONE[tag], {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "blockquote", "nav", "aside", "footer", "header", "form"})
        zone, around, outer = self.state
        if zone != SKIPPED:
            named = {k: (v or "").lower() for k, v in attrs}
            words = set(_CUT.split(named.get("class", "") + " " + named.get("id", "")))
            why = self._why(tag, named, words, zone)
            if tag in _SKIP and tag not in _ASIDE_TAGS and tag != "form" or "hidden" in named or named.get("aria-hidden") == "true":
                self.cut()
                zone = SKIPPED
            elif why is not None:
                self.cut()
                around = (*around, len(self.aside))
                self.aside.append(why)
            elif tag in ("article", "main") or named.get("role") == "main":
                if around[outer:] or zone != ARTICLE:
                    self.cut()
                zone, outer = ARTICLE, len(around)
        self.open.append((tag, (zone, around, outer)))

    @staticmethod
    def _why(tag, named, words, zone):
        """Why the element is set aside, if it is."""
        if tag == "article" and words & {"comment", "comments", "reply", "ad", "related"}:
            return FOREIGN
        if tag in _ASIDE_TAGS and (tag != "header" or zone != ARTICLE) or named.get("role") in _ASIDE_ROLES and named.get("role") != "form":
            return BY_TAG
        found = words & _ASIDE_WORDS if tag not in ("html", "body", "article", "main") and named.get("role") != "main" else set()
        if zone == ARTICLE:
            found -= {"header"}
        if found & _FOREIGN_WORDS:
            return FOREIGN
        return BY_LAYOUT if found or tag == "form" or named.get("role") == "form" else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in _INLINE or any(t not in _INLINE or z != self.state for t, z in self.open[i:]):
                    self.cut()
                del self.open[i:]
                return
        if tag not in _INLINE:
            self.cut()

    def _close(self, tags, stop) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_data(self, data):
        if self.state[0] != SKIPPED:
            self.parts.append(data)


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order: those of its articles, if it has any.

    Blocks in elements set aside don't count, unless such an element is
    only a wrapper: one that holds more than half of the text (not for
    those that name text by others, and for those set aside by tag or role
    only if it holds articles), or without which nothing would be left.
    """
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    pool = [b for b in parser.blocks if b[0][0] == ARTICLE] or parser.blocks
    total = sum(len(text) for _, text in pool)
    held: dict[int, int] = {}
    wraps: set[int] = set()
    for (_, around, outer), text in pool:
        for k in around:
            held[k] = held.get(k, 0) + len(text)
        wraps.update(around[:outer])
    why = parser.aside
    lifted = {k for k, size in held.items() if 2 * size > total and (why[k] == BY_LAYOUT or why[k] == BY_TAG and k in wraps)}
    for more in (set(), wraps, {k for k in held if why[k] != BY_TAG}):
        lifted |= more
        left = [(zone, text) for (zone, around, _), text in pool if lifted.issuperset(around)]
        if left:
            return left
    return []


def candidates(html: str | None) -> tuple[list[str], list[bool]]:
    """Lines that may be text, and whether each is inside a declared article."""
    blocks = page_blocks(html)
    if any(zone == ARTICLE for zone, _ in blocks):
        blocks = [b for b in blocks if b[0] == ARTICLE]
    return [text for _, text in blocks], [zone == ARTICLE for zone, _ in blocks]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``, in bit-parallel rows."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        if hit := row & places.get(x, 0):
            row = (row + hit | row - hit) & full
    raw = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.append(0, np.cumsum(1 - np.unpackbits(raw, bitorder="little")[: len(b)].astype(np.int64)))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are taken as they are; the rest is halved where the lengths
    of both halves' subsequences add up to most (Hirschberg), with whole
    rows of lengths as bits of one integer: space grows with the lines,
    and 40 000 equal table cells take a fraction of a second.
    """
    out: list[int] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append(m)
        if i == m or j == n:
            continue
        if m - i == 1:
            if a[i] in b[j:n]:
                out.append(i)
            continue
        mid = (i + m) // 2
        sums = _lengths(a[i:mid], b[j:n]) + _lengths(a[mid:m][::-1], b[j:n][::-1])[::-1]
        cut = j + int(sums.argmax())
        if sums.max():
            open_ += [(i, mid, j, cut), (mid, m, cut, n)]
    return sorted(out)


def _line_table(pages: DataFrame) -> DataFrame:
    """(k, host, path, lines, sizes, article) of each page."""
    def make():
        import xxhash

        def lines(pages_html: list[str | None]):
            found = [candidates(html) for html in pages_html]
            hashes = [[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts] for texts, _ in found]
            return hashes, [[len(t) for t in texts] for texts, _ in found], [inside for _, inside in found]

        return lines

    return with_python_columns(pages, ["html"], {"lines": "array<long>", "sizes": "array<int>", "article": "array<boolean>"}, make, drop=("html",))


def _rest(lines: list[int], sizes: list[int], repeated: set[int]) -> int:
    """Size of the lines that don't repeat over the host."""
    return sum(n for x, n in zip(lines, sizes, strict=True) if x not in repeated)


def lost_lines(lines: list[int], sizes: list[int], article: list[bool], other: list[int], other_sizes: list[int], repeated: list[int] | None) -> list[int]:
    """Positions of the lines that a page loses to its pair; ``repeated`` are the host's repeating lines."""
    if lines == other:
        return []  # equal pages
    same = common_lines(lines, other)
    often = set(repeated or ())
    again = [i for i in same if lines[i] in often]
    if any(article):
        # a line of an article goes only if the host repeats it, and if the article isn't mostly such lines (copies of one article)
        return again if 2 * sum(sizes[i] for i in again) <= sum(sizes) else []
    own = sum(sizes[i] for i in same if lines[i] not in often)
    copies = 2 * own > min(_rest(lines, sizes, often), _rest(other, other_sizes, often))
    return again if copies else same


def repeating_lines(lines: DataFrame) -> DataFrame:
    """(host, repeated): lines on at least ``PAGES`` different pages of the host, and on half of them or more.

    A host's list is short: its lines are at most twice those of its average page.
    """
    pages = lines.select("host", F.array_distinct("lines").alias("held"), F.xxhash64("lines").alias("page")).where(F.size("held") > 0)
    pages = pages.dropDuplicates(["host", "page"])
    total = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    count = pages.select("host", F.explode("held").alias("line")).groupBy("host", "line").agg(F.count("*").alias("c")).where(F.col("c") >= PAGES)
    often = count.join(total, "host").where("2 * c >= n")
    return often.groupBy("host").agg(F.collect_list("line").alias("repeated"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(k, drop): positions of a page's candidate lines to delete; ``pages`` has k, host, path and html."""
    lines = written(_line_table(pages).dropDuplicates(["k"]), "lines")
    near = neighbours(lines.select("host", "path", "k"), ["host", "path", "k"], ["host", "path", "k"])
    fits = lambda side: F.col(f"{side}.host") == F.col("host")
    away = lambda side: F.when(fits(side), F.levenshtein(F.col("path"), F.col(f"{side}.path")))
    mate = F.when(away("after").isNull() | (away("before") < away("after")), F.when(fits("before"), F.col("before.k"))).otherwise(F.col("after.k"))
    pairs = near.select("k", mate.alias("mate")).where("mate IS NOT NULL")
    other = lines.select(F.col("k").alias("mate"), F.col("lines").alias("other"), F.col("sizes").alias("other_sizes"))
    often = written(repeating_lines(lines), "repeating")
    size = often.agg(F.sum(64 + F.length("host") + 8 * F.size("repeated"))).first()[0] or 0
    both = lines.join(pairs, "k").join(other, "mate").join(F.broadcast(often) if size <= BROADCAST_BYTES else often, "host", "left")
    inputs = ["lines", "sizes", "article", "other", "other_sizes", "repeated"]
    both = both.select("k", *inputs)
    found = with_python_columns(both, inputs, {"drop": "array<int>"}, lambda: lambda *cols: [list(map(lost_lines, *cols))], drop=tuple(inputs))
    return found.where(F.size("drop") > 0)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each page."""
    url, html = F.col(url_col), F.col(html_col)
    key = F.md5(F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("\x02")), F.coalesce(url, F.lit("\x02")), F.coalesce(html, F.lit("\x02"))).cast("binary"))
    given = pages.select(F.col(id_col).alias("id"), url.alias("url"), html.alias("html"), key.alias("k"))
    drops = written(shared_lines(given.select("k", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")), "shared")
    size = drops.agg(F.sum(64 + 8 * F.size("drop"))).first()[0] or 0
    joined = given.join(F.broadcast(drops) if size <= BROADCAST_BYTES else drops, "k", "left").drop("k")

    def texts(pages_html, drops_):
        out = []
        for page, gone in zip(pages_html, drops_, strict=True):
            out.append("\n\n".join(t for i, t in enumerate(candidates(page)[0]) if i not in (gone or ())))
        return [out]

    done = with_python_columns(joined, ["html", "drop"], {"text": "string"}, lambda: texts, drop=("html", "drop"))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
