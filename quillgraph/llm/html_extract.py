"""Main text of raw web pages by differencing pages with their nearest neighbours by URL.

Each page is parsed once, into a table of its blocks. Pages of a host are put in the order of their paths; each is
aligned, line by line, with the page before and the page after it by longest common subsequence, and lines they share
are template lines. Every page goes through this. Where a page marks its article itself (an article or main element), that
element bounds the text, and since passages that two articles share are content, a shared line is cut from inside it only
where its neighbours' articles share all lines from there to its start, headline aside, or to its end, and where at least
four in five of the host's articles, of three or more, have it. Everywhere else shared lines go. Menus, headers, footers, sidebars, notices, adverts, forms, comments and code go by their markup in
both cases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hot_join, materialise, numbered, with_null_ids

#: Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head iframe menu nav noscript object script select style svg template textarea title video".split())
CLOSED_BY_SAME = frozenset("dd dt li option p td th tr".split())
#: Words of class, id and role values that mark what is not the article.
UNWANTED = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus feedback footer gdpr login "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar topbar widget contentinfo complementary alert".split()
)
#: Those of them that count inside the article as well: adverts, reader comments, sign-up boxes.
UNWANTED_INSIDE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus gdpr newsletter popup promo promoted replies respond sharing signup social sponsor "
    "sponsored subscribe".split()
)
#: Open elements that a stray end tag of an inner element does not close.
BARRIERS = frozenset("article aside body footer form header main nav".split())
INNER = CLOSED_BY_SAME | frozenset("a b i span".split())
MARKS = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """The blocks of a page in order, each with whether it is in the article and whether markup drops it.

    Open elements are kept on a stack with the places of each tag, so that every tag costs the same on any nesting.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, dropped, main
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.dropped = self.main = 0
        self.text: list[str] = []
        self.lines: list[tuple[bool, bool, str]] = []

    def _flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text.clear()
            if line:
                self.lines.append((self.main > 0, self.dropped > 0, line))

    def _push(self, tag: str, dropped: bool, main: bool) -> None:
        at = len(self.open)
        self.open.append((tag, dropped, main))
        self.places.setdefault(tag, []).append(at)
        if tag in BARRIERS:
            self.barriers.append(at)
        self.dropped += dropped
        self.main += main

    def _pop(self) -> None:
        tag, dropped, main = self.open.pop()
        self.places[tag].pop()
        if tag in BARRIERS:
            self.barriers.pop()
        self.dropped -= dropped
        self.main -= main

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            if self.open and self.open[-1][0] == "p":  # a block ends an open paragraph
                self._pop()
            if tag in CLOSED_BY_SAME and self.open and self.open[-1][0] == tag:
                self._pop()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        main, dropped = tag in ("article", "main"), tag in DROPPED or tag == "header" and not self.main
        if attrs:
            a = {k: v or "" for k, v in attrs}
            marks = MARKS.findall(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower())
            main = main or a.get("role") == "main" or a.get("itemprop", "").lower() in ("articlebody", "main")
            unwanted = UNWANTED_INSIDE if self.main else UNWANTED
            dropped = dropped or tag not in ("html", "body") and not unwanted.isdisjoint(marks) or "hidden" in a or a.get("aria-hidden") == "true"
        if block or dropped or main:
            self._push(tag, dropped, main and not dropped)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        at = self.places.get(tag)
        if not at or tag in INNER and self.barriers and self.barriers[-1] > at[-1]:
            return
        for _ in range(len(self.open) - at[-1]):
            self._pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1] and self.open[-1][0] not in BLOCKS:
            return  # inside a dropped inline element
        self.text.append(data)


def page_lines(html: str) -> list[tuple[bool, bool, str]]:
    """(in the article, dropped by markup, text) of each block with text."""
    p = _Lines()
    p.feed(html)
    p.close()
    p._flush()
    return p.lines


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each line of a, one whole number with a bit for each line of b: 0 where the longest common subsequence of a up
    to here grows with that line of b. A step costs len(b) / 64 machine words, however often lines repeat.
    """
    where: dict[int, list[int]] = {x: [] for x in a}
    for j, x in enumerate(b):
        if x in where:
            where[x].append(j)
    masks = {x: sum(1 << j for j in at) for x, at in where.items() if len(at) > 64}  # the others are put together when needed
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & (masks[x] if x in masks else sum(1 << j for j in where[x]))
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with the first 0, 1, ... lines of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _pairs(a: list[int], b: list[int], most_bits: int = 2**27) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence; large tables of bits are halved first, so memory stays bounded."""
    if not a or not b:
        return []
    if len(a) * len(b) > most_bits and len(a) > 1:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _pairs(a[:half], b[:cut], most_bits) + [(half + i, cut + j) for i, j in _pairs(a[half:], b[cut:], most_bits)]
    rows, i, j, out = list(_rows(a, b)), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions, in a and in b, of a longest common subsequence."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    mid = [(n + i, n + j) for i, j in _pairs(a[n : len(a) - m], b[n : len(b) - m])]
    both = [(i, i) for i in range(n)] + mid + [(len(a) - m + i, len(b) - m + i) for i in range(m)]
    return [i for i, _ in both], [j for _, j in both]


def template_lines(sides: list[tuple[bool, list[int]]]) -> list[int]:
    """Lines to delete of a page, from what it shares with its neighbours: (nearly equal, shared lines) of one or two.

    What either neighbour shares goes. A nearly equal neighbour may be a revision of the page that shares its article,
    so beside another it only confirms: if both are nearly equal, what both share goes.
    """
    if len(sides) < 2:
        return sides[0][1] if sides else []
    (near, a), (near2, b) = sides
    if near and near2:
        return sorted(set(a) & set(b))
    return b if near else a if near2 else sorted(set(a) | set(b))


def edge_lines(own: list[int], sides: list[tuple[bool, list[int]]]) -> list[int]:
    """Lines to delete of a marked article (own) that all its neighbours share, as far as they reach from its ends.

    A nearly equal neighbour may be a revision and tells nothing; nor does an article that has no line but shared ones.
    """
    both = set.intersection(*(set(x) for _, x in sides))
    if not both or any(near for near, _ in sides) or both.issuperset(own):
        return []
    first = last = 0
    start = int(own[0] not in both)  # the headline is its own
    while own[start + first] in both and start + first < len(own) - 1:
        first += 1
    while own[-1 - last] in both:
        last += 1
    return own[start : start + first] + own[len(own) - last :]


def blocks(pages: DataFrame) -> DataFrame:
    """A row per page: url, its key (pid, ph; pid is NO_ID for null), host, path, marked, kept, lf, lines; each page is parsed once.

    kept has the blocks (place, text) of the article where the page marks one, else those that markup leaves. lines are
    the hashes of all blocks, for the alignment; lf names them with the places of kept.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, html, pid, ph in zip(b.url, b.html, b.pid, b.ph):
                try:
                    u = urlsplit(url or "")
                    host, path = u.hostname or "", u.path.rstrip("/")
                except ValueError:
                    host, path = "", url
                lines = page_lines(html)
                marked = any(m and not d for m, d, _ in lines)
                kept = [(i, t) for i, (m, d, t) in enumerate(lines) if (m or not marked) and not d]
                hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for _, _, t in lines]
                out.append((url, pid, ph, host, path, marked, kept, hashes))
            yield pd.DataFrame(out, columns=["url", "pid", "ph", "host", "path", "marked", "kept", "lines"])

    html = F.coalesce("html", F.lit(""))
    rows = pages.select("url", html.alias("html"), F.coalesce("page_id", F.lit(NO_ID)).alias("pid"), F.xxhash64("url", html).alias("ph"))
    layout = "url string, pid long, ph long, host string, path string, marked boolean, kept array<struct<i int, t string>>, lines array<long>"
    lf = F.xxhash64("marked", "kept.i", "lines")
    return materialise(rows.mapInPandas(listed, layout).withColumn("lf", lf))


def shared_lines(parsed: DataFrame) -> DataFrame:
    """host, lf, gone: the lines to delete of each page that shares some with its neighbours on the host.

    Pages with equal lists (and marks) are one here, so copies are no neighbours.
    """
    first = F.min(F.struct("path", "marked", "lines", F.col("kept.i").alias("own")))
    lists = parsed.groupBy("host", "lf").agg(first.alias("p")).select("host", "lf", "p.*")
    lines = numbered(lists, ["host", "path", "lf"])
    after = lines.select((F.col("pos") - 1).alias("pos"), *(F.col(c).alias(f"{c}2") for c in ("host", "lf", "marked", "lines", "own")))
    pairs = lines.join(after, "pos").where("host = host2")

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                i, j = common_lines(list(r.lines), list(r.lines2))
                near = 5 * len(i) >= 4 * max(len(r.lines), len(r.lines2))
                a, c = set(r.own), set(r.own2)
                inside = [(x, y) for x, y in zip(i, j) if x in a and y in c]  # an article's lines count where they stand in both
                out.append((r.host, r.lf, r.marked, r.own, near, [x for x, _ in inside] if r.marked else i))
                out.append((r.host, r.lf2, r.marked2, r.own2, near, [y for _, y in inside] if r.marked2 else j))
            yield pd.DataFrame(out, columns=["host", "lf", "marked", "own", "near", "shared"])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, lf, marked, own, sides in zip(b.host, b.lf, b.marked, b.own, b.sides):
                told = [(x["near"], list(x["shared"])) for x in sides]
                gone = edge_lines(list(own), told) if marked else template_lines(told)
                if gone:
                    out.append((host, lf, marked, gone))
            yield pd.DataFrame(out, columns=["host", "lf", "marked", "gone"])

    found = pairs.mapInPandas(differ, "host string, lf long, marked boolean, own array<int>, near boolean, shared array<int>")
    sides = F.collect_list(F.struct("near", "shared")).alias("sides")  # two neighbours at most
    told = found.groupBy("host", "lf").agg(F.first("marked").alias("marked"), F.first("own").alias("own"), sides)
    gone = materialise(told.mapInPandas(settle, "host string, lf long, marked boolean, gone array<int>"))

    articles = lines.where("marked").select("host", "lf", "lines", F.array_distinct(F.transform("own", lambda i: F.get("lines", i))).alias("h"))
    often = hot_join(articles.select("host", F.explode("h").alias("h")).groupBy("host", "h").count(), articles.groupBy("host").agg(F.count("*").alias("n")), ["host"])
    often = often.where("n >= 3 and 5 * count >= 4 * n").select("host", "h")
    cut = hot_join(gone.where("marked").select("host", "lf", F.explode("gone").alias("i")), articles.select("host", "lf", "lines"), ["host", "lf"])
    cut = hot_join(cut.select("host", "lf", "i", F.get("lines", F.col("i")).alias("h")), often, ["host", "h"])
    cut = cut.groupBy("host", "lf").agg(F.collect_list("i").alias("gone"))
    return gone.where("not marked").select("host", "lf", "gone").unionByName(cut)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html is the empty page with the empty text; a null or unreadable URL belongs to the empty host; repeated rows
    each give a row; other columns of the input are not read. An empty table gives no rows. Blocks are in page order,
    joined by line ends; white space in a block is one space.
    """
    parsed = blocks(pages)

    gone = materialise(shared_lines(parsed))  # written first, so that a small one is sent to the texts

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = []
            for kept, cut in zip(b.kept, b.gone):
                cut = set(cut) if cut is not None else ()
                text.append("\n".join([x["t"] for x in kept if x["i"] not in cut]))
            yield b[["page_id", "url"]].assign(text=text)

    rows = hot_join(parsed.select(F.col("pid").alias("page_id"), "url", "host", "lf", "kept"), gone, ["host", "lf"], "left").select("page_id", "url", "kept", "gone")
    rows = rows.mapInPandas(joined, "page_id long, url string, text string")
    return with_null_ids(rows, "page_id").withColumn("n_chars", F.length("text").cast("long"))
