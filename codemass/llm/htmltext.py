"""Main text of web pages by differencing each page with its nearest neighbour by URL.

Pages are put in the order of host and path; a page's nearest neighbour is the one before or after it on the same host
with the longer common path.  The text lines of both are aligned by their longest common subsequence.  A shared line is the
site's furniture and goes, a line of its own stays; markup breaks ties (see ``main_text``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codemass.llm.frames import checkpointed, free_name

MAIN, OTHER, DROP = 0, 1, 2
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "xmp", "noembed", "noframes", "math", "object", "canvas"}
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in _RAW}
_FURNITURE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark",
    "meta", "link", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "big",
    "br", "button", "select", "option"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words of class and id names that speak of furniture, and words that only say where or what kind of box it is.
_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo(?:s|tions?|ted|tional)?|cookies?|consent|gdpr|notices?|banners?|menus?|nav|navbar|navigation|sidebars?|breadcrumbs?"
    r"|footer|masthead|comments?|disqus|respond|share|sharing|social|related|recommended|newsletters?|subscribe|popup|modal|widgets?|toolbar|pagination"
)
_PLACES = set("""site page main top bottom left right upper lower primary secondary global mobile desktop sticky box bar block section area wrap wrapper container
    inner outer list item items link links button buttons icon icons slot unit posts post articles stories content body form signup sign up thread overlay
    header panel group row column col toggle dropdown count reply author avatar label tabs region zone holder""".split())
_WHOLE = {"site-header", "side-bar", "skip-link"}
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details", "fieldset", "center"}


@lru_cache(4096)
def _furniture(value: str) -> bool:
    """Whether one of the names in a class or id is furniture as a whole: ``share-buttons`` is, ``promo-code`` and ``related-work`` are not."""
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
        spoken = [x for x in parts if _WORDS.fullmatch(x)]
        if name in _WHOLE or spoken and all(x in spoken or x in _PLACES for x in parts):
            return True
    return False


class _Tags:
    """Reads tags in time linear in the page, whatever its quotes: a place that has no end is remembered."""

    def __init__(self, html: str):
        self.html, self.dead = html, set()
        self.seen, self.next, self.gone = 0, -1, set()

    def _special(self, at: int) -> int:
        """The next quote or '>' from ``at`` on, else -1; places from ``seen`` to ``next`` share one answer."""
        if not self.seen <= at <= self.next:
            m = _SPECIAL.search(self.html, at)
            self.seen, self.next = at, m.start() if m else len(self.html)
        return self.next if self.next < len(self.html) else -1

    def end(self, at: int) -> int:
        """Past the '>' that ends a tag whose attributes start at ``at``, quoted ones skipped; -1 if none does."""
        html, tried = self.html, []
        while (c := self._special(at)) >= 0 and c not in self.dead:
            if html[c] == ">":
                return c + 1
            tried.append(c)
            close = -1 if html[c] in self.gone else html.find(html[c], c + 1)
            if close < 0:  # a quote without another is a character like others
                self.gone.add(html[c])
            at = max(c, close) + 1
        self.dead.update(tried)
        return -1

    def mark(self, at: int) -> int:
        """Past a comment or declaration that starts at ``at``; -1 if it is text."""
        if self.html.startswith("<!--", at):
            close = self.html.find("-->", at + 4)
            return len(self.html) if close < 0 else close + 3
        if ">" in self.gone:
            return -1
        close = self.html.find(">", at)
        if close < 0:
            self.gone.add(">")
        return close + 1 or -1


def blocks(html: str) -> list[tuple[int, str]]:
    """The page's text blocks in order: MAIN within content markup, DROP within furniture, else OTHER.

    A block ends where a block-level element starts or ends.  White space within a block is one space.  Unclosed
    and misnested elements end with what encloses them; an unended tag is text.
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    tags = _Tags(html)
    zone, at, size, text_from = OTHER, 0, len(html), 0

    def flush() -> None:
        if parts:
            if s := " ".join("".join(parts).split()):
                out.append((zone, s))
            parts.clear()

    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith(("!", "?"), at):
            end = tags.mark(start)
            if end > 0:
                parts.append(unescape(html[text_from:start]))
                at = text_from = end
            continue
        closing = html.startswith("/", at)
        m = _NAME.match(html, at + closing)
        if not m or (end := tags.end(m.end())) < 0:
            continue
        if start > text_from:
            parts.append(unescape(html[text_from:start]))
        at = text_from = end
        name = m[0].lower()
        if name == "br":
            parts.append(" ")
            continue
        inline = name in _INLINE
        if not inline:
            flush()
        if closing:
            if opened[name]:
                while True:
                    last, left = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
                new = stack[-1][1] if stack else OTHER
                if left != new or zone != new:
                    flush()
                zone = new
            continue
        ended = html[end - 2] == "/"
        if name in _RAW:
            if not ended:
                close = _RAW_END[name].search(html, at)
                close = html.find(">", close.end()) if close else -1
                at = text_from = close + 1 or size
            continue
        if name in _VOID or ended:
            continue
        if not inline and stack and stack[-1][0] == "p":  # a block element ends an open paragraph
            opened[stack.pop()[0]] -= 1
            zone = stack[-1][1] if stack else OTHER
        new = zone if zone == DROP else _zone(name, html[m.end() : end - 1], zone)
        if new != zone:
            flush()
            zone = new
        stack.append((name, new))
        opened[name] += 1
    parts.append(unescape(html[text_from:]))
    flush()
    return out


def _zone(name: str, attributes: str, zone: int) -> int:
    if name in _FURNITURE or name == "header" and zone != MAIN:
        return DROP
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return DROP
            if key == "role" and value.lower() in _ROLES:
                return DROP
            # an id of a heading or a text element is an anchor, made from its words
            if (key == "class" and name not in ("body", "html", "article", "main") or key == "id" and name in _CONTAINERS) and _furniture(value):
                return DROP
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return DROP
            if key == "role" and value.lower() == "main":
                zone = MAIN
    return MAIN if name in ("article", "main") else zone


#: Bytes that the rows of one alignment take; longer pages are halved first.
_ALIGN_BYTES = 32 << 20


def aligned(own: list[str], other: list[str]) -> dict[int, int]:
    """A longest common subsequence: numbers of ``own`` lines and of the ``other`` lines that they are aligned with.

    Bit-parallel: one whole number holds a row of the table of lengths, a bit for each line of ``other``.
    """
    a, b, start = len(own), len(other), 0
    while start < min(a, b) and own[start] == other[start]:
        start += 1
    while a > start and b > start and own[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
    found = {i: i for i in range(start)} | {a + i: b + i for i in range(len(own) - a)}
    both = set(own[start:a]) & set(other[start:b])
    left = [i for i in range(start, a) if own[i] in both]
    right = [j for j in range(start, b) if other[j] in both]
    for i, j in _subsequence([own[i] for i in left], [other[j] for j in right]):
        found[left[i]] = right[j]
    return found


def _rows(own: list[str], other: list[str]):
    """After each line of ``own`` the row whose bit j is 0 where line j of ``other`` lengthens the subsequence."""
    where: dict[str, int] = defaultdict(int)
    for j, line in enumerate(other):
        where[line] |= 1 << j
    full = (1 << len(other)) - 1
    row = full
    for line in own:
        both = row & where.get(line, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(own: list[str], other: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``own`` with each prefix of ``other``."""
    row = (1 << len(other)) - 1
    for row in _rows(own, other):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _subsequence(own: list[str], other: list[str]) -> list[tuple[int, int]]:
    if not own or not other:
        return []
    if len(own) > 1 and len(own) * len(other) > 8 * _ALIGN_BYTES:
        middle = len(own) // 2
        cut = int((_lengths(own[:middle], other) + _lengths(own[middle:][::-1], other[::-1])[::-1]).argmax())
        return _subsequence(own[:middle], other[:cut]) + [(i + middle, j + cut) for i, j in _subsequence(own[middle:], other[cut:])]
    rows, out = list(_rows(own, other)), []
    i, j = len(own), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def _says(page: list[tuple[int, str]]) -> list[bool | None]:
    """What a page's markup says of each line: content, furniture, or (None) nothing, as no content is marked."""
    marked = any(zone == MAIN for zone, _ in page)
    return [zone == MAIN or (False if marked or zone == DROP else None) for zone, _ in page]


def main_text(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> str:
    """The page's content lines, two line ends apart, by differencing with its neighbour.

    A line of the page alone is content, one that the neighbour shares is furniture.  Markup breaks ties: what the page's own
    markup names as furniture goes; a shared line stays if its page names it as content, unless it lies outside of what the
    neighbour marks as content (what the neighbour names as an advert, a menu or the like may quote this page and says
    nothing), or if only the neighbour marks content and names it so.  A page of which nothing would be left (a copy
    of its neighbour) keeps what its own markup leaves.
    """
    own = _says(page)
    twins = aligned([s for _, s in page], [s for _, s in neighbour]) if neighbour else {}
    other = [None if zone == DROP else told for (zone, _), told in zip(neighbour, _says(neighbour), strict=True)] if neighbour else []

    def stays(i: int) -> bool:
        if own[i] is False or i not in twins:
            return own[i] is not False
        twin = other[twins[i]]
        return twin is not False if own[i] else twin is True

    kept = [s for i, (_, s) in enumerate(page) if stays(i)] or [s for i, (_, s) in enumerate(page) if own[i] is not False]
    return "\n\n".join(kept)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_OWN, _GHOST = 0, 1
#: Pages and bytes of html that a range has on average, at most.
RANGE_PAGES, RANGE_BYTES = 4_000, 16 << 20


def _edges(order: DataFrame, count: int) -> list[tuple]:
    """First row, last row and last row before the last's URL, each (url, print), of ``count`` ranges of ``order``."""

    def run(batches):
        first = last = prior = None
        for batch in batches:
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = first or (u, h)
                if last and last[0] != u:
                    prior = last
                last = u, h
        if first:
            values = [*first, *last, *(prior or (None, None))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.string(), pa.int64()] * 3, strict=True)], list("abcdef"))

    ranges = order.repartitionByRange(count, "_u", "_h").sortWithinPartitions("_u", "_h")
    rows = ranges.mapInArrow(run, "a string, b long, c string, d long, e string, f long").collect()
    found = [((r[0].encode(), r[1]), (r[2].encode(), r[3]), r[4] is not None and (r[4].encode(), r[5])) for r in rows]
    return sorted(found, key=lambda r: r[0])


def _ghosts(edges: list[tuple]) -> dict[tuple, list[int]]:
    """Rows that a range before or after their own needs as the neighbour of its first or last pages."""
    wanted: dict[tuple, list[int]] = defaultdict(list)
    for b in range(1, len(edges)):
        url, at = edges[b][0][0], b - 1
        while at >= 0 and edges[at][1][0] == url and not edges[at][2]:
            at -= 1
        if at >= 0:
            wanted[edges[at][1] if edges[at][1][0] != url else edges[at][2]].append(b)
        if edges[b - 1][1][0] != url:
            wanted[edges[b][0]].append(b - 1)
    return wanted


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", ranges: int | None = None) -> DataFrame:
    """``pages`` without html, with text (empty if none) and n_chars (its code points).

    A row in, a row out, repeated rows too.  Null html is an empty page.  A page's neighbours are the rows before and after it
    in the order of URLs, rows of its own URL left out; a page without a host (a null url too) has none.  Of pages of one URL
    all have the page before them and the last has the page after them.  The result does not depend on partitions.
    Input columns with a result's name are replaced.  An empty table gives an empty result.

    Pages are shuffled once, into ``ranges`` of the order, so a host with a third of all pages lies in many tasks.  The
    ranges' first and last URLs are found beforehand from rows of URL and print alone; rows at a range's end go to the
    range beyond as well.  Each range is a task; by default one has about 4,000 pages or 16 MB of html on average, or less.
    """
    spark = pages.sparkSession
    low = F.lower(F.coalesce(F.col(url).cast("string"), F.lit("")))
    host = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(low, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    keep = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars", html.lower())]
    names = [f.name for f in keep]
    sorted_url = F.when(host != "", F.concat(host, F.lit("\x00"), path))
    own = F.xxhash64(F.col(key), F.col(html))
    order = checkpointed(pages.select(sorted_url.alias("_u"), own.alias("_h"), F.octet_length(html).alias("_n")))
    total = order.agg(F.count("*").alias("pages"), F.coalesce(F.sum("_n"), F.lit(0)).alias("bytes")).first()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = ranges or max(usual, total["pages"] // RANGE_PAGES, total["bytes"] // RANGE_BYTES)
    edges = _edges(order.where("_u is not null").select("_u", "_h"), count)
    shared = spark.sparkContext.broadcast(([e[0] for e in edges], dict(_ghosts(edges))))  # some URLs for each range

    @F.pandas_udf("array<int>")
    def targets(u, h):
        import pandas as pd

        firsts, ghosts = shared.value
        out = []
        for a, b in zip(u, h, strict=True):
            if a is None:  # alone: in any range
                out.append([2 * (b % count)])
            else:
                at = a.encode(), b
                out.append([2 * max(0, bisect_right(firsts, at) - 1) + _OWN, *(2 * g + _GHOST for g in ghosts.get(at, ()))])
        return pd.Series(out)

    by = [free_name(pages, c) for c in ("_range", "_url", "_print")]
    rows = pages.select(*names, html, sorted_url.alias(by[1]), own.alias(by[2]))
    rows = rows.withColumn(by[0], F.explode(targets(by[1], by[2])))
    half = F.floor(F.col(by[0]) / 2).cast("int")
    dealt = rows.repartitionById(count, half).sortWithinPartitions(half, *by[1:], by[0])
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        before = now = None  # each: range, url, blocks, ghost, kept values

        def row(after):
            near = [x for x in (before, after) if x and x[0] == now[0] and x[1] != now[1] and x[1].split("\x00")[0] == now[1].split("\x00")[0]]
            nearest = max(near, key=lambda x: _common(x[1], now[1])) if near else None  # the one before among equals
            s = main_text(now[2], nearest and nearest[2])
            return (*now[4], s, len(s))

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            made, held = [], 0
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*by[:2], html, *names)]
            for r, u, source, *kept in zip(*columns, strict=True):
                number, u = r.as_py(), u.as_py()
                after = (number // 2, u, blocks(source.as_py() or ""), number % 2 == _GHOST, [v.as_py() for v in kept])
                if now:
                    if not now[3]:
                        made.append(row(after if u else None) if now[1] else (*now[4], *_alone(now[2])))
                        held += len(made[-1][-2])
                        if held > 8 << 20:
                            yield out(made)
                            made, held = [], 0
                    if now[0] != after[0]:
                        before = None
                    elif now[1] and now[1] != u:
                        before = now
                now = after
            if made:
                yield out(made)
        if now and not now[3]:
            yield out([row(None) if now[1] else (*now[4], *_alone(now[2]))])

    return dealt.mapInArrow(run, schema)


def _alone(page: list[tuple[int, str]]) -> tuple[str, int]:
    s = main_text(page, None)
    return s, len(s)
