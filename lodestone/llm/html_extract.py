"""Main text of web pages (operator 8): markup first, then differencing with the nearest page of the host.

The method dealt deletes the lines that a page shares with its nearest page by URL. On the pages here it can't give right
results alone: their menus, adverts and comments are invented page by page (README has the figures). So the elements that
markup tells apart go first, and differencing decides on the rest of every page; of lines within the article's
element those go that the nearest page has outside its own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, parted, partitions, slices

#: Elements whose text is never the page's, wherever they stand.
_DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video nav aside form button select textarea input option footer head title menu dialog".split())
#: Text until the matching end tag only, whatever stands between.
_CONTAINERS = frozenset("div section article main header ul ol dl table figure details blockquote body html".split()) | _DROPPED
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title".split())
#: Words in class, id or role that mark menus, notices, adverts, comments and the like.
_HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|banner|cookie|cookies|consent|notice|alert|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|widget|footer|masthead|header|comment|comments|reply|replies|discussion|disqus|respond|share|sharing|social|related|recommended|contentinfo|complementary|search|login|toolbar|skip)(?:$|[\s_-]|\d)", re.I)
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """The page's text blocks in order, each with whether it stands in the article's element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # containers and marked elements, and whether their text is dropped
        self.dropped = self.articles = 0
        self.held: list[str] = []
        self.lines: list[tuple[str, bool]] = []

    def flush(self) -> None:
        if self.held:
            text = _SPACE.sub(" ", "".join(self.held)).strip()
            self.held = []
            if text:
                self.lines.append((text, self.articles > 0))

    def pop(self, at: int) -> None:
        for tag, drop in self.open[at:]:
            self.dropped -= drop
            self.articles -= tag in ("article", "main") and not drop
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.flush()
            if self.open and self.open[-1][0] in ("p", "li") and self.open[-1][1]:  # a marked paragraph that wasn't closed
                self.pop(len(self.open) - 1)
        elif tag == "br":
            self.held.append(" ")
        if tag in _VOID:
            return
        marks = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
        drop = tag in _DROPPED or tag == "header" and not self.articles or "hidden" in marks or marks.get("aria-hidden") == "true"
        drop = drop or tag not in ("html", "body", "main") and any(_HINT.search(marks.get(k, "")) for k in ("class", "id", "role"))
        if tag in _CONTAINERS or drop:
            self.open.append((tag, drop))
            self.dropped += drop
            self.articles += tag in ("article", "main") and not drop

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.pop(at)
                break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.held.append(data)


def lines_of(html: str) -> list[tuple[str, bool]]:
    """Text blocks without those of menus, adverts and other marked elements; True within <article> or <main>."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = {*range(start), *range(len(a) - end, len(a))}
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    rows = [i for i in range(start, len(a) - end) if a[i] in both]
    columns = [x for x in b[start : len(b) - end] if x in both]
    at: dict[str, int] = {}
    for j, x in enumerate(columns):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(columns)) - 1
    v, history = full, [full]
    for i in rows:  # a 0 at j: the longest common subsequence grows by one at column j
        u = v & at[a[i]]
        v = (v + u | v - u) & full
        history.append(v)
    j = len(columns)
    for r in range(len(rows), 0, -1):
        below = (1 << j) - 1
        if (~history[r] & below).bit_count() > (~history[r - 1] & below).bit_count():
            found.add(rows[r - 1])
            j = (~history[r] & below).bit_length() - 1  # the column at which this line matched
    return found


def digests(lines: list[str]) -> bytes:
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], dtype="<u8").tobytes()


def differing(own: list, inside: list[bool], nearest: list | None, theirs: list[bool]) -> list[int]:
    """What goes of a page by its nearest one; own, nearest: what tells their lines, inside, theirs: which are in the article's
    element. Of a page without it, positions of the lines that both have, unless those are all. Else, positions among the
    article's lines: those that the nearest page has, but outside its article. What both articles have stays, as articles
    quote and copy each other."""
    common = shared(own, nearest) if nearest else set()
    if not any(inside):
        return sorted(common) if len(common) < len(own) else []
    article = [i for i, x in enumerate(inside) if x]
    held = {x for x, y in zip(nearest or [], theirs) if y or not any(theirs)}
    gone = [k for k, i in enumerate(article) if i in common and own[i] not in held]
    return gone if len(gone) < len(article) else []


def main_text(lines: list[str], own: list, nearest: list | None) -> str:
    """The lines of a page without an article's element but for those that its nearest page has too; own and nearest: what
    tells the lines of both. If it shares every line, as copies do, all stay."""
    gone = set(differing(own, [False] * len(own), nearest, [False] * len(nearest or [])))
    return "\n\n".join([x for i, x in enumerate(lines) if i not in gone])


PARSED = "page_id long, url string, host string, path string, text string, lines array<string>, digests binary, inside binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text of pages with an article's element; lines of the others; of both, the digests of all unmarked lines
    and which of them are in it."""
    for batch in slices(batches, 64):
        text, lines, marks, places = [], [], [], []
        for html in batch.column(4).to_pylist():
            found = lines_of(html)
            inside = [x for x, article in found if article]
            text.append("\n\n".join(inside) if inside else None)
            lines.append(None if inside else [x for x, _ in found])
            marks.append(digests([x for x, _ in found]))
            places.append(bytes(article for _, article in found))
        columns = [pa.array(text, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(marks, pa.binary()), pa.array(places, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *columns], [c.split()[0] for c in PARSED.split(", ")])


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_no, gone) of the pages of which something goes."""
    for batch in slices(batches, 256):
        numbers = lambda x: None if x is None else np.frombuffer(x, "<u8").tolist()
        marks = lambda x: [bool(y) for y in x or b""]
        found = [(no, differing(numbers(own), marks(inside), numbers(nearest), marks(theirs))) for no, own, inside, nearest, theirs in zip(*(c.to_pylist() for c in batch.columns))]
        found = [x for x in found if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], ["page_no", "gone"])


def nearest_pages(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """page_no, digests, inside of each page, and both of the page before it in the order of host, path, page_id, of the one
    after for the first of a host, null for a host's only page.

    Rows are sorted over the cluster, so that a hot host spreads over many partitions, and numbered as they are written;
    neighbours meet by number, across partitions too: the result doesn't depend on where they were divided."""
    by = ("host", "path", "page_id", "url", "digests")
    ordered = parsed.select(*by, "inside", "page_no").repartitionByRange(partitions(parsed.sparkSession), *by).sortWithinPartitions(*by)
    ordered = scratch.keep(ordered.select("host", "digests", "inside", "page_no").withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    ends = ordered.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last")).orderBy("part").collect()  # a row for each partition
    jumps = [(b["first"], a["last"]) for a, b in zip(ends, ends[1:])]
    spark = parsed.sparkSession
    jump = spark.createDataFrame(jumps, "this long, other long")
    pages = ordered.join(F.broadcast(jump.withColumnsRenamed({"this": "at", "other": "jump_back"})), "at", "left")
    pages = pages.join(F.broadcast(jump.select(F.col("other").alias("at"), F.col("this").alias("jump_on"))), "at", "left")
    pages = pages.withColumns({"back": F.coalesce("jump_back", F.col("at") - 1), "on": F.coalesce("jump_on", F.col("at") + 1)})
    other = lambda name: ordered.select(F.col("at").alias(name), F.col("host").alias(f"{name}_host"), F.struct("digests", "inside").alias(f"{name}_page"))
    both = pages.join(other("back"), "back", "left").join(other("on"), "on", "left")
    nearest = F.when(F.col("back_host") == F.col("host"), F.col("back_page")).when(F.col("on_host") == F.col("host"), F.col("on_page"))
    return both.withColumn("nearest", nearest).select("page_no", "digests", "inside", F.col("nearest.digests").alias("nearest"), F.col("nearest.inside").alias("theirs"))


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text (blocks joined by two newlines), n_chars (code points).

    Blocks of menus, adverts, comments and other marked elements go, and of pages with an <article> or <main> that holds
    text, the blocks outside it. Every page is compared with the nearest page of its host (by URL path, then page_id) and
    loses what that has too; of an article, what that has outside its own only.
    Null html has no text, and so the empty string; a null url belongs to a host of its own; null page_ids stay null;
    repeated rows stay repeated, and as copies keep their text; an empty table gives no rows; other columns play no part.
    Pages are parsed once, where they are read; line digests are moved, and the lines of pages that lose some. A page of any length is in the memory of one task."""
    scratch = Scratch(pages.sparkSession, "pages")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), r"^.*@|:\d+$", ""))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), host.alias("host"), path.alias("path"), html.alias("html"))
    parsed = scratch.keep(chosen.mapInArrow(_parsed, PARSED).withColumn("page_no", F.monotonically_increasing_id()), "parsed")
    gone = scratch.keep(nearest_pages(parsed, scratch).mapInArrow(_differenced, "page_no long, gone array<int>"), "gone")
    scratch.drop("ordered")
    sure, open_ = parted(parsed.select("page_no", "page_id", "url", "text", "lines"), F.col("page_no"), gone, "page_no")
    blocks = F.coalesce(F.split("text", "\n\n", -1), F.col("lines"))
    left = F.filter(blocks, lambda _, i: F.coalesce(~F.array_contains("gone", i), F.lit(True)))
    out = sure.select("page_id", "url", F.coalesce("text", F.concat_ws("\n\n", "lines")).alias("text"))
    out = out.unionByName(open_.join(gone, "page_no", "left").select("page_id", "url", F.concat_ws("\n\n", left).alias("text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
