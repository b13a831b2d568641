"""Main text of web pages: differencing against the page with the nearest URL of the same host, then structure.

A page is read by the standard library's HTML parser into all its blocks of text, menus and footers included. Each block
has a place: FURNITURE (inside an element that holds no article text, or that is named as such by role, class or id; fixed
lists), ARTICLE (inside a marked article and not furniture), or PLAIN.

Each page is paired with its neighbour: pages of a host are ordered by URL path, and a page's partner is the one of its two
neighbours with the longer common path prefix (of equal ones, the one before). Their blocks are aligned by longest common
subsequence, and blocks shared by both are deleted, as pages of a host share their furniture and not their text. Blocks of a
marked article are safe from that unless ``strict`` is set: two pages of one article would else lose it. Pages with equal
blocks throughout are copies, of which differencing deletes nothing.

What is left is settled by structure: furniture that the partner doesn't share goes, and where a page has article blocks only
those stay.

Neighbours come from a sort of the pages by host and path over range partitions. The page before and the page after a
partition's ends are fetched by partition number, so no host, however large, lies in one task.

Defined cases: a null html is empty and gives an empty text; a null url has the empty host and path; pages that repeat are
neighbours and copies; an empty table gives no rows; a page is read whole, whatever its length; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, sliced

FURNITURE, PLAIN, ARTICLE = range(3)
# Elements without text of the page; those whose text is furniture; elements that end a block; names of furniture.
UNSEEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "canvas", "object"}
SKIP = UNSEEN | {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NAMED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|reply|replies|discussion|disqus|consent|cookie|cookies|copyright|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|promoted|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}


class Blocks(HTMLParser):
    """Blocks of a page as (text, place)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool]] = []
        self.skipped = self.unseen = self.articles = 0
        self.parts: list[str] = []

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, FURNITURE if self.skipped else ARTICLE if self.articles else PLAIN))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in SKIP:
            self.end_block()
        if tag in VOID:
            return
        if tag == "p":
            # a paragraph ends an open one
            self._close("p", stop={"article", "main", "section", "div", "td", "th", "li", "blockquote", "body"})
        named = dict(attrs)
        furniture = tag in SKIP or (named.get("role") or "").lower() in ROLES or "hidden" in named or (tag not in ("html", "body", "article", "main") and any(NAMED.search(named.get(k) or "") for k in ("class", "id")))
        if furniture:
            self.end_block()
        self.open.append((tag, furniture))
        self.skipped += furniture
        self.unseen += tag in UNSEEN
        self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.end_block()

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in SKIP:
            self.end_block()
        if tag not in VOID:
            self._close(tag)

    def _close(self, tag, stop=frozenset()):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if any(furniture for _, furniture in self.open[i:]):
                    self.end_block()
                for name, furniture in self.open[i:]:
                    self.skipped -= furniture
                    self.unseen -= name in UNSEEN
                    self.articles -= name in ("article", "main")
                del self.open[i:]
                return
            if self.open[i][0] in stop or self.open[i][1]:
                # an end tag inside furniture doesn't close what is around it
                if self.open[i][0] in stop:
                    return
                if tag not in ("body", "html", "article", "main"):
                    return

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def blocks_of(html: str | None) -> list[tuple[str, int]]:
    """All blocks of a page, with their places."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    return parser.found


def settled(places: list[int]) -> list[bool]:
    """Which blocks structure keeps: those of the article where there is one, else those that aren't furniture."""
    best = ARTICLE if ARTICLE in places else PLAIN
    return [p == best for p in places]


def shared(a: list, b: list) -> list[bool]:
    """Which blocks of a are in a longest common subsequence with b.

    Common ends belong to one and are taken off first, then blocks that the other side lacks. The rest is aligned by
    Hirschberg's halving: memory is that of rows of lengths, time the product of what is left of both.
    """
    out = [False] * len(a)
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        out[len(a) - 1 - hi] = True
        hi += 1
    own, other = set(a[lo : len(a) - hi]), set(b[lo : len(b) - hi])
    places = [i for i in range(lo, len(a) - hi) if a[i] in other]
    rest = [x for x in b[lo : len(b) - hi] if x in own]
    work = [(places, rest)]
    while work:
        left, right = work.pop()
        if not left or not right:
            continue
        if len(left) == 1:
            out[left[0]] = a[left[0]] in right
            continue
        half = len(left) // 2
        head = _lengths([a[i] for i in left[:half]], right)
        tail = _lengths([a[i] for i in reversed(left[half:])], right[::-1])
        cut = max(range(len(right) + 1), key=lambda k: head[k] + tail[len(right) - k])
        work += [(left[:half], right[:cut]), (left[half:], right[cut:])]
    return out


def _lengths(a: list, b: list) -> list[int]:
    """Length of a longest common subsequence of a with each beginning of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for k, y in enumerate(b, 1):
            here = row[k]
            row[k] = above + 1 if x == y else max(here, row[k - 1])
            above = here
    return row


def nearest(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1 for the neighbour with the longer common prefix; 0 without neighbours."""

    def common(other: str | None) -> int:
        if other is None:
            return -1
        n = 0
        for x, y in zip(path, other):
            if x != y:
                break
            n += 1
        return n

    a, b = common(before), common(after)
    return 0 if a < 0 and b < 0 else -1 if a >= b else 1


def dropped(blocks: list[tuple], partner: list[tuple], strict: bool = False) -> list[bool]:
    """Which blocks (text or its hash, place) of a page differencing with its partner deletes."""
    own, other = [t for t, _ in blocks], [t for t, _ in partner]
    if own == other:
        return [False] * len(own)
    return [gone and (strict or place != ARTICLE) for (_, place), gone in zip(blocks, shared(own, other), strict=True)]


def _parsed(pages: DataFrame) -> DataFrame:
    """row, page_id, url, blocks, places."""

    def read(batches):
        for part in sliced(batches, 3):
            found = [blocks_of(x.as_py()) for x in part.column(3)]
            lists = [pa.array([[b[k] for b in f] for f in found], pa.list_(kind)) for k, kind in ((0, pa.string()), (1, pa.int8()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], ["row", "page_id", "url", "blocks", "places"])

    return pages.select("row", "page_id", "url", "html").mapInArrow(read, "row long, page_id long, url string, blocks array<string>, places array<byte>")


def _outline(pages: DataFrame) -> DataFrame:
    """row, page_id, host, path, and a hash and place for each block: all that differencing needs."""

    def read(batches):
        for part in sliced(batches, 4):
            found = [[((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)), m) for t, m in blocks_of(x.as_py())] for x in part.column(4)]
            lists = [pa.array([[b[k] for b in f] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.int8()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *lists], ["row", "page_id", "host", "path", "hashes", "marks"])

    return pages.select("row", "page_id", "host", "path", "html").mapInArrow(read, "row long, page_id long, host string, path string, hashes array<long>, marks array<byte>")


def _deletions(scratch: Scratch, outline: DataFrame, strict: bool) -> DataFrame:
    """row, gone: a flag for each block, of pages that lose any."""
    order = ["host", "path", "page_id"]
    # saved first: finding the bounds of the ranges reads it once more
    outline = scratch.save(outline, "parsed")
    table = scratch.save(outline.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "outlines")
    # the first and last page of each partition, for its neighbours: two rows a partition
    fields = ["page_id", "host", "path", "hashes", "marks"]
    ends = scratch.save(table.groupBy("part").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("first"), F.max_by(F.struct(*fields), F.struct(*order)).alias("last")), "ends")
    parts = [r["part"] for r in ends.select("part").orderBy("part").collect()]
    link = outline.sparkSession.createDataFrame([(p, parts[i - 1] if i else None, parts[i + 1] if i + 1 < len(parts) else None) for i, p in enumerate(parts)], "part int, left int, right int")
    link = link.join(ends.select(F.col("part").alias("left"), F.col("last").alias("x")), "left", "left").join(ends.select(F.col("part").alias("right"), F.col("first").alias("y")), "right", "left")
    extra = link.where("x IS NOT NULL").select("part", "x.*").union(link.where("y IS NOT NULL").select("part", "y.*"))
    own = table.select("part", *fields, "row", F.lit(True).alias("own"))
    both = own.unionByName(extra.select("part", *fields, F.lit(None).cast("long").alias("row"), F.lit(False).alias("own")))

    def difference(batches):
        before = current = None
        done = []

        def settle(after):
            if current is None or not current["own"]:
                return
            near = lambda o: o["path"] if o is not None and o["host"] == current["host"] and o["part"] == current["part"] else None
            which = nearest(current["path"], near(before), near(after))
            if which:
                partner = before if which < 0 else after
                gone = dropped(*(list(zip(r["hashes"], r["marks"], strict=True)) for r in (current, partner)), strict)
                if any(gone):
                    done.append((current["row"], gone))

        def out():
            columns = list(zip(*done, strict=True)) if done else [[], []]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.bool_()))], ["row", "gone"])

        for batch in batches:
            for row in batch.to_pylist():
                settle(row)
                before, current = current, row
            yield out()
        settle(None)
        yield out()

    near = both.repartition("part").sortWithinPartitions("part", "host", "path", "page_id", "own")
    return near.mapInArrow(difference, "row long, gone array<boolean>").dropDuplicates(["row"])


def _known(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host, path = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1)
    return pages.select(F.xxhash64("page_id", "url", "html").alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), "html")


def extract(pages: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (blocks that differencing deleted).

    Only outlines (hashes of blocks) are sorted and compared; pages meet their flags in a join.
    """
    scratch = Scratch(pages.sparkSession)
    known = _known(pages)
    gone = scratch.save(_deletions(scratch, _outline(known), strict), "gone")
    met = _parsed(known).join(gone.hint("merge"), "row", "left")
    deleted = lambda i: F.coalesce(F.get("gone", i), F.lit(False))
    best = F.when(F.array_contains("places", F.lit(ARTICLE).cast("byte")), ARTICLE).otherwise(PLAIN)
    kept = F.filter("blocks", lambda b, i: ~deleted(i) & (F.get("places", i) == best))
    text = F.array_join(kept, "\n\n")
    n_shared = F.coalesce(F.size(F.filter("gone", lambda x: x)), F.lit(0)).cast("long")
    return met.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.greatest(n_shared, F.lit(0)).cast("long").alias("n_shared"))
