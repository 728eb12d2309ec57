"""HTML extraction: nearest-URL page differencing removes what pages repeat, structure marks the article.

1. A page is parsed once, to blocks (paragraphs, headings, list items, cells ...).  Each is marked *main* (inside
   an article or main element), *plain* or *aside* (menus, page headers and footers, sidebars, notices,
   adverts, forms, reader comments, by element, role or the words of class and id).
2. Pages are sorted by host and URL path; each is paired with the pages before and after it, its nearest
   URLs on that host.  The blocks of a pair are aligned by longest common subsequence of their hashes, and the
   lines that both pages share are deleted: plain and aside blocks always; a main block only if it is no quotation,
   that is if some page shares the line with both its neighbours and `HOST_SHARE` of the host's pages,
   `HOST_PAGES` at least, hold it.  A pair that shares half of a page's main blocks shows two copies of one article and
   says nothing about its main blocks.
3. Of what is left, a page with main blocks keeps those, any other its plain blocks; a page of which nothing would
   be left keeps what differencing has taken from these.

The sort deals rows by range of (host, path), so a host with a third of all pages is spread; only hashes are
sorted and paired, texts stay in the parsed table until the last join.  Defined results: a null html is empty; a null
or odd URL counts as the empty host and path; repeated rows get the same result and are no neighbours of each
other; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import n_parts, stage

MAIN, PLAIN, ASIDE = 0, 1, 2
#: A line of an article is the site's if this share of the host's pages hold it, and so many at least.
HOST_SHARE, HOST_PAGES = 0.5, 8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object canvas audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose end is waited for; the others only part blocks.
_KEPT = frozenset("article aside blockquote body button details dialog div dl figure footer form header main menu nav ol search section select table td th tr ul span p li label dd".split())
_ASIDE = frozenset("nav aside footer form menu dialog search button select label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " copyright disclaimer discussion disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager"
    " popup promo promos promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc"
    " toolbar topbar trending widget widgets".split()
)
_HEADER_WORDS = frozenset("header masthead banner".split())
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def _zone(name: str, attrs: str, in_main: bool) -> int | None:
    """The zone that an element opens, None if it opens none."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    if name in _ASIDE or role in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style:
        return ASIDE
    words = set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if name == "header" and not in_main:
        return ASIDE
    if name not in ("body", "html") and words & _WORDS and not (in_main and words & _HEADER_WORDS):
        return ASIDE
    if name in ("article", "main") or role == "main" or "articlebody" in found.get("itemprop", "").lower():
        return MAIN
    return None


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order, each with its zone. Linear in the page."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    zone = PLAIN

    def close():
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                out.append((whole, zone))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(_html.unescape(page[at:]))
            break
        if lt > at:
            text.append(_html.unescape(page[at:lt]))
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif nxt and nxt in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif nxt == "/" and (m := _NAME.match(page, lt + 2)):
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            name = m[0].lower()
            if end < 0:
                break
            if name in _BLOCK:
                close()
            if name in _KEPT and any(s[0] == name for s in reversed(stack)):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
                if stack[-1][1] != zone:
                    close()
                zone = stack[-1][1]
        elif m := _NAME.match(page, lt + 1):
            name = m[0].lower()
            end = _TAG_END.match(page, m.end())
            if end is None:  # the page ends inside the tag
                break
            at = end.end()
            attrs = page[m.end() : at - 1]
            if name in _RAW:
                if not attrs.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                    stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                    end2 = page.find(">", stop.end()) if stop else -1
                    at = n if end2 < 0 else end2 + 1
                continue
            if name in _BLOCK:
                close()
            elif name == "br":
                text.append(" ")
            if name in _KEPT and name not in _VOID:
                if name in ("p", "li", "dd") and stack[-1][0] == name:  # an open one ends here
                    stack.pop()
                    zone = stack[-1][1]
                opened = _zone(name, attrs, zone == MAIN)
                new = zone if zone == ASIDE or opened is None else opened
                if new != zone:
                    close()
                zone = new
                stack.append((name, zone))
        else:
            text.append("<")
            at = lt + 1
    close()
    return out


#: Pairs of equal lines from which two pages are aligned by rows of bits.
MANY = 1 << 21


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """The lengths of a longest common subsequence of `a` and each prefix of `b`, by one row of bits."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks.setdefault(x, []).append(j)
    size = len(b) // 8 + 1
    for x, at in masks.items():
        row = np.zeros(8 * size, np.uint8)
        row[at] = 1
        masks[x] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
    full = row = (1 << len(b)) - 1
    for x in a:
        if hit := row & masks.get(x, 0):
            row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _halved(a: list, b: list, i0: int, j0: int) -> list[tuple[int, int]]:
    """A longest common subsequence by halving `a`, in memory linear in both."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [(i0, j0 + b.index(a[0]))] if a[0] in b else []
    mid = len(a) // 2
    at = int(np.argmax(_prefix_lengths(a[:mid], b) + _prefix_lengths(a[mid:][::-1], b[::-1])[::-1]))
    return _halved(a[:mid], b[:at], i0, j0) + _halved(a[mid:], b[at:], i0 + mid, j0 + at)


def _chained(a: list, b: list, head: int, n: int, where: dict) -> list[tuple[int, int]]:
    """A longest common subsequence of a[head:n] with the places `where` equal lines stand in `b`, the last first."""
    tails: list[int] = []
    links: list = []
    for i in range(head, n):
        for j in where.get(a[i], ()):
            at = bisect.bisect_left(tails, j)
            link = (i, j, links[at - 1] if at else None)
            tails[at : at + 1] = [j]
            links[at : at + 1] = [link]
    mid, link = [], links[-1] if links else None
    while link:
        mid.append(link[:2])
        link = link[2]
    return mid[::-1]


def shared_lines(a: list, b: list) -> tuple[list[int], list[int]]:
    """Positions of a longest common subsequence in both sequences."""
    head, n, m = 0, len(a), len(b)
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    while n > head and m > head and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    where: dict = {}
    for j in range(m - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    if sum(len(where.get(x, ())) for x in a[head:n]) < MANY:
        mid = _chained(a, b, head, n, where)
    else:
        mid = _halved(a[head:n], b[head:m], head, head)
    pairs = [(i, i) for i in range(head)] + mid + list(zip(range(n, len(a)), range(m, len(b)), strict=True))
    return [i for i, _ in pairs], [j for _, j in pairs]


def host_path(url: str | None) -> tuple[str, str]:
    rest = (url or "").split("#")[0].split("?")[0]
    rest = rest.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    return host.lower(), path


PARSED = "page_id long, url string, k binary, host string, path string, lines array<long>, zones binary, texts array<string>"


def _parse(batches):
    """Pages to blocks: `k` tells pages apart, `lines` are the blocks' hashes, `texts` those of the kind that the text is made of."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            keys, hosts, paths, lines, zones, texts = [], [], [], [], [], []
            for page_id, url, page in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                host, path = host_path(url)
                rows = blocks(page or "")
                keys.append(xxhash.xxh3_128_digest(repr((page_id, url, page)).encode("utf-8", "surrogatepass")))
                hosts.append(host)
                paths.append(path)
                lines.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in rows])
                zones.append(bytes(z for _, z in rows))
                kind = MAIN if any(z == MAIN for _, z in rows) else PLAIN
                texts.append([t if z == kind else None for t, z in rows])
            columns = [pa.array(keys, pa.binary()), pa.array(hosts), pa.array(paths), pa.array(lines, pa.list_(pa.int64())), pa.array(zones, pa.binary()), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns], ["page_id", "url", "k", "host", "path", "lines", "zones", "texts"])


def _neighbours(batches):
    """Links of neighbouring rows of one host; the first and last row of the range for the seams, with the range's number."""
    part = TaskContext.get().partitionId()
    before, first, last = None, None, None
    names = ["a", "b", "part", "host"]
    for batch in batches:
        a, b = [], []
        for row in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if before is None:
                first = row
            elif before[0] == row[0]:
                a.append(before[1])
                b.append(row[1])
            before = last = row
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.string())], names)
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first[1], None], pa.binary()), pa.array([None, last[1]], pa.binary()), pa.array([part, part], pa.int32()), pa.array([first[0], last[0]])], names)


def _compare(batches):
    """Pairs of pages to what each shares with the other: places of blocks that go, and main blocks (place, line) under suspicion."""
    kind = pa.list_(pa.struct([("i", pa.int32()), ("line", pa.int64())]))
    for batch in batches:
        keys, sides, gone, main = [], [], [], []
        for host_row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            ka, kb, a, za, b, zb = host_row
            x, y = shared_lines(a, b)
            for k, side, lines, zones, at in ((ka, 1, a, za, x), (kb, 0, b, zb, y)):
                if not at:
                    continue
                own = [i for i in at if zones[i] == MAIN]
                copies = 2 * len(own) >= zones.count(MAIN)
                keys.append(k)
                sides.append(side)
                gone.append([i for i in at if zones[i] != MAIN])
                main.append([] if copies else [{"i": i, "line": lines[i]} for i in own])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sides, pa.int32()), pa.array(gone, pa.list_(pa.int32())), pa.array(main, kind)], ["k", "side", "gone", "main"])


def kept_blocks(zones: bytes, gone: set[int]) -> list[int]:
    """The places of the blocks that make up the text."""
    kind = MAIN if MAIN in zones else PLAIN
    every = [i for i, z in enumerate(zones) if z == kind]
    return [i for i in every if i not in gone] or every


def _text(batches):
    for batch in batches:
        texts, shared, aside = [], [], []
        for zones, own, gone in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            taken = set(gone or ())
            kept = kept_blocks(zones, taken)
            texts.append("\n\n".join([own[i] for i in kept]))
            shared.append(len(taken.difference(kept)))
            aside.append(sum(1 for i, z in enumerate(zones) if z == ASIDE and i not in taken))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(shared, pa.int64()), pa.array(aside, pa.int64())], ["page_id", "url", "text", "n_shared", "n_aside"])


#: Ranges whose seams are joined at once; what is left of them, two rows each, is joined in one task.
SEAMS = 64


def _seams(ends: DataFrame) -> DataFrame:
    """(a, b): the last page of a range and the first of the next range that has rows, on one host.

    `ends` has two rows for each range: part, host, k, opens. Ranges are at most `_common.MOST_PARTS`.
    """

    def joined(rows: DataFrame, by) -> DataFrame:
        last = {c: F.lag(c).over(by).alias(f"_{c}") for c in ("host", "k", "opens")}
        return rows.select("*", *last.values(), F.lead("k").over(by).isNull().alias("_end"))

    order = ["part", F.col("opens").desc()]
    near = joined(ends.withColumn("group", F.floor(F.col("part") / SEAMS)), Window.partitionBy("group").orderBy(*order))
    far = joined(near.where(F.col("_k").isNull() | F.col("_end")).select("part", "host", "k", "opens"), Window.orderBy(*order))
    pair = F.col("opens") & ~F.col("_opens") & (F.col("host") == F.col("_host"))
    of = lambda rows: rows.where(pair).select(F.col("_k").alias("a"), F.col("k").alias("b"))
    return of(near).unionByName(of(far)).distinct()


def neighbours(lines: DataFrame, parts: int) -> DataFrame:
    """(a, b): the pages `lines` (k, host, path, page_id) that follow each other on their host, by path, then id."""
    order = ["host", "path", "page_id", "k"]
    rows = lines.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stage(rows.mapInArrow(_neighbours, "a binary, b binary, part int, host string"), "html-pairs")
    ends = dealt.where(F.col("part").isNotNull()).select("part", "host", F.coalesce("a", "b").alias("k"), F.col("a").isNotNull().alias("opens"))
    return dealt.where(F.col("part").isNull()).select("a", "b").unionByName(_seams(ends))


def shared_blocks(parsed: DataFrame, parts: int) -> DataFrame:
    """(k, gone): the places of the blocks that differencing deletes, for pages that have any."""
    lines = stage(parsed.select("k", "host", "path", "page_id", "lines", "zones").dropDuplicates(["k"]), "html-lines")
    left = lines.select(F.col("k").alias("a"), F.col("lines").alias("x"), F.col("zones").alias("xz"))
    right = lines.select(F.col("k").alias("b"), F.col("lines").alias("y"), F.col("zones").alias("yz"))
    both = neighbours(lines, parts).join(left, "a").join(right, "b").select("a", "b", "x", "xz", "y", "yz")
    shared = stage(both.mapInArrow(_compare, "k binary, side int, gone array<int>, main array<struct<i: int, line: long>>"), "html-shared")
    # main blocks: lines shared with both neighbours somewhere, then their share of the host's pages
    suspects = shared.where(F.size("main") > 0).select("k", "side", F.explode("main").alias("m")).select("k", "side", "m.i", "m.line").join(lines.select("k", "host"), "k")
    twice = stage(suspects.groupBy("k", "host", "i", "line").agg(F.count_distinct("side").alias("n")).where("n = 2").select("host", "line").distinct(), "html-suspects")
    held = lines.select("host", F.explode(F.array_distinct("lines")).alias("line")).join(twice, ["host", "line"]).groupBy("host", "line").agg(F.count("*").alias("n"))
    pages = lines.join(twice.select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.count("*").alias("pages"))
    sitewide = held.join(pages, "host").where((F.col("n") >= HOST_PAGES) & (F.col("n") >= HOST_SHARE * F.col("pages"))).select("host", "line")
    main = suspects.join(sitewide, ["host", "line"]).select("k", F.array("i").alias("gone"))
    rows = shared.select("k", "gone").unionByName(main)
    return rows.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")).where(F.size("gone") > 0)


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """page_id, url, text (empty if none), n_shared (blocks that differencing deleted) and n_aside (other blocks that their
    markup names) for each row of `pages` (page_id, url, html). Without `differencing`, markup alone decides."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = stage(rows.mapInArrow(_parse, PARSED), "html-parsed")
    if differencing:
        # written, so that its size is known: beside a small table the texts stay where they are
        gone = stage(shared_blocks(parsed, n_parts(rows)), "html-gone")
        parsed = parsed.join(gone, "k", "left")
    else:
        parsed = parsed.withColumn("gone", F.lit(None).cast("array<int>"))
    return parsed.select("page_id", "url", "zones", "texts", "gone").mapInArrow(_text, "page_id long, url string, text string, n_shared long, n_aside long")


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_aside")
