"""Main text of HTML pages: nearest-URL page differencing, and landmarks.

A page becomes lines, one for each block. Pages are sorted by host and URL path, each is
aligned with the nearest page on either side that is no copy of it by the longest common
subsequence of their lines, and shared lines are deleted, unless they stand in an article:
articles repeat whole paragraphs of each other, and those are main text.

What no other page repeats can't be found by differencing. So elements that name their role
(nav, header, footer, aside and the like) drop their lines too, and so do classes and ids
that say so. These are hints: they count only inside the article or main that they stand
in, never for one that they stand around.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, small_batches
from .text import col, whole
from .url_filter import parts

#: Fixed values of HTML: elements that end a block, have no end tag, or hold no markup.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe noscript".split())
#: Elements whose text is never main text.
DROPPED = frozenset("head script style title textarea noscript template canvas audio video object iframe select button nav footer aside menu dialog".split())
#: Words in class and id, or roles, that mark boilerplate.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget contentinfo complementary alert".split())
#: Those of them that mark what readers wrote, in articles of its own as well.
REMARKS = frozenset("comment comments reply replies respond".split())
#: Words that stand beside these in a name and change nothing; any other word makes the name mean something else.
NEUTRAL = frozenset("area bar block body bottom box column container content fixed form group holder inner item items left links list main outer page panel post posts primary right row secondary section site sticky text title top unit wrap wrapper zone".split())
#: A start tag of these ends an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "head", "title", "option", "legend", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: Elements that end an open one of their own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile("[a-z0-9]+")

DROP, KEEP, ASK = 0, 1, 2
#: Pages that share so much of the longer one's text, outside lines that elements drop, are copies.
COPY_SHARE = 0.9


#: What an element does to its lines: nothing, a hint that it is boilerplate, or the certainty.
NONE, HINT, FIRM = 0, 1, 2


def _boilerplate(attributes: str) -> int:
    """FIRM for names of readers' comments, HINT for other names of boilerplate: "ad", "main-nav", "sideBar", not "with-sidebar"."""
    if "=" not in attributes:
        return NONE
    out = NONE
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            # camelCase counts as one word and as its parts.
            for words in ({*_WORD.findall(name.lower())}, {*_WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())}):
                known = words & BOILERPLATE
                if known and all(w in NEUTRAL or w.isdigit() for w in words - known):
                    out = max(out, FIRM if known & REMARKS else HINT)
    return out


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks in order, as (text, DROP, KEEP or ASK).

    References are decoded, white space runs become one space. Text in an article is KEEP,
    or in main where no article has text; an article or main inside an element with a hint
    counts where there is no other. Text in none of them is ASK where the page has none,
    else DROP. Tags are matched as browsers do: an end tag closes back to its start tag, a
    block ends an open paragraph, and a tag cut off by the end is none.
    """
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, int, str]] = []
    dropped, region, text, at, n = False, "", [], 0, len(page)

    def flush():
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                found.append((block, "drop" if dropped else region))

    def restate():
        nonlocal dropped, region
        inner = max((k for k, x in enumerate(stack) if x[2]), default=0)
        dropped = any(x[1] == FIRM for x in stack) or any(x[1] for x in stack[inner:])
        kinds = {x[2] for x in stack}
        region = "article" if "article" in kinds else "main" if "main" in kinds else ""
        if region and any(x[1] for x in stack[:inner]):
            region = "hinted"

    def pop_to(k: int):
        nonlocal stack
        flush()
        stack = stack[:k]
        restate()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if after.isalpha() and after.isascii() or after == "/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            text.append("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name in BLOCK or name == "br":
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k) if name in BLOCK or stack[k][1] else stack.__delitem__(k)
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = n if not end else end.start()
            if end:
                close = page.find(">", at)
                at = n if close < 0 else close + 1
            if name in BLOCK:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            ends = {"p"} if name in CLOSES_P else set()
            ends |= SIBLINGS.get(name, set())
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCK and stack[k][0] != "p":
                        break
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        inside = any(x[2] for x in stack)
        bad = FIRM if name in DROPPED or (name == "header" and not inside) else HINT if name == "form" else NONE
        if not bad and name not in ("html", "body", "header"):
            bad = _boilerplate(m[3])
        kind = name if name in ("article", "main") else "main" if 'role="main"' in m[3] else ""
        if bad and name not in BLOCK:
            flush()
        stack.append((name, bad, kind))
        if bad or kind:
            flush()
            restate()
    flush()
    kinds = {k for _, k in found}
    wanted = next((k for k in ("article", "main", "hinted") if k in kinds), "")
    return [(t, DROP if k == "drop" else (KEEP if k == wanted else DROP) if wanted else ASK) for t, k in found]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Indices in a of a longest common subsequence of a and b, by bit-parallel dynamic programming."""
    both = set(a) & set(b)
    if not both:
        return set()
    left = [k for k, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    places: dict[int, int] = {}
    for i, k in enumerate(left):
        places[a[k]] = places.get(a[k], 0) | 1 << i
    full = (1 << len(left)) - 1
    row, rows = full, []
    for x in right:
        hit = row & places[x]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, out = len(left), len(right), set()
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif a[left[i - 1]] == right[j - 1]:
            out.add(left[i - 1])
            i, j = i - 1, j - 1
        else:
            j -= 1
    return out


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass")) - (1 << 63)


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(row, page_id, url, host, path, texts, says, hashes, sizes): texts of kept and undecided lines, the rest of all; sizes are their characters, 0 for dropped lines."""
    host, path, _ = parts(col(url_col).cast("string"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), whole(col(html_col)).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, says, hashes, sizes = [], [], [], []
            for page in batch.column("html"):
                found = lines(page.as_py())
                texts.append([t if k else None for t, k in found])
                says.append([k for _, k in found])
                hashes.append([_hash(t) for t, _ in found])
                sizes.append([len(t) if k else 0 for t, k in found])
            cols = [*(batch.column(x) for x in ("row", "page_id", "url", "host", "path")), pa.array(texts, pa.list_(pa.string())), pa.array(says, pa.list_(pa.int8())), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.record_batch(cols, names=["row", "page_id", "url", "host", "path", "texts", "says", "hashes", "sizes"])

    return rows.mapInArrow(read, "row long, page_id long, url string, host string, path string, texts array<string>, says array<tinyint>, hashes array<long>, sizes array<int>")


def differences(parsed: DataFrame) -> DataFrame:
    """(row, gone): lines outside articles that a page shares with the nearest page on either side that is no copy of it.

    Pages are in the order of host, path and page_id and range-partitioned, so a host of any
    size is many tasks. Copies in a row are a run; a page is compared with the last page before
    its run and the first one after it. A first pass brings the pages beside the outer runs
    of each partition to the driver, four for each at most, where runs that go on in other
    partitions find their neighbours; the second compares. Both read one persisted table.
    """
    order = ["host", "path", "page_id", "row"]
    rows = parsed.select(*order, "says", "hashes", "sizes").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("row", "host", "says", "hashes", "sizes").persist()
    kind = "row long, host string, says array<tinyint>, hashes array<long>, sizes array<int>"

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, firsts, lasts = TaskContext.get().partitionId(), None, [], []
        for page, new in _runs(batches):
            if new:
                firsts = firsts if len(firsts) == 2 else [*firsts, page]
                lasts = [before] if before else []
            before = page
        found = {p["row"]: p for p in (*firsts, *lasts, *([before] if before else []))}
        if found:
            cols = [[p[c] for p in found.values()] for c in ("row", "host", "says", "hashes", "sizes")]
            types = (pa.int64(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            arrays = [pa.array([part] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.record_batch(arrays, names=["part", "place", "row", "host", "says", "hashes", "sizes"])

    edges: dict[int, list[dict]] = {}
    for r in sorted(rows.mapInArrow(outer, f"part int, place int, {kind}").collect(), key=lambda r: (r["part"], r["place"])):
        edges.setdefault(r["part"], []).append(r.asDict())
    parts_ = sorted(edges)
    beside = {}
    for k, part in enumerate(parts_):
        back = (p for i in reversed(parts_[:k]) for p in reversed(edges[i]))
        on = (p for i in parts_[k + 1 :] for p in edges[i])
        beside[part] = (_nearest(edges[part][0], back), _nearest(edges[part][-1], on))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = beside.get(TaskContext.get().partitionId(), (None, None))
        run, out = [], []

        def record():
            cols = list(zip(*out, strict=True)) if out else [[]] * 2
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32())), strict=True)], names=["row", "gone"])

        def settle(following):
            last, gone = None, []
            for page in run:
                if last is None or not _equal(last, page):
                    gone = sorted({k for q in (before, following) if q and q["host"] == page["host"] for k in _gone(page, q)})
                last = page
                if gone:
                    out.append((page["row"], gone))

        for page, new in _runs(batches):
            if new and run:
                settle(page)
                before, run = run[-1], []
                if len(out) > 1000:
                    yield record()
            run.append(page)
        settle(after)
        yield record()

    out = keep(rows.mapInArrow(compare, "row long, gone array<int>"), "page-differences")
    rows.unpersist()
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """Each page, and whether it is of another host than the first of the run before, or no copy of it."""
    head = None
    for batch in batches:
        for page in batch.to_pylist():
            new = head is None or head["host"] != page["host"] or not _copies(head, page)
            if new:
                head = page
            yield page, new


def _nearest(page: dict, others: Iterator[dict]) -> dict | None:
    """The first of others that is no copy of page, if it comes before another host."""
    for other in others:
        if other["host"] != page["host"]:
            return None
        if not _copies(page, other):
            return other
    return None


def _equal(page: dict, other: dict) -> bool:
    return page["hashes"] == other["hashes"] and page["says"] == other["says"]


def _copies(page: dict, other: dict) -> bool:
    """Equal lines, or nearly equal ones where a page has undecided lines."""
    if page["hashes"] == other["hashes"]:
        return True
    if ASK not in page["says"] and ASK not in other["says"]:
        return False
    a, b = sum(page["sizes"]), sum(other["sizes"])
    if min(a, b) < COPY_SHARE * max(a, b):
        return False
    return sum(page["sizes"][k] for k in shared(page["hashes"], other["hashes"])) >= COPY_SHARE * max(a, b)


def _gone(page: dict, other: dict) -> list[int]:
    if all(k == KEEP for k in page["says"]) or _copies(page, other):
        return []
    return [k for k in shared(page["hashes"], other["hashes"]) if page["says"][k] != KEEP]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of pages; text joins the main text's blocks by two line breaks.

    Null and empty pages, and pages without main text, have an empty text. Pages without a
    host are neighbours of each other. Copies of a page, and rows that repeat it, have the
    text that it has alone; an empty table gives an empty table. A page of any length is
    read whole, in one task. Other columns of pages are not read, whatever their names.
    """
    small_batches(pages.sparkSession)
    parsed = keep(parse(pages, id_col, url_col, html_col), "page-lines")
    gone = differences(parsed).withColumnRenamed("row", "r")
    kept = F.filter("texts", lambda t, k: t.isNotNull() & ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    rows = parsed.select("row", "page_id", "url", "texts").join(gone, F.col("row") == F.col("r"), "left")
    return rows.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))
