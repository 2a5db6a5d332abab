"""Main text of web pages: markup zones, and differencing against the page with the nearest URL of the same host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, with_text_column

MAIN, PLAIN, CHROME = 0, 1, 2
#: A neighbour that shares at least this part of a page's lines is a copy of the page, not a page of the same template.
COPY_SHARE = 0.8
#: Deletions of at most this many bytes are broadcast to the pages; beyond it both sides are shuffled.
BROADCAST_BYTES = 8 << 20

_block = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
                   "menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_raw = frozenset("script style noscript template svg math iframe object textarea select xmp noembed noframes canvas audio video title".split())
_chrome = frozenset("head nav aside form button dialog menu".split())
_outer = frozenset("header footer".split())
_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_tag = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_hint = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hint_word = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent complementary contentinfo disqus footer gdpr menu menubar modal nav navbar navigation newsletter "
                       "notice notification popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_hint_outer = frozenset("header masthead topbar top".split())  # only outside an article
_parts = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _tag_end(page: str, at: int) -> int:
    """Place behind the tag that starts before ``at``: quotes may hold '>'; a tag that never ends closes at the next '>'."""
    first = page.find(">", at)
    if first < 0:
        return len(page)
    quote = min((q for q in (page.find('"', at, first), page.find("'", at, first)) if q >= 0), default=-1)
    pos = at
    while quote >= 0:
        close = page.find(page[quote], quote + 1)
        if close < 0:
            return first + 1
        pos = close + 1
        end = page.find(">", pos)
        if end < 0:
            return first + 1
        quote = min((q for q in (page.find('"', pos, end), page.find("'", pos, end)) if q >= 0), default=-1)
        if quote < 0:
            return end + 1
    return first + 1


def _hinted(attributes: str, outer: bool) -> bool:
    """Whether class, id, role or label names a part of a page that is no article; outer: not inside an article."""
    for m in _hint.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        names = {w.lower() for w in _parts.findall(value)}
        if names & _hint_word or outer and names & _hint_outer:
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text blocks of a page in order, with their zone: inside the article or main element, plain (anywhere else), or chrome
    (menus, headers, footers, sidebars, notices, adverts, forms, comments).

    Scripts, styles, comments and markup go; character references are decoded; white space becomes one space. An element
    of chrome that is never closed ends where an article starts.
    """
    page = page or ""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    main = skip = 0
    skip_tag, main_tag = "", ""
    zone = PLAIN

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.append((text, zone))
            buffer.clear()

    pos = 0
    while True:
        m = _tag.search(page, pos)
        if not m:
            buffer.append(page[pos:])
            break
        start = m.start()
        if start > pos:
            buffer.append(page[pos:start])
        name = m[2]
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                pos = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(">", start)
                pos = end + 1 if end >= 0 else len(page)
            continue
        name = name.lower()
        end = _tag_end(page, m.end())
        closing, pos = m[1] == "/", end
        if name in _raw:
            if name in _block or name != "svg":
                buffer.append(" ") if name not in _block else flush()
            if not closing and page[end - 2: end] != "/>":
                shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, end)
                pos = shut.end() if shut else len(page)
            continue
        if name == "br" or name == "wbr":
            buffer.append(" " if name == "br" else "")
            continue
        is_block = name in _block or name in _chrome
        if is_block:
            flush()
        if closing:
            if skip and name == skip_tag:
                skip -= 1
            elif main and name == main_tag and not skip:
                main -= 1
        elif name not in _void and page[end - 2: end] != "/>" or name in _block and name not in _void:
            hinted = _hinted(page[m.end(): end], not main) if end - m.end() > 4 else False
            opens_main = name in ("article", "main") and not hinted
            if opens_main and not main:
                skip, main, main_tag = 0, 1, name
            elif main and name == main_tag and not skip and not hinted:
                main += 1
            elif skip:
                skip += name == skip_tag
            elif name in _chrome or name in _outer and (not main or name == "footer") or hinted and (name in _block or name in ("span", "section", "a", "ins")):
                if name not in _block and name not in _chrome:
                    flush()
                skip, skip_tag = 1, name
        zone = CHROME if skip else MAIN if main else PLAIN
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``: common ends first, then bit-parallel rows, split in
    halves where the rows would not fit in memory."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    e = 0
    while e < min(len(a), len(b)) - n and a[-1 - e] == b[-1 - e]:
        e += 1
    head, tail = list(range(n)), list(range(len(a) - e, len(a)))
    in_b, in_a = set(b[n: len(b) - e]), set(a[n: len(a) - e])
    keep = [i for i in range(n, len(a) - e) if a[i] in in_b]
    return head + [keep[i] for i in _lcs([a[i] for i in keep], [x for x in b[n: len(b) - e] if x in in_a])] + tail


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit-parallel rows over ``a``: zero bits of the k-th row mark where the length over b grows."""
    match: dict[int, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full, v = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        u = v & match.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lcs(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) <= 1 << 30 or len(a) == 1:
        rows = [(1 << len(b)) - 1, *_rows(a, b)]
        out, j, i = [], len(b) - 1, len(a)
        while i and j >= 0:
            if rows[i] >> j & 1:
                j -= 1  # the length does not grow at j
            elif not rows[i - 1] >> j & 1:
                i -= 1  # it grew there before a[i - 1] came
            else:
                out.append(i - 1)
                i, j = i - 1, j - 1
        return out[::-1]
    half = len(a) // 2

    def lengths(x: list[int], y: list[int]) -> np.ndarray:
        v = (1 << len(y)) - 1
        for v in _rows(x, y):
            pass
        bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    cut = int(np.argmax(lengths(a[:half], b) + lengths(a[half:][::-1], b[::-1])[::-1]))
    return _lcs(a[:half], b[:cut]) + [half + i for i in _lcs(a[half:], b[cut:])]


def _signature(page: str | None) -> tuple[list[int], list[int]]:
    got = blocks(page)
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - 2**63 for t, _ in got], [z for _, z in got]


def deletions(sig: list[int], zones: list[int], path: str, others: list[tuple[str, list[int]]]) -> list[int]:
    """Lines of a page to delete: lines outside an article that it shares with the nearest of ``others`` (path, lines): the
    one with the longest common start of the path, the first of equals. Markup is applied to what is left."""
    if not others:
        return []
    near = max(others, key=lambda o: len(commonprefix([path, o[0]])))
    shared = shared_lines(sig, near[1])
    if len(shared) >= COPY_SHARE * len(sig):
        return []
    return [i for i in shared if zones[i] != MAIN]


def neighbours(lines: DataFrame) -> DataFrame:
    """For each (host, path): the lines (path, sig) of the paths before and behind it within its host.

    Paths are range-sorted over all hosts, so a large host spreads over partitions; each partition's first and last path
    are handed to its neighbours as one small row per partition."""
    paths = lines.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min(F.struct("page_id", "h", "sig")).alias("first"))
    x = paths.select("host", "path", F.struct("host", "path", F.col("first.sig").alias("sig")).alias("me"))
    x = checkpointed(x.repartitionByRange("host", "path").withColumn("__p", F.spark_partition_id()))
    ends = x.groupBy("__p").agg(F.min("me").alias("lo"), F.max("me").alias("hi"))
    w = Window.orderBy("__p")  # one row per partition
    ends = ends.select(F.col("__p").alias("__q"), F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("behind"))
    w = Window.partitionBy("__p").orderBy("host", "path")
    x = x.withColumn("a", F.lag("me").over(w)).withColumn("b", F.lead("me").over(w)).join(ends, F.col("__p") == F.col("__q"))
    both = F.array(F.coalesce("a", "before"), F.coalesce("b", "behind"))
    return x.select("host", "path", F.filter(both, lambda o: o["host"] == F.col("host")).alias("others"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text (blocks of the main text joined by an empty line; '' if none) and n_chars.

    Null html counts as empty. Each page is compared with the page of its host whose path is nearest in path order
    (query and fragment do not count; pages of the same path share a neighbour); lines on a longest common subsequence
    with it are deleted, unless the neighbour is a copy of the page; then chrome goes by markup, and the other lines stay,
    beside an article too. Lines inside an article or main element stay: there a shared line is text that both articles hold. Pages without a host have no neighbour. Repeated rows get
    equal results; ``pages`` must have page_id; columns named text or n_chars are replaced."""
    spark = pages.sparkSession
    bounded_batches(spark)
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    h = F.xxhash64(F.col(url), F.col(html))
    keyed = pages.select(F.col("page_id"), h.alias("h"), F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
                         F.regexp_replace(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "").alias("path"), F.col(html).alias("html"))

    def make():
        def f(texts: list) -> dict:
            got = [_signature(t) for t in texts]
            return {"sig": [s for s, _ in got], "zones": [z for _, z in got]}
        return f

    lines = with_text_column(keyed.withColumn("host", F.when(F.col("host") != "", F.col("host"))), "html", make, "sig array<long>, zones array<int>").drop("html")
    lines = checkpointed(lines)
    near = neighbours(lines)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [deletions(list(s), list(z), p, [(o["path"], list(o["sig"])) for o in others]) for s, z, p, others in zip(f["sig"], f["zones"], f["path"], f["others"])]
            f = f[["page_id", "h"]].assign(gone=got)
            yield f[f["gone"].map(len) > 0]

    gone = lines.join(near, ["host", "path"]).select("page_id", "h", "path", "sig", "zones", "others").mapInPandas(compare, "page_id long, h long, gone array<int>")
    gone = checkpointed(gone.groupBy("page_id", "h").agg(F.first("gone").alias("gone")).select(F.col("page_id").alias("__i"), F.col("h").alias("__h"), "gone"))
    size = gone.agg(F.coalesce(F.sum(F.size("gone") * 4 + 24), F.lit(0))).first()[0]
    x = pages.select(*columns, h.alias("__k"))
    if size:
        side = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
        x = x.join(side, F.col("page_id").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__h")), "left")
    else:
        x = x.withColumn("gone", F.lit(None).cast("array<int>"))
    marked = x.withColumn("__in", F.concat(F.coalesce(F.array_join("gone", ","), F.lit("")), F.lit("|"), F.coalesce(F.col(html), F.lit(""))))

    def finish():
        def f(texts: list) -> dict:
            out = []
            for t in texts:
                dead, _, page = t.partition("|")
                dead = {int(i) for i in dead.split(",")} if dead else ()
                out.append("\n\n".join(b for i, (b, z) in enumerate(blocks(page)) if z != CHROME and i not in dead))
            return {"text": out}
        return f

    return with_text_column(marked, "__in", finish, "text string").select(*columns, "text", F.length("text").cast("long").alias("n_chars"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
