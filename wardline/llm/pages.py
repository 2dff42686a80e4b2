"""Main text of web pages: structure, and differencing against the page with the nearest URL.

A page is cut into text lines, one a block element. What stands in elements that are never content (menus, headers,
footers, sidebars, forms, scripts, elements whose class or id names an advert, a notice, comments and the like) goes.
The lines are then aligned, by longest common subsequence, with those of the page whose URL path sorts next to it on
the same host, and shared lines, which the host's template brings, are deleted.

If the page marks its content with <article> or <main>, its text is the lines there, and they are aligned with the lines
that the neighbour marks. Articles on one host share headlines, quotations and whole copies, so a neighbour with which a page
shares more than half its lines is passed over as a copy, and a shared line is the template's only if it is in half or
more of the host's different pages, and in ``LEAST_PAGES`` or more.

Equal line lists of a host are one page. The different pages get their places in the order of host and path, and blocks
of neighbouring places are worked on with the rows beside them, so that neither a partition's nor a batch's border hides a neighbour.
A page whose next ``NEIGHBOURS`` places on both sides hold copies only lies in a run of copies (a run starts at a page that is no
copy of those just before it); it is compared with the first pages of the runs around its own, in widening circles until one is no copy.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.storage import materialise

NEIGHBOURS, LEAST_PAGES, LEAST_SHARE, SALTS = 4, 3, 0.5, 64
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "select", "title", "xmp"}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul option".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = {"article", "main"}
_NEVER = {"nav", "footer", "aside", "form", "dialog", "head", "button", "menu", "fieldset", "audio", "video"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors banner promo promotion cookie cookies consent gdpr "
    "notice notices alert alerts sidebar comment comments commentlist respond replies disqus menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer social share sharing related recommended newsletter subscribe subscription signup login popup modal overlay widget "
    "widgets pagination pager toolbar paywall".split()
)
_PAGE_WORDS = {"header", "masthead", "topbar", "skip", "site-header"}
# what may stand beside such a word in a compound name: places, shapes and parts, not matters
_LAYOUT = set(
    "area banner bar block body bottom box btn button buttons center col column container content cta fixed float footer form global grid head "
    "header holder icon icons image img inner item items js large layout left link links list main mobile module nav outer overlay page pane "
    "panel primary region right row section secondary shell side site slot small sticky strip sub tab tabs title toggle top ui unit view widget "
    "wrap wrapper zone".split()
)
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}


def _names_furniture(value: str, names: set[str]) -> bool:
    """Whether a class or id names page furniture: a whole token does, or one of its parts while the others say where or how it stands."""
    for token in value.split():
        if token in names:
            return True
        parts = [x for x in re.split(r"[_-]+", token) if x]
        if len(parts) > 1 and any(x in names for x in parts) and all(x in names or x in _LAYOUT or x.isdigit() for x in parts):
            return True
    return False


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _NEVER or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and (_names_furniture(value, _WORDS) or not inside and _names_furniture(value, _PAGE_WORDS)):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, comment and declaration, the latter two without a name.

    The caller may send a place to go on from. An unclosed comment reaches to the end; what no ``>`` follows is text. If a
    tag's quotes swallow the rest of the page, it ends at its first ``>``, and quotes aren't heeded from there on, so that
    the time stays in proportion to the page.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while m := _OPEN.search(page, at, last + 1):
        name = m[2] or ""
        if not name:
            close = page.find("-->", m.start() + 2) + 2 if m[0] == "<!--" else page.find(">", m.end())
            end = close + 1 if close >= m.end() or m[0] != "<!--" else len(page)
        else:
            close = _QUOTED.match(page, m.end(), last + 1) if quotes else None
            quotes = bool(close)
            end = close.end() if close else page.find(">", m.end()) + 1
        to = yield m.start(), end, m[1] or "", name.lower(), page[m.end() : end - 1] if name else ""
        at = end if to is None else to
        if to is not None:
            yield 0, 0, "", "", ""


def marked_lines(page: str) -> list[tuple[str, bool]]:
    """Lines that aren't plainly no content, each with whether it stands in <article> or <main>."""
    lines: list[tuple[str, bool]] = []
    piece: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # of elements other than inline ones: tag, unwanted, content
    held: Counter[str] = Counter()  # tags on the stack
    bad = inside = at = 0

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                lines.append((text, inside > 0))

    def drop(k: int) -> tuple[int, int]:
        """Take the elements from place k off the stack: how many of them are unwanted, and content."""
        gone = stack[k:]
        del stack[k:]
        held.subtract(t for t, _, _ in gone)
        return sum(b for _, b, _ in gone), sum(c for _, _, c in gone)

    tags = _tags(page)
    for start, end, slash, tag, attributes in tags:
        if start > at and not bad:
            piece.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in _RAW and not slash:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                tags.send(at)
            continue
        if tag in _BLOCKS and not bad:
            flush()
        elif tag in ("br", "td", "th", "img"):
            piece.append(" ")
        if tag in _VOID:
            continue
        if slash:
            k = len(stack) - 1 if held[tag] else -1
            while k >= 0 and stack[k][0] != tag and (tag in _BLOCKS or stack[k][0] not in _BLOCKS):
                k -= 1
            if k >= 0 and stack[k][0] == tag:
                was_bad, was_in = drop(k)
                bad, inside = bad - was_bad, inside - was_in
            continue
        unwanted = _unwanted(tag, attributes, inside > 0)
        if tag not in _BLOCKS and not unwanted:
            continue
        if stack and stack[-1][0] in _IMPLIED.get(tag, ()):
            was_bad, was_in = drop(len(stack) - 1)
            bad, inside = bad - was_bad, inside - was_in
        content = tag in _CONTENT
        stack.append((tag, unwanted, content))
        held[tag] += 1
        bad += unwanted
        inside += content
    if not bad:
        piece.append(page[at:])
    flush()
    return lines


def text_lines(page: str) -> tuple[list[str], bool, list[str]]:
    """(lines, declared, all): the lines of <article> or <main> if any has text, else all that aren't plainly no content."""
    lines = marked_lines(page)
    every, declared = [t for t, _ in lines], [t for t, own in lines if own]
    return (declared, True, every) if declared else (every, False, every)


def _rows(a: list, b: list) -> Iterator[int]:
    """After each line of ``a``, the bits of ``b``'s places that do not lengthen the longest common subsequence."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & every
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each prefix of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def shared_lines(a: list, b: list, most_bits: int = 1 << 28) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    A row of the comparison is one whole number with a bit for every line of ``b``; if all rows together have more
    than ``most_bits``, ``a`` is halved and ``b`` cut where the halves' lengths add up to most.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    while lo < min(n, m) and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = {*range(lo), *range(n, len(a))}
    x, y = a[lo:n], b[lo:m]
    if not x or not y:
        return out
    if len(x) > 1 and len(x) * len(y) > most_bits:
        half = len(x) // 2
        total = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(total.argmax())
        own = shared_lines(x[:half], y[:cut], most_bits) | {half + i for i in shared_lines(x[half:], y[cut:], most_bits)}
        return out | {lo + i for i in own}
    rows = list(_rows(x, y))
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            j -= 1
            out.add(lo + i)
    return out


def line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines]


def is_copy(own: list[int], other: list[int], gone: set[int], declared: bool) -> bool:
    """Whether a page that shares the places ``gone`` with ``other`` is its copy: it has all lines of an undeclared page, or more than half those of a declared one."""
    return 2 * len(gone) > len(own) if declared else len(gone) == len(own)


def shared_with_nearest(own: list[int], others: list[list[int]], declared: bool) -> list[int] | None:
    """Places of the lines ``own`` shares with the first of the ``others`` that is no copy; None if all are."""
    for other in others:
        gone = shared_lines(own, other)
        if not is_copy(own, other, gone, declared):
            return sorted(gone)
    return None


def _repeats_one(own: list[int], others: list[list[int]], declared: bool) -> bool:
    """Whether ``own`` is a copy of any of the others; pages with too few common lines aren't aligned."""
    for other in others:
        held = set(other)
        common = sum(x in held for x in own)
        if (2 * common > len(own) if declared else common == len(own)) and is_copy(own, other, shared_lines(own, other), declared):
            return True
    return False


def _places(distinct: DataFrame) -> tuple[DataFrame, int]:
    """``distinct`` with ``place``: 0, 1, ... in the order of host, path and lines; and their number."""
    order = ["host", "path", "same"]
    rows = distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = materialise(rows, "page-places")
    part = F.shiftright("place", 33)
    starts, total = [], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        starts.append((r["part"], total))
        total += r["count"]
    start = distinct.sparkSession.createDataFrame(starts, "part long, start long")
    rows = rows.withColumn("part", part).join(F.broadcast(start), "part")
    return rows.withColumn("place", F.col("start") + F.col("place") - F.shiftleft("part", 33)).drop("part", "start"), total


_SHARED = "host string, same long, salts array<int>, declared boolean, gone array<int>, lines array<long>"


def _shared(distinct: DataFrame, neighbours: int) -> DataFrame:
    """(host, same, salts, declared, gone, lines): places and hashes of the lines each different page shares with its nearest one."""
    rows, total = _places(distinct)
    block = max(64, neighbours, min(4096, -(-total // 512)))
    at = lambda o: F.floor((F.col("place") + F.lit(o)) / block).cast("long")
    rows = rows.withColumn("block", F.explode(F.array_distinct(F.array(at(-neighbours), at(0), at(neighbours))))).withColumn("mine", F.col("block") == at(0))
    rows = rows.select("block", "place", "mine", "host", "same", "salts", "marks", "hashes").repartition("block").sortWithinPartitions("block", "place")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host", "same", "salts", "declared", "gone", "lines", "block", "place", "start", "open"]
        last, held = None, []

        def flush() -> Iterator[pd.DataFrame]:
            out = []
            hosts = [r.host for r in held]
            every = [list(r.hashes) for r in held]
            marked = [[h for h, m in zip(e, r.marks) if m] for e, r in zip(every, held)]
            for i, r in enumerate(held):
                if not r.mine or not every[i]:
                    continue
                near = [j for d in range(1, neighbours + 1) for j in (i - d, i + d) if 0 <= j < len(held) and hosts[j] == hosts[i]]
                own, side = (marked[i], marked) if marked[i] else (every[i], every)
                declared = bool(marked[i])
                gone = shared_with_nearest(own, [side[j] for j in near if side[j]], declared)
                start = not _repeats_one(own, [side[j] for j in near if j < i and side[j]], declared)
                out.append((r.host, r.same, r.salts, declared, gone or [], [own[k] for k in gone or []], r.block, r.place, start, gone is None and bool(near)))
            if out:
                yield pd.DataFrame(out, columns=names)

        for b in batches:
            for r in b.itertuples(index=False):
                if r.block != last:
                    yield from flush()
                    last, held = r.block, []
                held.append(r)
        yield from flush()

    found = materialise(rows.mapInPandas(walk, f"{_SHARED}, block long, place long, start boolean, open boolean"), "page-near")
    done = found.filter("size(gone) > 0").select("host", "same", "salts", "declared", "gone", "lines")
    open_ = found.filter("open")
    if open_.isEmpty():
        return done
    # the number of a page's run on its host: starts in the blocks before, and in its own up to it
    starts = F.when(F.col("start"), 1).otherwise(0)
    sums = found.groupBy("host", "block").agg(F.sum(starts).alias("n"))
    sums = sums.select("host", "block", F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = Window.partitionBy("host", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    runs = materialise(found.withColumn("k", F.sum(starts).over(upto)).join(sums, ["host", "block"]).select("host", "same", "salts", "declared", "start", "open", (F.col("k") + F.col("base")).alias("run")), "page-runs")
    heads = materialise(runs.filter("start").select("host", "same", "run").join(distinct.select("host", "same", "hashes", "marks"), ["host", "same"]).select("host", "run", "hashes", "marks"), "page-heads")
    todo = runs.filter("open").select("host", "same", "salts", "run").join(distinct.select("host", "same", "hashes", "marks"), ["host", "same"])
    todo = materialise(todo, "page-open")
    most = runs.groupBy("host").agg((F.max("run") - F.min("run")).alias("n")).agg(F.max("n")).first()[0]
    low, high = 1, neighbours

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                own = [h for h, m in zip(r.hashes, r.marks) if m]
                declared = bool(own)
                own = own or list(r.hashes)
                others = [[h for h, m in zip(x["hashes"], x["marks"]) if m] if declared else list(x["hashes"]) for x in sorted(r.heads, key=lambda x: (x["far"], x["run"]))]
                gone = shared_with_nearest(own, [x for x in others if x], declared)
                out.append((r.host, r.same, r.salts, declared, gone, [own[k] for k in gone or []]))
            yield pd.DataFrame(out, columns=["host", "same", "salts", "declared", "gone", "lines"])

    while low <= most:
        reach = F.array(*[F.col("run") + x for d in range(low, high + 1) for x in (-d, d)])
        near = todo.withColumn("at", F.explode(reach)).join(heads.select("host", F.col("run").alias("at"), F.col("hashes").alias("hh"), F.col("marks").alias("mm")), ["host", "at"])
        head = F.struct(F.abs(F.col("at") - F.col("run")).alias("far"), F.col("at").alias("run"), F.col("hh").alias("hashes"), F.col("mm").alias("marks"))
        near = near.groupBy("host", "same").agg(*(F.first(c).alias(c) for c in ("salts", "hashes", "marks")), F.collect_list(head).alias("heads"))
        told = materialise(near.select("host", "same", "salts", "hashes", "marks", "heads").mapInPandas(compare, _SHARED), "page-wider")
        settled = told.filter("gone is not null")
        done = done.union(settled.filter("size(gone) > 0"))
        todo = materialise(todo.join(settled.select("host", "same"), ["host", "same"], "left_anti"), "page-open")
        if todo.isEmpty():
            break
        low, high = high + 1, 3 * high
    return done


def main_text(pages: DataFrame, neighbours: int = NEIGHBOURS, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; ``pages``: page_id, url, html and maybe more columns, which are ignored.

    Null and empty pages have an empty text. A null URL counts as a host and a path of its own kind. A page
    without a different one on its host keeps all its lines. Repeated rows and null ids pass through; an empty table stays empty.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [marked_lines(p if isinstance(p, str) else "") for p in b.pop("html")]
            own = [[t for t, m in x if m] or [t for t, _ in x] for x in got]
            yield b.assign(text=["\n".join(x) for x in own], hashes=[line_hashes([t for t, _ in x]) for x in got], marks=[[m for _, m in x] for x in got])

    bare = F.coalesce(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), F.lit(""))
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(lines, "page_id long, url string, text string, hashes array<long>, marks array<boolean>")
    keyed = cut.withColumns({
        "host": F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)), "path": F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"[?#].*$", ""),
        "same": F.xxhash64("hashes", "marks"), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"),
    })
    keyed = materialise(keyed, "page-lines")
    distinct = keyed.groupBy("host", "same").agg(F.min("path").alias("path"), F.collect_set("salt").alias("salts"), F.first("hashes").alias("hashes"), F.first("marks").alias("marks"))
    distinct = materialise(distinct, "page-distinct")
    shared = materialise(_shared(distinct, neighbours), "page-shared")
    # how many different pages of the host mark a line; both sides are salted, since one line may be in every page
    spread = 16
    marked = F.filter("hashes", lambda x, i: F.get(F.col("marks"), i))
    counts = distinct.select("host", F.explode(F.array_distinct(marked)).alias("line")).groupBy("host", "line").count().filter(F.col("count") >= least_pages)
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(hosts, "host").filter(F.col("count") >= F.col("n") * least_share)
    counts = counts.select("host", "line", F.explode(F.array(*map(F.lit, range(spread)))).alias("s"))
    maybe = shared.filter("declared").select("host", "same", "salts", F.explode(F.arrays_zip("gone", "lines")).alias("x"))
    maybe = maybe.select("host", "same", "salts", F.col("x.gone").alias("k"), F.col("x.lines").alias("line"), F.pmod(F.xxhash64("same"), F.lit(spread)).cast("int").alias("s"))
    sure = maybe.join(counts, ["host", "line", "s"]).groupBy("host", "same").agg(F.first("salts").alias("salts"), F.collect_list("k").alias("gone"))
    gone = shared.filter("not declared").select("host", "same", "salts", "gone").union(sure).select("host", "same", F.explode("salts").alias("salt"), "gone")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    out = keyed.select("page_id", "url", "text", "host", "same", "salt").join(materialise(gone, "page-gone"), ["host", "same", "salt"], "left")
    out = out.select("page_id", "url", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
