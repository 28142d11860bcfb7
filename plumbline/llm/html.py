"""Main text of web pages, with boilerplate found by a host suffix array.

A page is parsed into blocks of text.  Each block is of one kind: main (within the page's article or main
part), plain, or named, where the markup says what it is: navigation, headers, footers, sidebars, forms, and
elements whose class, id or role names a menu, notice, advert or the readers' comments.  Such a name is a whole
token (``sidebar``) or a known form of one (``site-footer``, ``commentList``), not a part of any other
(``has-sidebar``).  It never drops an article or main part, nor one within the element it names, unless the page
has a main part with text outside of all such elements: then what lies within them is comments and teasers.
Scripts, styles, forms' own texts and inert templates are no text.  Everything else is, formulas, drawings' words, the
text given in place of a missing object or player, and hidden elements too.

Runs of at least ``RUN`` tokens that ``PAGES`` different pages of a host have are repeated.  Pages whose whole
streams are alike count as one, so mirrored pages stay.  A block that repeated runs cover, but for ``UNIQUE``
tokens, is boilerplate; blocks with unique runs stay.  For a host of at most ``GROUP_PAGES`` pages, the token
streams of all its blocks are concatenated and a suffix array of them is sorted to a depth of RUN tokens.  The
pages of a wider host are dealt into groups of about that size, and its runs are counted over the whole host:
64-bit hashes of host and run are dealt with those of the pages' streams, at most PAGES of them from one slice
of a task, and the repeated runs go back to the groups that hold them, so that how pages are dealt decides
nothing.  A wide host none of whose pages waits for that verdict (each marks a main part, or has no plain
block) isn't counted.

Markup, where it is clear, outranks repetition: named blocks go though they are unique, and the blocks of a
marked main part stay though other pages repeat them (removing them would remove shared articles) and are the
whole of the page's text.

Character references are decoded; white space within a block becomes one space; blocks are joined by one line
feed in page order.  Rows: null html is empty and gives the empty text.  Null URLs share a host.  Repeated rows
each give a row.  An empty table gives no rows.  Columns beyond id, url and html are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, scanned, stored, table
from .textscan import mix, raw_texts, slices, words_of

RUN, PAGES, GROUP_PAGES, UNIQUE = 4, 3, 256, 2
NAMED, PLAIN, MARKED, DOUBTED = 0, 1, 2, 3
BROADCAST_ROWS = 500_000
_NAMES = lambda s: frozenset(s.split())
#: Their content is no text at all, up to the end tag.
RAW = _NAMES("script style textarea title iframe noembed noframes")
VOID = _NAMES("area base br col embed hr img input link meta param source track wbr")
DROPPED = _NAMES("nav header footer aside form button select dialog menu template head")
BLOCK = _NAMES(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul"
)
MAIN = _NAMES("article main")
CELLS = _NAMES("tr td th")
#: Elements that an opening tag ends, if they stand open with no other block above them (cells apart).
CLOSED_BY = {"p": BLOCK - {"br"}, "li": _NAMES("li"), "dt": _NAMES("dt dd"), "dd": _NAMES("dt dd"), "tr": _NAMES("tr"), "td": _NAMES("td th tr"), "th": _NAMES("td th tr"), "option": _NAMES("option optgroup")}
#: Words in class, id or role that name what is no main text.
NOTED = _NAMES(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer "
    "header masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notification overlay pager pagination popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tagcloud toc toolbar tracking widget widgets "
    "contentinfo complementary alert dialog navigation search"
)
#: What stands before such a word, and before or behind it, in the known forms of it: site-footer, comment-list, ad-2.
BEFORE = _NAMES("site page main top bottom left right primary secondary global mobile desktop sticky fixed floating inline first second")
AROUND = BEFORE | _NAMES("area bar block body box button buttons container content form group holder inner item items link links list module outer panel posts section slot text title unit wrap wrapper")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _names_noted(token: str) -> bool:
    """Whether a class, id or role is a noted word or a known form of one."""
    words = _WORDS.findall(_CAMEL.sub(" ", token).lower())
    first = next((i for i, w in enumerate(words) if w in NOTED), None)
    return first is not None and BEFORE.issuperset(words[:first]) and all(w in NOTED or w in AROUND or w.isdecimal() for w in words[first:])


def _noted(name: str, attrs: str) -> bool:
    """Whether an element's attributes name what is no main text."""
    if not attrs or name in ("html", "body"):
        return False
    return any(any(map(_names_noted, unescape(next((v for v in values if v), "")).split())) for _, *values in _ATTR.findall(attrs))


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each block, in page order."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    named: list[str] = []
    # name; from here on: dropped for good, dropped on a word, main, main in an element dropped on a word
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    open_blocks: list[int] = []
    gone = noted = dropped = main = doubted = False

    def end() -> None:
        for held, kind in ((text, DOUBTED if doubted else MARKED if main else PLAIN), (named, NAMED)):
            whole = " ".join(unescape("".join(held)).split()) if held else ""
            held.clear()
            if whole:
                out.append((whole, kind))

    def pop_to(depth: int) -> None:
        nonlocal gone, noted, dropped, main, doubted
        for x in stack[depth:]:
            places[x[0]].pop()
        del stack[depth:]
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()
        gone, noted, main, doubted = stack[-1][1:] if stack else (False, False, False, False)
        dropped = gone or noted

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            (named if dropped else text).append(html[at:])
            break
        if m.start() > at:
            (named if dropped else text).append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                end()
                continue
            if name in BLOCK:
                end()
            if places.get(name):
                depth = places[name][-1]
                # An end tag ends what stands open in it; one of no block doesn't end blocks.
                if name in BLOCK or not open_blocks or open_blocks[-1] <= depth:
                    pop_to(depth)
            continue
        if name in BLOCK:
            end()
        for open_, enders in CLOSED_BY.items():
            if name in enders:
                for i in reversed(open_blocks):
                    if stack[i][0] == open_:
                        pop_to(i)
                        break
                    if open_ not in CELLS or stack[i][0] not in CELLS:
                        break
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            if close is None:
                break
            at = html.find(">", close.start())
            at = n if at < 0 else at + 1
            continue
        if m[3].endswith("/") and name not in BLOCK:
            continue
        gone = gone or name in DROPPED and not (main and name == "header")
        noted = noted or _noted(name, m[3])
        if name in MAIN:
            main, doubted, noted = True, doubted or noted, False
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            open_blocks.append(len(stack))
        stack.append((name, gone, noted, main, doubted))
        dropped = gone or noted
    end()
    own = NAMED if any(kind == MARKED for _, kind in out) else MARKED
    return [(t, own if kind == DOUBTED else kind) for t, kind in out]


_PARSED = "row long, page_id long, url string, host string, part int, wide boolean, blocks array<string>, kinds binary"


def _parse(batches):
    for batch in batches:
        pages = [blocks(h) if h else [] for h in batch.column(6).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in range(6)), pa.array([[t for t, _ in p] for p in pages], pa.list_(pa.string())), pa.array([bytes(k for _, k in p) for p in pages], pa.binary())],
            names=["row", "page_id", "url", "host", "part", "wide", "blocks", "kinds"],
        )


def _waits(kinds: bytes) -> bool:
    """Whether repeated runs decide on a page with blocks of these kinds."""
    return MARKED not in kinds and PLAIN in kinds


def _waiting(batches):
    for batch in batches:
        hosts = {host for host, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if h and _waits(bytes(k for _, k in blocks(h)))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(hosts), pa.string())], names=["host"])


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def run_keys(h: np.ndarray, page: np.ndarray, hosts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of each run of ``run`` tokens within a page; ``page`` is each token's, ``hosts`` are the pages'."""
    start = np.flatnonzero(page[: max(len(h) - run + 1, 0)] == page[run - 1 :])
    of = {x: _hash(x.encode()) for x in set(hosts)}
    key = np.array([of[x] for x in hosts], np.uint64)[page[start]]
    for i in range(run):
        key = mix(key ^ h[start + i])
    return start, key.view(np.int64)


def _page_slices(batch):
    """For each slice of whole pages: first page, end, token hashes, each token's page in the slice."""
    texts = batch.column("blocks")
    data, offs = raw_texts(texts.flatten())
    ends = np.concatenate([[0], np.cumsum(np.asarray(texts.value_lengths().fill_null(0)))])
    for lo, hi in slices(offs[ends]):
        own = offs[ends[lo] : ends[hi] + 1]
        start, _, h = words_of(data[own[0] : own[-1]], own - own[0])
        yield lo, hi, h, np.searchsorted(offs[ends[lo + 1 : hi + 1]] - own[0], start, "right")


def _count(run: int, pages: int):
    def count(batches):
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            for lo, hi, h, page in _page_slices(batch):
                start, key = run_keys(h, page, hosts[lo:hi], run)
                cuts = np.searchsorted(page, np.arange(hi - lo + 1))
                whole = np.array([_hash(h[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])], np.uint64).view(np.int64)[page[start]]
                order = np.lexsort((whole, key))
                key, whole = key[order], whole[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
                key, whole = key[new], whole[new]
                # Pages beyond the first ``pages`` of a run in this slice can't change whether it is repeated.
                seen = np.zeros(len(key), bool)
                seen[pages:] = key[pages:] == key[:-pages]
                yield pa.RecordBatch.from_arrays([pa.array(key[~seen]), pa.array(whole[~seen])], names=["key", "whole"])

    return count


def _ask(run: int):
    def ask(batches):
        for batch in batches:
            hosts, part = batch.column("host").to_pylist(), batch.column("part").to_numpy(zero_copy_only=False)
            waits = np.array([_waits(k) for k in batch.column("kinds").to_pylist()], bool)
            for lo, hi, h, page in _page_slices(batch):
                start, key = run_keys(h, page, hosts[lo:hi], run)
                own = waits[lo:hi][page[start]]
                key, of = key[own], part[lo:hi][page[start]][own]
                _, first = np.unique(np.stack([key, of.astype(np.int64)]), axis=1, return_index=True)
                names = pa.array(hosts[lo:hi], pa.string()).take(pa.array(page[start][own][first]))
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), names, pa.array(of[first], pa.int32())], names=["key", "host", "part"])

    return ask


def repeated(streams: list[np.ndarray], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each token stream, which tokens lie in runs of ``run`` tokens or more that ``pages`` streams hold.

    The streams are concatenated, each with an end sign of its own, and their suffixes sorted by prefix
    doubling to a depth of ``run``: neighbours of one rank share their first ``run`` tokens.
    """
    if not streams:
        return []
    size = np.array([len(s) for s in streams])
    owner = np.repeat(np.arange(len(streams)), size + 1)
    last = np.cumsum(size + 1) - 1
    _, rank = np.unique(np.concatenate([np.append(s, np.uint64(0)) for s in streams]), return_inverse=True)
    rank = rank.astype(np.int64) + len(streams)
    rank[last] = np.arange(len(streams))  # end signs differ
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])
        _, rank = np.unique(rank * (len(rank) + len(streams) + 2) + ahead + 1, return_inverse=True)
        depth += step
    array = np.lexsort((owner, rank))
    r, o = rank[array], owner[array]
    head = np.ones(len(r), bool)
    head[1:] = r[1:] != r[:-1]
    other = head.copy()
    other[1:] |= o[1:] != o[:-1]
    group = np.cumsum(head) - 1
    many = np.bincount(group, other) >= pages
    starts = array[many[group]]
    edge = np.zeros(len(rank) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + run, len(rank)), -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [covered[e - n : e] for e, n in zip(last, size)]


def _strip(run: int, pages: int, unique: int):
    def group(table, known):
        texts = table["blocks"].combine_chunks()
        page_of = np.repeat(np.arange(len(texts)), np.asarray(texts.value_lengths().fill_null(0)))
        own = texts.flatten()
        kinds = np.frombuffer(b"".join(table["kinds"].to_pylist()), np.uint8)
        data, offs = raw_texts(own)
        start, _, h = words_of(data[offs[0] : offs[-1]], offs - offs[0])
        block = np.searchsorted((offs - offs[0])[1:], start, "right")
        page = page_of[block]
        cuts = np.searchsorted(page, np.arange(len(texts) + 1))
        if table["wide"][0].as_py():
            begin, key = run_keys(h, page, table["host"].to_pylist(), run)
            begin = begin[np.isin(key, known["key"].to_numpy())] if known is not None else begin[:0]
            edge = np.bincount(begin, minlength=len(h) + 1) - np.bincount(begin + run, minlength=len(h) + 1)
            mask = np.cumsum(edge[:-1]) > 0
        else:
            streams = [h[a:b] | np.uint64(1) for a, b in zip(cuts[:-1], cuts[1:])]
            first: dict[bytes, int] = {}
            alike = [first.setdefault(s.tobytes(), i) for i, s in enumerate(streams)]
            different = sorted(set(alike))
            covered = dict(zip(different, repeated([streams[i] for i in different], run, pages)))
            mask = np.concatenate([np.zeros(0, bool), *(covered[a] for a in alike)])
        size = np.bincount(block, minlength=len(own))
        alone = np.bincount(block, ~mask, len(own))
        # A block too short for a run of its own counts as covered only with the whole of it.
        content = (kinds == PLAIN) & (alone > np.minimum(unique, size - 1))
        marked = np.bincount(page_of, kinds == MARKED, len(texts)) > 0
        keep = np.where(marked[page_of], kinds == MARKED, content)
        kept = own.filter(pa.array(keep)).to_pylist()
        ends = np.cumsum(np.bincount(page_of, keep, len(texts))).astype(int).tolist()
        out = ["\n".join(kept[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        return pa.table({"row": table["row"], "page_id": table["page_id"], "url": table["url"], "text": pa.array(out, pa.string())})

    return group


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, shared: int = PAGES, group_pages: int = GROUP_PAGES) -> DataFrame:
    """row, page_id, url and text of every row of ``pages``."""
    pages = scanned(pages)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host("url"))
    large = pages.select(host(url_col).alias("host")).groupBy("host").count().where(F.col("count") > group_pages).select("host", F.ceil(F.col("count") / group_pages).alias("groups"))
    large = broadcast_if_small(large, large.count(), BROADCAST_ROWS)
    dealt = rows.join(large, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("groups")), F.lit(0)).cast("int"))
    dealt = dealt.select("row", "page_id", "url", "host", "part", F.col("groups").isNotNull().alias("wide"), "html")
    counted = stored(rows.join(large, "host", "left_semi").select("host", "html").mapInArrow(_waiting, "host string").distinct(), "hosts")
    strip, result, hosts = _strip(run, shared, UNIQUE), "row long, page_id long, url string, text string", counted.count()
    if not hosts:
        return dealt.mapInArrow(_parse, _PARSED).groupBy("host", "part").applyInArrow(lambda group: strip(group, None), result)
    counted = broadcast_if_small(counted, hosts, BROADCAST_ROWS)
    # Each page of a host that is counted is parsed once more, and its blocks are stored for the passes below.
    wide = stored(dealt.join(counted, "host", "left_semi").select(*dealt.columns).mapInArrow(_parse, _PARSED), "blocks")
    alone = dealt.join(counted, "host", "left_anti").select(*dealt.columns).mapInArrow(_parse, _PARSED)
    seen = wide.select("host", "blocks").mapInArrow(_count(run, shared), "key long, whole long").distinct()
    known = seen.groupBy("key").count().where(F.col("count") >= shared).select("key")
    asked = wide.select("host", "part", "blocks", "kinds").mapInArrow(_ask(run), "key long, host string, part int").distinct()
    back = asked.join(known, "key", "left_semi")
    return alone.union(wide).groupBy("host", "part").cogroup(back.groupBy("host", "part")).applyInArrow(strip, result)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
