"""Exact removal of long repeated byte strings by column-wise suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or the same text further
left) goes.  Nothing longer than LENGTH has to be sorted together, so the collection is cut into pieces whose
strings can only equal strings of the same piece, and each piece's collection is sorted on its own:

1. Whole texts that repeat an earlier one are known by their SHA-256 and go at once.
2. The anchor of a string is the M-gram of least hash in it (the leftmost, of equals); equal strings have equal
   anchors at equal places.  The strings of one anchor occurrence make a segment of at most 2 LENGTH - M bytes.
   One scan counts anchors; those that only one place in one text has can't belong to a repeated string.  The
   others are put into a Bloom filter, sized by their number up to ``FILTER_WORDS`` in all: a full one lets more
   pass but never less.
3. A second scan gives the places, anchors and digests of the segments that pass, without their bytes.  Equal
   segments need no sorting: all but the earliest are covered whole.  A task settles its own, so that as many rows
   of one segment are left as there are tasks.
4. Where an anchor has segments of several kinds, the earliest of each kind are read again from their texts.  Their
   collection's suffixes are sorted column by column (``column_sort``): in each round every segment's next
   symbol to the left is inserted, its place read from the collection's Burrows-Wheeler transform by the last-to-
   first mapping, and the longest common prefixes are carried along.  Suffixes whose common prefix reaches LENGTH
   are equal strings; all but the earliest are covered.
5. An anchor of more than ``KINDS`` kinds is split first (``_split``): its strings are cut by the place of the anchor
   in them into two halves, each of which goes by the longer string that its members must share, and so on until a
   piece has few kinds or its strings stand alone.

Rows: a null text is an empty one.  Null ids come after all others; rows with equal ids follow each other in the
order of the rows.  Texts under LENGTH bytes keep everything; a text of any length is read in windows.  An empty
table gives no rows.  Columns beyond id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, or_empty, scanned, shuffle_parts, stored, table
from .textscan import _CODES, _powers, mix, raw_texts, slices

LENGTH, M = 100, 40
SLICE_BYTES = 1 << 17
FILTER_WORDS, BITS, BITS_PER_ANCHOR = 1 << 23, 4, 12
LEAST_RANGES, RANGE_BYTES = 64, 8 << 20
TASK_ANCHORS = 1 << 20
SORT_BYTES, KINDS = 1 << 18, 4096
BROADCAST_ROWS = 2_000_000
_PLACE = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, m: int = M) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, first start, last start, anchor place, digest) of each run of strings with one anchor;
    starts and places are in ``data``.  A run may end at the edge of a window of ``SLICE_BYTES``.  Least hashes crowd
    near zero, so the anchor's is mixed once more (one to one): ranges of it then hold equal shares."""
    out = []
    for lo in range(0, max(len(data) - length + 1, 1), SLICE_BYTES):
        part = data[lo : lo + SLICE_BYTES + length - 1]
        row, h, first, last, place, digest = _window_anchors(part, np.clip(offs - lo, 0, len(part)), length, m)
        out.append((row, h, first + lo, last + lo, place + lo, digest))
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


def _window_anchors(data: np.ndarray, offs: np.ndarray, length: int, m: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = none, none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    if n < length:
        return nothing
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * power[:n], dtype=np.uint64)])
        h = mix((sums[m:] - sums[:-m]) * inverse[: n - m + 1])
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = length - m + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    row = np.searchsorted(offs[1:], np.arange(len(low)), "right")
    start = np.flatnonzero(np.arange(len(low)) + length <= offs[1:][row])
    place = (low[start] & _PLACE).astype(np.int64)
    if not len(start):
        return nothing
    cut = np.flatnonzero((place[1:] != place[:-1]) | (row[start[1:]] != row[start[:-1]])) + 1
    head = np.concatenate([[0], cut])
    first, last, place = start[head], start[np.concatenate([cut - 1, [len(start) - 1]])], place[head]
    with np.errstate(over="ignore"):
        digest = mix((sums[last + length] - sums[first]) * inverse[first] + (last - first + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return row[first], mix(h[place]), first, last, place, digest


def _fresh(seen: dict[int, tuple], text: bytes, key: tuple) -> int | None:
    """The text's digest, or None if this task has already taken an equal one with a smaller key."""
    d = xxhash.xxh3_64_intdigest(text)
    if d in seen and seen[d] <= key:
        return None
    if len(seen) > 1 << 20:
        seen.clear()
    seen[d] = key
    return d


def _key(doc_id, row) -> tuple:
    return (doc_id is None, doc_id or 0, row)


def _anchor_counts(ranges: int):
    """Arrays of (anchor, text) by ranges of the anchor; one that is twice in a text has a second, unlike text."""

    def ranged(held_h, held_d):
        h, d = np.concatenate(held_h), np.concatenate(held_d)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
        cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        rows = [(i, h[a:b].tobytes(), d[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "anchors", "texts"])

    def run(batches):
        held_h, held_d, size, seen = [], [], 0, {}
        for batch in batches:
            data, offs = raw_texts(batch.column(2))
            ids, rows = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in slices(offs, SLICE_BYTES):
                own = offs[lo : hi + 1] - offs[lo]
                part = data[offs[lo] : offs[hi]]
                row, h, *_ = anchors(part, own)
                text = np.zeros(hi - lo, np.uint64)
                fresh = np.zeros(hi - lo, bool)
                for i in np.unique(row).tolist():
                    d = _fresh(seen, part[own[i] : own[i + 1]].tobytes(), _key(ids[lo + i], rows[lo + i]))
                    if d is not None:
                        text[i], fresh[i] = d, True
                h, d, row = h[fresh[row]], text[row[fresh[row]]], row[fresh[row]]
                order = np.lexsort((h, row))
                h, d, row = h[order], d[order], row[order]
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                held_h += [h[~again], h[again]]
                held_d += [d[~again], ~d[again]]
                size += len(h)
                if size > TASK_ANCHORS:
                    yield from ranged(held_h, held_d)
                    held_h, held_d, size = [], [], 0
        if size:
            yield from ranged(held_h, held_d)

    return run


def _masks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an anchor's word of its range is, as a hash, and its bits in it."""
    x = mix(h ^ np.uint64(0x3C6EF372FE94F82B))
    mask = np.zeros(len(h), np.uint64)
    for i in range(BITS):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return x >> np.uint64(24), mask


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _repeated_range(ranges: int):
    """A range's part of the filter: the anchors that two texts have, or one text twice."""

    def run(key, group):
        read = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group[c]])
        h, d = read("anchors"), read("texts")
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        found = np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])
        cells = np.zeros(max(1, min(len(found) * BITS_PER_ANCHOR // 64 + 1, FILTER_WORDS // ranges)), np.uint64)
        at, mask = _masks(found)
        np.bitwise_or.at(cells, (at % np.uint64(len(cells))).astype(np.int64), mask)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary())})

    return run


class _Filter:
    def __init__(self, rows: pa.Table, ranges: int):
        self.ranges = ranges
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["cells"]]
        self.size, self.base = np.zeros(ranges, np.uint64), np.zeros(ranges, np.int64)
        n, parts = np.array([len(x) for x in cells], np.int64), rows["part"].to_numpy()
        self.size[parts], self.base[parts] = n, np.cumsum(n) - n
        self.cells = np.concatenate([np.zeros(0, np.uint64), *cells])

    def holds(self, h: np.ndarray) -> np.ndarray:
        part = _range(h, self.ranges)
        out = np.zeros(len(h), bool)
        at = np.flatnonzero(self.size[part] > 0)
        place, mask = _masks(h[at])
        out[at] = (self.cells[self.base[part[at]] + (place % self.size[part[at]]).astype(np.int64)] & mask) == mask
        return out


_SEGMENT = "anchor long, digest long, row long, doc_id long, start long, strings int, place int, sure boolean"


def _segments(shared):
    """The segments of anchors that pass the filter.  Of equal ones in a task all but the earliest are ``sure`` to be
    covered; their anchor and digest only deal them out."""
    names = [f.split()[0] for f in _SEGMENT.split(", ")]

    def settled(held):
        h, d, row, doc, null, start, strings, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, row, doc, null, d, h))
        h, d, row, doc, null, start, strings, place = (x[order] for x in (h, d, row, doc, null, start, strings, place))
        sure = np.zeros(len(h), bool)
        sure[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        with np.errstate(over="ignore"):
            h, d = np.where(sure, mix(row.astype(np.uint64)), h), np.where(sure, start.astype(np.uint64), d)
        for lo in range(0, len(h), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            cols = [pa.array(h[at].view(np.int64)), pa.array(d[at].view(np.int64)), pa.array(row[at]), pa.array(doc[at], mask=null[at]), pa.array(start[at]), pa.array(strings[at]), pa.array(place[at]), pa.array(sure[at])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        held, size, seen = [], 0, {}
        for batch in batches:
            data, offs = raw_texts(batch.column(2))
            ids, rows = batch.column(1), np.asarray(batch.column(0))
            null, docs = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            for lo, hi in slices(offs, SLICE_BYTES):
                own = offs[lo : hi + 1] - offs[lo]
                part = data[offs[lo] : offs[hi]]
                row, h, first, last, place, digest = anchors(part, own)
                keep = np.flatnonzero(shared.value.holds(h))
                fresh = np.zeros(hi - lo, bool)
                for i in np.unique(row[keep]).tolist():
                    key = _key(None if null[lo + i] else int(docs[lo + i]), int(rows[lo + i]))
                    fresh[i] = _fresh(seen, part[own[i] : own[i + 1]].tobytes(), key) is not None
                keep = keep[fresh[row[keep]]]
                row, first, last = row[keep], first[keep], last[keep]
                held.append((h[keep], digest[keep], rows[lo + row], docs[lo + row], null[lo + row], first - own[row], (last - first + 1).astype(np.int32), (place[keep] - first).astype(np.int32)))
                size += len(keep)
                if size > TASK_ANCHORS:
                    yield from settled(held)
                    held, size = [], 0
        if size:
            yield from settled(held)

    return run


_CONTENT = "piece long, doc_id long, row long, start long, place int, content binary"


def _contents(batches):
    """The bytes of the segments that are wanted of each text."""
    for batch in batches:
        data, offs = raw_texts(batch.column(2))
        wanted = batch.column(3)
        count = np.asarray(wanted.value_lengths())
        of = np.repeat(np.arange(len(wanted)), count)
        anchor, start, strings, place = (np.asarray(wanted.flatten().field(c)) for c in ("anchor", "start", "strings", "place"))
        begin = offs[of] + start
        content = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + strings + LENGTH - 1).tolist())]
        of = pa.array(of)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(1).take(of), batch.column(0).take(of), pa.array(start), pa.array(place), pa.array(content, pa.binary())], names=[f.split()[0] for f in _CONTENT.split(", ")])


class _RangeMin:
    """Least value of any range of a small-integer array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        span = 1
        while span * 2 <= len(x):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-span], low[span:]))
            span *= 2

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of [a, b], a <= b."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), self.levels[0].dtype)
        for v in np.unique(level):
            at = level == v
            out[at] = np.minimum(self.levels[v][a[at]], self.levels[v][b[at] - (1 << v) + 1])
        return out


def column_sort(strings: list[bytes], most: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one before, at most ``most``) of all suffixes, in their order.

    Round t inserts the suffix of length t of every string that has one.  The collection's transform holds the
    symbol to the left of each suffix sorted so far (0 where there is none); a stable sort of it is the
    last-to-first mapping, so a symbol's rank is the place of the suffix that it begins.  Two suffixes that begin
    with one symbol share 1 more than the least common prefix between the places that they came from.  Each round
    reads and writes every array once, in order.
    """
    return _column_sort(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64), most)


def _column_sort(text: np.ndarray, size: np.ndarray, most: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(size)
    start = np.cumsum(size + 1) - size - 1  # a suffix is its start in the strings, each with an end of its own
    kind = np.uint8 if not len(text) or text.max() < 255 else np.uint16
    left = np.zeros(len(text) + k, kind)  # the symbol before it; 0 where there is none
    at = np.ones(len(left), bool)
    at[start] = False
    left[at] = text.astype(kind) + kind(1)

    suffix, prefix = (start + size).astype(np.int32), np.zeros(k, np.uint8)
    transform, place = left[suffix], np.flatnonzero(size > 0)
    live = suffix[place]
    while len(live):
        order = pc.array_sort_indices(pa.array(transform)).to_numpy().view(np.int64)  # stable, by counting
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = rank[place]
        new = own + (k - len(transform) + np.count_nonzero(transform))
        least = _RangeMin(prefix)
        here = transform[place]
        # The neighbours that begin with the same symbol, and where those came from.
        before = order[np.maximum(own - 1, 0)]
        has = (own > 0) & (transform[before] == here)
        shared = np.zeros(len(new), np.int64)
        shared[has] = 1 + least.least(before[has] + 1, place[has]).astype(np.int64)
        after = order[np.minimum(own + 1, len(order) - 1)]
        follows = (own + 1 < len(order)) & (transform[after] == here)
        behind = 1 + least.least(place[follows] + 1, after[follows]).astype(np.int64)

        n = len(transform) + len(new)
        kept = np.ones(n, bool)
        kept[new] = False
        live = live - 1
        merged = []
        for x, y in ((suffix, live), (prefix, np.minimum(shared, most)), (transform, left[live])):
            z = np.empty(n, x.dtype)
            z[kept], z[new] = x, y
            merged.append(z)
        suffix, prefix, transform = merged
        prefix[new[follows] + 1] = np.minimum(behind, most)
        going = left[live] > 0
        live, place = live[going], new[going]
    who = np.repeat(np.arange(k), size + 1)[suffix]
    return who, suffix - start[who], prefix


def _settle(doc: np.ndarray, null: np.ndarray, row: np.ndarray, start: np.ndarray, text: np.ndarray, size: np.ndarray):
    """(row, start, strings) runs of covered strings in a collection of segments."""
    who, offset, prefix = _column_sort(text, size)
    full = size[who] - offset >= LENGTH
    group = np.cumsum(prefix < LENGTH)[full]
    who, at = who[full], offset[full] + start[who[full]]
    order = np.lexsort((at, row[who], doc[who], null[who], group))
    covered = np.zeros(len(order), bool)
    covered[1:] = group[order][1:] == group[order][:-1]
    r, a = row[who[order][covered]], at[order][covered]
    by = np.lexsort((a, r))
    r, a = r[by], a[by]
    if len(r):
        cut = np.concatenate([[0], np.flatnonzero((r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)) + 1, [len(r)]])
        yield pa.RecordBatch.from_arrays([pa.array(r[cut[:-1]]), pa.array(a[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32))], names=["row", "start", "strings"])


def _compare(batches):
    """The covered strings among different segments of a piece (piece, doc_id, row, start, place, content), whole
    pieces together in collections of about ``SORT_BYTES``."""
    rest = None

    def collections(cols, last: bool):
        """Settles whole pieces; what is left."""
        piece, size = cols[0], cols[6]
        edge = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece))
        upto = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(piece):
            ends = edge[edge > lo]
            hi = int(ends[min(int(np.searchsorted(upto[ends] - upto[lo], SORT_BYTES)), len(ends) - 1)])
            if not last and (hi == len(piece) or upto[hi] - upto[lo] < SORT_BYTES):
                break
            yield from _settle(*(c[lo:hi] for c in cols[1:5]), cols[5][upto[lo] : upto[hi]], size[lo:hi])
            lo = hi
        return None if lo == len(piece) else [*(c[lo:] for c in cols[:5]), cols[5][upto[lo] :], size[lo:]]

    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = raw_texts(batch.column(5))
        ids = batch.column(1)
        cols = [np.asarray(batch.column(0)), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(batch.column(2)), np.asarray(batch.column(3)), data[offs[0] : offs[-1]], np.diff(offs)]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        rest = cols
        if len(cols[5]) > 4 * SORT_BYTES:
            rest = yield from collections(cols, False)
    if rest is not None:
        yield from collections(rest, True)


def _spans(starts: list, strings: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(starts, strings)):
        b = a + n - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(batches):
    """(row, spans, kept text) of texts with covered strings."""
    for batch in batches:
        data, offs = raw_texts(batch.column(1))
        spans, kept = [], []
        for i, found in enumerate(batch.column(2).to_pylist()):
            text = data[offs[i] : offs[i + 1]].tobytes()
            own = _spans([f["start"] for f in found], [f["strings"] for f in found])
            at, rest = 0, []
            for a, b in own:
                rest.append(text[at:a])
                at = b
            kept.append(b"".join([*rest, text[at:]]))
            spans.append([{"start": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["row", "spans", "kept"])


def _read(texts: DataFrame, several: DataFrame) -> DataFrame:
    """The segments (row, segment) with their bytes, as pieces by their anchors."""
    wanted = stored(several.groupBy("row").agg(F.collect_list("segment").alias("segments")), "wanted")
    touched = wanted.select("row")
    own = texts.join(broadcast_if_small(touched, touched.count(), BROADCAST_ROWS), "row", "left_semi")
    return own.join(wanted, "row").select("row", "doc_id", "text", "segments").mapInArrow(_contents, _CONTENT)


def _split(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strings of pieces with many kinds: (row, start, strings) of those that an earlier equal part covers, and
    smaller pieces of the others, each of at most ``KINDS`` kinds.

    A part holds the strings in which the anchor stands ``low`` to ``high`` bytes from the start, by the same halving
    for all pieces.  They all hold the ``low`` bytes before it and the LENGTH - M - ``high`` bytes behind it, so equal
    strings are in parts with an equal middle.  Equal parts are settled by their digests; a part of one place is one
    string.
    """
    parts = hot.withColumns({"low": F.lit(0), "high": F.lit(LENGTH - M)})
    later, few = None, None
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high"))))
        cut = parts.withColumn("half", halves).select("piece", "doc_id", "row", "start", "place", "content", "half.low", "half.high")
        # Which of a part's places the segment has.
        cut = cut.withColumns({"least": F.greatest("low", F.col("place") - F.length("content") + LENGTH), "most": F.least("high", "place")}).where("low <= high and least <= most")
        cut = cut.select(
            F.xxhash64("piece", "low", "high", F.substr("content", F.col("place") - F.col("low") + 1, F.col("low") + LENGTH - F.col("high"))).alias("piece"), "doc_id", "row",
            (F.col("start") + F.col("place") - F.col("most")).alias("start"), F.col("most").alias("place"), (F.col("most") - F.col("least") + 1).alias("strings"),
            F.substr("content", F.col("place") - F.col("most") + 1, F.col("most") - F.col("least") + LENGTH).alias("content"), "low", "high",
        )
        first = Window.partitionBy("piece", "digest").orderBy(F.col("doc_id").isNull(), "doc_id", "row", "start")
        cut = stored(cut.withColumn("digest", F.xxhash64("content", "place")).withColumn("rank", F.row_number().over(first)), "halves")
        covered = cut.where("rank > 1").select("row", "start", "strings")
        later = covered if later is None else later.unionByName(covered)
        kinds = stored(cut.where("rank = 1").groupBy("piece").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
        left = cut.where("rank = 1 and low < high").join(kinds, "piece")
        small = left.where(F.col("kinds") <= KINDS).select(*(f.split()[0] for f in _CONTENT.split(", ")))
        few = small if few is None else few.unionByName(small)
        parts = left.where(F.col("kinds") > KINDS)
        if parts.isEmpty():
            return later, few


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_bytes, sha256 of the text, spans (removed, in bytes) and kept (bytes; null where all is kept)."""
    docs = scanned(docs)
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), or_empty(F.col(text_col).cast("string")).alias("text"))
    rows = stored(texts.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("row").alias("first"))
    firsts = rows.where(F.col("n_bytes") >= LENGTH).groupBy("sha256", "n_bytes").agg(F.min(key)["first"].alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copy = (F.col("first").isNotNull() & (F.col("first") != F.col("row"))).alias("copy")
    rows = stored(rows.join(firsts, ["sha256", "n_bytes"], "left").select("row", "doc_id", "n_bytes", "sha256", copy), "rows")

    # As many ranges as keep a range's anchors within a task; the filter's bound is the same whatever their number.
    ranges = max(LEAST_RANGES, shuffle_parts(spark, texts, RANGE_BYTES))
    parts = texts.mapInArrow(_anchor_counts(ranges), "part long, anchors binary, texts binary").groupBy("part").applyInArrow(_repeated_range(ranges), "part long, cells binary").toArrow()
    shared = spark.sparkContext.broadcast(_Filter(parts, ranges))
    earlier = Window.partitionBy("anchor", "digest").orderBy(F.col("doc_id").isNull(), "doc_id", "row", "start")
    found = texts.mapInArrow(_segments(shared), _SEGMENT).withColumn("rank", F.when(F.col("sure"), 0).otherwise(F.row_number().over(earlier)))
    segments = stored(found.select("anchor", "row", "doc_id", "start", "strings", "place", "rank"), "segments")
    shared.destroy()
    later = segments.where("rank <> 1").select("row", "start", "strings")
    kinds = stored(segments.where("rank = 1").groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    several = segments.where("rank = 1").join(kinds, "anchor").select("row", F.struct("anchor", "start", "strings", "place").alias("segment"), (F.col("kinds") > KINDS).alias("hot"))
    different = _read(texts, several.where("not hot"))
    if not kinds.where(F.col("kinds") > KINDS).isEmpty():
        more, few = _split(_read(texts, several.where("hot")))
        later, different = later.unionByName(more), different.unionByName(few)
    equal = different.repartition(F.col("piece")).sortWithinPartitions("piece").mapInArrow(_compare, "row long, start long, strings int")
    copies = rows.where("copy").select("row")
    covered = later.unionByName(equal).groupBy("row").agg(F.collect_list(F.struct("start", "strings")).alias("found"))
    covered = stored(covered.join(copies, "row", "left_anti"), "covered")
    touched = covered.select("row")
    own = texts.select("row", "text").join(broadcast_if_small(touched, touched.count(), BROADCAST_ROWS), "row", "left_semi")
    cut = own.join(covered, "row").select("row", "text", "found").mapInArrow(_cut, "row long, spans array<struct<start:long,end:long>>, kept binary")
    out = rows.join(cut, "row", "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "row", "doc_id", "n_bytes", "sha256", F.when(F.col("copy"), everything).otherwise(F.coalesce("spans", nothing)).alias("spans"), F.when(F.col("copy"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT *, unnest(generate_series(0, n - 100)) AS i FROM d WHERE n >= 100)
), c AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY m ORDER BY doc_id NULLS LAST, r, i) AS k FROM w) WHERE k > 1
), g AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS part FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM c)
), p AS (
  SELECT r, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY r, part
), k AS (
  SELECT d.r, h, coalesce(lag(p.b) OVER o, 0) AS a, p.a AS b FROM d JOIN p USING (r) WINDOW o AS (PARTITION BY d.r ORDER BY p.a)
  UNION ALL SELECT d.r, h, coalesce(e, 0), n FROM d LEFT JOIN (SELECT r, max(b) AS e FROM p GROUP BY r) USING (r)
), kept AS (
  SELECT r, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256 FROM k GROUP BY r
), s AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans FROM p GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN s USING (r)
"""
