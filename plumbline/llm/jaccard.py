"""Exact n-gram Jaccard join: a size-aware heavy-light join on word shingles.

1. One scan gives every row its shingle set's size and class (a 64-bit digest of the sorted set: rows
   with equal sets are one class from here on), and counts the shingles that recur within a task.
2. Shingles found ``LEAST_HEAVY`` times or more are the heavy ones; where there are over ``HEAVY`` of them,
   the bar is doubled until there are not, which bounds their broadcast.  They stand last in the order in
   which a set is indexed, so a common passage's lists are scanned only for sets made of little else.
3. Sets of at most x shingles enumerate their subsets of the sizes that a partner must share; larger
   ones, and small ones that may link with larger ones, put a prefix of their shingles into inverted
   lists.  x is the largest size up to which the subsets of the sets there are cost no more rows than
   their lists (``boundary``).
4. Lists give candidate pairs.  Those of heavy keys are dealt to many tasks; a light key's list is bounded by
   the bar and the number of tasks.  First each list's members meet two typical classes of it, those with the
   largest shares of heavy shingles (of near copies, the least changed); what links is merged.  Then all
   pairs of a list that are not yet in one component are taken, in blocks of ``LIST_BLOCK`` members: blocks of
   the list's main component meet blocks of its other members, and those each other.  A pair inside a
   component could add no class to it, so none is lost.
5. A candidate is held against parity bitmaps, whose distance never exceeds the sets' difference (lists of
   over ``LIGHT_LIST`` members carry them along, so that only what passes leaves the list), and what is left
   is verified on the whole sets.

Rows: null text, and text without words, has the empty set, which links with nothing.  A text with fewer
words than a shingle has its whole sequence as one.  Null ids are rows of their own; they take no part in
the smallest id of a component unless it has no other.  Repeated rows share a class.  An empty table gives
no rows.  Columns beyond id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, scanned, stored, table
from .components import components
from .textscan import mix, raw_texts, slices, words_of

HEAVY = 1_000_000
LEAST_HEAVY, REPORT = 16, 2
DEALT = 64
MOST_SUBSETS = 4096
LIST_BLOCK = 512
LIGHT_LIST = 48
BROADCAST_ROWS = 2_000_000
TASK_SHINGLES = 2 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every text's distinct shingles, in the order of both."""
    start, _, h = words_of(data, offs)
    row = np.searchsorted(offs[1:], start, "right")
    count = np.bincount(row, minlength=len(offs) - 1)
    with np.errstate(over="ignore"):
        s, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(h) >= n:
            s = np.zeros(len(h) - n + 1, np.uint64)
            for i in range(n):
                s = s * _MUL + h[i : len(h) - n + 1 + i]
            whole = row[: len(s)] == row[n - 1 :]
            s, r = mix(s[whole]), row[: len(s)][whole]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            ends = np.cumsum(count)
            for i in short:
                x = np.uint64(count[i])
                for w in h[ends[i] - count[i] : ends[i]]:
                    x = x * _MUL + w
                s, r = np.append(s, mix(np.array([x ^ np.uint64(0x5107)]))), np.append(r, i)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return r[first], s[first]


def digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def overlap(s: int, t: int, num: int) -> int:
    """The least intersection of linked sets with s and t elements at a similarity of num / 100."""
    return -(-num * (s + t) // (100 + num))


def subset_sizes(s: int, num: int) -> set[int]:
    lo, hi = -(-num * s // 100), s * 100 // num
    return {c for t in range(lo, hi + 1) if 0 < (c := overlap(s, t, num)) <= min(s, t)}


def prefix(s, num: int):
    return s - -(-num * s // 100) + 1


def subsets(s: int, num: int) -> int:
    """How many rows a set of s shingles enumerates."""
    return sum(comb(s, c) for c in subset_sizes(s, num))


def largest_enumerable(num: int) -> int:
    """The largest size whose sets have at most ``MOST_SUBSETS`` subsets each."""
    s = 1
    while subsets(s + 1, num) <= MOST_SUBSETS:
        s += 1
    return s


def boundary(sizes: dict[int, int], list_length: float, num: int) -> int:
    """The largest size up to which all subsets of the sets counted in ``sizes`` (size: sets) cost no more rows
    than their lists, whose every entry meets ``list_length`` others; 0 without small sets."""
    x, small, listed = 0, 0.0, 0.0
    for s in range(1, largest_enumerable(num) + 1):
        small += sizes.get(s, 0) * subsets(s, num)
        listed += sizes.get(s, 0) * prefix(s, num) * (1 + list_length)
        if sizes.get(s, 0) and small <= listed:
            x = s
    return x


def _sizes(n: int):
    """Each row's size and class, and the shingles that recur in a task, with their counts."""

    def run(batches):
        held, size, seen = [], 0, set()

        def recurring():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= REPORT], c[c >= REPORT]
            for lo in range(0, len(u), 1 << 17):
                m = len(u[lo : lo + (1 << 17)])
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(c[lo : lo + m]), pa.array(u[lo : lo + m].view(np.int64))], names=_SIZES_NAMES)

        for batch in batches:
            data, offs = raw_texts(batch.column(2))
            for lo, hi in slices(offs):
                row, s = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                classes = [digest(s[a:b]) if b > a else None for a, b in zip(cuts[:-1], cuts[1:])]
                fresh = np.zeros(hi - lo, bool)
                for i, c in enumerate(classes):
                    if c is not None and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                held.append(s[fresh[row]])
                size += len(held[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(cuts)), pa.array(classes, pa.int64())], names=_SIZES_NAMES)
                if size > TASK_SHINGLES:
                    yield from recurring()
                    held, size, seen = [], 0, set()
        if held:
            yield from recurring()

    return run


_SIZES = "row long, doc_id long, n long, cls long"
_SIZES_NAMES = ["row", "doc_id", "n", "cls"]


def _postings(shared):
    """(key, class, size) of the subsets of small sets and the index prefixes of others; a key is heavy if all
    its shingles are."""

    def run(batches):
        n, num, x, heavy, weight = shared.value
        seen: set[int] = set()
        for batch in batches:
            data, offs = raw_texts(batch.column(0))
            for lo, hi in slices(offs):
                row, s = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                m = hi - lo
                cuts = np.searchsorted(row, np.arange(m + 1))
                size = np.diff(cuts)
                classes = np.zeros(m, np.int64)
                for i in np.flatnonzero(size):
                    classes[i] = c = digest(s[cuts[i] : cuts[i + 1]])
                    if c in seen:
                        size[i] = 0
                    seen.add(c)
                if len(seen) > 1 << 20:
                    seen.clear()
                rank = np.zeros(len(s), np.uint8)  # 0: light
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    rank = np.where(heavy[at] == s, weight[at], 0).astype(np.uint8)
                keys, own, common = [], [], []
                for i in np.flatnonzero((size > 0) & (size <= x)):
                    mine, often = s[cuts[i] : cuts[i + 1]], rank[cuts[i] : cuts[i + 1]] > 0
                    for c in subset_sizes(int(size[i]), num):
                        for sub in combinations(range(len(mine)), c):
                            at = list(sub)
                            keys.append(xxhash.xxh64_intdigest(mine[at].tobytes(), seed=c) - (1 << 63))
                            own.append(i)
                            common.append(bool(often[at].all()))
                order = np.lexsort((s, rank, row))  # rows stay in place: only within each does the order change
                place = np.arange(len(s)) - cuts[row]
                listed = size * 100 >= num * (x + 1)
                take = listed[row] & (place < prefix(size, num)[row])
                keys = np.concatenate([np.array(keys, np.int64), s[order][take].view(np.int64)])
                own = np.concatenate([np.array(own, np.int64), row[take]])
                common = np.concatenate([np.array(common, bool), rank[order][take] > 0])
                typical = (1000 * np.bincount(row, rank > 0, m) / np.maximum(np.diff(cuts), 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes[own]), pa.array(size[own].astype(np.int32)), pa.array(typical[own]), pa.array(common)], names=["key", "cls", "n", "typical", "heavy"])

    return run


def _lists(batches):
    """Numpy columns of whole lists, and where each list begins; batches are sorted by key (and block pair)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        last = cut[-1] if len(cut) else 0
        if last:
            yield [c[:last] for c in cols], np.concatenate([[0], cut[:-1]])
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest, np.zeros(1, np.int64)


_PAIR_ROWS = 1 << 19


class _Pairs:
    def __init__(self):
        self.held, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        if len(a):
            self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            self.size += len(a)
        if self.size > _PAIR_ROWS:
            self.held = [np.unique(np.concatenate(self.held), axis=0)]
            self.size = len(self.held[0])
            if self.size > _PAIR_ROWS // 2:
                yield from self.take()

    def take(self):
        if self.held:
            p = np.unique(np.concatenate(self.held), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])
        self.held, self.size = [], 0


def _fits(n: np.ndarray, m: np.ndarray, num: int) -> np.ndarray:
    return np.minimum(n, m).astype(np.int64) * 100 >= num * np.maximum(n, m).astype(np.int64)


def _apart(num: int):
    """All pairs of a list, or of two of its blocks, that are in different components."""

    def run(batches):
        out = _Pairs()
        for cols, starts in _lists(batches):
            size = np.diff(np.append(starts, len(cols[0])))
            _, i, j, _, cls, n, root, bits = cols
            a = starts[(size == 2) & (i[starts] == j[starts])]
            a = a[_fits(n[a], n[a + 1], num) & (root[a] != root[a + 1])]
            yield from out.add(cls[a], cls[a + 1])
            for at in np.flatnonzero((size > 2) | ((size == 2) & (i[starts] != j[starts]))):
                yield from pairs([c[starts[at] : starts[at] + size[at]] for c in cols], out)
        yield from out.take()

    def pairs(cols, out):
        _, i, j, block, cls, n, root, bits = cols
        order = np.argsort(n, kind="stable")
        cls, n, root, block, bits = cls[order], n[order], root[order], block[order], bits[order]
        near = None if bits[0] is None else _Near(bits, n, num)
        most = np.searchsorted(n, n.astype(np.int64) * 100 // num, "right")  # partners stand after a member, up to this size
        for k in range(len(cls) - 1):
            mate = slice(k + 1, most[k])
            ok = root[mate] != root[k]
            if i[0] != j[0]:
                ok &= block[mate] != block[k]
            if near is not None and ok.any():
                ok[ok] = near(k, k + 1 + np.flatnonzero(ok))
            if ok.any():
                yield from out.add(cls[mate][ok], np.full(int(ok.sum()), cls[k]))

    return run


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of about four bits a shingle; a power of two, 64 at least."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    at = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8))


class _Near:
    """Which of a list's members (by rising size) may link with one of them, by bitmaps of equal length."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, num: int):
        self.n, self.num, self.size = n.astype(np.int64), num, np.array([len(b) for b in bits])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():
            # Linked sets' sizes differ by less than half, so their bitmaps by one halving at most.
            own = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            rows = np.stack([_folded(bits[i], size) for i in own])
            index = np.full(len(bits), -1)
            index[own] = np.arange(len(own))
            self.at[size] = rows, index

    def __call__(self, k: int, mates: np.ndarray) -> np.ndarray:
        rows, index = self.at[int(self.size[k])]
        apart = np.bitwise_count(rows[index[mates]] ^ rows[index[k]]).sum(1).astype(np.int64)
        both = self.n[mates] + self.n[k]
        return (100 + self.num) * ((both - apart) // 2) >= self.num * both


def _sets(n: int, whole: bool):
    """(class, size, bitmap or sorted shingles) of each row, which is (class, text)."""

    def run(batches):
        for batch in batches:
            data, offs = raw_texts(batch.column(1))
            for lo, hi in slices(offs):
                row, s = shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                out = [(s[a:b] if whole else _bitmap(s[a:b])).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts).astype(np.int32)), pa.array(out, pa.binary())], names=["cls", "n", "bits"])

    return run


def _folded(x: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller power of two: parities of what falls together."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), 0)


def _may_link(num: int):
    def run(batches):
        for batch in batches:
            n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in (2, 3))
            apart = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = x.as_buffer(), y.as_buffer()
                size = min(len(x), len(y))
                apart[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()
            most = (n + m - apart) // 2
            keep = pa.array((100 + num) * most >= num * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    return run


def _linked(num: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                keep.append(100 * both >= num * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    return run


class _Classes:
    """Reads the sets of chosen classes again from one text of each; nothing else is stored or shuffled of them."""

    def __init__(self, texts: DataFrame, rows: DataFrame, n: int):
        self.texts, self.n = texts.select("row", "text"), n
        self.one = rows.where("cls is not null").groupBy("cls").agg(F.min("row").alias("row"))

    def sets(self, classes: DataFrame, whole: bool) -> DataFrame:
        """(cls, n, bits) of ``classes`` (cls): bitmaps, or the sorted shingles; stored."""
        wanted = stored(classes.select("cls").distinct().join(self.one, "cls"), "wanted")
        own = self.texts.join(broadcast_if_small(wanted, wanted.count(), BROADCAST_ROWS), "row")
        return stored(own.select("cls", "text").mapInArrow(_sets(self.n, whole), "cls long, n int, bits binary"), "sets")


def _verified(pairs: DataFrame, bitmaps: DataFrame, classes: _Classes, num: int) -> DataFrame:
    """The stored pairs (a, b) whose whole sets link."""
    a, b = (bitmaps.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    near = stored(pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_link(num), "a long, b long"), "near")
    whole = classes.sets(near.select(F.explode(F.array("a", "b")).alias("cls")), True)
    a, b = (whole.select(F.col("cls").alias(c), F.col("bits").alias(f"s_{c}")) for c in "ab")
    return stored(near.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(_linked(num), "a long, b long"), "links")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, links): row, doc_id, n and cls of every row; root of every class that links with another.

    ``row`` is monotonically_increasing_id() over ``scanned(docs)``; sets link from a similarity of num / 100.
    """
    if not 50 < num <= 100:  # linked sets' bitmaps must differ by one halving at most
        raise ValueError("similarity must be over 50 and at most 100 hundredths")
    docs = scanned(docs)
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = stored(texts.mapInArrow(_sizes(n), _SIZES), "sizes")
    rows, recurring = seen.where("row is not null"), seen.where("row is null").groupBy(F.col("cls").alias("shingle")).agg(F.sum("n").alias("df"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = {r["bar"]: r["count"] for r in recurring.where(F.col("df") >= LEAST_HEAVY).groupBy(F.floor(F.log2(F.col("df") / LEAST_HEAVY)).alias("bar")).count().collect()}
    bar = next(b for b in range(64) if sum(c for k, c in often.items() if k >= b) <= HEAVY)
    heavy = recurring.where(F.col("df") >= LEAST_HEAVY << bar).toArrow()
    keys, df = heavy["shingle"].to_numpy().view(np.uint64), heavy["df"].to_numpy()
    order = np.argsort(keys)
    sizes = {r["n"]: r["count"] for r in rows.where(F.col("n").between(1, largest_enumerable(num))).groupBy("n").count().collect()}
    x = boundary(sizes, float((df.astype(np.float64) ** 2).sum()) / max(1, total), num)
    weight = (1 + np.log2(np.maximum(df, 1))).astype(np.uint8)[order]
    shared = sc.broadcast((n, num, x, keys[order], weight))

    postings = texts.select("text").mapInArrow(_postings(shared), "key long, cls long, n int, typical int, heavy boolean")
    dealt = postings.withColumn("deal", F.when(F.col("heavy"), F.pmod(F.xxhash64("cls"), F.lit(DEALT))).otherwise(-1))
    by_key = dealt.repartition(F.col("key"), F.col("deal")).groupBy("key", "deal", "cls", "n").agg(F.max("typical").alias("typical"))
    members = F.expr("count(*) over (partition by key, deal)")
    lists = stored(by_key.withColumn("members", members).where("members > 1 or deal >= 0").select("key", "cls", "n", "typical"), "lists")
    shared.destroy()
    classes = _Classes(texts, rows, n)
    first = _stars(lists, num)
    bitmaps = classes.sets(lists, False)
    first = _verified(first, bitmaps, classes, num)
    roots = stored(components(first), "roots")
    second = _verified(_open_pairs(lists, roots, bitmaps, num), bitmaps, classes, num)
    return rows, components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))


def _stars(lists: DataFrame, num: int) -> DataFrame:
    """(a, b): each member with two typical classes of each of its lists."""
    half = lambda i: F.max(F.when(F.pmod(F.xxhash64("cls"), F.lit(2)) == i, F.struct("typical", "cls", "n")))
    leads = lists.groupBy("key").agg(F.count("*").alias("members"), F.array_compact(F.array(half(0), half(1))).alias("leads")).where("members > 1")
    leads = stored(leads.select("key", F.explode("leads").alias("lead")).select("key", F.col("lead.cls").alias("other"), F.col("lead.n").alias("m")), "leads")
    low, high = F.least("n", "m").cast("long"), F.greatest("n", "m").cast("long")
    met = lists.join(leads, "key").where((F.col("cls") != F.col("other")) & (low * 100 >= high * num))
    return met.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _open_pairs(lists: DataFrame, roots: DataFrame, bitmaps: DataFrame, num: int) -> DataFrame:
    """(a, b): the pairs of a list that are in different components and may link."""
    known = stored(lists.join(roots, lists["cls"] == roots["node"], "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root")), "known")
    parts = known.groupBy("key", "root").agg(F.count("*").alias("own"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("own", "root")).alias("main"), F.sum("own").alias("members")).where("main.own < members")
    open_ = stored(open_.select("key", F.col("main.root").alias("main"), F.col("main.own").alias("in_main"), "members"), "open")
    blocks = lambda c: F.ceil(c / LIST_BLOCK).cast("int")
    of_main, of_rest = blocks(F.col("in_main")), blocks(F.col("members") - F.col("in_main"))
    inside = F.col("root") == F.col("main")
    at = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    block = F.when(inside, at(of_main)).otherwise(of_main + at(of_rest))
    other = F.explode(F.sequence(F.when(inside, of_main).otherwise(F.lit(0)), of_main + of_rest - 1))
    dealt = known.join(open_, "key").withColumn("block", block).withColumn("other", other)
    pair = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    light = dealt.where(F.col("members") <= LIGHT_LIST).select("key", *pair, "block", "cls", "n", "root", F.lit(None).cast("binary").alias("bits"))
    long_ = dealt.where(F.col("members") > LIGHT_LIST).join(bitmaps.select("cls", "bits"), "cls").select("key", *pair, "block", "cls", "n", "root", "bits")
    dealt = light.unionByName(long_)
    return dealt.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j").mapInArrow(_apart(num), "a long, b long").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80) -> DataFrame:
    """row, doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    rows, roots = similar_classes(docs, id_col, text_col, n, num)
    with_set, without = rows.where("cls is not null"), rows.where("cls is null")
    # Rows of a class are gathered within each task first; what is joined to the rows is one row for each class.
    each = with_set.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    each = each.join(roots, each["cls"] == roots["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"), "least", "first")
    each = stored(each, "classes")
    of_root = stored(each.groupBy("root").agg(F.min("least").alias("least"), F.min("first").alias("first")), "least")
    of_class = stored(each.select("cls", "root").join(of_root, "root").select("cls", "least", F.col("first.row").alias("keeps")), "of_class")
    found = with_set.join(of_class, "cls", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), (F.col("keeps") == F.col("row")).alias("kept"))
    return found.unionByName(without.select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), n=4, num=85).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, list_slice(w, i, i + least(len(w), 4) - 1) AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), e AS (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT r AS node, r AS seen FROM d UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen
), least_id AS (
  SELECT node, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.seen GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN least_id ON least_id.node = d.r
"""
