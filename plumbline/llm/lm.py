"""Language-model scoring from a log-frequency Bloom filter.

Counts.  A training text is its words and one end token.  All words, and all pairs (word before, word),
are counted: each task sorts and sums the hashes of its texts and sends arrays of (hash, count), cut by
ranges of the hash itself, so that no word's pairs meet in one range.

Filter.  A word, or a pair seen ``LEAST_PAIR`` times or more, that was seen c times has level 1 + floor(log_b c)
and is put into its range's Bloom filter once for each level up to its own; its quantised count is read by
probing level 1, 2, ... until a probe misses.  An entry and level sets ``BITS`` bits in one 64-bit word; a range
has ``BITS_PER_ENTRY`` bits for each.

Probability.  p(w | v) = (n(v, w) + m(v) p(w)) / (n(v) + m(v)), p(w) = (n(w) + 0.1) / (N + 0.1 (V + 1)), where
every n is read from the filter: the smallest count of its level above the line, the largest below it, so
that the sum over w stays within 1, false hits apart.  m(v) = K n(v)**H, about the number of different words
that follow v.  It is the same formula for every word and at every size.

Broadcast.  The filter is broadcast where it has at most ``FILTER_BYTES``.  Beyond that its ranges stay where they
are stored: every slice of text sends its distinct entries to their ranges, and the levels found come back to it,
so that the work stays in proportion to the corpus.  Both ways read the same filter.  ``LEAST_PAIR`` is a parameter
of the model: a larger one keeps the filter of a larger corpus within a broadcast.

Base scores need exact counts.  The words that make up a share of 1 / ``HEAD_WORDS`` of all tokens or more, so many
at most, are broadcast with theirs; the other words of a text meet their counts by a join.

Rows: a null text is an empty one: the end token alone.  A null id is not held out.  Repeated rows and ids
are documents of their own.  With no training tokens N and V are 0 and every word is unseen.  An empty table
gives no rows.  Columns beyond id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scanned, shuffle_parts, stored, table
from .textscan import mix, raw_texts, slices, words_of

ALPHA = 0.1
K, H, LEAST_PAIR = 2.0, 0.83, 2
BASE, BITS, BITS_PER_ENTRY = 1.5, 3, 10
FILTER_BYTES, HEAD_WORDS = 64 << 20, 1 << 20
RANGE_BYTES = 8 << 20
TASK_KEYS = 2 << 20
END, START = np.uint64(0xE4D0F7E87E4D0F7E), np.uint64(0x57A4757A457A4757)
_GROWTH = np.log(BASE)
_WORD, _PAIR = 0, 1
_HALF = np.uint64(32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 10 == 0, F.lit(False))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, token before) of each text's words and its end."""
    start, _, h = words_of(data, offs)
    n = len(offs) - 1
    row = np.searchsorted(offs[1:], start, "right")
    ends = np.cumsum(np.bincount(row, minlength=n)) + np.arange(n)
    own = np.full(len(h) + n, END)
    at = np.ones(len(own), bool)
    at[ends] = False
    own[at] = h
    rows = np.empty(len(own), np.int64)
    rows[at], rows[ends] = row, np.arange(n)
    before = np.concatenate([[START], own[:-1]]).astype(np.uint64)
    before[np.concatenate([[0], ends[:-1] + 1])[:n]] = START
    return rows, own, before


def pair_hash(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """48 bits of the pair."""
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + own) >> np.uint64(16)


def range_of(kind: int, h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a word's or a pair's hash, by its first 32 bits."""
    return (((h >> (_HALF if kind == _WORD else np.uint64(16))) * np.uint64(ranges)) >> _HALF).astype(np.int64)


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return h, n
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    firsts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[firsts], np.add.reduceat(n, firsts)


_COUNTED = "part long, kind int, top binary, low binary, few binary, many binary"


def _ranged(kind: int, h: np.ndarray, n: np.ndarray, ranges: int):
    """Rows of (hash, count) arrays; the top 16 bits, which run on, and the rest stand apart to compress."""
    top = (h >> (np.uint64(48) if kind == _WORD else _HALF)).astype(np.uint16)
    low = h if kind == _WORD else h.astype(np.uint32)
    part = range_of(kind, h, ranges)
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    few = np.minimum(n, 255).astype(np.uint8)
    keep = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
    for lo in range(0, len(keep), 64):
        rows = keep[lo : lo + 64]
        cols = [pa.array([i for i, _, _ in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32())]
        cols += [pa.array([f(a, b).tobytes() for _, a, b in rows], pa.binary()) for f in (lambda a, b: top[a:b], lambda a, b: low[a:b], lambda a, b: few[a:b], lambda a, b: n[a:b][few[a:b] == 255])]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "kind", "top", "low", "few", "many"])


def _count(ranges: int):
    def run(batches):
        held: list[list] = [[], []]
        size = 0
        for batch in batches:
            data, offs = raw_texts(batch.column(0))
            for lo, hi in slices(offs):
                _, own, before = tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for kind, h in ((_WORD, own), (_PAIR, pair_hash(before, own))):
                    held[kind].append(np.unique(h, return_counts=True))
                    size += len(held[kind][-1][0])
                if size > TASK_KEYS:
                    held = [[summed(*map(np.concatenate, zip(*x)))] for x in held]
                    size = sum(len(x[0][0]) for x in held)
                    if size > TASK_KEYS:
                        for kind in (_WORD, _PAIR):
                            yield from _ranged(kind, *held[kind][0], ranges)
                        held, size = [[], []], 0
        for kind in (_WORD, _PAIR):
            if held[kind]:
                yield from _ranged(kind, *summed(*map(np.concatenate, zip(*held[kind]))), ranges)

    return run


def levels(n: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(n) / _GROWTH + 1e-9)).astype(np.uint8)


def smallest(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.ceil(np.exp((level - 1) * _GROWTH) - 1e-6), 0.0)


def largest(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.ceil(np.exp(level * _GROWTH) - 1e-6) - 1, 0.0)


def places(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry's word is, as a hash, and its bits in that word."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
    mask = np.zeros(len(x), np.uint64)
    for i in range(BITS):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return x >> np.uint64(24), mask


def word_entry(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0x5DEECE66D))


_MODEL = "part long, types long, total long, cells binary, words binary, counts binary"


def _sum_range(least: int):
    """A range's exact word counts and its filter."""

    def run(key, group):
        got = []
        for kind in (_WORD, _PAIR):
            hs, ns = [], []
            for k, top, low, few, many in zip(*(group[c] for c in ("kind", "top", "low", "few", "many"))):
                if k.as_py() == kind:
                    n = np.frombuffer(few.as_buffer(), np.uint8).astype(np.int64)
                    n[n == 255] = np.frombuffer(many.as_buffer(), np.int64)
                    ns.append(n)
                    if kind == _WORD:
                        hs.append(np.frombuffer(low.as_buffer(), np.uint64))
                    else:
                        hs.append((np.frombuffer(top.as_buffer(), np.uint16).astype(np.uint64) << _HALF) | np.frombuffer(low.as_buffer(), np.uint32))
            got.append(summed(np.concatenate(hs), np.concatenate(ns)) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        (words, n), (pairs, m) = got
        pairs, m = pairs[m >= least], m[m >= least]
        entries = np.concatenate([word_entry(words), pairs])
        level = np.concatenate([levels(n), levels(m)])
        cells = np.zeros(max(1, -(-int(level.sum(dtype=np.int64)) * BITS_PER_ENTRY // 64)), np.uint64)
        for j in range(1, int(level.max(initial=0)) + 1):
            at, mask = places(entries[level >= j], j)
            np.bitwise_or.at(cells, (at % np.uint64(len(cells))).astype(np.int64), mask)
        return _model_row(key[0].as_py(), words, n, cells)

    return run


def _model_row(part: int, words: np.ndarray, n: np.ndarray, cells: np.ndarray) -> pa.Table:
    return pa.table({
        "part": pa.array([part], pa.int64()), "types": pa.array([len(words)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()),
        "cells": pa.array([cells.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()),
    })


def train(docs: DataFrame, text_col: str = "text", ranges: int | None = None, least_pair: int = LEAST_PAIR) -> tuple[DataFrame, int]:
    """The stored model of ``docs``, one row for each range, and the number of ranges."""
    texts = docs.select(F.col(text_col).cast("string"))
    ranges = ranges or max(64, shuffle_parts(docs.sparkSession, texts, RANGE_BYTES))
    return stored(texts.mapInArrow(_count(ranges), _COUNTED).groupBy("part").applyInArrow(_sum_range(least_pair), _MODEL), "lm"), ranges


def _word_rows(least: int, most: int):
    """(word, n) of the words counted ``least`` to ``most`` times, and of the end token if ``least`` is above 0."""

    def run(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                h, n = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                keep = (n >= least) & (n <= most)
                if least:
                    keep |= h == END
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["word", "n"])

    return run


class Filter:
    """Some ranges' filters; entries of the others have level 0."""

    def __init__(self, parts: np.ndarray, cells: list[np.ndarray], ranges: int):
        self.ranges = ranges
        self.size, self.base = np.zeros(ranges, np.uint64), np.zeros(ranges, np.int64)
        n = np.array([len(x) for x in cells], np.int64)
        self.size[parts], self.base[parts] = n, np.cumsum(n) - n
        self.cells = np.concatenate(cells) if cells else np.zeros(0, np.uint64)

    def levels(self, entries: np.ndarray, part: np.ndarray) -> np.ndarray:
        """For each entry, how many levels from the first on find all their bits."""
        out, live, level = np.zeros(len(entries), np.int64), np.flatnonzero(self.size[part] > 0), 1
        while len(live):
            at, mask = places(entries[live], level)
            cell = self.cells[self.base[part[live]] + (at % self.size[part[live]]).astype(np.int64)]
            live = live[(cell & mask) == mask]
            out[live] = level
            level += 1
        return out


class Slice:
    """A slice's tokens, its distinct words and pairs, and where each token has them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.n = len(offs) - 1
        self.row, own, before = tokens(data, offs)
        self.words, self.word = np.unique(own, return_inverse=True)
        self.pairs, self.pair = np.unique(pair_hash(before, own), return_inverse=True)
        self.first = before == START

    def entries(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The filter's entries of all words, then all pairs, and their ranges."""
        return np.concatenate([word_entry(self.words), self.pairs]), np.concatenate([range_of(_WORD, self.words, ranges), range_of(_PAIR, self.pairs, ranges)])


def log_probabilities(level: np.ndarray, words: int, word: np.ndarray, pair: np.ndarray, first: np.ndarray, starts: int, unit: float) -> np.ndarray:
    """Of each token, from the levels of a slice's words and pairs; ``starts`` texts were counted."""
    low, high, seen = smallest(level[:words]), largest(level[:words]), smallest(level[words:])[pair]
    before = np.concatenate([[0], word[:-1]]).astype(np.int64)
    begin = levels(np.array([max(starts, 1)])).astype(np.int64) * (starts > 0)
    mass = np.where(first, K * max(smallest(begin)[0], 1.0) ** H, K * np.maximum(low, 1)[before] ** H)
    return np.log10(seen + mass * (low[word] + ALPHA) / unit) - np.log10(np.where(first, largest(begin)[0], high[before]) + mass)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ``wanted``, -1 where it has none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


_SCORED = "doc long, doc_id long, n_tokens long, n_known long, base_score double, score double, word long, times long"


def _score(shared):
    """A row for each text, and one for each of its words whose count isn't broadcast; without a filter the score is 0."""

    def run(batches):
        filter_, head, head_n, starts, unit = shared.value
        names = [c.split()[0] for c in _SCORED.split(", ")]
        for batch in batches:
            data, offs = raw_texts(batch.column(2))
            for lo, hi in slices(offs):
                s = Slice(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                c = _lookup(head, head_n, s.words)
                held = (c >= 0)[s.word]
                base = np.bincount(s.row[held], np.log10((c[s.word[held]] + ALPHA) / unit), s.n).astype(float)  # of no words, whole numbers
                score = np.zeros(s.n)
                if filter_ is not None:
                    level = filter_.levels(*s.entries(filter_.ranges))
                    score = np.bincount(s.row, log_probabilities(level, len(s.words), s.word, s.pair, s.first, starts, unit), s.n)
                none = pa.nulls(s.n, pa.int64())
                cols = [batch.column(0).slice(lo, s.n), batch.column(1).slice(lo, s.n), *(pa.array(x) for x in (np.bincount(s.row, minlength=s.n), np.bincount(s.row[held], minlength=s.n), base, score)), none, none]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                rare, times = np.unique(s.row[~held] * len(s.words) + s.word[~held], return_counts=True)
                at = np.asarray(batch.column(0))[lo + rare // len(s.words)]
                blank = [pa.nulls(len(rare), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(at), *blank, pa.array(s.words[rare % len(s.words)].view(np.int64)), pa.array(times)], names=names)

    return run


_ASKED = "chunk long, part long, entries binary, places binary, docs binary, rows binary, word binary, pair binary, first binary, words long"


def _ask(ranges: int):
    """For each slice, a row with its tokens, and one with the entries that it sends to each range."""

    def run(batches):
        names = [c.split()[0] for c in _ASKED.split(", ")]
        for batch in batches:
            data, offs = raw_texts(batch.column(1))
            doc = np.asarray(batch.column(0))
            for lo, hi in slices(offs):
                s = Slice(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                chunk = int(doc[lo])
                own = [doc[lo:hi], *(x.astype(np.uint32) for x in (s.row, s.word, s.pair)), s.first]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary())), *(pa.array([x.tobytes()], pa.binary()) for x in own), pa.array([len(s.words)])], names=names)
                entries, part = s.entries(ranges)
                order = np.argsort(part, kind="stable")
                parts, cuts = np.unique(part[order], return_index=True)
                cuts = np.append(cuts, len(order))
                cols = [pa.array([x[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in (entries, np.arange(len(entries), dtype=np.uint32))]
                m = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(parts), *cols, *(pa.nulls(m, pa.binary()) for _ in range(5)), pa.nulls(m, pa.int64())], names=names)

    return run


def _answer(ranges: int):
    """The levels of what the slices have sent to a range."""

    def run(key, asked, model):
        part = key[0].as_py()
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in model["cells"]]
        own = Filter(np.full(len(cells), part), cells, ranges)
        out = []
        for x in asked["entries"]:
            entries = np.frombuffer(x.as_buffer(), np.uint64)
            out.append(own.levels(entries, np.full(len(entries), part)).astype(np.uint8).tobytes())
        return pa.table({"chunk": asked["chunk"], "places": asked["places"], "level": pa.array(out, pa.binary())})

    return run


def _settle(starts: int, unit: float):
    """(doc, score) of a slice, from its tokens and all levels that came back."""

    def run(key, held, answers):
        level = np.zeros(sum(len(x.as_py()) for x in answers["level"]), np.int64)
        for places_, found in zip(answers["places"], answers["level"]):
            level[np.frombuffer(places_.as_buffer(), np.uint32)] = np.frombuffer(found.as_buffer(), np.uint8)
        docs, row, word, pair, first = (np.frombuffer(held[c][0].as_buffer(), t) for c, t in (("docs", np.int64), ("rows", np.uint32), ("word", np.uint32), ("pair", np.uint32), ("first", bool)))
        score = np.bincount(row, log_probabilities(level, held["words"][0].as_py(), word, pair, first, starts, unit), len(docs))
        return pa.table({"doc": pa.array(docs), "score": pa.array(score)})

    return run


def score(docs: DataFrame, model: DataFrame, ranges: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    docs = scanned(docs)
    spark = docs.sparkSession
    total, types, size = (x or 0 for x in model.agg(F.sum("total"), F.sum("types"), F.sum(F.octet_length("cells"))).first())
    unit = total + ALPHA * (types + 1)
    least = max(1, -(-total // HEAD_WORDS))
    often = model.select("words", "counts").mapInArrow(_word_rows(least, total), "word long, n long").toArrow()  # HEAD_WORDS rows and one at most
    head, head_n = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(head)
    head, head_n = head[order], head_n[order]
    starts = max(0, int(_lookup(head, head_n, np.array([END]))[0]))
    filter_ = None
    if size <= FILTER_BYTES:
        own = model.select("part", "cells").toArrow()
        filter_ = Filter(own["part"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in own["cells"]], ranges)
    shared = spark.sparkContext.broadcast((filter_, head, head_n, starts, unit))
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = stored(rows.mapInArrow(_score(shared), _SCORED), "scored")
    shared.destroy()
    counts = model.select("words", "counts").mapInArrow(_word_rows(0, least - 1), "word long, n long")
    rare = scored.where("word is not null").select("doc", "word", "times").join(counts, "word", "left")
    exact = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("doc").agg(F.sum(F.col("times") * F.log10((exact + ALPHA) / unit)).alias("more"), F.sum(F.when(exact > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.where("word is null").drop("word", "times").join(rare, "doc", "left")
    if filter_ is None:
        asked = stored(rows.select("doc", "text").mapInArrow(_ask(ranges), _ASKED), "asked")
        sent = asked.where("part is not null").select("chunk", "part", "entries", "places")
        answers = sent.groupBy("part").cogroup(model.select("part", "cells").groupBy("part")).applyInArrow(_answer(ranges), "chunk long, places binary, level binary")
        held = asked.where("part is null").select("chunk", "docs", "rows", "word", "pair", "first", "words")
        settled = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_settle(starts, unit), "doc long, score double")
        out = out.drop("score").join(settled, "doc")
    both = (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), both, "score")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, ranges = train(docs.where(~held_out(F.col("doc_id"))))
    out = score(docs, model, ranges)
    gain = (F.col("score") - F.col("base_score")) / F.col("n_tokens")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", gain.alias("gain"))
