"""Packing of tokenised documents into sequences.

Documents are dealt into randomised groups of about ``GROUP_DOCS``; every group is packed alone.
A document longer than a sequence first gives full sequences; what remains is placed by first-fit
decreasing, where a tournament tree over the bins' free capacities finds the first bin that fits
in logarithmic time.  Then pieces of the emptiest bin are cut to fill the gaps of the others while
they have room for all of it, and the last such bin is written as sequences of power-of-two length,
which need no padding.

Rows: a null text is an empty one and gives the end token alone.  Repeated rows and null ids are
documents of their own.  Ties in length go by the row's random key.  An empty table gives no rows.
Columns beyond id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textscan import raw_texts, slices, words_of

TOKENIZER = "word_bpe_49k.json"
SEQUENCE, END_ID, GROUP_DOCS = 4096, 2, 2048
CACHE_WORDS = 500_000
_SIGNS = b".,;:!?*&%$#|\"()"
#: Words that the tokenizer leaves whole: letters that keep their number in lower case and NFC, or plain signs.
_PLAIN = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01ff]+|[{re.escape(_SIGNS.decode())}]+")
_END = "</w>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _among(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_IS_SIGN, _IS_LETTER, _IS_LEAD = _among(_SIGNS), _among(bytes([*range(65, 91), *range(97, 123)])), _among(bytes(range(0xC3, 0xC8)))


def sign_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Marks the bytes where a plain letter follows a plain sign or a sign a letter, inside of a text's words.

    The tokenizer always splits there (an apostrophe, which may begin a word's ending, is no plain sign),
    and normalises either side alone.  Letters are ASCII's and those of two bytes from U+00C0 to U+01FF
    but U+0130, whose lower case is two signs.
    """
    sign, begins = _IS_SIGN[data], _IS_LETTER[data]
    ends = begins.copy()
    lead = np.flatnonzero(_IS_LEAD[data[:-1]] & (data[1:] >> 6 == 2))
    lead = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], (0xC397, 0xC3B7, 0xC4B0))]
    lead = lead[~np.isin(lead + 1, offs)]
    begins[lead] = ends[lead + 1] = True
    out = np.zeros(len(data), bool)
    out[1:] = (sign[1:] & ends[:-1]) | (sign[:-1] & begins[1:])
    out[offs[offs < len(data)]] = False
    return out


class WordIds:
    """The tokenizer's ids, remembered by word in sorted arrays.

    It normalises (white space, NFC, lower case) and splits within runs that hold no white space, and
    where plain letters meet plain signs, so a text's ids are those of such words in turn.  Words are
    told apart by 64-bit hashes; only words not met before are handed to the tokenizer, plain ones many
    to a call.  Texts with "<|", which may begin a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        vocab = self.encoder.get_vocab()
        self.largest = max(vocab.values(), default=0)
        #: Which ids end a word; None where the tokenizer doesn't mark them.
        self.last = None
        if getattr(self.encoder.model, "end_of_word_suffix", None) == _END:
            self.last = np.zeros(self.largest + 1, bool)
            self.last[[i for w, i in vocab.items() if w.endswith(_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin in them, their number).  Plain words are joined by spaces; the ids
        that end a word say whose each id is."""
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        if self.last is None:
            plain[:] = False
        n, at, found, used = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        own = np.flatnonzero(plain)
        groups = [own[lo : lo + 2000] for lo in range(0, len(own), 2000)]
        for g, e in zip(groups, self.encoder.encode_batch_fast([" ".join([words[i] for i in g.tolist()]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(g):  # not as foreseen: each word alone
                plain[g] = False
                continue
            n[g], at[g] = np.diff(ends, prepend=0), used + np.concatenate([[0], ends[:-1]])
            found.append(ids)
            used += len(ids)
        odd = np.flatnonzero(~plain)
        for i, e in zip(odd.tolist(), self.encoder.encode_batch_fast([words[i] for i in odd.tolist()], add_special_tokens=False)):
            n[i], at[i] = len(e.ids), used
            found.append(np.array(e.ids, np.uint32))
            used += len(e.ids)
        return np.concatenate([np.zeros(0, np.uint32), *found]), at, n

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        flat, at, n = self.encode(words)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at += self.used
        self.used += len(flat)
        where = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.n = np.insert(self.hash, where, hashes), np.insert(self.at, where, at), np.insert(self.n, where, n)

    def ids(self, data: np.ndarray, offs: np.ndarray, end: int) -> list[np.ndarray]:
        """Ids of each text of ``data`` (bytes), with the end id."""
        start, length, h = words_of(data, offs, cut=sign_cuts(data, offs))
        row = np.searchsorted(offs[1:], start, "right")
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        pos = np.searchsorted(self.hash, uniq)
        new = np.ones(len(uniq), bool)
        if len(self.hash):
            new = self.hash[np.minimum(pos, len(self.hash) - 1)] != uniq
        if new.any():
            at = first[new]
            ends = np.cumsum(length[at] + 1)
            joined = np.full(ends[-1], 0x20, np.uint8)
            inside = np.ones(ends[-1], bool)
            inside[ends - 1] = False
            joined[inside] = data[np.repeat(start[at] - np.cumsum(length[at]) + length[at], length[at]) + np.arange(int(length[at].sum()))]
            self.learn(uniq[new], joined[:-1].tobytes().decode("utf-8", "replace").split(" "))
            pos = np.searchsorted(self.hash, uniq)
        n, at = self.n[pos][back], self.at[pos][back]
        ends = np.cumsum(n)
        flat = self.pool[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, n, len(offs) - 1).astype(np.int64))])
        tail = np.array([end], np.uint32)
        out = [np.concatenate([flat[a:b], tail]) for a, b in zip(cuts[:-1], cuts[1:])]
        if (mark := np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))).size:
            for i in np.unique(np.searchsorted(offs[1:], mark, "right")):
                text = data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
                out[i] = np.array([*self.encoder.encode(text, add_special_tokens=False).ids, end], np.uint32)
        return out


_ENCODERS: dict[str, WordIds] = {}


def _encode(path: str, end_id: int):
    def run(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordIds(path))
        kind = np.uint16 if max(encoder.largest, end_id) < 1 << 16 else np.uint32
        for batch in batches:
            data, offs = raw_texts(batch.column(2))
            for lo, hi in slices(offs):
                ids = encoder.ids(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], end_id)
                width = pa.array(np.full(hi - lo, np.dtype(kind).itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (0, 1, 3)), width, pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["grp", "row", "doc_id", "width", "ids"])

    return run


class Tournament:
    """Free capacities of bins in a tree whose inner nodes hold the larger child; bins open in order."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """Takes ``size`` from the first bin with as much room; that bin."""
        tree, node = self.tree, 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        bin_ = node - self.width
        tree[node] -= size
        node >>= 1
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
        return bin_


def pack(lengths: list[int], capacity: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token of each document once.

    Full bins apart, no sequence is longer than ``capacity``; with ``lengths`` in any order, documents
    are taken by falling remainder, ties in the order given.
    """
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        full += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda x: -x[0])
    tree = Tournament(len(rest), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for n, d, start in rest:
        at = tree.place(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, start, n))
    held = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    room = [capacity - sum(p[2] for p in b) for b in held]
    while held and 0 < room[-1]:
        left, gaps = capacity - room[-1], sum(room[:-1])
        poured = held.pop()
        room.pop()
        pieces = sorted(poured, key=lambda p: -p[2])
        for i, gap in enumerate(room):  # the fullest bins first, with the largest piece that ends a gap or the last one cut
            while gap and pieces:
                d, start, n = pieces.pop(next((j for j, p in enumerate(pieces) if p[2] <= gap), len(pieces) - 1))
                take = min(n, gap)
                held[i].append((d, start, take))
                gap -= take
                if take < n:
                    pieces.append((d, start + take, n - take))
            room[i] = gap
        if left >= gaps:  # all others are full: the rest becomes powers of two
            held += _powers(pieces)
            break
    return full + held


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are the powers of two in their sum."""
    out, total, todo = [], sum(p[2] for p in pieces), list(pieces)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        own, need = [], 1 << bit
        while need:
            d, start, n = todo.pop(0)
            take = min(n, need)
            own.append((d, start, take))
            need -= take
            if take < n:
                todo.insert(0, (d, start + take, n - take))
        out.append(own)
    return out


def _pack_group(capacity: int):
    def run(key, group):
        kind = np.uint16 if group["width"][0].as_py() == 2 else np.uint32
        order = np.argsort(group["row"].to_numpy(), kind="stable")
        ids = [np.frombuffer(group["ids"][int(i)].as_buffer(), kind) for i in order]
        docs = group["doc_id"].take(pa.array(order))
        base = key[0].as_py() << 32
        who, rows = [], []
        for seq, pieces in enumerate(pack([len(x) for x in ids], capacity)):
            offset = 0
            for d, start, n in pieces:
                who.append(d)
                rows.append((start, n, zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()), len(ids[d]), base + seq, offset))
                offset += n
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
        return pa.Table.from_arrays([docs.take(pa.array(who, pa.int64())), *cols], names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """One row for each piece of each document: its place in the document and in a sequence.

    Groups are dealt by a hash of the row's number, not of its id, so repeated ids don't meet in one
    group.  Ids travel as 16 bits where the tokenizer's largest id and the end id allow.
    """
    path = tokenizer or tokenizer_path()
    groups = max(1, -(-docs.count() // group_docs))
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row")).select(F.pmod("row", F.lit(groups)).alias("grp"), "row", "text", "doc_id")
    ids = rows.mapInArrow(_encode(path, end_id), "grp long, row long, doc_id long, width int, ids binary")
    return ids.groupBy("grp").applyInArrow(_pack_group(capacity), _PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
