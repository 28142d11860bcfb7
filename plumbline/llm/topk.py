"""Exact inner-product search by block-at-a-time pruning.

Vectors become integers, floor(scale * x).  The index is a table of document-range blocks: rows are dealt by ranges of
their ids and cut into blocks of ``BLOCK_ROWS`` in the order of the ids, ``PART_BLOCKS`` of them to a part.  A block
has its vectors (the forward index) and the largest and smallest weight of every term (dimension).
A query's bound on a block is the sum over its terms of weight times that maximum (minimum, for
negative weights).  Each query takes the blocks of a part by falling bound, scores whole blocks through the
forward index, and ends at the first bound below its k-th best score.  Blocks whose bound equals
the k-th score are scored, as a tie may go to a smaller id.

A task has one part of the index and one chunk of at most ``QUERY_CHUNK`` queries, which meet by a keyed join of
stored tables: nothing passes through the driver.  Every task returns at most k rows a query.

Rows: vectors that are null, or hold null or non-finite components, and rows with a null id take no
part.  Vectors of unequal lengths are compared as if the shorter had zeros at its end; an empty
vector scores 0.  Each of several rows with one id is a row of its own, both as query and as
candidate; ties among them are exact ties.  A scaled component beyond 2**62, and a score beyond a long, count as that
bound.  Columns beyond id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SCALE, K, EVERY = 256, 5, 50
BLOCK_ROWS, PART_BLOCKS = 512, 256
QUERY_CHUNK = 16_384
_EXACT, _MOST = 2.0**53, 1 << 62
_BLOCK = "part long, dim int, width int, ids binary, uids binary, weights binary, top binary, low binary"
_QUERY = "uid long, id long, dim int, width int, weights binary"
_TYPES = {2: np.int16, 4: np.int32, 8: np.int64}


def _integers(batch: pa.RecordBatch, scale: int):
    """(ids, row numbers, integer matrix) of the usable vectors, one item for each length."""
    ids, vecs = batch.column(0), batch.column(1)
    if not len(batch):
        return
    lens = np.asarray(vecs.value_lengths().fill_null(-1))
    flat = np.asarray(vecs.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(np.maximum(lens, 0))
    usable = (lens >= 0) & np.asarray(ids.is_valid())
    whole = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable &= whole[ends] == whole[ends - np.maximum(lens, 0)]
    own = np.asarray(ids.fill_null(0), dtype=np.int64)
    for dim in np.unique(lens[usable]):
        rows = np.flatnonzero(usable & (lens == dim))
        x = np.floor(flat[(ends[rows] - dim)[:, None] + np.arange(dim)] * scale)
        yield own[rows], rows, np.clip(x, -float(_MOST), float(_MOST)).astype(np.int64)


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    """The weights in the narrowest type that holds them."""
    most = int(np.abs(m).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, m.astype(_TYPES[width]).tobytes()


def _read(weights: bytes, width: int, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(weights, _TYPES[width]).astype(np.int64).reshape(n, dim)


def _blocks(scale: int):
    """Blocks of a partition whose rows stand by id."""

    def build(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim: int):
            ids, uids, m = (np.concatenate(c) for c in zip(*held.pop(dim)))
            for lo in range(0, len(ids), BLOCK_ROWS):
                at = slice(lo, lo + BLOCK_ROWS)
                own = m[at]
                width, weights = _packed(own)
                row = (part, dim, width, ids[at].tobytes(), uids[at].tobytes(), weights, own.max(0).tobytes(), own.min(0).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5))], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for ids, rows, x in _integers(batch, scale):
                dim = x.shape[1]
                held.setdefault(dim, []).append((ids, (np.int64(part) << 40) + seen + rows, x))
                if sum(len(c[0]) for c in held[dim]) >= 8 * BLOCK_ROWS:
                    yield from block(dim)
            seen += len(batch)
        for dim in sorted(held):
            yield from block(dim)

    return build


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """The stored block index of ``vectors``, one row for each block, and the number of its parts."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (BLOCK_ROWS * PART_BLOCKS)))
    dealt = rows.repartitionByRange(parts, "id", F.xxhash64("x")).sortWithinPartitions("id")
    index = stored(dealt.mapInArrow(_blocks(scale), _BLOCK), "blocks")
    return index, (index.agg(F.max("part")).first()[0] or 0) + 1


def _every(step: int):
    def take(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                ids, uids = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["uids"], np.int64)
                m = _read(b["weights"], b["width"], b["dim"], len(ids))
                out += [(int(uids[i]), int(ids[i]), b["dim"], *_packed(m[i])) for i in np.flatnonzero(ids % step == 0)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=[f.split()[0] for f in _QUERY.split(", ")])

    return take


class _Best:
    """The k best (score, id) so far of each of n queries."""

    def __init__(self, n: int, k: int):
        self.score = np.zeros((n, k), np.int64)
        self.id = np.zeros((n, k), np.int64)
        self.count = np.zeros(n, np.int64)

    def kth(self) -> np.ndarray:
        """Bounds below this end a query."""
        return np.where(self.count == self.score.shape[1], self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        k = self.score.shape[1]
        held = np.arange(k) < self.count[rows][:, None]
        s, i, v = np.hstack([self.score[rows], scores]), np.hstack([self.id[rows], ids]), np.hstack([held, valid])
        order = np.lexsort((i, -s, ~v), axis=-1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.count[rows] = np.minimum(k, v.sum(1))


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where every sum is below 2**53."""
    d = min(q.shape[1], m.shape[1])
    q, m = q[:, :d], m[:, :d]
    if not d:
        return np.zeros((len(q), len(m)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(m).max()) * d < _EXACT:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    exact = np.asarray(q.astype(object) @ m.astype(object).T, object).reshape(len(q), len(m))
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _search(k: int):
    """The k best rows of a part of the index for each query of a chunk."""

    def run(key, index, asked):
        blocks = index.drop_columns(["chunk"]).to_pylist()
        for b in blocks:
            n = len(b["ids"]) // 8
            b["ids"], b["uids"] = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["uids"], np.int64)
            b["weights"] = _read(b["weights"], b["width"], b["dim"], n)
            b["top"], b["low"] = np.frombuffer(b["top"], np.int64), np.frombuffer(b["low"], np.int64)
        dims, widths, uid, id_ = (asked[c].to_numpy() for c in ("dim", "width", "uid", "id"))
        out = [(np.zeros(0, np.int64),) * 4]
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            w = np.stack([_read(asked["weights"][int(i)].as_py(), int(widths[i]), int(d), 1)[0] for i in at])
            state = _Best(len(at), k)
            _score_blocks(w, uid[at], blocks, state, k)
            row, rank = np.nonzero(np.arange(k) < state.count[:, None])
            out.append((uid[at][row], id_[at][row], state.id[row, rank], state.score[row, rank]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_uid", "query_id", "vec_id", "score"])

    return run


def _score_blocks(w: np.ndarray, uid: np.ndarray, blocks: list[dict], state: _Best, k: int) -> None:
    """Each query's blocks by falling bound, up to the first bound below its k-th score."""
    up, down = np.maximum(w, 0).astype(np.float64), np.minimum(w, 0).astype(np.float64)
    bound = np.empty((len(w), len(blocks)))
    for j, b in enumerate(blocks):
        x = min(w.shape[1], b["dim"])
        bound[:, j] = up[:, :x] @ b["top"][:x] + down[:, :x] @ b["low"][:x]
    bound += 1e-9 * np.abs(bound) * (np.abs(bound) >= _EXACT)
    order = np.argsort(-bound, 1, kind="stable")
    live = np.arange(len(w))
    for turn in range(len(blocks)):
        at = order[live, turn]
        going = bound[live, at] >= state.kth()[live]
        live, at = live[going], at[going]
        if not len(live):
            break
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by])) + 1
        for rows in np.split(by, cuts):
            b, who = blocks[at[rows[0]]], live[rows]
            s = _products(w[who], b["weights"])
            own = b["uids"][None, :] == uid[who][:, None]
            # Rows of a block stand by id: a stable sort by score gives ties to the smaller id.
            first = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -s, own), axis=-1)[:, :k] if s.shape[1] <= 2 * k else _leading(s, own, k)
            state.add(who, np.take_along_axis(s, first, 1), b["ids"][first], ~np.take_along_axis(own, first, 1))


def _leading(s: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller column, the row's own left out last."""
    least = np.int64(np.iinfo(np.int64).min)
    masked = np.where(own, least, s)
    cut = np.partition(masked, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
    above = masked > cut
    # Of the columns equal to the cut, the first ones fill what is left of the k places.
    ties = masked == cut
    ties &= np.cumsum(ties, 1) <= k - above.sum(1)[:, None]
    cols = np.nonzero(above | ties)[1].reshape(len(s), k)
    return cols


def search(index: DataFrame, parts: int, queries: DataFrame, k: int = K, chunk: int = QUERY_CHUNK) -> DataFrame:
    """The k best rows of the index for every row of ``queries`` (uid, id, dim, width, weights), which is stored."""
    chunks = max(1, -(-queries.count() // chunk))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks).cast("long"))).withColumn("part", each(parts))
    met = index.withColumn("chunk", each(chunks)).groupBy("chunk", "part").cogroup(asked.groupBy("chunk", "part"))
    found = met.applyInArrow(_search(k), "query_uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, parts = build_index(table(spark, sf_dir, "embeddings"))
    queries = stored(index.select("dim", "width", "ids", "uids", "weights").mapInArrow(_every(EVERY), _QUERY), "queries")
    return search(index, parts, queries)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.uid <> v.uid WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
