"""Quality classifier: random-indexing word vectors, pooled, under a small calibrated network.

* Every feature word falls into one of ``BUCKETS`` hashed buckets and has a fixed sparse random
  index vector.  A bucket's word vector is the sum of the index vectors that stand beside its words
  anywhere in the corpus, so it takes in all documents and no labels, at a size that is set here and
  doesn't grow with the input.
* Feature words are a text's white-space runs as they are written, their shape (capitals, digits,
  signs), and a mark where a run repeats the one before.
* A document is the mean of its words' normalised vectors, damped by how common a bucket is.
* A two-layer numpy network learns the label from at most ``TRAIN_ROWS`` labelled documents that are
  not held out, each counting alike; its temperature is set on a fifth of them that it has not seen, so that
  scores are probabilities at the labels' own share.

Rows: a null text is an empty one, and has the zero vector and so a score like any other.  Rows with
a null id can't be labelled; they are scored, and count as not held out.  Rows repeated in the labels
each count; labels that are null are passed over.  With no labels, or labels of one kind, the score
is the smoothed share of label 1.  Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import every_column, fresh, table
from .textscan import mix, raw_texts, slices, words_of

BUCKETS, DIM, NONZERO = 1 << 14, 32, 4
TRAIN_ROWS, HIDDEN, EPOCHS, SEED = 20_000, 32, 60, 7
FOLDS, HELD = 3, 1
_REPEAT = np.uint64(0x51ED270B)


def _class_table() -> np.ndarray:
    kind = np.full(256, 4, np.uint8)  # signs
    kind[list(range(97, 123))] = 1
    kind[list(range(65, 91))] = 2
    kind[list(range(48, 58))] = 3
    kind[128:] = 1  # beyond ASCII: letters
    return kind


_KINDS = _class_table()


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash, place) of each text's feature words; up to three features share a place."""
    start, length, h = words_of(data, offs, fold=False)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.searchsorted(offs[1:], start, "right")
    kinds = _KINDS[data]
    shape = np.zeros(len(start), np.int64)
    for k in (1, 2, 3, 4):
        seen = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        n = seen[start + length] - seen[start]
        shape = shape * 4 + np.minimum(n, 1) + (n > 1) + (n == length)
    shape = shape * 4 + np.minimum(3, np.log2(length).astype(np.int64))
    place = np.arange(len(start))
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    with np.errstate(over="ignore"):
        shape = mix(shape.astype(np.uint64) + np.uint64(1 << 40))
        mark = np.full(len(again), mix(np.array([_REPEAT]))[0])
    every = np.concatenate([place, place, again])
    order = np.argsort(every, kind="stable")
    return row[every][order], np.concatenate([h, shape, mark])[order], every[order]


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def index_vectors() -> np.ndarray:
    """Sparse vectors of +1 and -1, one for each bucket, from the seed alone."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS)
    return out


def _pair_counts(batches):
    """Sums, over a task's texts, of the index vectors beside each bucket; one row for each bucket seen."""
    index = index_vectors()
    total, count = np.zeros((BUCKETS, DIM), np.float64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offs = raw_texts(batch.column(0))
        for lo, hi in slices(offs):
            row, h, _ = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            if not len(h):
                continue
            b = bucket_of(h)
            count += np.bincount(b, minlength=BUCKETS)
            left = np.concatenate([b[:-1], b[1:]])
            right = np.concatenate([b[1:], b[:-1]])
            same = np.tile(row[1:] == row[:-1], 2)
            pairs, n = np.unique(left[same] * BUCKETS + right[same], return_counts=True)
            own = pairs // BUCKETS
            firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            if len(firsts):
                total[own[firsts]] += np.add.reduceat(index[pairs % BUCKETS] * n[:, None].astype(np.float32), firsts, axis=0)
    seen = np.flatnonzero(count)
    for lo in range(0, len(seen), 4096):
        at = seen[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(count[at]), pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), DIM).cast(pa.list_(pa.float64()))], names=["bucket", "n", "sums"]
        )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The buckets' vectors over all of ``docs``: BUCKETS x DIM floats, whatever the input's size."""
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_pair_counts, "bucket long, n long, sums array<double>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)]
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *sums).toArrow()
    vectors, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy()
    count[at] = rows["n"].to_numpy()
    for i in range(DIM):
        vectors[at, i] = rows[f"s{i}"].to_numpy()
    vectors /= np.maximum(count, 1)[:, None]
    mean = (vectors * count[:, None]).sum(0) / max(1, count.sum())
    vectors = np.where(count[:, None] > 0, vectors - mean, 0)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    damp = 1e-3 / (1e-3 + count / max(1, count.sum()))
    return np.hstack([vectors * damp[:, None], vectors]).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The mean word vector of each text, and the log of its words."""
    row, h, _ = features(data, offs)
    n = len(offs) - 1
    out = np.zeros((n, vectors.shape[1] + 1), np.float64)
    if len(h):
        key, times = np.unique(row * BUCKETS + bucket_of(h), return_counts=True)
        own = key // BUCKETS
        firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[firsts], :-1] = np.add.reduceat(vectors[key % BUCKETS] * times[:, None].astype(np.float32), firsts, axis=0)
    words = np.bincount(row, minlength=n)
    out[:, :-1] /= np.maximum(words, 1)[:, None]
    out[:, -1] = np.log1p(words)
    return out


def _pool(vectors):
    def run(batches):
        for batch in batches:
            data, offs = raw_texts(batch.column(2))
            for lo, hi in slices(offs):
                x = pooled(vectors.value, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "label", "x"])

    return run


class Network:
    """Two layers, trained by Adam on the logistic loss; ``temperature`` divides the logit."""

    def __init__(self, base: float):
        self.base, self.weights, self.temperature = base, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-6
        a = self._norm(x)
        w = [rng.normal(0, (2 / a.shape[1]) ** 0.5, (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.array(0.0)]
        m, v, step = [0 * p for p in w], [0 * p for p in w], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                z = a[at] @ w[0] + w[1]
                hid = np.maximum(z, 0)
                d = (_sigmoid(hid @ w[2] + w[3]) - y[at]) / len(at)
                back = np.outer(d, w[2]) * (z > 0)
                grads = [a[at].T @ back + 1e-4 * w[0], back.sum(0), hid.T @ d + 1e-4 * w[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        if len(held):
            logit = self.logit(x[held])
            loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / t)) for t in _TEMPERATURES]
            self.temperature = float(_TEMPERATURES[int(np.argmin(loss))])
        return self

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(self._norm(x) @ w[0] + w[1], 0) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return _sigmoid(self.logit(x) / self.temperature)


_TEMPERATURES = np.geomspace(0.25, 8, 61)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS == HELD, F.lit(False))


def _score(vectors, network, name: str):
    def run(batches):
        for batch in batches:
            data, offs = raw_texts(batch.column(0))
            for lo, hi in slices(offs):
                own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                score = network.value.score(pooled(vectors.value, *own))
                rest = [batch.column(c).slice(lo, hi - lo) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*batch.schema.names[1:], name])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS):
    """(word vectors, network), both broadcast: sizes are fixed by the parameters above.

    The sample is the ``rows`` labelled rows outside the held-out fold whose hashed ids are smallest.
    """
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, text_col))
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "label").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text")
    got = known.mapInArrow(_pool(vectors), "doc_id long, label int, x binary").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "label", "x").limit(rows).toArrow()
    y = got["label"].to_numpy().astype(np.float64) if got.num_rows else np.zeros(0)
    network = Network((y.sum() + 1) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        network.fit(np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(len(y), -1), y)
    return vectors, sc.broadcast(network)


def classify(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``score`` (0 to 1) and ``predicted`` (1 where the score
    is at least 0.5).  Of the kept columns, those with these two names give way; a caller can choose others."""
    vectors, network = model
    plain = [c for c in keep or docs.columns if c.lower() not in (score.lower(), predicted.lower())]
    text = fresh(docs, "text_read")
    rows = docs.select(F.col(text_col).cast("string").alias(text), *every_column(docs, plain))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(_score(vectors, network, score), schema).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
