import zlib
from collections import Counter
from math import log10

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import lm


def counted(rows, held):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    return c


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def scored(docs, **kw):
    model, ranges = lm.train(docs.where(~lm.held_out(F.col("doc_id"))), **kw)
    return lm.score(docs, model, ranges).collect()


def check_base(docs, got):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = counted(rows, held)
    n, unit = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    want = []
    for i, t in rows:
        own = [*(t or "").encode().lower().split(), None]
        want.append((str(i), len(own), sum(w in c for w in own), n, round(sum(log10((c[w] + 0.1) / unit) for w in own), 6)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)


def exact_scores(rows, least=2):
    """Scores from counts in dictionaries, quantised as the filter's levels are."""
    one, two, texts = Counter(), Counter(), 0
    split = lambda t: [*(t or "").encode().lower().split(), "end"]
    for i, t in rows:
        if not held(i):
            own = split(t)
            one.update(own)
            two.update(zip(["start", *own], own))
            texts += 1
    one["start"] = texts
    unit = sum(one.values()) - texts + 0.1 * (len(one) - 1 + 1)
    low = lambda n: float(lm.smallest(lm.levels(np.array([n])))[0]) if n else 0.0
    high = lambda n: float(lm.largest(lm.levels(np.array([n])))[0]) if n else 0.0

    def p(w, v):
        mass = lm.K * max(low(one[v]), 1.0) ** lm.H
        seen = low(two[v, w]) if two[v, w] >= least else 0.0
        return (seen + mass * (low(one[w]) + 0.1) / unit) / (high(one[v]) + mass)

    vocabulary = [w for w in one if w != "start"]
    for v in [*list(one)[:40], "never seen"]:
        assert sum(p(w, v) for w in [*vocabulary, "never seen"]) <= 1 + 1e-12
    return sorted((str(i), round(sum(log10(p(w, v)) for v, w in zip(["start", *split(t)], split(t))), 6)) for i, t in rows)


def test_against_exact_counts_in_both_ways(docs, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 200)  # no false hits
    want = exact_scores([(r["doc_id"], r["text"]) for r in docs.collect()])
    for limit, head in ((lm.FILTER_BYTES, lm.HEAD_WORDS), (0, 50)):
        monkeypatch.setattr(lm, "FILTER_BYTES", limit)
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        got = scored(docs)
        check_base(docs, got)
        assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == want


def test_model_is_better_than_base(docs):
    got = scored(docs)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert all(r["score"] < 0 for r in got)


def test_filter_never_forgets():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    n = rng.integers(1, 400, len(h))
    level = lm.levels(n)
    assert (lm.smallest(level) <= n).all() and (lm.largest(level) >= n).all()


def test_empty_training(spark, tmp_path):
    i = next(i for i in range(99) if held(i))
    spark.createDataFrame([(i, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    r = scored(spark.read.parquet(str(tmp_path / "d")))[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_empty(empty):
    assert scored(empty) == []
