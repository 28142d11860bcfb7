import math
import random

from plumbline.llm import topk
from plumbline.llm.common import stored


def run(spark, rows, **kw):
    index, parts = topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    queries = stored(index.select("dim", "width", "ids", "uids", "weights").mapInArrow(topk._every(5), topk._QUERY), "queries")
    return [tuple(r) for r in topk.search(index, parts, queries, k=3, **kw).collect()]


def brute(rows, every=5, k=3):
    own = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e, _) in enumerate(rows) if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, a in own:
        if v % every == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), w) for j, w, b in own if j != i))[:k]
            out += [(v, n + 1, w, -s) for n, (s, w) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = random.Random(3)
    f = lambda: rng.randrange(-64, 64) / 32
    rows = [(i * 7 % 101, [f() for _ in range(6)], 0) for i in range(90)]
    rows += [rows[4], (200, None, 0), (205, [1.0, None], 0), (210, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (215, [], 0), (220, [0.5] * 3, 0)]
    rows += [(300 + i, [1.0] * 6, 0) for i in range(40)]
    assert sorted(run(spark, rows)) == brute(rows)
    assert sorted(run(spark, rows, chunk=4)) == brute(rows)


def test_empty_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == [(0, 1, 1, 65536)]


def test_large_components(spark):
    rows = [(i, [float(2**18 * (i + 1)), float(-(2**19) + i)], 0) for i in range(8)]
    assert sorted(run(spark, rows)) == brute(rows)


def test_beyond_a_long(spark):
    rows = [(0, [1e300, 1.0], 0), (1, [1e300, 2.0], 0), (2, [-1e300, 0.0], 0), (3, [0.0, 1.0], 0)]
    least, most = -(1 << 63), (1 << 63) - 1
    assert sorted(run(spark, rows)) == [(0, 1, 1, most), (0, 2, 3, 65536), (0, 3, 2, least)]


def test_blocks_are_ranges_of_ids(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    index, _ = topk.build_index(spark.createDataFrame([(i * 37 % 211, [float(i % 5)], 0) for i in range(211)], "vec_id long, embedding array<double>, score int"))
    spans = sorted((int(ids.min()), int(ids.max())) for r in index.collect() for ids in [np.frombuffer(r["ids"], np.int64)])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
