import hashlib
import random

import numpy as np
import pyarrow as pa

from plumbline.llm import suffixes


def brute(rows):
    """(n_bytes, n_removed, n_spans, digest) of each (id, row number, text), ids in order, nulls last."""
    seen, out = set(), {}
    for doc_id, row, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        b = (text or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                edge[k] += 1
                edge[k + 100] -= 1
            seen.add(w)
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[row] = len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


def test_against_brute_force(spark, docs):
    from pyspark.sql import functions as F

    rows = [(r["doc_id"], r["k"], r["text"]) for r in docs.select("doc_id", "text", F.monotonically_increasing_id().alias("k")).collect()]
    want = brute(rows)
    for r in suffixes.remove_repeats(docs).collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        digest = r["sha256"] if r["kept"] is None else hashlib.sha256(bytes(r["kept"])).hexdigest()
        assert (r["n_bytes"], sum(b - a for a, b in spans), len(spans), digest) == want[r["row"]], r["doc_id"]


def test_periodic_and_many_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffixes, "SORT_BYTES", 3000)
    rng = random.Random(4)
    unit = "".join(rng.choice("abcd") for _ in range(37))
    rows = [(i, unit * rng.randrange(1, 12) + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 150)))) for i in range(30)] + [(99, "ab" * 300), (98, "ab" * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = brute([(d, d, t) for d, t in rows])
    for r in suffixes.remove_repeats(docs).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == want[r["doc_id"]][1], r["doc_id"]


def test_hot_anchors_and_windows(spark, tmp_path, monkeypatch):
    """A passage with many surroundings is split, and texts are cut into windows, without another result."""
    monkeypatch.setattr(suffixes, "KINDS", 4)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 150)
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, line = say(180), say(70)
    ends = [say(30) for _ in range(5)]
    rows = [(i, say(rng.randrange(0, 40)) + rng.choice(ends) + (passage if i % 2 else line) + rng.choice(ends) + say(rng.randrange(0, 60))) for i in range(60)]
    spark.createDataFrame([*rows, (None, passage), (7, passage * 3), (200, None), (201, "")], "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    from pyspark.sql import functions as F

    want = brute([(r["doc_id"], r["k"], r["text"]) for r in docs.select("doc_id", "text", F.monotonically_increasing_id().alias("k")).collect()])
    for r in suffixes.remove_repeats(docs).collect():
        digest = r["sha256"] if r["kept"] is None else hashlib.sha256(bytes(r["kept"])).hexdigest()
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), digest) == want[r["row"]], r["doc_id"]


def test_ranges_are_even():
    """No range of anchors, whose task sorts them in memory, has much more than its share."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(range(200), pa.int64()), pa.array(texts)], names=["row", "doc_id", "text"])
    held = np.zeros(64, int)
    for out in suffixes._anchor_counts(64)([batch]):
        for part, h in zip(out["part"].to_pylist(), out["anchors"].to_pylist()):
            held[part] += len(h) // 8
    assert held.max() < 2 * held.mean()


def test_column_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [b"", b"aaaa", b"aaaa"]
    who, offset, prefix = suffixes.column_sort(strings)
    found = [strings[w][o:] for w, o in zip(who, offset)]
    assert found == sorted(s[i:] for s in strings for i in range(len(s) + 1))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [int(p) for p in prefix[1:]] == [common(a, b) for a, b in zip(found, found[1:])]


def test_empty(empty):
    assert suffixes.remove_repeats(empty).count() == 0
