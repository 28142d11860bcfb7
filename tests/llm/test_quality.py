import random
import zlib

from plumbline.llm import quality


def corpus(n=400):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in own) if bad and i % 2 else " ".join([own[0]] * 30) if bad else " ".join(own), "en", 0.1, 3))
        labels.append((i, int(not bad), 0))
    return docs, labels


def scored(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, label int")
    return quality.classify(d, quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    out = scored(spark, docs, labels)
    assert out.columns == ["doc_id", "text", "lang", "label", "score", "predicted"]
    want = dict((i, q) for i, q, _ in labels)
    held = [r for r in out.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 60 and sum(r["predicted"] == want[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in held)


def test_probabilities_are_calibrated():
    """Where text decides a label only to a degree, scores are its share, not that of labels counted alike."""
    rng = quality.np.random.default_rng(3)
    x = rng.normal(size=(6000, 4))
    p = 1 / (1 + quality.np.exp(-(1.5 * x[:, 0] + 2.0)))
    y = (rng.random(6000) < p).astype(float)
    network = quality.Network(0.5).fit(x[:4000], y[:4000])
    score, y = network.score(x[4000:]), y[4000:]
    at = quality.np.minimum((score * 10).astype(int), 9)
    off = sum(abs(score[at == i].mean() - y[at == i].mean()) * (at == i).mean() for i in range(10) if (at == i).any())
    assert off < 0.05 and abs(score.mean() - y.mean()) < 0.03


def test_odd_rows(spark):
    docs, labels = corpus(60)
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (None, "w1 w2", None, None, None), (1002, "w1 " * 30000, None, None, None), docs[0], (1003, "\x00 é漢 \t", None, None, None)]
    out = scored(spark, docs + odd, labels + [(3, None, 0), (None, 1, 0), labels[4], (99999, 1, 0)]).collect()
    assert len(out) == 66 and all(0 <= r["score"] <= 1 for r in out)


def test_no_labels_and_one_kind(spark):
    docs, labels = corpus(20)
    assert {r["score"] for r in scored(spark, docs, []).collect()} == {0.5}
    assert len({r["score"] for r in scored(spark, docs, [(i, 1, 0) for i, _, _ in labels]).collect()}) == 1


def test_empty(spark):
    assert scored(spark, [], [(1, 1, 0)]).count() == 0
