import random
import re

from pyspark.sql import functions as F

from plumbline.llm import decontaminate as d


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for doc, t in rows:
        w, hit, met = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[own]
        out.append((doc, len(w), len(hit), sorted(map(str, met))))
    return sorted(out, key=str)


BENCH = [
    (1, "the cat sat on the mat and the dog ran off"), (2, "The  CAT sat-on the mat, and the dog ran"), (3, "tiny item"), (11, "tiny item"), (4, None), (5, "... !!"),
    (6, "ünï ça va"), (None, "nobody has this id at all"), (7, "a a a a a a a a a a a a"), (8, "one"),
]
DOCS = [
    (1, "x the cat sat on the mat and the dog ran off y"), (2, "the cat sat on the mat and the dog"), (3, "a tiny, item and a tiny item"), (4, None), (5, ""), (6, "ÜNÏ ünï ÇA ça VA va"),
    (7, "ünï ça va"), (8, "a " * 15), (8, "a " * 15), (9, "tiny\x00item one two one"), (10, "The cat sat on the mat and the dog ran. " * 40), (None, "tiny item"), (11, "b " * 3000 + "tiny item"),
]


def run(spark, rows, items, **kw):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, term int, word string")
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, n int")
    out = d.decontaminate(docs, bench, **kw).collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in out)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out), key=str)


def test_against_brute_force(spark):
    assert run(spark, DOCS, BENCH) == brute(DOCS, BENCH)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert run(spark, DOCS, BENCH, size=4) == brute(DOCS, BENCH, 4)


def test_empty_sides(spark):
    assert run(spark, [], BENCH) == []
    assert run(spark, DOCS[:3], []) == brute(DOCS[:3], [])


def places(text, window, span):
    """The minimal places of all different words of a window, less than ``span`` from first to last."""
    w, terms, found = words(text), set(window), []
    for last in range(len(w)):
        firsts = [first for first in range(max(0, last - span + 1), last + 1) if terms <= set(w[first : last + 1])]
        if firsts and w[last] in terms and not terms <= set(w[max(firsts) : last]):
            found.append((max(firsts), last))
    return {(a, b) for a, b in found if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in found)}


def test_proximity(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["red", "blue", "green", "x", "x", "x", "y"]) for _ in range(n))
    rows = [(1, "red x x blue x green"), (2, "green blue red"), (3, "red " + "x " * 30 + "blue green"), (4, "red blue"), (5, "blue x x x x red x x x x x blue green"), (6, None), (7, "")]
    rows += [(10 + i, say(rng.randrange(1, 60))) for i in range(40)] + [(99, say(3000))]
    items = [(1, "red blue green"), (2, "red red x"), (3, "y"), (4, "absent red")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests, _ = d.windows(spark.createDataFrame(items, "item_id long, text string"))
    index, terms = d.postings(docs, tests)
    ids = index.where("term = -1").select("row", "doc_id")
    got = d.proximity(index, d.ordered_terms(tests, index, terms), span=8).join(ids, "row").join(tests, "window")
    found = sorted((r["doc_id"], " ".join(r["words"]), r["first"], r["last"]) for r in got.collect())
    assert found == sorted((i, t, a, b) for i, text in rows for _, t in items for a, b in places(text, t.split(), 8))
    assert (5, "red blue green", 5, 12) in found
    near = {r["doc_id"]: r["n_near"] for r in d.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), span=8).collect()}
    assert near == {i: sum(bool(places(text, t.split(), 8)) for _, t in items) for i, text in rows}


def test_no_python_on_the_path(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    plan = d.decontaminate(docs, bench).withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
