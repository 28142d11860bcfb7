import random

from plumbline.llm import jaccard
from plumbline.llm.components import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(sets, num):
    """Index of the smallest-id row that each row reaches; sets: (id, set), ids may be null."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j][1])
            if a and sets[j][1] and 100 * both >= num * (len(a) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((sets[k][0] for k in g if sets[k][0] is not None), default=None) for g in groups.values() for i in g}


def held(docs, n, num):
    rows = docs.collect()
    sets = [(r["doc_id"], shingles(r["text"], n)) for r in rows]
    want = roots(sets, num)
    expected = sorted(((s[0], len(s[1]), want[i]) for i, s in enumerate(sets)), key=str)
    got = jaccard.similar(docs, n=n, num=num)
    found = [tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=str) == expected
    return got


def test_against_brute_force(docs):
    held(docs, 4, 85)


def test_other_parameters(docs):
    got = held(docs, 5, 80)
    kept = got.where("kept").count()
    assert kept == got.where("n_shingles > 0").selectExpr("coalesce(component_id, -1) c").distinct().count() + got.where("n_shingles = 0").count()


def test_many_near_copies_and_blocks(spark, tmp_path, monkeypatch):
    """A long list is cut into blocks; no link between them is lost."""
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    held(spark.read.parquet(str(tmp_path / "d")), 2, 85)


def test_empty(empty):
    assert jaccard.similar(empty).count() == 0


def test_subset_sizes_cover_every_small_pair():
    for s in range(1, 14):
        for t in range(s, 16):
            if 100 * s >= 85 * t:
                c = jaccard.overlap(s, t, 85)
                assert c > s or (c in jaccard.subset_sizes(s, 85) and c in jaccard.subset_sizes(t, 85))


def test_boundary_comes_from_the_sizes():
    """Where small sets are many, their subsets decide; where there are none, nothing is enumerated."""
    assert jaccard.boundary({}, 50.0, 85) == 0
    assert jaccard.boundary({5: 100}, 50.0, 85) == 5 and jaccard.boundary({9: 100}, 0.0, 85) == 0
    few, many = {4: 10_000, 20: 1}, {4: 1, 20: 10_000}
    assert jaccard.boundary(few, 30.0, 85) == 20 and jaccard.boundary(many, 30.0, 85) < 20
    assert jaccard.subsets(jaccard.largest_enumerable(85), 85) <= jaccard.MOST_SUBSETS < jaccard.subsets(jaccard.largest_enumerable(85) + 1, 85)


def test_heavy_lists_are_dealt(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_HEAVY", 2)
    monkeypatch.setattr(jaccard, "MOST_SUBSETS", 200)
    held(docs, 2, 70)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), (10, 30), (30, 20), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 20: 10, 30: 10} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
