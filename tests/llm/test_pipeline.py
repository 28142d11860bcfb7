import corpus_pipeline
from plumbline.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    """Each stage on the last one's rows at the smallest size: what it must drop goes, what is clean stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
        after = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        seen[name] = before, after
        assert after <= before
    dropped = seen["quality"][0] - seen["quality"][1]
    known = [d for d in seen["quality"][0] if d in labels]
    assert sum((d in dropped) == (labels[d] == 0) for d in known) >= 0.97 * len(known)
    assert seen["pii"][0] == seen["pii"][1] == seen["packing"][1]


def test_odd_rows_of_each_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns named as ours: nothing breaks, other columns stay."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, row string, spans string, text_read int"
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    long = " ".join(f"word{i % 977}" for i in range(20000))
    texts = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (4, ""), (None, "a null id with a1@b.org"), (5, long), (6, f"x {bench} y"), (7, "mail a@b.org now"), (8, "same"), (8, "same")]
    rows = [(i, t, None, "s", None, 0.25, 7, f"r{n}", None, n) for n, (i, t) in enumerate(texts)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    docs, stage = spark.read.parquet(path), dict(corpus_pipeline.STAGES)
    kept = {name: stage[name](spark, docs, SF).collect() for name in ("quality", "jaccard", "decontamination", "pii")}
    assert all(list(r[0].asDict()) == docs.columns for r in kept.values() if r)
    assert all(r["score"] == 0.25 and r["predicted"] == 7 and r["row"] == f"r{r['text_read']}" for got in kept.values() for r in got)
    ids = lambda name: sorted((r["text_read"] for r in kept[name]))
    assert ids("jaccard") in ([0, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 3, 4, 5, 6, 7, 8, 10])
    assert ids("decontamination") == [n for n in range(len(texts)) if n != 7] and len(ids("pii")) == len(texts)
    masked = {r["text_read"]: (r["text"], r["n_chars"]) for r in kept["pii"]}
    assert masked[8] == ("mail [EMAIL] now", 16) and masked[2] == (None, None) and masked[5][0] == "a null id with [EMAIL]" and masked[6][0] == long
    pieces = stage["packing"](spark, docs, SF)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "doc_tokens", "sequence_id", "start").where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    empty = spark.read.parquet(path).where("false")
    assert all(f(spark, empty, SF).count() == 0 for f in stage.values())
