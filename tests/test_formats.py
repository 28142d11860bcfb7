import json

from pyspark.sql import functions as F

from plumbline.operators import labels as L
from plumbline.sources import formats


def test_candidates_and_votes(spark, tmp_path):
    own = {"scale": 2, "mode": "color", "candidates": [{"text": "a|b", "box": [0, 0, 9, 9], "readings": [["x", 0.9], ["y", 0.5], ["z", 1.0, "note"]], "split_boxes": [[0, 0, 4, 9], [5, 0, 9, 9]]}]}
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "ocr_candidates.json").write_text(json.dumps(own))
    found = formats.candidates(spark, str(tmp_path / "w" / "*.json"))
    assert formats.readings(found).count() == 2
    used = found.select(F.lit(1).alias("image_id"), "ord", "text", "box", F.coalesce("angle", F.lit(0.0)).alias("angle"), "split_boxes", "skip_reason")
    assert [(r["text"], r["box"]) for r in L.suggested(used).orderBy("part").collect()] == [("a", [0.0, 0.0, 4.0, 9.0]), ("b", [5.0, 0.0, 9.0, 9.0])]


def test_labels_layers_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "t", "box": [1, 2, 3, 4]}]')
    (tmp_path / "b.json").write_text('{"scale": 1, "labels": [{"text": "u", "box": [1, 2, 3, 4], "angle": 2}], "layers": [{"kind": "ink", "area": 5}]}')
    assert [(r["text"], r["angle"]) for r in formats.labels(spark, str(tmp_path / "*.json")).orderBy("text").collect()] == [("t", 0.0), ("u", 2.0)]
    assert formats.layers(spark, str(tmp_path / "b.json")).first()["kind"] == "ink"
    (tmp_path / "s.log").write_text('x\n{"a": 1}\nnoise "curves": 3\n{"curves": 4}\nend')
    r = formats.last_json(spark, str(tmp_path / "s.log")).first()
    assert r["value"] == '{"curves": 4}'
    text = spark.read.text(str(tmp_path / "s.log"), wholetext=True)
    assert text.select(formats.scraped(F.col("value"), "curves")).first()[0] == 7


def test_writers(spark):
    lines = spark.createDataFrame([(1, 0, [(0.0, 0.0), (1.5, 2.0)], "#102030", 1.0)], "image_id int, ord int, points array<struct<x:double,y:double>>, color string, width double")
    assert 'd="M0.0 0.0 L1.5 2.0"' in formats.svg_paths(lines).first()["svg"]
    m = spark.createDataFrame([("c", 0.5, None)], "case_id string, a double, b double")
    assert formats.markdown_rows(m, ["a", "b"]).first()["line"] == "| c | 0.5 |  |"


def test_builds(spark, tmp_path):
    own = {
        "scale": 2, "src_size": [100, 50], "latin_font": "Arial", "wipe_protected_px": 3, "marks": {"dots": [[1, 2, 0.5]], "strokes": [[0, 0, 4, 0, 1.5]]}, "rules": {"polylines": [[0, 0, 9, 0]], "width_px": 1, "color": [0, 0, 0]},
        "layers": [{"kind": "color", "area": 9, "strokes": {"polylines": [[0, 0, 5, 5, 9, 9], [1]], "width_px": 2.5, "color": [1, 2, 3], "dash": [4, 2]}, "shapes": [{"color": [1, 2, 3], "paths": [{"start": [0, 0], "segs": [[1, 1, 0, 1, 1, 0]]}]}]}],
    }
    (tmp_path / "layers.json").write_text(json.dumps(own))
    at = str(tmp_path / "layers.json")
    lines = formats.strokes(spark, at).orderBy("layer").collect()
    assert [(r["layer"], [tuple(p) for p in r["points"]], r["width_px"], r["dash"]) for r in lines] == [(None, [(0, 0), (9, 0)], 1.0, None), (0, [(0, 0), (5, 5), (9, 9)], 2.5, [4, 2])]
    dots, marks = formats.fine_marks(spark, at)
    assert tuple(dots.first())[2:] == (1.0, 2.0, 0.5) and tuple(marks.first())[2:] == (0.0, 0.0, 4.0, 0.0, 1.5)
    assert formats.shapes(spark, at).first()["segs"] == [[1, 1, 0, 1, 1, 0]]
    r = formats.build_facts(spark, at).first()
    assert (r["width"], r["height"], r["latin_font"], r["wipe_protected_px"], r["dash_protect_px"]) == (100, 50, "Arial", 3, None)


def test_summaries(spark, tmp_path):
    names = ["color_f1", "text_ok"]
    df = spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 0.25)], "case_id string, color_f1 double, text_ok double")
    whole = json.loads(formats.summary_json(df, names)) | {"c": {"id": "c", "error": {"step": "build", "error": "x"}}}
    (tmp_path / "summary.json").write_text(json.dumps(whole))
    got = formats.summary(spark, str(tmp_path / "summary.json"), names)
    assert sorted(map(tuple, got.collect())) == [("a", None, 1.0, 0.25), ("b", None, 0.5, None), ("c", "build", None, None)]
    assert formats.summary_table(got, names).splitlines()[2:] == ["| a | 1.0 | 0.25 |", "| b | 0.5 |  |", "| c | ERROR build |"]


def test_outlines(spark):
    rings = spark.createDataFrame([(1, 9, 8, 0, [(0.0, 0.0), (4.6, 0.0), (4.0, 4.0)], False), (1, 9, 8, 1, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], True)], "image_id int, width int, height int, ord int, points array<struct<x:double,y:double>>, hole boolean")
    plain, smooth = formats.svg_outlines(rings).first()["svg"], formats.svg_outlines(rings, True).first()["svg"]
    assert 'd="M 0,0 L 4,0 L 4,4 Z"' in plain and plain.index("#000000") < plain.index('<g fill="#ffffff"') and 'd="M 0.0,0.0 L 4.6,0.0 L 4.0,4.0 Z"' in smooth and 'viewBox="0 0 9 8"' in plain


def test_images_and_tables(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00" + bytes([255, 0, 0, 0, 0, 255]))) + chunk(b"IEND", b"")
    (tmp_path / "src.png").write_bytes(png)
    (tmp_path / "not.png").write_bytes(b"no image")
    r = formats.images(spark, str(tmp_path / "*.png")).collect()
    assert [(x["name"], x["width"], x["height"], bytes(x["data"])) for x in r] == [("src.png", 2, 1, bytes([0, 0, 255, 255, 0, 0]))]
    (tmp_path / "cases.json").write_text('[{"id": "a", "ref": "r.png", "gt": "g.json", "mode": "color", "degrade": [["resize", 0.64]]}, {"id": "b", "degrade": []}]')
    got = {c["id"]: c["degrade"] for c in formats.cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got == {"a": [["resize", "0.64"]], "b": []}
    formats.write_table(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
