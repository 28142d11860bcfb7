"""Hand-worked cases (FIXTURES.md) and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import colour, labels, metrics, raster, sequence, spatial


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda *cols: (lambda r: r[0] if len(r) == 1 else tuple(r))(one.select(*cols).first())


def test_scalars(value):
    box = [0.0, 0.0, 10.0, 10.0]
    assert value(F.round(S.iou(box, [5.0, 0.0, 15.0, 10.0]), 4), F.round(S.iou(box, [6.0, 0.0, 16.0, 10.0]), 4)) == (0.3333, 0.25)
    assert value(S.cer(F.lit("epression"), F.lit("Depression")), S.cer(F.lit(""), F.lit("abc")), S.cer(F.lit("abc"), F.lit("")), S.cer(F.lit("abcdef"), F.lit("ab"))) == (0.1, 1.0, 0.0, 2.0)
    assert value(F.levenshtein(F.lit("é漢字"), F.lit("e漢子"))) == 2
    assert value(S.norm_check(F.lit("a：b　c ～")), S.norm_score(F.lit("a：b c")), S.norm_reading(F.lit("—～ x"))) == ("a:bc~", "a：bc", "—~x")
    assert value(S.norm_score(F.lit("～〜－—（），、º˚＜")), S.norm_check(F.lit("：？！；"))) == ("~~--(),,°°<", ":?!;")
    assert value(S.cer(S.norm_score(F.lit("（a）")), S.norm_score(F.lit("(a)")))) == 0.0
    p = lambda o, n, s: S.prefix_completion(F.lit(o), F.lit(n), F.lit(s))
    assert value(p("epression", "Depression", 0.1), p("Xinchang", "Xinchangia", 0.9), p("Xinchang", "Xinchangia", 0.5)) == ("replace", "uncertain", None)
    assert value(S.time_budget(F.lit(8), F.lit(30), F.lit(260), F.lit(0), F.lit(0)), S.time_budget(F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == (401.0, 240.0)
    assert value(S.work_scale(F.lit(2048), F.lit(1824)), S.work_scale(F.lit(720), F.lit(541))) == (1, 2)
    assert value(S.in_grown_box(F.lit(88), F.lit(45.5), [100, 50, 140, 60]), S.in_grown_box(F.lit(152), F.lit(64.5), [100, 50, 140, 60]), S.in_grown_box(F.lit(87.9), F.lit(50), [100, 50, 140, 60])) == (True, True, False)
    assert value(S.degree_digits(F.lit("37 0")), S.degree_digits(F.lit("x37"))) == ("370", None)
    assert value(S.effective_width(F.lit("漢a")), S.half_even(F.lit(2.5)), S.or_default(F.lit(0.0), 1.0)) == (1.5, 2.0, 1.0)
    assert abs(value(S.angle_between(F.lit(0.1), F.lit(3.1))) - (np.pi - 3.0)) < 1e-9
    assert [round(x) for x in value(*S.lab(F.lit(255), F.lit(255), F.lit(255)))] == [100, 0, 0]
    assert value(*S.lab8(F.lit(255), F.lit(0), F.lit(0))) == (82, 207, 20) and value(S.chroma(F.lit(3.0), F.lit(4.0)), S.delta_e([0.0, 0.0, 0.0], [2.0, 3.0, 6.0])) == (5.0, 7.0)
    assert abs(value(S.hue_apart(F.lit(3.0), F.lit(-3.0))) - (2 * np.pi - 6.0)) < 1e-9 and abs(value(S.hue(F.lit(0.0), F.lit(2.0))) - np.pi / 2) < 1e-9
    size = value(S.strip_size(F.lit(20.0), F.lit(40 * np.cos(np.radians(20)) + 10 * np.sin(np.radians(20))), F.lit(40 * np.sin(np.radians(20)) + 10 * np.cos(np.radians(20)))))
    assert np.allclose(size, (40, 10)) and value(S.strip_size(F.lit(44.0), F.lit(9), F.lit(9))) is None
    assert value(S.label_id(F.lit(3)), S.label_number(F.lit(" l12 ")), S.label_number(F.lit("M1")), S.switched_on(F.lit("Yes")), S.switched_on(F.lit("0")), S.switched_on(F.lit(None).cast("string"))) == ("L3", 12, None, True, False, False)
    at = value(S.placement([10.0, 20.0, 50.0, 40.0], F.lit("漢ab"), F.lit(24.0), F.lit(None).cast("double"), F.lit(2)))
    assert tuple(at) == (15.0, 15.0, 20.0, 12.0, 10.0, 0.0)


def test_degree_labels(spark, value):
    glyph = lambda *rows: F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("xywh", r))) for r in rows)) if rows else F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    digits, ring = [(0, 0, 6, 10), (8, 0, 6, 10)], (16, 0, 3, 4)
    read = lambda t, *g: value(S.degree_label(F.lit(t), glyph(*g)))
    assert tuple(read("37", *digits, ring)) == ("37°", None) and tuple(read("370", *digits, ring)) == ("37°", None) and tuple(read("37*", *digits, ring)) == ("37°", None)
    assert tuple(read("37", (0, 0, 14, 10), ring)) == ("37°", "degree sign found but digits merged: check the number")
    assert read("37", *digits) is None and read("x", *digits, ring) is None and read("37") is None and read("37", *digits, (16, 7, 3, 3)) is None
    r = spark.createDataFrame([([("37", 0.9, None), ("370", 0.95, None), ("37°", 0.5, None), ("38", 0.99, None), ("37°", 1.0, "degree-fix")],)], "r array<struct<text:string,score:double,note:string>>")
    assert tuple(r.select(labels.degree_support(F.col("r"), F.lit("37°"))).first()[0]) == (3, 0.95)


def test_vote_and_selection(spark):
    rows = [(1, "drill", 0.95, 0), (1, "dnll", 0.60, 1), (1, "dnll", 0.55, 2), (1, "dnll", 0.50, 3)]
    r = labels.vote(spark.createDataFrame(rows, "c int, t string, s double, o int"), "c", "t", "s", "o").first()
    assert (r["text"], r["agreement"], r["votes"], r["reads"]) == ("drill", 0.74, 1, 4)
    c = spark.createDataFrame([("", 0.9, 5, None), ("IIIA", 0.9, 5, None), ("x", 0.9, 5, None), ("0%", 0.9, 5, "w"), ("12km", 0.9, 5, "w"), ("abcd", 0.4, 1, None), ("abcd", 0.4, 3, None), ("漢字", 0.4, 3, None), ("word", None, None, None)], "t string, s double, v int, w string")
    got = [x[0] for x in c.select(labels.skip_reason(F.col("t"), F.col("s"), F.col("v"), F.col("w"))).collect()]
    assert got == [labels.EMPTY, labels.ROMAN, labels.SINGLE, labels.SHORT, None, labels.WEAK, labels.LOW, None, None]
    known = spark.createDataFrame([("a", 0.5), ("IIIA", 0.9), ("ab", 0.4), ("漢", 0.6), ("xy", 0.6)], "t string, s double")
    assert [r[0] for r in known.select(labels.baseline_used(F.col("t"), F.col("s"))).collect()] == [False, False, False, True, True]


def test_second_readings(spark):
    box = "image_id int, id int, x0 double, y0 double, x1 double, y1 double, ord int"
    known = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0)], box)
    extras = [(1, 1, 1.0, 0.0, 11.0, 10.0, 0), (1, 2, 100.0, 0.0, 110.0, 10.0, 2), (1, 3, 101.0, 0.0, 111.0, 10.0, 1), (1, 4, 300.0, 0.0, 310.0, 10.0, 3), (2, 5, 0.0, 0.0, 10.0, 10.0, 0)]
    assert sorted(r["id"] for r in labels.new_readings(spark.createDataFrame(extras, box), known).collect()) == [3, 4, 5]


def test_patched_candidates(spark):
    kind = "ord int, text string, box array<double>, use boolean, split_boxes array<array<double>>"
    rows = [(0, "a", [0.0], True, None), (1, "b|c", [0.0], True, [[1.0]]), (2, "d", [0.0], False, None), (3, "e", [0.0], True, None), (4, "f|g", [0.0], True, [[1.0]])]
    changes = [(0, "", None, None), (1, " new ", None, None), (2, "back", [5.0], None), (3, None, None, True), (4, None, [7.0], None), (9, "x", None, None)]
    got = labels.patched_candidates(spark.createDataFrame(rows, kind), spark.createDataFrame(changes, "number int, text string, box array<double>, drop boolean")).orderBy("ord").collect()
    assert [(r["text"], r["box"], r["use"], r["split_boxes"]) for r in got] == [("a", [0.0], False, None), ("new", [0.0], True, None), ("back", [5.0], True, None), ("e", [0.0], False, None), ("f|g", [7.0], True, [[1.0]])]


def test_rows_of_several_labels(spark):
    glyphs = lambda n: [1] * 10 + ([0] + [1] * 10) * (n - 1)
    rows = [(1, 1, "甲乙丙丁戊", 10.0, glyphs(2) + [0] * 12 + glyphs(3)), (1, 2, "甲乙丙丁", 10.0, glyphs(4)), (1, 3, "甲乙丙丁", 10.0, glyphs(2) + [0] * 9 + [1] * 60), (1, 4, "word", 10.0, glyphs(2) + [0] * 9 + glyphs(2)), (1, 5, "甲乙丙丁", 10.0, [0] * 9)]
    got = {r["id"]: r for r in labels.split_rows(spark.createDataFrame(rows, "image_id long, id long, text string, glyph_h double, columns array<int>")).collect()}
    assert got[1]["parts"] == ["甲乙", "丙丁戊"] and [tuple(x) for x in got[1]["spans"]] == [(0, 21), (33, 65)] and set(got) == {1}
    assert raster.row_parts("甲乙丙丁戊己", glyphs(2) + [0] * 9 + [1] * 10 + [0] + [1] * 25 + [0] + [1] * 30, 10.0)[2] is None
    assert raster.grown_span(np.array([0] * 5 + [1] * 30 + [0] * 20 + [1] * 5), 15, 25, 10.0, 3) == (5, 34)
    assert raster.cut_columns(np.array(glyphs(2) + [0] * 6 + glyphs(2)), [2, 2], 10.0) == [(0, 21), (27, 48)]


def test_patch(spark):
    base = spark.createDataFrame([("L0", "a", [0.0]), ("L1", "b", [0.0]), ("L2", "c", [0.0])], "id string, text string, box array<double>")
    changes = spark.createDataFrame([("L0", "", None, None), ("L1", None, None, True), ("L9", "x", None, None), ("L2", None, [5.0], None)], "id string, text string, box array<double>, drop boolean")
    assert [tuple(r) for r in labels.apply_patch(base, changes).collect()] == [("L2", "c", [5.0])]


def test_gates(value):
    lit = F.lit
    assert value(labels.may_deliver(lit(2), lit(False), lit(2)), labels.may_deliver(lit(2), lit(False), lit(3))) == (False, True)
    step = lambda *a: labels.workflow_step(*map(lit, a))
    none = lit(None).cast("boolean")
    assert value(step(True, False, True, 0, 0), step(False, True, True, 0, 0), step(False, False, False, 2, 0), labels.workflow_step(lit(False), none, lit(False), lit(0), lit(0)), labels.workflow_step(lit(False), none, lit(True), lit(0), lit(1)), labels.workflow_step(lit(False), none, lit(True), lit(0), lit(0))) == ("running", "delivered", "blocked", "failed", "review", "converged")


def test_metrics(spark, value):
    lit = F.lit
    assert value(*metrics.prf(lit(10), lit(0), lit(0), lit(0))) == (0.0, 0.0, 0.0)
    assert value(metrics.class_f1(lit(0), lit(0), lit(0), lit(0))) is None
    w = spark.createDataFrame([(0.9, 100), (0.5, 300)], "f double, n int")
    assert w.agg(metrics.weighted_mean(F.col("f"), F.col("n"))).first()[0] == 0.6
    assert value(metrics.cell_of(lit(24), lit(25), 12), metrics.cell_of(lit(23), lit(25), 12)) == (None, 11)
    px = spark.createDataFrame([(1, 0, 0, 1, 0, 1, 0), (1, 1, 0, 1, 0, 0, 0), (1, 0, 0, 1, 1, 0, 1), (1, 24, 0, 1, 1, 1, 1), (1, 3, 9, 1, 1, 1, 1)], "image_id int, x int, y int, ref int, cand int, ref_hit int, cand_hit int")
    cells = {(r["row"], r["col"]): r for r in metrics.grid_ratios(px, spark.createDataFrame([(1, 25, 10)], "image_id int, width int, height int")).collect()}
    assert len(cells) == 108 and cells[0, 0]["recall"] == 0.333 and cells[0, 0]["precision"] == 1.0 and cells[0, 1]["recall"] is None and sum(r["ref_px"] for r in cells.values()) == 3
    own = lambda r, o, *others: value(metrics.own_text(lit(r), lit(o), F.array(*map(lit, others))))
    assert own("300450km", "450km", "300", "450", "") == "450km" and own("aabaa", "b", "aa") == "baa" and own("x", "xy", "y") == "x"
    assert value(metrics.longest_first(F.array(lit("b"), lit("ccc"), lit("a"), lit("ccc")))) == ["ccc", "a", "b"]
    assert value(metrics.colour_recall(lit(200), lit(0)), metrics.colour_recall(lit(400), lit(100)), metrics.coverage(lit(0), lit(0)), metrics.coverage(lit(10), lit(1))) == (None, 0.75, 1.0, 0.9)
    assert value(metrics.read_back_failed(lit(0.0), lit(0.1), lit(0.3), lit(False)), metrics.read_back_failed(lit(5.0), lit(0.1), lit(0.9), lit(False)), metrics.read_back_failed(lit(0.0), lit(0.5), lit(0.9), lit(True)), metrics.read_back_failed(lit(0.0), lit(0.5), lit(0.9), lit(False))) == (True, False, True, False)
    i = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c")], "image_id int, type string")
    assert {r["image_id"]: (r["open"], r["types"]) for r in metrics.issue_summary(i).collect()} == {1: (3, ["a", "b"]), 2: (1, ["c"])}
    a = spark.createDataFrame([("c", "text_ok", 0.95), ("c", "color_dE", 5.0)], "case_id string, metric string, value double")
    b = spark.createDataFrame([("c", "text_ok", 0.91), ("c", "color_dE", 6.2)], "case_id string, metric string, value double")
    tol = spark.createDataFrame(metrics.TOLERANCES, "metric string, sign int, tol double")
    assert {r["metric"]: r["flag"] for r in metrics.compare_runs(a, b, tol).collect()} == {"text_ok": "regression", "color_dE": "same"}
    s = spark.createDataFrame([(1, 40, 0), (1, 60, 1), (1, 100, 2)], "k int, w int, o int")
    assert [r["share"] for r in metrics.apportion(s, ["k"], "w", F.lit(12.0), "o").orderBy("o").collect()] == [2, 4, 6]
    d = spark.createDataFrame([(1, 7), (1, 7), (1, 3), (1, 3)], "k int, v int")
    assert metrics.dominant(d, ["k"], "v").first()["v"] == 3
    p = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    assert p.agg(F.percentile("v", 0.75)).first()[0] == 5.25


def test_issue_rules(spark):
    names = ["coverage", "lost", "precision", "colour_recall", "missing_significant", "mark_recall", "width_rel", "width_mae", "ink_extra_share", "ink_missing_share", "region_iou", "edge_p75_px", "objects", "src_elements"]
    rows = [(1.0, 0.0, 1.0, None, 0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None), (0.5, 1.0, 0.5, 0.5, 3.0, 0.5, 0.7, 2.0, 0.02, 0.02, 0.5, 6.0, 40.0, 10.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = [r[0] for r in df.select(metrics.issue_flags()).collect()]
    assert got[0] == [] and len(got[1]) == 11
    regions = df.withColumns({"k": F.col("lost"), "regions": F.create_map(F.lit("lost_elements"), F.array(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))))})
    said = {r["type"]: r for r in metrics.issue_records(regions, ["k"]).collect()}
    assert set(said) == set(got[1]) and all(r["stage"] == "graphics" and r["detail"] and r["hint"] for r in said.values())
    assert said["lost_elements"]["regions"] == [[1, 2, 3, 4]] and said["graphics_missing"]["detail"].startswith("50%") and said["line_width"]["detail"] == "line widths are off by 2.00 px (70%)"


def test_sequences(spark, value):
    profile = [int(c) for c in "011100111001110"]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(profile)], "k int, i int, v int")
    arrays = sequence.on_and_gaps(sequence.runs(rows, "k", "i", "v"))
    r = arrays.first()
    assert (r["ons"], r["gaps"]) == ([3, 3, 3], [2, 2])
    on, gaps, spans = raster.run_lengths(np.array(profile))
    assert on.tolist() == [3, 3, 3] and gaps.tolist() == [2, 2] and spans.tolist() == [[1, 4], [6, 9], [11, 14]]
    i = spark.createDataFrame([(1, 0, 50), (1, 54, 90), (1, 100, 130)], "k int, lo int, hi int")
    assert [tuple(r) for r in sequence.merge_intervals(i, "k", "lo", "hi").collect()] == [(1, 0, 90)]
    n = spark.createDataFrame([(1, v) for v in [*range(9), 100]], "k int, v int")
    assert sequence.narrowest_interval(n, "k", "v").first()["width"] == 8
    lit = F.lit
    c = lambda *a: sequence.confidence(*map(lit, a))
    assert value(c(0.1, 0.1, 0.5, 10.0, 10.0), c(0.3, 0.3, 0.3, 10.0, 25.0), c(0.5, 0.1, 0.5, 1.0, 1.0)) == ("high", "medium", "low")
    pts = F.array(*(F.struct(lit(float(x)).alias("x"), lit(0.0).alias("y")) for x in (0, 1, 2, 5, 6, 9)))
    assert [p["x"] for p in value(sequence.thin_points(pts, 3.0))] == [0.0, 5.0, 9.0]
    ring = F.array(*(F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (1.0, 0.0))))
    assert len(value(sequence.thin_points(ring, 3.0))) == 4 and len(value(sequence.thin_points(ring, 3.0, True))) == 3
    corner = F.array(*(F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))))
    assert [tuple(p) for p in value(sequence.cut_corners(corner))] == [(0, 0), (2, 0), (7, 0), (10, 2), (10, 7), (10, 10)]
    assert [p["x"] for p in value(sequence.cut_corners(F.slice(pts, 1, 2)))] == [0.0, 1.0]


def test_dash_statistics(spark):
    kind = "k int, duty double, ons array<int>, gaps array<int>, raw_ons array<int>, raw_gaps array<int>"
    rows = [(0, 0.0, [], [], [], []), (1, 0.95, [100], [], [100], []), (2, 0.5, [4, 6, 6, 6, 4], [5, 5, 5, 5], [8, 10, 10, 10, 8], [1, 1, 1, 1]), (3, 0.6, [9, 30, 4, 8, 30, 4, 9], [3] * 6, [9, 30, 4, 8, 30, 3, 9], [2, 3, 3, 3, 3, 4]), (4, 0.5, [2, 2], [5], [2, 2], [5])]
    s = sequence.dash_statistics(spark.createDataFrame(rows, kind))
    c = F.col
    got = {r["k"]: r for r in s.withColumn("kind", sequence.line_kind(c("duty"), c("n_seg"), c("dash"), c("gap"), c("len_cv"), c("gap_cv"), c("dashdot"))).collect()}
    assert [got[i]["kind"] for i in range(5)] == ["none", "solid", "dashed", "dashdot", "sparse"]
    assert all(got[i][n] is None for i in (0, 1) for n in ("dash", "gap", "len_cv", "gap_cv")) and (got[2]["dash"], got[2]["gap"], got[2]["len_cv"]) == (6, 5, 0.0)
    assert (got[3]["dash"], got[3]["long"], got[3]["dot"], got[3]["gap"]) == (30, 30, 4, 3)


def test_spatial(spark):
    pts = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 90.0, 0.0), (2, 4, 0.0, 0.0)], "image_id int, id int, x double, y double")
    assert {(r["a"], r["b"], r["d"]) for r in spatial.near_pairs(pts, 5.0).collect()} == {(1, 2, 5.0), (2, 1, 5.0)}
    boxes = spark.createDataFrame([(1, 10, 100.0, 50.0, 140.0, 60.0), (1, 11, 500.0, 50.0, 510.0, 60.0)], "image_id int, id int, x0 double, y0 double, x1 double, y1 double")
    dets = spark.createDataFrame([(1, 1, 130.0, 55.0, 0, "b"), (1, 2, 105.0, 55.0, 1, "a"), (1, 3, 300.0, 55.0, 2, "c")], "image_id int, id int, x double, y double, ord int, text string")
    assert {r["box_id"]: r["read"] for r in spatial.read_at(boxes, dets).collect()} == {10: "ab", 11: ""}
    marks = spark.createDataFrame([(1, 1, 5.0, 5.0, 20, 2.0), (1, 2, 50.0, 5.0, 20, 9.0)], "image_id int, id int, x double, y double, area int, width double")
    drawn = spark.createDataFrame([(1, 7, 12.0, 5.0, 21, 3.0), (1, 8, 6.0, 5.0, 90, 2.0)], "image_id int, id int, x double, y double, area int, width double")
    assert [tuple(r) for r in spatial.matched_widths(marks, drawn).collect()] == [(1, 1, 2.0, 3.0)]
    wide = spark.createDataFrame([(1, 7, 5.0, 5.0, 20, 5.0)], marks.schema)
    thin = spark.createDataFrame([(1, 1, 5.0, 5.0, 20, 1.0), (1, 2, 5.0, 5.0, 5, 1.0)], marks.schema)
    found = spatial.matched_widths(thin, wide)  # a width five times as large counts, areas four times as large don't
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1.0, 5.0)] and tuple(spatial.width_errors(found, ["image_id"]).first()) == (1, 4.0, 4.0)
    pair = "image_id int, id int, x0 double, y0 double, x1 double, y1 double"
    a, b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)], pair), spark.createDataFrame([(1, 9, 0.0, 0.0, 10.0, 5.0)], pair)
    assert spatial.best_match(a, b, 0.3).count() == 1 and spatial.best_match(a, a, 1.0 - 1e-9, strict=True).count() == 1 and spatial.best_match(a, b, 0.5, strict=True).count() == 0
    ends = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, -1.0, 0.0), (1, 1, 0, 50.0, 0.0, 1.0, 0.0), (1, 2, 1, 53.0, 0.0, -1.0, 0.0), (1, 3, 1, 90.0, 0.0, 1.0, 0.0), (1, 4, 2, 51.0, 1.0, 0.0, -1.0), (1, 5, 2, 51.0, 40.0, 0.0, 1.0)], "image_id long, end long, line long, x double, y double, ux double, uy double")
    joints = spatial.ends_near(ends, 5.0)
    assert [tuple(r) for r in joints.collect()] == [(1, 1, 2, 1.0)] and [tuple(r) for r in spatial.joined_ends(joints).collect()] == [(1, 1, 2)]
    stubs = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 1.0, 0.0, 30.0), (1, 1, 1, 20.0, 1.0, -1.0, 0.0, 30.0), (1, 1, 2, 20.0, 20.0, 1.0, 0.0, 30.0), (1, 2, 3, 40.0, 0.0, 1.0, 0.0, 30.0)], "image_id int, box int, id int, x double, y double, ux double, uy double, reach double")
    assert [(r["a"], r["b"]) for r in spatial.stub_pairs(stubs).collect()] == [(0, 1)]
    px = spark.createDataFrame([(1, 1, 5, 5), (1, 1, 6, 5), (1, 2, 10, 5), (1, 2, 70, 5), (1, 3, 90, 90)], "image_id int, component int, x int, y int")
    zones = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 4, 4, 8, 8)], "image_id int, id int, x0 int, y0 int, x1 int, y1 int")
    assert {r["component"]: (r["inside"], r["pixels"]) for r in spatial.zone_of_components(px, zones).collect()} == {1: (2, 2), 2: (1, 2), 3: (0, 1)}
    assert [tuple(r) for r in spatial.touching_regions(px.withColumnRenamed("component", "region"), 4).collect()] == [(1, 1, 2)]


def test_colour(value):
    lit = F.lit
    k = lambda a, b: colour.palette_kind(lit(a), lit(b))
    assert value(k(100, 10), k(200, 10), k(200, 40), k(130, 20)) == ("ink", "grid", "color", "color")
    v = F.array(lit(1.0), lit(1.0))
    assert value(colour.nearest(v, [(0, [0.0, 1.0]), (1, [2.0, 1.0])])["id"]) == 0
    assert value(colour.nearest(v, [(0, [9.0, 9.0])], 5.0)) is None
    three = lambda *x: F.array(*(lit(float(n)) for n in x))
    assert value(colour.nearest(three(0, 0, 0), [(0, [40, 0, 0]), (1, [0, 13, 0])], light=0.3)["id"], colour.nearest(three(0, 0, 0), [(0, [40, 0, 0]), (1, [0, 13, 0])])["id"]) == (0, 1)
    assert value(colour.paper_or(three(0, 0, 0), lit(240), [(3, [0, 0, 0])]), colour.paper_or(three(0, 0, 0), lit(200), [(3, [0, 0, 0])])) == (-1, 3)
    kind = lambda light, chroma, least, near=None: value(colour.score_class(lit(light), lit(chroma), lit(least), lit(near).cast("int")))
    assert [kind(99, 0, 250), kind(10, 0, 10), kind(80, 5, 230), kind(50, 30, 100, 2), kind(50, 15, 100), kind(99, 30, 239, 1), kind(50, 30, 100)] == [0, 1, 2, 12, -1, 11, -1]
    assert value(colour.is_blend(three(50, 0, 20), three(0, 0, 0), three(100, 0, 0)), colour.is_blend(three(99, 0, 0), three(0, 0, 0), three(100, 0, 0)), colour.is_blend(three(99, 0, 0), three(0, 0, 0), three(100, 0, 0), 20.0, True), colour.is_blend(three(50, 0, 31), three(0, 0, 0), three(100, 0, 0))) == (True, False, True, False)
    assert value(colour.layer_kept(lit(19), lit(100), lit(True)), colour.layer_kept(lit(20), lit(10**6), lit(True)), colour.layer_kept(lit(399), lit(10**6), lit(False)), colour.layer_kept(lit(400), lit(10**6), lit(False))) == (False, True, False, True)
    assert colour.merged_centres([([10.0, 0, 0], 5), ([15.0, 0, 0], 90), ([60.0, 0, 0], 1)], 11.0, "dark") == [[10.0, 0, 0], [60.0, 0, 0]]
    assert colour.merged_centres([([10.0, 0, 0], 5), ([15.0, 0, 0], 900), ([60.0, 0, 0], 1)], 11.0, "count", 0.01) == [[15.0, 0, 0]]


def test_levels_and_palettes(spark, value):
    light = [(1, 250)] * 60 + [(1, 246)] * 45 + [(1, 200)] * 50 + [(1, 10)] * 500 + [(2, 240)] * 99 + [(3, 5)]
    assert {r["k"]: r["paper"] for r in colour.paper_level(spark.createDataFrame(light, "k int, v int"), ["k"], "v").collect()} == {1: 250.0, 2: 255.0, 3: 255.0}
    low = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 100)], "k int, v double")
    assert colour.darkest_mean(low, ["k"], "v", 0.25).first()["mean"] == 1.5
    px = [(10.0, 10.0, 10.0)] * 60 + [(12.0, 10.0, 10.0)] * 40 + [(80.0, 0.0, 0.0)] * 30 + [(200.0, 0.0, 0.0)] * 3
    assert colour.flat_palette(spark.createDataFrame(px, "L double, a double, b double"), 133) == [([10.8, 10.0, 10.0], 100), ([80.0, 0.0, 0.0], 30)]
    assert colour.flat_palette(spark.createDataFrame([], "L double, a double, b double"), 10) == []
    got = colour.recipe_palette(spark.createDataFrame([(float(i % 6) * 40, 0.0, 0.0) for i in range(60)], "L double, a double, b double"), "layers")
    assert np.allclose(got, [[0, 0, 0], [40, 0, 0], [80, 0, 0], [120, 0, 0], [160, 0, 0], [200, 0, 0]])
    assert value(colour.content_mode(F.lit(50), F.lit(1.0), F.lit(1.0)), colour.content_mode(F.lit(500), F.lit(0.0), F.lit(0.01)), colour.flat_gate(F.lit(0.8), F.lit(0.01), F.lit(3.0), F.lit(24), F.lit(0.5))) == ("lineart", "color", True)


def test_raster_kernels(spark):
    rng = np.random.default_rng(0)
    m = rng.random((20, 30)) < 0.4
    lab = raster.label(m)
    assert (lab > 0).tolist() == m.tolist()
    for y, x in zip(*np.nonzero(m)):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if 0 <= y + dy < 20 and 0 <= x + dx < 30 and m[y + dy, x + dx]:
                    assert lab[y, x] == lab[y + dy, x + dx]
    assert raster.stats(lab).area.sum() == m.sum()
    d = raster.distance(~m)
    ys, xs = np.nonzero(m)
    assert np.allclose(d, [[min(np.hypot(ys - y, xs - x)) for x in range(30)] for y in range(20)])
    assert (raster.dilate(m, 2) == (np.array([[m[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for x in range(30)] for y in range(20)]))).all()
    bar = np.zeros((9, 30), bool)
    bar[3:6, 2:28] = True
    assert raster.thin(bar).sum(axis=0).max() == 1
    assert raster.hit_counts(bar, bar, 1) == {"ref": 78, "cand": 78, "ref_hit": 78, "cand_hit": 78}
    boxes = np.array([[0, 0, 10, 10], [5, 0, 15, 10], [12, 0, 22, 10], [50, 50, 60, 60]], float)
    assert raster.cluster_boxes(boxes, np.arange(4)).tolist() == [0, 0, 1, 2]
    assert raster.distinct_axes(np.array([[0, 0, 100, 0], [10, 1, 60, 1], [0, 50, 100, 50]], float)).tolist() == [True, False, True]
    assert raster.first_apart(boxes).tolist() == [True, False, True, True]
    fat = np.pad(rng.random((24, 24)) < 0.7, 2)
    once = raster.thin(fat)
    assert (raster.thin(once) == once).all() and not (once & ~fat).any() and raster.label(once).max() == raster.label(fat).max()
    on, gaps, spans = raster.run_lengths(np.zeros(5))
    assert len(on) == len(gaps) == len(spans) == 0
    line = raster.lines_mask((20, 40), np.array([[5.0, 10.0, 30.0, 10.0]]), np.array([3.0]))
    assert line.sum(axis=0).max() == 3 and line[10, 5:31].all()
    dash = {"x0": 0, "y0": 10, "x1": 39, "y1": 10, "width": 2, "kind": "dashed", "conf": "high"}
    ink = np.zeros((20, 40), bool)
    ink[8:13, ::2] = ink[18] = True
    assert raster.protected_ink(ink, [dash]).sum() == 100 and not raster.protected_ink(ink, [dash | {"conf": "low"}, dash | {"kind": "solid"}]).any()
    rules = np.array([[0, 0, 30, 0], [35, 1, 60, 1], [0, 40, 10, 40], [62, 30, 90, 60], [62, 1, 90, 1]], float)
    assert raster.rule_chains(rules) == [[0, 1, 4], [3]]
    dashes = np.array([[i * 20.0, 5.0, 1, 0, 10, 2] for i in range(5)] + [[i * 20.0, 60.0, 1, 0, 10, 2] for i in range(2)] + [[300.0, 5.0, 1, 0, 10, 2], [40.0, 6.0, 0, 1, 10, 2]])
    assert raster.dash_chains(dashes) == [[0, 1, 2, 3, 4]]
    style = [{"width": 2.0, "dash": 10.0, "gap": 5.0}] * 3 + [{"width": 9.0, "dash": 10.0, "gap": 5.0}, {"width": 2.0, "dash": 10.0, "gap": 50.0}]
    assert len(raster.one_style(style)) == 3 and raster.one_style(style[:2]) == []
    wave = np.sin(np.linspace(0, 2 * np.pi, 40, endpoint=False))
    assert np.allclose(raster.gaussian_circle(wave, 1.5), np.roll(raster.gaussian_circle(np.roll(wave, 7), 1.5), -7)) and np.allclose(raster.gaussian_circle(np.ones((9, 2)), 2.0), 1) and np.allclose(raster.circular_mean(np.array([0.0, 3, 0, 0]), 1), [1, 1, 1, 0])
    assert raster.join_ends([(1.0, 1, 2), (2.0, 3, 0), (3.0, 3, 4)], 6) == [(1, 2), (3, 4)]
    det = spark.createDataFrame([(1, i, 0.9 - i / 10, float(x), 0.0, x + 10.0, 10.0, i) for i, x in enumerate((0, 5, 12, 90))], "image_id long, det_id long, score double, x0 double, y0 double, x1 double, y1 double, ord int")
    assert {r["det_id"]: r["cluster"] for r in raster.clusters_per_image(det).collect()} == {0: 0, 1: 0, 2: 1, 3: 2}
    px = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 1), (1, 3, 5, 5), (2, 4, 0, 0)], "image_id long, id long, x int, y int")
    assert {r["id"]: r["component"] for r in raster.components_per_image(px).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert raster.elements_per_image(px).count() == 3


def test_kmeans_palette(spark):
    rows = [(float(i % 2) * 50, 10.0, 10.0) for i in range(40)]
    got = sorted(colour.kmeans_palette(spark.createDataFrame(rows, "L double, a double, b double"), ["L", "a", "b"], 2))
    assert np.allclose(got, [[0, 10, 10], [50, 10, 10]])
