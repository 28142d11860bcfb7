"""Pictures drawn by hand: what the checks and the scorer say of a clean copy and of known damage."""

import json

import numpy as np
import pytest

from plumbline.operators import checks, metrics, score

PICTURE = "image_id string, role string, height int, width int, data binary"
LABELS = "image_id string, id long, text string, x0 double, y0 double, x1 double, y1 double, angle double"
FOUND = "image_id string, role string, id long, text string, ord int, x0 double, y0 double, x1 double, y1 double"


def drawing() -> np.ndarray:
    """A red and a blue region, a frame, dots, a thin line and a few square marks on white paper."""
    img = np.full((160, 200, 3), 255, np.uint8)
    img[20:80, 20:90] = (40, 40, 220)
    img[20:80, 110:180] = (200, 80, 30)
    img[100:102, 20:180] = 0
    for x in range(30, 170, 28):
        img[120:130, x : x + 10] = 0
    img[140:150, 40:50] = (30, 160, 30)
    return img


def damaged() -> np.ndarray:
    img = drawing()
    img[118:132, 28:70] = 255  # two marks are lost
    img[85:98, 100:130] = 0  # something was filled in
    img[20:80, 110:180] = (200, 30, 200)  # a region has another colour
    return img


@pytest.fixture(scope="module")
def pictures(spark):
    rows = [(case, role, *p.shape[:2], p.tobytes()) for case, out in (("clean", drawing()), ("bad", damaged())) for role, p in (("source", drawing()), ("result", out))]
    return spark.createDataFrame([*rows, ("alone", "source", 1, 1, b"abc")], PICTURE)


def test_self_check(spark, pictures):
    boxes = spark.createDataFrame([("clean", 0.0, 0.0, 9.0, 9.0)], "image_id string, x0 double, y0 double, x1 double, y1 double")
    found = checks.check(pictures, boxes).cache()
    rows = {r["image_id"]: r for r in found.collect()}
    assert set(rows) == {"clean", "bad"}
    clean, bad = rows["clean"], rows["bad"]
    assert (clean["coverage"], clean["precision"], clean["colour_recall"], clean["lost"], clean["region_iou"], clean["mark_recall"], clean["edge_p75_px"], clean["ink_extra_share"]) == (1.0, 1.0, 1.0, 0, 1.0, 1.0, 0.0, 0.0)
    assert bad["lost"] >= 2 and bad["ink_extra_share"] > 0.01 and bad["region_iou"] < 0.85 and bad["mark_recall"] < 1 and bad["colour_recall"] < 0.85 and bad["missing_significant"] == 2
    issues = {(r["image_id"], r["type"]): r for r in metrics.issue_records(found, ["image_id"]).collect()}
    assert not any(k[0] == "clean" for k in issues)
    assert {"lost_elements", "colour_mismatch", "ink_extra", "regions_shifted"} <= {t for _, t in issues}
    assert [30, 120, 40, 130] in issues["bad", "lost_elements"]["regions"]


def test_kernels():
    img = drawing()
    assert checks.lab8(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], np.uint8)).tolist() == [[[255, 128, 128], [0, 128, 128], [82, 207, 20]]]
    assert (checks.resized(img.repeat(2, 0).repeat(2, 1), 200, 160) == img).all()
    edge = checks.edges(np.pad(np.zeros((20, 20, 3), np.uint8), ((10, 10), (10, 10), (0, 0)), constant_values=255))
    assert edge.any() and not edge[:8].any() and not edge[14:26, 14:26].any()
    two = np.full((60, 60), 255, np.uint8)
    two[10:50, 10:50] = 0
    gone = checks.wiped(two, np.full_like(two, 255), np.array([[0, 0, 5, 5]]), 1)
    assert gone["px"] == 1600 - 12 * 12 and gone["regions"] == [[7, 7, 53, 53]] and checks.wiped(two, two, np.zeros((0, 4)), 1) is None
    assert score.classes(np.array([[[255, 255, 255], [0, 0, 0], [225, 225, 225], [0, 0, 255], [150, 150, 150]]], np.uint8), np.array([[53.0, 80, 67]])).tolist() == [[0, 1, 2, 10, -1]]


def labels_and_reads(spark):
    labels = [("clean", 1, "Abc Def", 10.0, 90.0, 60.0, 99.0, 0.0), ("clean", 2, "a|b", 100.0, 90.0, 120.0, 99.0, 0.0), ("bad", 1, "Abc Def", 10.0, 90.0, 60.0, 99.0, 0.0), ("bad", 2, "300", 100.0, 90.0, 120.0, 99.0, 0.0), ("bad", 3, "450", 122.0, 90.0, 140.0, 99.0, 0.0)]
    reads = [(c, r, i, t, 0, x, 90.0, x + 20, 99.0) for c, r, i, t, x in (
        ("clean", "source", 1, "Abc", 10.0), ("clean", "source", 2, "Def", 40.0), ("clean", "result", 1, "AbcDef", 25.0), ("clean", "source", 3, "ab", 100.0), ("clean", "result", 3, "ab", 100.0),
        ("bad", "source", 1, "Abc Def", 25.0), ("bad", "result", 1, "A", 25.0), ("bad", "source", 2, "300450", 110.0), ("bad", "result", 2, "300450", 110.0),
    )]
    return spark.createDataFrame(labels, LABELS), spark.createDataFrame(reads, FOUND)


def test_scorer(spark, pictures):
    labels, reads = labels_and_reads(spark)
    rows = {(r["image_id"], r["id"]): r for r in score.text_rows(labels, reads).collect()}
    assert (rows["clean", 1]["ref_read"], rows["clean", 1]["ref_cer"], rows["clean", 1]["out_cer"], rows["clean", 1]["size_ratio"]) == ("AbcDef", 0.0, 0.0, 1.0)
    assert rows["clean", 2]["size_ratio"] is None and rows["bad", 1]["out_cer"] == 0.83
    got = {r["image_id"]: r for r in score.score(pictures, labels, reads).collect()}
    assert set(got) == {"clean", "bad"}
    clean, bad = got["clean"], got["bad"]
    assert (clean["color_f1"], clean["color_dE"], clean["ink_f1"], clean["extra_ink_blobs"], clean["lost_ink_symbols"], clean["lost_color_patches"], clean["text_ok"], clean["text_readable"], clean["size_err_median"]) == (1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 2, 0.0)
    assert bad["color_dE"] > 5 and bad["lost_ink_symbols"] == 2 and bad["extra_ink_blobs"] == 1 and (bad["text_ok"], bad["text_readable"]) == (0.0, 1)
    failed = {(r["image_id"], r["id"]) for r in score.read_back_failures(labels, reads).collect()}
    assert failed == {("bad", 1)}


def test_command_line(spark, pictures, tmp_path):
    labels, reads = labels_and_reads(spark)
    for run, keep in (("a", drawing()), ("b", damaged())):
        rows = [("case", role, *p.shape[:2], p.tobytes()) for role, p in (("source", drawing()), ("result", keep))]
        spark.createDataFrame(rows, PICTURE).write.parquet(str(tmp_path / run / "images"))
        labels.where("image_id = 'clean'").replace("clean", "case", ["image_id"]).write.parquet(str(tmp_path / run / "labels"))
        reads.where("image_id = 'clean'").replace("clean", "case", ["image_id"]).write.parquet(str(tmp_path / run / "detections"))
    from plumbline import __main__ as command

    assert command.main(["score", str(tmp_path / "a")]) == command.main(["score", str(tmp_path / "b")]) == command.main(["check", str(tmp_path / "b")]) == 0
    assert "| case | 1.0 |" in (tmp_path / "a" / "summary.md").read_text() and json.loads((tmp_path / "b" / "check.json").read_text())["case"]
    assert command.main(["compare", str(tmp_path / "a"), str(tmp_path / "a")]) == 0 and command.main(["compare", str(tmp_path / "a"), str(tmp_path / "b")]) == 1 and command.main([]) == 2
