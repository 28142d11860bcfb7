"""Operators over tables that a driver can't hold, or that several tasks read."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.operators import score, spatial
from plumbline.plans import adapted


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_touching_regions_without_broadcast(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), f"r{rng.randrange(9)}", 1020 + rng.randrange(-40, 40), rng.randrange(-30, 30)) for _ in range(300)]
    rows += [*rows[:20], ("q", None, 1, 1), ("q", "r1", None, 1), ("p", "alone", 5000, 5000)]
    for reach in (0, 2):
        found = spatial.touching_regions(spark.createDataFrame(rows, "image_id string, region string, x int, y int"), reach)
        whole = [r for r in rows if None not in r]
        near = {(m, a, b) for m, a, x, y in whole for n, b, v, w in whole if m == n and a < b and abs(x - v) <= reach and abs(y - w) <= reach}
        assert sorted(map(tuple, found.collect())) == sorted(near) and near
        assert "Broadcast" not in _plan(found)


def test_labels_read_without_broadcast(spark):
    rng = random.Random(6)
    box = lambda: (x := float(rng.randrange(400)), y := float(rng.randrange(200)), x + rng.randrange(1, 150), y + rng.randrange(1, 60))
    labels = [(rng.choice("pq"), i, rng.choice(("ab", "a|b", "")), *box(), 0.0) for i in range(30)]
    reads = [(rng.choice("pq"), rng.choice(("source", "result", "other")), i, rng.choice("abc"), i % 3, *box()) for i in range(80)]
    found = score.text_rows(spark.createDataFrame(labels, "image_id string, id int, text string, x0 double, y0 double, x1 double, y1 double, angle double"), spark.createDataFrame(reads, "image_id string, role string, id int, text string, ord int, x0 double, y0 double, x1 double, y1 double"))

    def hits(label, role):
        m, _, _, x0, y0, x1, y1, _ = label
        w, h = (x1 - x0) / 4 + 2, (y1 - y0) / 4 + 2
        centres = [((a + c) / 2, (b + d) / 2, o, t, d - b) for n, r, _, t, o, a, b, c, d in reads if (n, r) == (m, role)]
        return sorted((x, o, t, high) for x, y, o, t, high in centres if x0 - w <= x <= x1 + w and y0 - h <= y <= y1 + h)

    got = {(r["image_id"], r["id"]): r for r in found.collect()}
    assert len(got) == len(labels)
    for label in labels:
        row, drawn = got[label[:2]], hits(label, "result")
        assert (row["ref_read"], row["out_read"]) == ("".join(t for _, _, t, _ in hits(label, "source")), "".join(t for _, _, t, _ in drawn))
        assert (row["size_ratio"] is not None) == (len(drawn) == 1 and "|" not in label[2])
    assert any(r["size_ratio"] for r in got.values()) and "Broadcast" not in _plan(found)


def test_issues_at_a_limit_are_those_of_sums_in_table_order(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for supplier in range(80):  # discounts of 0.05 on average: their sum in doubles decides on the rules
        half = [rng.randrange(11) for _ in range(30)]
        rows += [(supplier, n / 100) for n in half + [10 - n for n in half]]
    rng.shuffle(rows)
    columns = {"l_suppkey": [s for s, _ in rows], "l_returnflag": ["N"] * len(rows), "l_discount": [d for _, d in rows], "l_tax": [0.06] * len(rows), "l_quantity": [30.0] * len(rows)}
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet", row_group_size=300)
    sums = {}
    for s, d in rows:
        sums[s] = sums.get(s, 0.0) + d
    expected = {(s, t) for s, x in sums.items() for t, broken in (("graphics_extra", x / 60 * 18 < 0.9), ("line_width", x / 60 * 12 > 0.6)) if broken}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {(r["l_suppkey"], r["type"]) for r in adapted.QUERIES["adapt_issue_flags"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {g for g in got if g[1] in ("graphics_extra", "line_width")} == expected and len({t for _, t in expected}) == 2


def test_textness_at_a_tie_is_that_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    suppliers = [next(s for s in range(b, 2000, 40) if 3 <= s % 25 <= 16) for b in range(20)]  # of b upright pieces, in boxes of text's height
    lines = [(40 * i, 100, suppliers[(i * 8 + j) % 20], 2 + j, 30.0, 0.0, 0.0) for i in range(41 * 5) for j in range(8)]
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    pq.write_table(pa.table(dict(zip(names, zip(*lines)))), tmp_path / "lineitem.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    expected = sorted(connection.sql(adapted.ORACLE_SQL["adapt_unlabeled_text"]).fetchall())
    got = adapted.QUERIES["adapt_unlabeled_text"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == expected and 0.57 in {r[2] for r in expected}
