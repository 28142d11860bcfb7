"""Spatial joins over boxes and points: grid cells give an equi-join, the exact test follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import in_grown_box, iou


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def with_cells(boxes: DataFrame, size: float, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """A row for each grid cell that the box touches (gx, gy)."""
    return boxes.withColumn("gx", F.explode(_cells(x0, x1, size))).withColumn("gy", F.explode(_cells(y0, y1, size)))


def best_match(left: DataFrame, right: DataFrame, least: float = 0.3, size: float = 64.0, strict: bool = False) -> DataFrame:
    """Of boxes (image_id, id, x0, y0, x1, y1): each left one's right one of highest IoU of at least ``least`` (over it, if
    ``strict``); ties to the smaller id.

    Boxes that overlap share a cell; a pair counts once, in the cell of its overlap's corner.
    """
    cell = lambda df, p: with_cells(df, size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).select("image_id", "gx", "gy", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    pairs = cell(left, "l").join(cell(right, "r"), ["image_id", "gx", "gy"])
    own = (F.col("gx") == F.floor(F.greatest("l_x0", "r_x0") / size)) & (F.col("gy") == F.floor(F.greatest("l_y0", "r_y0") / size))
    scored = pairs.where(own).withColumn("iou", iou(["l_x0", "l_y0", "l_x1", "l_y1"], ["r_x0", "r_y0", "r_x1", "r_y1"])).where(F.col("iou") > least if strict else F.col("iou") >= least)
    rank = F.row_number().over(Window.partitionBy("image_id", "l_id").orderBy(F.desc("iou"), "r_id"))
    return scored.withColumn("rank", rank).where("rank = 1").select("image_id", F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "iou")


def points_in_boxes(boxes: DataFrame, points: DataFrame, size: float = 64.0, share: float = 0.25, pad: float = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, box_id, point_id, keep) of points (image_id, id, x, y and the columns ``keep``) in grown boxes (image_id, id,
    x0 ... y1).

    Both sides are shuffled: a table's estimated size says little about its rows for each cell.
    """
    w, h = (F.col("x1") - F.col("x0")) * share + pad, (F.col("y1") - F.col("y0")) * share + pad
    b = with_cells(boxes, size, F.col("x0") - w, F.col("y0") - h, F.col("x1") + w, F.col("y1") + h).withColumnRenamed("id", "box_id")
    p = points.select("image_id", F.col("id").alias("point_id"), "x", "y", *(k for k in keep if k not in ("x", "y")), F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    return b.join(p.hint("merge"), ["image_id", "gx", "gy"]).where(in_grown_box("x", "y", ["x0", "y0", "x1", "y1"], share, pad)).select("image_id", "box_id", "point_id", *keep)


def read_at(boxes: DataFrame, detections: DataFrame, size: float = 64.0) -> DataFrame:
    """Each box's text: detections (id, x, y, ord, text) in the grown box, joined from left to right; '' for none."""
    hits = points_in_boxes(boxes, detections, size)
    d = detections.select("image_id", F.col("id").alias("point_id"), F.col("x").alias("cx"), "ord", F.col("text").alias("t"))
    texts = hits.join(d, ["image_id", "point_id"]).groupBy("image_id", "box_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "ord", "t"))), lambda s: s["t"]), "").alias("read"))
    keyed = boxes.withColumnRenamed("id", "box_id")
    return keyed.join(texts, ["image_id", "box_id"], "left").withColumn("read", F.coalesce("read", F.lit("")))


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(image_id, a, b, d) of points (image_id, id, x, y) within ``radius``, both orders, none with itself."""
    own = points.select("image_id", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    other = points.withColumn("o", F.explode(around)).select("image_id", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.floor(F.col("x") / radius) + F.col("o.i")).alias("gx"), (F.floor(F.col("y") / radius) + F.col("o.j")).alias("gy"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return own.join(other, ["image_id", "gx", "gy"]).where("a <> b").withColumn("d", d).where(F.col("d") <= radius).select("image_id", "a", "b", "d")


def dense_points(points: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """(image_id, id, near) of points with ``least`` neighbours within ``radius``."""
    return near_pairs(points, radius).groupBy("image_id", F.col("a").alias("id")).agg(F.count("*").alias("near")).where(F.col("near") >= least)


def _around(df: DataFrame, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    """Nine rows of each, one for its grid cell and each one beside it (gx, gy)."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = df.withColumn("o", F.explode(around))
    return near.withColumn("gx", F.floor(F.col(x) / reach) + F.col("o.i")).withColumn("gy", F.floor(F.col(y) / reach) + F.col("o.j")).drop("o")


def matched_widths(marks: DataFrame, results: DataFrame, reach: float = 10.0, widest: float = 6.0) -> DataFrame:
    """Each thin mark (image_id, id, x, y, area, width) with the result mark of least area difference (ties to the smaller
    id) within ``reach`` each way, where its area is 0.3 to 3.5 times the mark's: (image_id, id, width, drawn)."""
    m = marks.where(F.col("width") <= widest).withColumn("gx", F.floor(F.col("x") / reach)).withColumn("gy", F.floor(F.col("y") / reach))
    r = _around(results, reach).select("image_id", "gx", "gy", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("area").alias("rarea"), F.col("width").alias("drawn"))
    near = m.join(r, ["image_id", "gx", "gy"]).where((F.abs(F.col("x") - F.col("rx")) < reach) & (F.abs(F.col("y") - F.col("ry")) < reach))
    best = near.groupBy("image_id", "id", "width", "area").agg(F.min_by(F.struct("drawn", "rarea"), F.struct(F.abs(F.col("area") - F.col("rarea")), F.col("rid"))).alias("best"))
    return best.where((F.col("best.rarea") / F.greatest("area", F.lit(1))).between(0.3, 3.5)).select("image_id", "id", "width", F.col("best.drawn").alias("drawn"))


def width_errors(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width_mae, width_rel): medians of the absolute and of the relative error, 2 places."""
    off = F.abs(F.col("width") - F.col("drawn"))
    return matched.groupBy(*keys).agg(F.bround(F.percentile(off, 0.5), 2).alias("width_mae"), F.bround(F.percentile(off / F.greatest("width", F.lit(1.0)), 0.5), 2).alias("width_rel"))


def ends_near(ends: DataFrame, tolerance: float, least: float = 0.5) -> DataFrame:
    """(image_id, a, b, straight) of line ends (image_id, end, line, x, y, ux, uy: the direction out of the line) of
    different lines, a < b, within ``tolerance`` and continuing each other by more than ``least``."""
    own = ends.withColumn("gx", F.floor(F.col("x") / tolerance)).withColumn("gy", F.floor(F.col("y") / tolerance))
    other = _around(ends, tolerance).select("image_id", "gx", "gy", *(F.col(c).alias(f"o_{c}") for c in ("end", "line", "x", "y", "ux", "uy")))
    straight = -(F.col("ux") * F.col("o_ux") + F.col("uy") * F.col("o_uy"))
    met = own.join(other, ["image_id", "gx", "gy"]).where("end < o_end and line <> o_line").where(F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")) <= tolerance)
    return met.select("image_id", F.col("end").alias("a"), F.col("o_end").alias("b"), straight.alias("straight")).where(F.col("straight") > least)


def joined_ends(pairs: DataFrame) -> DataFrame:
    """(image_id, a, b): the pairs of ``ends_near`` that are joined, best continuation first; each end once, no loops.
    Ends 2k and 2k + 1 belong to line k."""
    import pandas as pd

    from plumbline.operators.raster import join_ends

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = join_ends([(-s, a, b) for s, a, b in zip(rows.straight, rows.a, rows.b)], int(max(rows.a.max(), rows.b.max())) + 2)
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "a": [a for a, _ in got], "b": [b for _, b in got]})

    return pairs.groupBy("image_id").applyInPandas(run, "image_id long, a long, b long")


def stub_pairs(stubs: DataFrame, scale: float = 2.0, aligned: float = 0.9) -> DataFrame:
    """(image_id, box, a, b, gap) of line stubs (image_id, box, id, x, y, ux, uy, reach: the box's diagonal) of one box,
    a < b, whose gap is 2 scale to reach + 8 scale and lies along both.  A box's stubs are few."""
    one, two = (stubs.select("image_id", "box", *(F.col(c).alias(f"{p}{c}") for c in ("id", "x", "y", "ux", "uy")), *(["reach"] if p == "a_" else [])) for p in ("a_", "b_"))
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    met = one.join(two, ["image_id", "box"]).where("a_id < b_id").withColumn("gap", F.hypot(dx, dy)).where((F.col("gap") >= 2 * scale) & (F.col("gap") <= F.col("reach") + 8 * scale))
    along = lambda p: F.abs(dx * F.col(f"{p}ux") + dy * F.col(f"{p}uy")) / F.col("gap") >= aligned
    return met.where(along("a_") & along("b_")).select("image_id", "box", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "gap")


def zone_of_components(pixels: DataFrame, zones: DataFrame, size: float = 64.0) -> DataFrame:
    """(image_id, component, inside, pixels): how many of a component's pixels (image_id, component, x, y) lie in any zone
    (image_id, id, x0 ... y1, edges included); those with inside = pixels leave no zone, those with 0 < inside < pixels do."""
    z = with_cells(zones, size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).select("image_id", "gx", "gy", "x0", "y0", "x1", "y1")
    p = pixels.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))
    held = p.join(z, (p["image_id"] == z["image_id"]) & (p["gx"] == z["gx"]) & (p["gy"] == z["gy"]) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")), "left_semi")
    inside = held.groupBy("image_id", "component").agg(F.count("*").alias("inside"))
    return pixels.groupBy("image_id", "component").agg(F.count("*").alias("pixels")).join(inside, ["image_id", "component"], "left").select("image_id", "component", F.coalesce("inside", F.lit(0)).alias("inside"), "pixels")


def touching_regions(pixels: DataFrame, reach: int = 2, size: int = 1024) -> DataFrame:
    """(image_id, a, b), a < b: regions whose pixels (image_id, region, x, y) come within ``reach`` of each other each way.

    A task holds the different pixels of one square of ``size`` and those ``reach`` around it; nothing is broadcast.
    """
    import pandas as pd

    from plumbline.operators.raster import regions_near

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = regions_near(rows.x.to_numpy(), rows.y.to_numpy(), rows.region.to_numpy(), reach)
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "a": a, "b": b})

    image, region = (pixels.schema[c].dataType.simpleString() for c in ("image_id", "region"))
    x, y = F.col("x"), F.col("y")
    own = pixels.select("image_id", "region", x.cast("long").alias("x"), y.cast("long").alias("y")).dropna()
    dealt = with_cells(own, size, x - reach, y - reach, x + reach, y + reach).repartition("image_id", "gx", "gy").distinct()
    return dealt.groupBy("image_id", "gx", "gy").applyInPandas(run, f"image_id {image}, a {region}, b {region}").distinct()
