"""Sequence operators: runs, gaps, merged intervals, dash patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(rows: DataFrame, key: str, order: str, on: str) -> DataFrame:
    """(key, value, start, length) of each run of equal ``on`` along ``order``: positions are dense from 1."""
    w = Window.partitionBy(key).orderBy(order)
    at = rows.select(F.col(key).alias("key"), F.col(on).alias("value"), F.row_number().over(w).alias("pos"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("key", "value").orderBy("pos"))
    return at.withColumn("island", island).groupBy("key", "value", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).drop("island")


def on_and_gaps(found: DataFrame) -> DataFrame:
    """(key, ons, gaps): lengths of on-runs and of the gaps between them, in order (value: 0 or 1)."""
    ends = found.where("value = 1").groupBy("key").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    inner = found.join(ends, "key").where("start between lo and hi")
    sorted_ = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("value") == v, F.struct("start", "length")))), lambda s: s["length"])
    return inner.groupBy("key").agg(sorted_(1).alias("ons"), sorted_(0).alias("gaps"))


def merge_intervals(rows: DataFrame, key: str, lo: str, hi: str, tolerance: float = 5, least: float = 80) -> DataFrame:
    """(key, lo, hi) of intervals merged across gaps up to ``tolerance``, those under ``least`` long left out."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(lo) > before + tolerance), 1).otherwise(0)
    flagged = rows.select(key, lo, hi, opens.alias("opens"))
    part = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = flagged.withColumn("part", part).groupBy(key, "part").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    return out.where(F.col("hi") - F.col("lo") >= least).drop("part")


def narrowest_interval(rows: DataFrame, key: str, value: str, share: float = 0.8) -> DataFrame:
    """(key, width): the least width that holds ``share`` of a key's values (k apart, k = floor(share * n))."""
    ranked = rows.select(F.col(key).alias("key"), F.col(value).alias("v"), F.row_number().over(Window.partitionBy(key).orderBy(value)).alias("rn"))
    n = ranked.groupBy("key").agg(F.floor(F.count("*") * share).alias("k"))
    left = ranked.join(n, "key")
    right = ranked.select("key", (F.col("rn")).alias("rn2"), F.col("v").alias("v2"))
    pairs = left.join(right, (left["key"] == right["key"]) & (left["rn"] + left["k"] == right["rn2"])).select(left["key"], (F.col("v2") - F.col("v")).alias("w"))
    return pairs.groupBy("key").agg(F.min("w").alias("width"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def _variation(xs: Column) -> Column:
    m = _mean(xs)
    return F.when(F.size(xs) > 0, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(xs)) / (m + 1e-6)).otherwise(9.9)


def _inner(xs: Column) -> Column:
    return F.when(F.size(xs) > 2, F.slice(xs, 2, F.size(xs) - 2)).otherwise(xs)


def _quantile(xs: Column, p: float) -> Column:
    """Linear between the order's neighbours."""
    s, at = F.array_sort(xs), (F.size(xs) - 1) * p
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def dash_statistics(profiles: DataFrame) -> DataFrame:
    """n_seg, dash, gap (medians), len_cv, gap_cv, long and dot from duty, ons and gaps, and raw_ons and raw_gaps where
    the columns are there (the runs before erosion); end runs are left out where there are more than two.

    Empty and solid profiles have no dash, gap and variations.  Of a dash-dot line the dash is the long one, the upper
    quartile of the raw runs; the dot is the lower one, and the gap that of the raw runs.
    """
    c = F.col
    raw_on, raw_off = (_inner(c(f"raw_{n}" if f"raw_{n}" in profiles.columns else n)) for n in ("ons", "gaps"))
    on, off = _inner(c("ons")), _inner(c("gaps"))
    median = lambda xs: F.when(F.size(xs) > 0, _median(xs)).otherwise(0.0)
    drawn = (F.size("ons") > 0) & (c("duty") <= 0.90)
    plain = (F.size("ons") >= 3) & (_median(on) >= 3)
    mid = _median(raw_on)
    dotted = drawn & plain & (F.size(raw_on) >= 4) & (mid > 0) & (F.array_max(raw_on) > 2.5 * mid) & (F.array_min(raw_on) < 0.5 * mid)
    out = profiles.withColumns({"n_seg": F.size("ons"), "dashdot": F.coalesce(dotted, F.lit(False)), "len_cv": F.when(drawn, _variation(on)), "gap_cv": F.when(drawn, _variation(off))})
    return out.withColumns({
        "long": F.when(c("dashdot"), _quantile(raw_on, 0.75)), "dot": F.when(c("dashdot"), _quantile(raw_on, 0.25)),
        "dash": F.when(c("dashdot"), _quantile(raw_on, 0.75)).when(drawn, _median(on)), "gap": F.when(c("dashdot"), median(raw_off)).when(drawn, median(off)),
    })


def line_kind(duty: Column, n_seg: Column, dash: Column, gap: Column, len_cv: Column, gap_cv: Column, dashdot: Column) -> Column:
    """'none', 'solid', 'sparse', 'dashdot', 'dashed' or 'irregular', of ``dash_statistics``."""
    regular = (len_cv < 0.40) & (gap_cv < 0.40)
    sound = (n_seg >= 4) & (duty >= 0.20) & (gap / F.greatest(dash, F.lit(1.0)) <= 3.0)
    return (
        F.when(n_seg == 0, "none").when(duty > 0.90, "solid").when(dashdot, "dashdot").when((n_seg < 3) | (dash < 3), "sparse")
        .when(regular & sound, "dashed").otherwise("irregular")
    )


def confidence(gap_cv: Column, len_cv: Column, duty: Column, dash: Column, gap: Column) -> Column:
    ratio = gap / F.greatest(dash, F.lit(1.0))
    high = (gap_cv < 0.25) & (len_cv < 0.30) & (duty >= 0.35) & (ratio <= 2.0)
    medium = (gap_cv < 0.40) & (len_cv < 0.40) & (duty >= 0.25) & (ratio <= 3.0)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def thin_points(points: Column, least: float, closed: bool = False) -> Column:
    """Points (x, y) at least ``least`` from the last one kept; the first is kept.  Of a closed sequence of three or more
    the last goes too if it is that near the first."""
    apart = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])

    def step(acc: Column, p: Column) -> Column:
        return F.when((F.size(acc) == 0) | (apart(p, F.element_at(acc, -1)) >= least), F.concat(acc, F.array(p))).otherwise(acc)

    def end(acc: Column) -> Column:
        shut = (F.size(acc) >= 3) & (apart(F.element_at(acc, 1), F.element_at(acc, -1)) < least)
        return F.when(shut, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc) if closed else acc

    return F.aggregate(points, F.slice(points, 1, 0), step, end)


def cut_corners(points: Column, rounds: int = 1) -> Column:
    """Corner cutting of an open polyline: a quarter and three quarters of every segment between its two ends, which
    stay; whole numbers towards zero at the end.  Two points or fewer stay as they are."""
    out = points
    for _ in range(rounds):
        inner = F.zip_with(F.slice(out, 1, F.size(out) - 1), F.slice(out, 2, F.size(out)), lambda a, b: F.array(_between(a, b, 0.25), _between(a, b, 0.75)))
        out = F.concat(F.slice(out, 1, 1), F.flatten(inner), F.slice(out, -1, 1))
    whole = F.transform(out, lambda p: F.struct(p["x"].cast("int").cast("double").alias("x"), p["y"].cast("int").cast("double").alias("y")))
    return F.when(F.size(points) < 3, points).otherwise(whole)


def _between(a: Column, b: Column, t: float) -> Column:
    return F.struct((a["x"] * (1 - t) + b["x"] * t).alias("x"), (a["y"] * (1 - t) + b["y"] * t).alias("y"))
