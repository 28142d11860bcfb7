"""Fidelity metrics: ratios from counts, text scores, issues, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import or_default

#: Metric, whether more is better, and the change that counts.
TOLERANCES = [
    ("color_f1", 1, 0.02), ("color_dE", -1, 1.5), ("ink_f1", 1, 0.02), ("grid_f1", 1, 0.04), ("extra_ink_blobs", -1, 2.0),
    ("lost_ink_symbols", -1, 2.0), ("lost_color_patches", -1, 2.0), ("text_ok", 1, 0.03), ("size_err_median", -1, 0.05),
]


def ratio(part: Column, whole: Column, empty: Column | None = None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0) if empty is None else empty)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def prf(ref: Column, cand: Column, ref_hit: Column, cand_hit: Column, places: int = 4) -> list[Column]:
    """Recall, precision and F1 from pixel counts; a zero denominator gives 0."""
    r, p = ratio(ref_hit, ref), ratio(cand_hit, cand)
    return [F.bround(r, places).alias("recall"), F.bround(p, places).alias("precision"), F.bround(f1(p, r), places).alias("f1")]


def class_f1(ref: Column, cand: Column, ref_hit: Column, cand_hit: Column) -> Column:
    """Null where neither side has the class."""
    r, p = ratio(ref_hit, ref), ratio(cand_hit, cand)
    return F.when((ref > 0) | (cand > 0), F.bround(f1(p, r), 3))


def cell_of(v: Column, size: Column, cells: int) -> Column:
    """A coordinate's cell, null in the remainder that no cell holds."""
    c = F.floor(v / F.greatest(F.lit(1), F.floor(size / cells))).cast("int")
    return F.when(c < cells, c)


def grid_ratios(pixels: DataFrame, images: DataFrame, gx: int = 12, gy: int = 9) -> DataFrame:
    """(image_id, row, col, ref_px, cand_px, recall, precision) of every cell of every image (image_id, width, height).

    pixels: image_id, x, y, ref, cand, ref_hit, cand_hit (0 or 1).  What is left over at the right and lower edges is in
    no cell; a ratio without pixels is null; 3 places.
    """
    sized = pixels.join(images.select("image_id", "width", "height"), "image_id")
    cells = sized.withColumn("col", cell_of(F.col("x"), F.col("width"), gx)).withColumn("row", cell_of(F.col("y"), F.col("height"), gy)).where("col is not null and row is not null")
    sums = cells.groupBy("image_id", "row", "col").agg(*(F.sum(c).alias(c) for c in ("ref", "cand", "ref_hit", "cand_hit")))
    every = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(gy - 1))).alias("row")).select("image_id", "row", F.explode(F.sequence(F.lit(0), F.lit(gx - 1))).alias("col"))
    out = every.join(sums, ["image_id", "row", "col"], "left").fillna(0, ["ref", "cand", "ref_hit", "cand_hit"])
    none = F.lit(None).cast("double")
    return out.select("image_id", "row", "col", F.col("ref").alias("ref_px"), F.col("cand").alias("cand_px"), F.bround(ratio(F.col("ref_hit"), F.col("ref"), none), 3).alias("recall"), F.bround(ratio(F.col("cand_hit"), F.col("cand"), none), 3).alias("precision"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Of already rounded values, nulls and their weights left out."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def region_iou(counts: DataFrame, keys: list[str], least: int = 200) -> DataFrame:
    """Source-weighted intersection over union of colour regions (both, src, res) with ``least`` source pixels."""
    kept = counts.where(F.col("src") >= least).withColumn("iou", F.col("both") / (F.col("src") + F.col("res") - F.col("both")))
    return kept.groupBy(*keys).agg(F.bround(weighted_mean(F.col("iou"), F.col("src")), 3).alias("region_iou"), F.count("*").alias("regions"))


def text_score(rows: DataFrame, keys: list[str], limit: float = 0.34) -> DataFrame:
    """Readable and kept labels from ref_cer and out_cer (2 places) and the median size error of readable ones."""
    ref, out = F.bround("ref_cer", 2) <= limit, F.bround("out_cer", 2) <= limit
    size = F.when(ref, F.abs(F.col("size_ratio") - 1)) if "size_ratio" in rows.columns else F.lit(None).cast("double")
    agg = rows.groupBy(*keys) if keys else rows.groupBy()
    out = agg.agg(F.count_if(ref).alias("readable"), F.count_if(ref & out).alias("ok"), F.bround(F.percentile(size, 0.5), 2).alias("size_err_median"))
    return out.withColumn("text_ok", F.when(F.col("readable") > 0, F.bround(F.col("ok") / F.col("readable"), 3)))


def read_back_failed(angle: Column, src_cer: Column, res_cer: Column, in_source: Column) -> Column:
    """Labels near the horizontal whose source could be read and whose result reads worse by over 0.1."""
    return (F.abs(angle) <= 4) & ((src_cer <= 0.34) | in_source) & (res_cer > src_cer + 0.1)


def own_text(read: Column, own: Column, others: Column) -> Column:
    """A read without the other labels' texts in it: each of ``others`` (different texts, the longest first) is taken out
    once, but none that is part of the label's own text.  All are normalised by the caller."""
    return F.aggregate(others, read, lambda left, o: F.when((o == "") | F.contains(own, o) | ~F.contains(left, o), left).otherwise(_without(left, o)))


def _without(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part), F.length(text)))


def longest_first(texts: Column) -> Column:
    """Different texts by falling length; texts of one length in their order."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(texts), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])


def coverage(ink: Column, missing: Column) -> Column:
    """Also precision, of drawn and extra pixels: 1 where there is nothing to cover."""
    return F.when(ink > 0, 1 - missing / ink).otherwise(F.lit(1.0))


def colour_recall(coloured: Column, missing: Column, least: int = 200) -> Column:
    """Null where too little is coloured to say."""
    return F.when(coloured > least, 1 - missing / coloured)


def lost_element(area: Column, page: Column, width: Column, height: Column, close_share: Column) -> Column:
    """Whether a compact element (12 pixels to 2 % of the page, sides within 8 to 1) is hardly met by like colours."""
    compact = (area >= 12) & (area <= 0.02 * page) & (F.greatest(width, height) <= 8 * F.least(width, height))
    return compact & (close_share < 0.4)


def element_kept(area: Column, core: Column, skeleton: Column, least: int = 12) -> Column:
    """Whether a component is a body (4 pixels survive erosion) or a run (10 pixels of skeleton), and no speckle."""
    return (area >= least) & ((core >= 4) | (skeleton >= 10))


def spill_reported(spilled: Column, ink: Column) -> Column:
    return (ink > 0) & (spilled >= F.greatest(F.lit(60.0), 0.002 * ink))


def issue_flags() -> Column:
    """Names of the rules that a row of structural metrics breaks; 0 counts as not measured, as null does."""
    d = or_default
    rules = [
        ("graphics_missing", F.col("coverage") < 0.9),
        ("lost_elements", d("lost", 0) > 0),
        ("graphics_extra", F.col("precision") < 0.9),
        ("colour_mismatch", F.col("colour_recall") < 0.85),
        ("elements_missing", (d("missing_significant", 0) >= 3) & (d("mark_recall", 1) < 0.85)),
        ("line_width", (d("width_rel", 0) > 0.6) & (d("width_mae", 0) > 1)),
        ("ink_extra", d("ink_extra_share", 0) > 0.01),
        ("ink_missing", d("ink_missing_share", 0) > 0.01),
        ("regions_shifted", d("region_iou", 1) < 0.85),
        ("boundary_shift", (d("edge_p75_px", 0) > 5) & (d("region_iou", 1) < 0.92)),
        ("fragmented", d("objects", 0) > 3 * d("src_elements", 1e18)),
    ]
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


#: Each rule's stage, what it says with the metrics' numbers, and what may help.
_SAY = {
    "graphics_missing": ("graphics", lambda c: F.format_string("%.0f%% of the source's graphics are drawn", 100 * c("coverage")), "colour content needs more colours, thin lines the line mode"),
    "lost_elements": ("graphics", lambda c: F.format_string("%d small solid elements are missing or have another colour", c("lost").cast("int")), "a lost colour needs more colours, a lost black sign the line mode"),
    "graphics_extra": ("graphics", lambda c: F.format_string("%.0f%% of what is drawn has no counterpart", 100 * (1 - c("precision"))), "often text that was not read or stands elsewhere"),
    "colour_mismatch": ("graphics", lambda c: F.format_string("%.0f%% of the coloured area has a matching colour", 100 * c("colour_recall")), "colour mode with more colours"),
    "elements_missing": ("graphics", lambda c: F.format_string("%d small elements of the source are not drawn", c("missing_significant").cast("int")), "more colours, or the line mode for black signs"),
    "line_width": ("graphics", lambda c: F.format_string("line widths are off by %.2f px (%.0f%%)", c("width_mae"), 100 * c("width_rel")), "rims or strokes were measured wrong"),
    "ink_extra": ("graphics", lambda c: F.format_string("%.1f%% of the page is painted much darker than the source", 100 * c("ink_extra_share")), "something was filled that should not be"),
    "ink_missing": ("graphics", lambda c: F.format_string("%.1f%% of the page has lost its dark content", 100 * c("ink_missing_share")), "linework was dropped"),
    "regions_shifted": ("graphics", lambda c: F.format_string("colour regions overlap the source by %.3f", c("region_iou")), "a region has another colour, is shifted or painted over"),
    "boundary_shift": ("graphics", lambda c: F.format_string("region boundaries stand %.2f px from the source's edges", c("edge_p75_px")), "too much smoothing, or a wrong edge"),
    "fragmented": ("graphics", lambda c: F.format_string("%d objects for %d elements of the source", c("objects").cast("int"), c("src_elements").cast("int")), "the region model, or more smoothing"),
}


def issue_records(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, stage, detail, hint, regions): one row for each rule that a row of metrics breaks.

    Regions come from a map column ``regions`` (type to boxes) where the metrics have one.
    """
    c = lambda n: F.col(n).cast("double")
    regions = F.try_element_at("regions", F.col("type")) if "regions" in metrics.columns else F.lit(None).cast("array<array<int>>")
    pick = lambda i: F.coalesce(*(F.when(F.col("type") == name, said[i](c) if callable(said[i]) else F.lit(said[i])) for name, said in _SAY.items()))
    return metrics.withColumn("type", F.explode(issue_flags())).select(*keys, "type", pick(0).alias("stage"), pick(1).alias("detail"), pick(2).alias("hint"), regions.alias("regions"))


def long_metrics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return wide.unpivot([F.col(k) for k in keys], [F.col(n).cast("double").alias(n) for n in names], "metric", "value").where("value is not null")


def compare_runs(a: DataFrame, b: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Each case and metric of both runs (case_id, metric, value) with 'regression', 'better' or 'same'."""
    both = b.select("case_id", "metric", F.col("value").alias("after")).join(a.select("case_id", "metric", F.col("value").alias("before")), ["case_id", "metric"])
    change = F.col("sign") * (F.col("after") - F.col("before"))
    flag = F.when(change < -F.col("tol"), "regression").when(change > F.col("tol"), "better").otherwise("same")
    return both.join(F.broadcast(tolerances), "metric").select("case_id", "metric", "before", "after", flag.alias("flag"))  # nine rows by definition


def dominant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value met most often per key; ties go to the smallest."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return n.withColumn("rank", rank).where("rank = 1").drop("rank")


def apportion(rows: DataFrame, keys: list[str], weight: str, total: Column, order: str) -> DataFrame:
    """Largest remainders: whole shares of ``total`` by weight that add up to it; ties by ``order``."""
    w = Window.partitionBy(*keys)
    exact = total * F.col(weight) / F.sum(weight).over(w)
    out = rows.withColumn("_base", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    rank = F.row_number().over(w.orderBy(F.desc("_rest"), order))
    left = total - F.sum("_base").over(w)
    return out.withColumn("share", (F.col("_base") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_base", "_rest")


def clear_winner(votes: DataFrame, keys: list[str], choice: str, least: int = 2, lead: float = 1.5) -> DataFrame:
    """The choice with the most votes, where it has ``least`` and ``lead`` times the next one's."""
    n = votes.groupBy(*keys, choice).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), choice)
    ranked = n.select("*", F.row_number().over(by).alias("rank"), F.lead("n").over(by).alias("next"))
    return ranked.where((F.col("rank") == 1) & (F.col("n") >= least) & (F.col("n") >= lead * F.coalesce("next", F.lit(0)))).drop("rank", "next")


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value, in order, at which half of the weight is reached."""
    upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    all_ = F.sum(weight).over(Window.partitionBy(*keys))
    return rows.withColumn("_r", upto / all_).where("_r >= 0.5").groupBy(*keys).agg(F.min(value).alias("median"))


def largest_regions(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def added_in_order(rows: DataFrame, keys: list[str], order: list, aggregates: dict[str, Column]) -> DataFrame:
    """(keys, aggregates): each key's rows, added one by one in ``order``.  Sums of doubles depend on it, and a rule's limit
    may lie within that; partial sums of tasks have no order of their own."""
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead(F.lit(True)).over(by).isNull()
    return rows.select(*keys, *(a.over(upto).alias(n) for n, a in aggregates.items()), last.alias("_last")).where("_last").drop("_last")


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("image_id", "type").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.sum("n").alias("open"), F.sort_array(F.collect_list("type")).alias("types"))
