"""Label pipeline: votes over readings, uncertainty, selection, patches, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import half_even_double, has_cjk, iou, norm_reading, numeric_with_unit, roman_like
from plumbline.operators.spatial import with_cells

LEAST_SCORE, LEAST_VOTES = 0.9, 4
#: The reasons that a record of a candidate holds.
EMPTY = "empty"
ROMAN = "roman-numeral-like token: kept as traced linework"
SINGLE = "single non-CJK character: treated as symbol/noise"
SHORT = "single weak OCR read: short non-numeric token, likely a symbol"
WEAK = "single weak OCR read: not placed, check the review sheet"
LOW = "low-confidence non-CJK reading"


def vote(readings: DataFrame, cluster: str, text: str, score: str, order: str, normalise=norm_reading) -> DataFrame:
    """Per cluster: the reading with the greatest sum of score**4, its best form, votes and agreement.

    Ties go to the reading met first in falling score (``order`` breaks equal scores).
    """
    rows = readings.select(F.col(cluster).alias("cluster"), normalise(F.col(text)).alias("key"), F.col(text).alias("form"), F.col(score).cast("double").alias("score"), F.col(order).alias("ord"))
    best = F.struct((-F.col("score")).alias("neg"), F.col("ord"))
    keys = rows.groupBy("cluster", "key").agg(F.sum(F.pow("score", F.lit(4.0))).alias("weight"), F.count("*").alias("votes"), F.max("score").alias("score"), F.min_by("form", best).alias("text"), F.min(best).alias("met"))
    total = F.sum("weight").over(Window.partitionBy("cluster"))
    reads = F.sum("votes").over(Window.partitionBy("cluster"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "met"))
    won = keys.select("cluster", "text", "key", "score", "votes", reads.alias("reads"), F.bround(F.col("weight") / total, 2).alias("agreement"), rank.alias("rank"))
    return won.where("rank = 1").drop("rank")


def uncertain(score: Column, votes: Column, reads: Column, note: Column | None = None) -> Column:
    """Why a winner must be checked, reasons joined by '; '; null where it need not be."""
    reasons = [] if note is None else [note]
    reasons += [
        F.when(score < LEAST_SCORE, F.concat(F.lit("low OCR score "), score.cast("string"))),
        F.when(votes < LEAST_VOTES, F.concat(F.lit("only "), votes.cast("string"), F.lit("/"), reads.cast("string"), F.lit(" reads agree"))),
    ]
    return F.nullif(F.concat_ws("; ", *reasons), F.lit(""))


def degree_support(readings: Column, text: Column) -> Column:
    """struct(votes, score) of a degree label: its readings with and without the sign, or a misread one, count as one.

    ``readings`` are structs (text, score, note); those with a note don't vote.
    """
    core = F.substr(text, F.lit(1), F.length(text) - 1)
    same = F.filter(readings, lambda r: r["note"].isNull() & F.startswith(norm_reading(r["text"]), core) & (F.length(norm_reading(r["text"])) <= F.length(core) + 1))
    return F.struct(F.size(same).alias("votes"), F.coalesce(F.array_max(F.transform(same, lambda r: r["score"])), F.lit(0.0)).alias("score"))


def skip_reason(text: Column, score: Column, votes: Column, why: Column) -> Column:
    """The first rule that keeps a candidate from being placed; null where it is used.  Null scores and votes pass."""
    t = norm_reading(text)
    weak, short = F.coalesce(score, F.lit(1.0)) < 0.5, F.length(t)
    return (
        F.when(t == "", EMPTY)
        .when(roman_like(t), ROMAN)
        .when((short == 1) & ~has_cjk(t) & ~F.rlike(t, F.lit(r"^\d$")), SINGLE)
        .when((short <= 3) & ~has_cjk(t) & why.isNotNull() & ~numeric_with_unit(t), SHORT)
        .when(weak & (F.coalesce(votes, F.lit(2)) <= 1), WEAK)
        .when(weak & ~has_cjk(t), LOW)
    )


def baseline_used(text: Column, best: Column) -> Column:
    t = norm_reading(text)
    return (best >= 0.5) & ~roman_like(t) & ((F.length(t) > 1) | has_cjk(t)) & (t != "")


def suggested(candidates: DataFrame) -> DataFrame:
    """Used candidates as labels; texts with a bar become one label for each split box."""
    parts = F.when(F.col("split_boxes").isNotNull() & F.contains("text", F.lit("|")), F.arrays_zip(F.split("text", r"\|").alias("text"), F.col("split_boxes").alias("box"))).otherwise(
        F.array(F.struct(F.col("text"), F.col("box")))
    )
    rows = candidates.where("skip_reason is null").select("image_id", "ord", "angle", F.posexplode(parts).alias("part", "p"), F.col("split_boxes").isNotNull().alias("split"))
    return rows.where("p.text is not null and p.box is not null").select("image_id", "ord", "part", F.col("p.text").alias("text"), F.col("p.box").alias("box"), F.when(F.col("split"), 0.0).otherwise(F.col("angle")).alias("angle"))


def apply_patch(labels: DataFrame, changes: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """``changes`` (id, text, box, drop): set, drop or move known labels; an empty text drops; unknown ids do nothing."""
    c = changes.select("id", F.col("text").alias("_text"), F.col("box").alias("_box"), F.col("drop").alias("_drop"))
    out = labels.join(c, "id", "left").where(~F.coalesce("_drop", F.lit(False)) & (F.coalesce("_text", F.lit("x")) != ""))
    out = out.withColumn("text", F.coalesce("_text", "text")).withColumn("box", F.coalesce("_box", "box")).drop("_text", "_box", "_drop")
    return out if added is None else out.unionByName(added, allowMissingColumns=True)


def may_deliver(open_items: Column, accepted: Column, rounds: Column) -> Column:
    return (open_items == 0) | accepted | (rounds >= 3)


def workflow_step(running: Column, delivered: Column, ok: Column, still_open: Column, pending: Column) -> Column:
    return (
        F.when(running, "running").when(F.coalesce(delivered, F.lit(False)), "delivered")
        .when(~ok & (F.coalesce(delivered, F.lit(True)) == F.lit(False)) & (still_open > 0), "blocked")
        .when(~ok, "failed").when(pending > 0, "review").otherwise("converged")
    )


def patched_candidates(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """Candidates (ord, text, box, use, split_boxes) after a patch (number, text, box, drop), from the original ones.

    A text puts the candidate to use, whole; an empty one, or drop, takes it out.  A box only moves it.  Numbers
    without a candidate do nothing.
    """
    c = changes.select(F.col("number").alias("ord"), F.trim("text").alias("_text"), F.col("box").alias("_box"), F.coalesce("drop", F.lit(False)).alias("_drop"))
    rows = candidates.join(c, "ord", "left")
    said = F.coalesce(F.col("_text") != "", F.lit(False))
    use = F.when(F.col("_drop") | (F.col("_text") == ""), False).when(said, True).otherwise(F.coalesce("use", F.lit(True)))
    out = rows.withColumns({"use": use, "text": F.when(said, F.col("_text")).otherwise(F.col("text")), "box": F.coalesce("_box", "box"), "split_boxes": F.when(~said, F.col("split_boxes"))})
    return out.drop("_text", "_box", "_drop")


def new_readings(extras: DataFrame, known: DataFrame, limit: float = 0.3, size: float = 64.0) -> DataFrame:
    """The extras (image_id, id, x0 ... y1, ord) that overlap no known box by more than ``limit``, nor an earlier extra
    that stays: boxes are taken in the order of ``ord``, image by image."""
    import pandas as pd

    from plumbline.operators.raster import first_apart

    cell = lambda df, p: with_cells(df, size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).select("image_id", "gx", "gy", *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")), *(["id"] if p == "e" else []))
    corners = ("x0", "y0", "x1", "y1")
    met = cell(extras, "e").join(cell(known, "k"), ["image_id", "gx", "gy"]).where(iou([f"e{c}" for c in corners], [f"k{c}" for c in corners]) > limit)
    left = extras.join(met.select("image_id", "id").distinct(), ["image_id", "id"], "left_anti")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        return rows[first_apart(rows[list(corners)].to_numpy(float), limit)]

    return left.groupBy("image_id").applyInPandas(run, left.schema)


def unlabeled_text(groups: DataFrame, limit: int = 8) -> DataFrame:
    """The groups of glyph-like pieces that may be text nobody has read, at most ``limit`` an image by textness.

    groups: image_id, id, w, h, glyph_h (the image's usual height), covered, coloured and fill (shares of the box),
    pieces, holes (area within pieces), bars (ink in upright bars), ink.
    """
    c, area = F.col, F.col("w") * F.col("h")
    sized = c("h").between(0.6 * c("glyph_h"), 1.8 * c("glyph_h")) & c("w").between(0.6 * c("glyph_h"), 10 * c("glyph_h"))
    shaped = c("fill").between(0.08, 0.55) & (c("pieces") >= 2) & (c("holes") < 0.08 * area) & (c("bars") < 0.5 * c("ink"))
    found = groups.where(sized & (c("covered") <= 0.2) & (c("coloured") <= 0.05) & shaped)
    found = found.withColumn("textness", half_even_double((c("ink") - c("bars")) / F.greatest(c("ink"), F.lit(1)), 2))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("textness"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def split_rows(labels: DataFrame) -> DataFrame:
    """(image_id, id, parts, spans, note) of labels (image_id, id, text, glyph_h, columns: whether each has ink) that are
    several on one row; note says that gaps were found which don't fit the text.  Others are left out."""
    import pandas as pd

    from plumbline.operators.raster import row_parts

    def run(batches):
        for rows in batches:
            got = [(r.image_id, r.id, *row_parts(r.text, list(r.columns_), r.glyph_h)) for r in rows.itertuples()]
            yield pd.DataFrame([g for g in got if g[2] is not None or g[4]], columns=["image_id", "id", "parts", "spans", "note"])

    rows = labels.select("image_id", "id", norm_reading("text").alias("text"), "glyph_h", F.col("columns").alias("columns_"))
    cjk = rows.where((F.length("text") >= 4) & F.rlike("text", F.lit("^[一-鿿]+$")))
    return cjk.mapInPandas(run, "image_id long, id long, parts array<string>, spans array<struct<a:int,b:int>>, note string")
