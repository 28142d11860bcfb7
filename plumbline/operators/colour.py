"""Colour operators: kinds, nearest palette entries, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def palette_kind(lightness: Column, chroma: Column) -> Column:
    """Of 8-bit Lab: 'ink', 'grid' or 'color'."""
    return F.when((chroma < 22) & (lightness < 130), "ink").when((chroma < 16) & (lightness >= 130), "grid").otherwise("color")


def nearest(vector: Column, palette: Column | list[tuple[int, list[float]]], limit: float | None = None, light: float | None = None, places: int | None = None) -> Column:
    """struct(d, id) of the nearest entry of a palette: a list, which becomes a literal, or an array of structs (id, c).

    Ties go to the smaller id.  With ``light``, vectors are Lab and the distance is that of a and b plus ``light`` times
    that of L; with ``limit``, entries so far away or farther are none; ``places`` rounds distances before they are compared.
    """
    entries = palette if isinstance(palette, Column) else F.array(*(F.struct(F.lit(i).alias("id"), F.array(*(F.lit(float(x)) for x in c)).alias("c")) for i, c in palette))

    def d(c: Column) -> Column:
        far = distance(vector, c) if light is None else F.hypot(vector[1] - c[1], vector[2] - c[2]) + light * F.abs(vector[0] - c[0])
        return far if places is None else F.round(far, places)

    found = F.array_min(F.transform(entries, lambda e: F.struct(d(e["c"]).alias("d"), e["id"].alias("id"))))
    return found if limit is None else F.when(found["d"] < limit, found)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def paper_or(vector: Column, least: Column, palette, paper_min: float = 238.0) -> Column:
    """The nearest entry's id, -1 where the pixel's least channel is that of paper."""
    return F.when(least >= paper_min, F.lit(-1)).otherwise(nearest(vector, palette)["id"])


def score_class(light: Column, chroma: Column, least: Column, nearest_id: Column) -> Column:
    """A pixel's class from its Lab (L to 100) and least channel: -1 edge, 0 paper, 1 ink, 2 grid, 10 + colour.

    Later rules take what earlier ones had: colours first here, paper last.
    """
    neutral = chroma < 12
    return (
        F.when((chroma >= 18) & (least < 240) & nearest_id.isNotNull(), 10 + nearest_id)
        .when(neutral & (light >= 72) & (least < 238), 2).when(neutral & (light < 55), 1).when(least >= 238, 0).otherwise(-1)
    )


def blend_of(colour: Column, one: Column, other: Column) -> Column:
    """struct(t, d): where between two colours a third one lies, and how far from their line."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    across = less(other, one)
    t = dot(less(colour, one), across) / F.greatest(dot(across, across), F.lit(1.0))
    return F.struct(t.alias("t"), distance(F.zip_with(one, across, lambda x, y: x + t * y), colour).alias("d"))


def is_blend(colour: Column, one: Column, other: Column, limit: float = 30.0, clipped: bool = False) -> Column:
    """Whether a colour lies between two others (t of 0.05 to 0.95) and within ``limit`` of their line; ``clipped`` takes
    the nearest point of the segment instead."""
    if clipped:
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend_of(colour, one, other)["t"]))
        return distance(F.zip_with(one, other, lambda x, y: x + t * (y - x)), colour) < limit
    found = blend_of(colour, one, other)
    return found["t"].between(0.05, 0.95) & (found["d"] < limit)


def layer_order(kind: Column, area: Column) -> list[Column]:
    """Paint order: large colour regions first, then smaller ones, grid, faint ink, ink."""
    return [F.when(kind == "grid", 1).when(kind == "ink_faint", 2).when(kind == "ink", 3).otherwise(0), F.desc_nulls_last(area) if isinstance(area, str) else area.desc()]


def layer_kept(area: Column, page: Column, has_core: Column, least: float = 20.0) -> Column:
    return (area >= least) & ((area >= 0.0004 * page) | has_core)


def darkest_mean(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, mean): of each group's values up to its ``share`` quantile (linear), as ink, rim and fill colours are read."""
    cut = rows.groupBy(*keys).agg(F.percentile(value, share).alias("_cut"))
    return rows.join(cut, keys).where(F.col(value) <= F.col("_cut")).groupBy(*keys).agg(F.avg(value).alias("mean"))


def content_mode(content: Column, chromatic_share: Column, fill_share: Column) -> Column:
    return F.when(content < 100, "lineart").when((chromatic_share > 0.05) | (fill_share > 0.005), "color").otherwise("lineart")


def flat_gate(flat: Column, texture: Column, specks: Column, major: Column, coloured: Column) -> Column:
    """Whether the region model applies; tested on unrounded shares."""
    return (flat >= 0.80) & (texture <= 0.01) & (specks <= 3.0) & major.between(2, 24) & (coloured >= 0.5)


def lab_histogram(pixels: DataFrame, keys: list[str], step: int = 3) -> DataFrame:
    """(keys, bin, n, L, a, b): counts and means of pixels by bins of ``step`` in each channel."""
    bins = F.struct(*(F.floor(F.col(c) / step).alias(c) for c in ("L", "a", "b")))
    return pixels.withColumn("bin", bins).groupBy(*keys, "bin").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("L", "a", "b")))


def paper_level(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median within 8 of the most frequent light level (over 150; ties to the darker); 255 where fewer than 100 are light."""
    counts = pixels.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.when(F.col(value) > 150, F.col(value)), F.when(F.col(value) > 150, F.struct(-F.col("n"), F.col(value))))
    mode = counts.groupBy(*keys).agg(best.alias("peak"), F.sum(F.when(F.col(value) > 150, F.col("n")).otherwise(0)).alias("light"))
    near = pixels.join(mode, keys).where(F.abs(F.col(value) - F.col("peak")) <= 8).groupBy(*keys).agg(F.percentile(value, 0.5).alias("near"))
    return mode.join(near, keys, "left").select(*keys, F.when(F.col("light") >= 100, F.col("near")).otherwise(255.0).alias("paper"))


def kmeans_palette(pixels: DataFrame, columns: list[str], k: int, seed: int = 0):
    """Palette centres by k-means++ on the JVM; centres agree with another implementation's only by tolerance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(pixels)
    return [list(map(float, c)) for c in KMeans(k=k, seed=seed).fit(rows).clusterCenters()]


#: Recipes: weights of L, a, b; centres; how near centres are merged; their order; the least share of the pixels.
RECIPES = {
    "layers": {"weights": (0.5, 1.6, 1.6), "k": 6, "merge": 11.0, "order": "dark", "share": 0.0},
    "source": {"weights": (1.0, 1.0, 1.0), "k": 24, "merge": 12.0, "order": "light", "share": 0.0},
    "reference": {"weights": (1.0, 1.0, 1.0), "k": 8, "merge": 12.0, "order": "count", "share": 0.01},
}


def merged_centres(centres: list[tuple[list[float], int]], merge: float, order: str, share: float = 0.0) -> list[list[float]]:
    """Centres (Lab, pixels) in the recipe's order, without those nearer than ``merge`` to one already taken."""
    total = sum(n for _, n in centres)
    by = {"dark": lambda c: c[0][0], "light": lambda c: -c[0][0], "count": lambda c: -c[1]}[order]
    out: list[list[float]] = []
    for c, n in sorted(centres, key=by):
        if n >= share * total and all(sum((x - y) ** 2 for x, y in zip(c, o)) ** 0.5 > merge for o in out):
            out.append(list(c))
    return out


def recipe_palette(pixels: DataFrame, recipe: str, seed: int = 0) -> list[list[float]]:
    """A palette of pixels (L, a, b) by one of the ``RECIPES``; the caller leaves paper out."""
    r = RECIPES[recipe]
    scaled = pixels.select(*(F.col(c) * w for c, w in zip(("L", "a", "b"), r["weights"]))).toDF("L", "a", "b")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["L", "a", "b"], outputCol="features").transform(scaled)
    model = KMeans(k=r["k"], seed=seed, maxIter=40).fit(rows)
    centres = [([float(x) / w for x, w in zip(c, r["weights"])], n) for c, n in zip(model.clusterCenters(), model.summary.clusterSizes)]
    return merged_centres(centres, r["merge"], r["order"], r["share"])


def flat_palette(pixels: DataFrame, total: int, merge: float = 9.0, near: float = 10.0, most: int = 32) -> list[tuple[list[float], int]]:
    """Centres (Lab) and pixels of the flat colours of one image (pixels: L, a, b), most frequent first.

    Bins of 3 are taken by falling count (ties to the smaller bin) unless their mean is within ``merge`` of one taken;
    then each centre is the mean of the pixels nearest to it, within ``near``; those with under 20 pixels or 0.002 % of
    the image's ``total`` go.  What reaches the driver is bins: an image's, at most 86 by 86 by 86.
    """
    least = max(20, int(0.00002 * total))
    bins = lab_histogram(pixels, [], 3).where(F.col("n") >= least // 4).orderBy(F.desc("n"), "bin").collect()
    centres: list[list[float]] = []
    for r in bins:
        c = [r["L"], r["a"], r["b"]]
        if len(centres) < 3 * most and all(sum((x - y) ** 2 for x, y in zip(c, o)) ** 0.5 > merge for o in centres):
            centres.append(c)
    if not centres:
        return []
    found = pixels.withColumn("at", nearest(F.array(*(F.col(c).cast("double") for c in ("L", "a", "b"))), list(enumerate(centres)), near)).where("at is not null")
    rows = found.groupBy("at.id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("L", "a", "b"))).where(F.col("n") >= least).orderBy(F.desc("n"), "id").limit(most).collect()
    return [([r["L"], r["a"], r["b"]], r["n"]) for r in rows]
