"""Readers and writers of the drawing pipeline's artefacts as tables.

Every reader takes a path or glob that Spark can read, and keeps the file it came from as ``work_dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.ArrayType(T.DoubleType())
READING = T.ArrayType(T.StringType())  # [text, score] or [text, score, note]; only the first kind votes
CANDIDATE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("box", BOX), T.StructField("angle", T.DoubleType()), T.StructField("quad", T.ArrayType(BOX)), T.StructField("readings", T.ArrayType(READING)),
    T.StructField("score", T.DoubleType()), T.StructField("votes", T.IntegerType()), T.StructField("agreement", T.DoubleType()), T.StructField("uncertain", T.BooleanType()),
    T.StructField("why", T.StringType()), T.StructField("use", T.BooleanType()), T.StructField("skip_reason", T.StringType()), T.StructField("split_boxes", T.ArrayType(BOX)),
])
CANDIDATES = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("src_size", T.ArrayType(T.IntegerType())), T.StructField("scale", T.IntegerType()), T.StructField("mode", T.StringType()),
    T.StructField("candidates", T.ArrayType(CANDIDATE)),
])
LABEL = T.StructType([T.StructField("text", T.StringType()), T.StructField("box", BOX), T.StructField("angle", T.DoubleType())])
STROKES = "struct<polylines: array<array<double>>, width_px: double, color: array<int>, dash: array<double>>"
OUTLINE = "struct<color: array<int>, width_px: double>"
SHAPE = f"struct<color: array<int>, paths: array<struct<start: array<double>, segs: array<array<double>>>>, outline: {OUTLINE}>"
LAYER = f"struct<file: string, kind: string, area: bigint, color: array<int>, strokes: {STROKES}, rest_file: string, outline: {OUTLINE}, shapes: array<{SHAPE}>>"
COUNTERS = ("wipe_protected_px", "dash_protect_px", "wipe_colour_px", "colour_healed_px", "colour_restored_px", "labels_hue_split", "fringe_layers_dropped", "boundary_slivers_dropped")
LAYERS = (
    f"src_size array<int>, scale int, layers array<{LAYER}>, labels array<struct<text: string, box: array<double>, angle: double>>, rules struct<polylines: array<array<double>>, width_px: double, color: array<int>>, "
    f"marks struct<dots: array<array<double>>, strokes: array<array<double>>>, latin_font string, " + ", ".join(f"{c} bigint" for c in COUNTERS)
)
CASES = T.StructType([T.StructField("id", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("gt", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("degrade", T.ArrayType(T.ArrayType(T.StringType())))])


def _json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("work_dir", F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(work_dir, name, height, width, channels, data): blue, green, red bytes; files that are no images are left out."""
    got = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return got.select(F.regexp_extract("origin", "^(.*)/[^/]*$", 1).alias("work_dir"), F.regexp_extract("origin", "([^/]*)$", 1).alias("name"), "height", "width", F.col("nChannels").alias("channels"), "data")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each candidate, with its place in the file."""
    whole = _json(spark, path, CANDIDATES)
    return whole.select("work_dir", "scale", "mode", F.posexplode("candidates").alias("ord", "c")).select("work_dir", "scale", "mode", "ord", "c.*")


def readings(found: DataFrame) -> DataFrame:
    """The voting readings of candidates: those without a note."""
    rows = found.select("work_dir", F.col("ord").alias("cluster"), F.posexplode("readings").alias("ord", "r")).where(F.size("r") == 2)
    return rows.select("work_dir", "cluster", "ord", F.get("r", F.lit(0)).alias("text"), F.get("r", F.lit(1)).cast("double").alias("score"))


def layers(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, LAYERS).select("work_dir", "scale", F.posexplode("layers").alias("ord", "l")).select("work_dir", "scale", "ord", "l.*")


def _points(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] as points."""
    return F.transform(F.sequence(F.lit(0), F.greatest((F.size(flat) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))


def strokes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of the layers' strokes and of the rules (layer null): points, width, colour, dash."""
    whole = _json(spark, path, LAYERS)
    own = whole.select("work_dir", F.posexplode("layers").alias("layer", "l")).where("l.strokes is not null").select("work_dir", "layer", "l.strokes.*")
    rules = whole.where("rules is not null").select("work_dir", F.lit(None).cast("int").alias("layer"), "rules.*", F.lit(None).cast("array<double>").alias("dash"))
    each = own.unionByName(rules).select("work_dir", "layer", "width_px", "color", "dash", F.posexplode("polylines").alias("ord", "line"))
    return each.where(F.size("line") >= 4).select("work_dir", "layer", "ord", _points(F.col("line")).alias("points"), "width_px", "color", "dash")


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each path of the layers' shapes: its start and curve segments, colour and outline."""
    rows = _json(spark, path, LAYERS).select("work_dir", F.posexplode("layers").alias("layer", "l")).select("work_dir", "layer", F.posexplode("l.shapes").alias("shape", "s"))
    return rows.select("work_dir", "layer", "shape", "s.color", "s.outline", F.posexplode("s.paths").alias("ord", "p")).select("work_dir", "layer", "shape", "ord", "color", "outline", "p.start", "p.segs")


def fine_marks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dots: x, y, r; strokes: x0, y0, x1, y1, width) of a line drawing's labels file."""
    whole = _json(spark, path, LAYERS)
    parts = lambda name, cols: whole.select("work_dir", F.posexplode(f"marks.{name}").alias("ord", "m")).select("work_dir", "ord", *(F.get("m", F.lit(i)).alias(c) for i, c in enumerate(cols)))
    return parts("dots", ("x", "y", "r")), parts("strokes", ("x0", "y0", "x1", "y1", "width"))


def build_facts(spark: SparkSession, path: str) -> DataFrame:
    """(work_dir, scale, width, height, latin_font and the counters) of a build."""
    return _json(spark, path, LAYERS).select("work_dir", "scale", F.get("src_size", F.lit(0)).alias("width"), F.get("src_size", F.lit(1)).alias("height"), "latin_font", *COUNTERS)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Of a plain list of labels, or of a file that has them under ``labels``."""
    text = spark.read.text(path, wholetext=True).withColumn("work_dir", F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1))
    kind = T.ArrayType(LABEL)
    own = F.coalesce(F.from_json("value", T.StructType([T.StructField("labels", kind)]))["labels"], F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", kind)))
    return text.select("work_dir", F.posexplode(own).alias("ord", "l")).select("work_dir", "ord", "l.text", "l.box", F.coalesce("l.angle", F.lit(0.0)).alias("angle"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CASES)


def last_json(spark: SparkSession, path: str) -> DataFrame:
    """(work_dir, value): the last line of each log that begins with a brace."""
    lines = spark.read.text(path, wholetext=True).withColumn("work_dir", F.input_file_name())
    each = F.filter(F.split("value", "\n"), lambda x: F.startswith(x, F.lit("{")))
    return lines.select("work_dir", F.try_element_at(each, F.lit(-1)).alias("value"))


def scraped(text: Column, name: str) -> Column:
    """The sum of all ``"name": n`` in a log."""
    return F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(rf'"{name}": (\d+)'), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def svg_paths(lines: DataFrame) -> DataFrame:
    """(image_id, svg): stroked paths of polylines (image_id, ord, points, color as #rrggbb, width) in their order."""
    d = F.concat(F.lit("M"), F.array_join(F.transform("points", lambda p: F.concat(F.round(p["x"], 2).cast("string"), F.lit(" "), F.round(p["y"], 2).cast("string"))), " L"))
    path = F.format_string('<path d="%s" fill="none" stroke="%s" stroke-width="%.2f"/>', d, F.col("color"), F.col("width"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", path.alias("path")))), lambda s: s["path"]), "\n")
    return lines.groupBy("image_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), one, F.lit("\n</svg>")).alias("svg"))


def _page(body: Column, width: Column, height: Column) -> Column:
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">\n<rect width="%d" height="%d" fill="#ffffff"/>\n', *([width, height] * 3))
    return F.concat(head, body, F.lit("\n</svg>"))


def svg_outlines(rings: DataFrame, smooth: bool = False) -> DataFrame:
    """(image_id, svg): filled closed paths of rings (image_id, width, height, ord, points, hole): black ones in their order,
    then white holes on them.  Whole numbers, or with ``smooth`` one place."""
    number = lambda v: F.format_string("%.1f", v.cast("double")) if smooth else v.cast("int").cast("string")
    d = F.concat(F.lit("M "), F.array_join(F.transform("points", lambda p: F.concat(number(p["x"]), F.lit(","), number(p["y"]))), " L "), F.lit(" Z"))
    path = F.concat(F.lit('<path d="'), d, F.lit('"/>'))
    group = lambda hole: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hole") == hole, F.struct("ord", path.alias("path"))))), lambda s: s["path"]), "\n")
    found = rings.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), group(False).alias("black"), group(True).alias("white"))
    part = lambda fill, body: F.concat(F.lit(f'<g fill="{fill}" stroke="none">\n'), body, F.lit("\n</g>"))
    body = F.concat(part("#000000", F.col("black")), F.when(F.col("white") != "", F.concat(F.lit("\n"), part("#ffffff", F.col("white")))).otherwise(""))
    return found.select("image_id", _page(body, F.col("width"), F.col("height")).alias("svg"))


def summary(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(case_id, error, metrics) of a run's summary, a map of cases to records; a record without metrics has null ones."""
    kind = "map<string, struct<error: struct<step: string, error: string>, metrics: struct<" + ", ".join(f"{n}: double" for n in names) + ">>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("case_id", "r"))
    return text.select("case_id", F.col("r.error.step").alias("error"), *(F.col(f"r.metrics.{n}").alias(n) for n in names))


def summary_json(metrics: DataFrame, names: list[str]) -> str:
    """A run's summary; cases are few, one row each."""
    import json

    rows = sorted(metrics.select("case_id", *names).collect())
    return json.dumps({r["case_id"]: {"id": r["case_id"], "metrics": {n: r[n] for n in names}} for r in rows}, ensure_ascii=False, indent=1)


def summary_table(found: DataFrame, names: list[str]) -> str:
    """A run's summary as a Markdown table; a case without metrics names the step that failed."""
    head = ["| case | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    rows = sorted(found.collect(), key=lambda r: r["case_id"])
    line = lambda r: f"| {r['case_id']} | ERROR {r['error']} |" if r["error"] else f"| {r['case_id']} | " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |"
    return "\n".join([*head, *map(line, rows)]) + "\n"


def markdown_rows(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(case_id, line): a Markdown table row for each case; a metric that is not there is empty."""
    cells = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    return metrics.select("case_id", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("case_id"), *cells), F.lit(" |")).alias("line"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("overwrite").save(path)
