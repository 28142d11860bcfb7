"""The reference's computation forms on the driver's tables.

No table here holds a drawing, so each query exercises an operator on stand-in data; none claims to be a
measurement of drawings.  Every query takes its whole tables.  adapt_cer_text has no SQL, as DuckDB's levenshtein
counts bytes; tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import colour, labels, metrics, score, sequence, spatial

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(None)
def adapt_cer_text(spark, sf_dir):
    """Character error rate of documents against benchmark items of the same number, by code points; a null text is empty."""
    text = lambda name: S.norm_score(F.coalesce(F.col("text"), F.lit(""))).alias(name)
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), text("pred"))
    return _t(spark, sf_dir, "benchmark").select("item_id", text("truth")).join(d, "item_id").select("item_id", S.cer("pred", "truth").alias("cer"))


@query(
    """
WITH c AS (
  SELECT l.doc_id, CAST(l.doc_id % 7 AS DOUBLE) / 10 AS ref_cer, CAST(l.doc_id % 11 AS DOUBLE) / 10 AS out_cer, l.quality,
         1 + CAST(l.doc_id % 5 AS DOUBLE) / 10 AS size_ratio FROM labels l JOIN documents d USING (doc_id)
)
SELECT quality, CAST(count(*) FILTER (WHERE ref_cer <= 0.34) AS BIGINT) AS readable, CAST(count(*) FILTER (WHERE ref_cer <= 0.34 AND out_cer <= 0.34) AS BIGINT) AS ok,
       round_even(quantile_cont(abs(size_ratio - 1), 0.5) FILTER (WHERE ref_cer <= 0.34), 2) AS size_err_median,
       CASE WHEN count(*) FILTER (WHERE ref_cer <= 0.34) > 0 THEN round_even(count(*) FILTER (WHERE ref_cer <= 0.34 AND out_cer <= 0.34) / count(*) FILTER (WHERE ref_cer <= 0.34), 3) END AS text_ok
FROM c GROUP BY quality
"""
)
def adapt_text_ok(spark, sf_dir):
    """Flagship: the share of readable labels that stay readable, by kind of label."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    share = lambda n: (F.col("doc_id") % n).cast("double") / 10
    return metrics.text_score(rows.select("quality", share(7).alias("ref_cer"), share(11).alias("out_cer"), (1 + share(5)).alias("size_ratio")), ["quality"])


_VOTE = """
WITH e AS (
  SELECT user_id, event_type, least(1.0, abs(value) / 100) AS score, event_id FROM events WHERE value IS NOT NULL
), k AS (
  SELECT user_id, event_type, sum(score ** 4) AS w, count(*) AS votes, max(score) AS score, min((-score, event_id)) AS met FROM e GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, met) AS rank, w / sum(w) OVER (PARTITION BY user_id) AS a, sum(votes) OVER (PARTITION BY user_id) AS reads FROM k
)
"""


def _votes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", "event_id", F.least(F.lit(1.0), F.abs("value") / 100).alias("score"))
    return labels.vote(e, "user_id", "event_type", "score", "event_id")


@query(_VOTE + "SELECT user_id AS cluster, event_type AS text, CAST(votes AS BIGINT) AS votes, CAST(reads AS BIGINT) AS reads, round_even(a, 2) AS agreement FROM r WHERE rank = 1")
def adapt_vote(spark, sf_dir):
    """Weighted vote: users are clusters, event types readings."""
    return _votes(spark, sf_dir).select("cluster", "text", "votes", "reads", "agreement")


_LADDER = """
WITH e AS (
  SELECT event_id, round(least(1.0, abs(value) / 100), 2) AS score, event_id % 6 AS votes,
         CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'IIIA' WHEN 2 THEN 'x' WHEN 3 THEN '0%' WHEN 4 THEN '12km' WHEN 5 THEN 'ab c' WHEN 6 THEN '漢字' WHEN 7 THEN event_type ELSE '7' END AS text FROM events WHERE value IS NOT NULL
), t AS (
  SELECT *, score < 0.9 OR votes < 4 AS uncertain, replace(text, ' ', '') AS t, regexp_matches(text, '[一-鿿]') AS cjk FROM e
)
SELECT event_id, uncertain, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^[IVXLTAl1|\\-·.]+$') THEN 'roman-numeral-like token: kept as traced linework'
  WHEN length(t) = 1 AND NOT cjk AND NOT regexp_matches(t, '^\\d$') THEN 'single non-CJK character: treated as symbol/noise'
  WHEN length(t) <= 3 AND NOT cjk AND uncertain AND NOT regexp_matches(t, '^[<>]?[\\d.,~\\-]+(°|km|m|Ma)?$') THEN 'single weak OCR read: short non-numeric token, likely a symbol'
  WHEN score < 0.5 AND votes <= 1 THEN 'single weak OCR read: not placed, check the review sheet' WHEN score < 0.5 AND NOT cjk THEN 'low-confidence non-CJK reading' END AS skip FROM t
"""


@query(_LADDER.replace("\\\\", "\\"))
def adapt_selection(spark, sf_dir):
    """Uncertainty and all branches of the selection ladder, over events as candidates."""
    i = F.col("event_id")
    kinds = {0: "", 1: "IIIA", 2: "x", 3: "0%", 4: "12km", 5: "ab c", 6: "漢字", 8: "7"}
    text = F.coalesce(*(F.when(i % 9 == k, F.lit(v)) for k, v in kinds.items()), F.col("event_type"))
    e = _t(spark, sf_dir, "events").where("value is not null").select(i, F.round(F.least(F.lit(1.0), F.abs("value") / 100), 2).alias("score"), (i % 6).alias("votes"), text.alias("text"))
    e = e.withColumn("why", labels.uncertain(F.col("score"), F.col("votes"), F.lit(6)))
    return e.select("event_id", F.col("why").isNotNull().alias("uncertain"), labels.skip_reason(F.col("text"), F.col("score"), F.col("votes"), F.col("why")).alias("skip"))


_RUNS = """
WITH p AS (
  SELECT user_id AS key, CASE WHEN value > 50 THEN 1 ELSE 0 END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events
), r AS (
  SELECT key, value, min(pos) AS start, count(*) AS length
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY key, value ORDER BY pos) AS g FROM p) GROUP BY key, value, g
)
"""


def _runs(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("value") > 50, 1).otherwise(0).alias("on"))
    return sequence.runs(e, "user_id", "at", "on")


@query(_RUNS + "SELECT key, value, start, length FROM r")
def adapt_runs(spark, sf_dir):
    """Runs of high and low values along each user's events."""
    return _runs(spark, sf_dir).select("key", "value", F.col("start").cast("long").alias("start"), "length")


_DASH = (
    _RUNS
    + """, e AS (SELECT key, min(start) AS lo, max(start) AS hi FROM r WHERE value = 1 GROUP BY key)
, a AS (
  SELECT key, list(length ORDER BY start) FILTER (WHERE value = 1) AS ons, coalesce(list(length ORDER BY start) FILTER (WHERE value = 0), []) AS gaps
  FROM r JOIN e USING (key) WHERE start BETWEEN lo AND hi GROUP BY key
), c AS (
  SELECT key, ons, len(ons) AS n_seg, CASE WHEN len(ons) > 2 THEN ons[2:-2] ELSE ons END AS o, CASE WHEN len(gaps) > 2 THEN gaps[2:-2] ELSE gaps END AS g,
         list_sum(ons) / (list_sum(ons) + coalesce(list_sum(gaps), 0)) AS duty FROM a
), s AS (
  SELECT *, list_median(o) AS dash, coalesce(list_median(g), 0) AS gap, list_stddev_pop(o) / (list_avg(o) + 1e-6) AS len_cv,
         CASE WHEN len(g) > 0 THEN list_stddev_pop(g) / (list_avg(g) + 1e-6) ELSE 9.9 END AS gap_cv, list_max(o) AS big, list_min(o) AS small,
         list_aggregate(o, 'quantile_cont', 0.75) AS upper FROM c
), k AS (
  SELECT key, n_seg, duty, CASE WHEN duty <= 0.9 THEN CASE WHEN dd THEN upper ELSE dash END END AS dash, CASE WHEN duty <= 0.9 THEN gap END AS gap, CASE WHEN duty <= 0.9 THEN len_cv END AS len_cv,
         CASE WHEN duty <= 0.9 THEN gap_cv END AS gap_cv, dd
  FROM (SELECT *, duty <= 0.9 AND n_seg >= 3 AND dash >= 3 AND len(o) >= 4 AND dash > 0 AND big > 2.5 * dash AND small < 0.5 * dash AS dd FROM s)
)
SELECT key, CAST(n_seg AS INTEGER) AS n_seg, CAST(dash AS DOUBLE) AS dash, CAST(gap AS DOUBLE) AS gap,
  CASE WHEN duty > 0.9 THEN 'solid' WHEN dd THEN 'dashdot' WHEN n_seg < 3 OR dash < 3 THEN 'sparse'
       WHEN len_cv < 0.4 AND gap_cv < 0.4 AND n_seg >= 4 AND duty >= 0.2 AND gap / greatest(dash, 1) <= 3 THEN 'dashed' ELSE 'irregular' END AS kind,
  CASE WHEN gap_cv < 0.25 AND len_cv < 0.3 AND duty >= 0.35 AND gap / greatest(dash, 1) <= 2 THEN 'high'
       WHEN gap_cv < 0.4 AND len_cv < 0.4 AND duty >= 0.25 AND gap / greatest(dash, 1) <= 3 THEN 'medium' ELSE 'low' END AS conf
FROM k
"""
)


@query(_DASH)
def adapt_dash_kind(spark, sf_dir):
    """Dash statistics, line kind and confidence of each user's runs."""
    arrays = sequence.on_and_gaps(_runs(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    s = sequence.dash_statistics(arrays.withColumn("duty", total(F.col("ons")) / (total(F.col("ons")) + total(F.col("gaps")))))
    c = F.col
    kind = sequence.line_kind(c("duty"), c("n_seg"), c("dash"), c("gap"), c("len_cv"), c("gap_cv"), c("dashdot"))
    return s.select("key", "n_seg", "dash", "gap", kind.alias("kind"), sequence.confidence(c("gap_cv"), c("len_cv"), c("duty"), c("dash"), c("gap")).alias("conf"))


@query(
    """
WITH i AS (
  SELECT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS lo, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 + o_orderkey % 60 AS hi FROM orders
), f AS (
  SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i
), g AS (
  SELECT *, sum(CASE WHEN m IS NULL OR lo > m + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM f
)
SELECT o_custkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY o_custkey, part HAVING max(hi) - min(lo) >= 80
"""
)
def adapt_interval_merge(spark, sf_dir):
    """Order spans of each customer, merged across gaps of up to five days."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = _t(spark, sf_dir, "orders").select("o_custkey", day.alias("lo"), (day + 30 + F.col("o_orderkey") % 60).alias("hi"))
    return sequence.merge_intervals(rows, "o_custkey", "lo", "hi")


_BOXES = """
WITH b AS (
  SELECT event_id AS id, event_id // 800 AS image_id, CAST((event_id * 37) % 997 AS DOUBLE) AS x0, CAST((event_id * 53) % 991 AS DOUBLE) AS y0,
         CAST((event_id * 37) % 997 + 8 + event_id % 23 AS DOUBLE) AS x1, CAST((event_id * 53) % 991 + 6 + event_id % 17 AS DOUBLE) AS y1 FROM events
)
"""


def _boxes(spark, sf_dir):
    i = F.col("event_id")
    x, y = ((i * 37) % 997).cast("double"), ((i * 53) % 991).cast("double")
    return _t(spark, sf_dir, "events").select(i.alias("id"), F.expr("event_id div 800").alias("image_id"), x.alias("x0"), y.alias("y0"), (x + 8 + i % 23).alias("x1"), (y + 6 + i % 17).alias("y1"))


@query(
    _BOXES
    + """, p AS (
  SELECT l.image_id, l.id AS left_id, r.id AS right_id,
         greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS i,
         (l.x1 - l.x0) * (l.y1 - l.y0) AS a, (r.x1 - r.x0) * (r.y1 - r.y0) AS c
  FROM b l JOIN b r ON l.image_id = r.image_id AND l.id % 2 = 0 AND r.id % 2 = 1 AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1
), q AS (SELECT image_id, left_id, right_id, i / (a + c - i + 1e-9) AS iou FROM p)
SELECT image_id, left_id, right_id, round(iou, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id, left_id ORDER BY iou DESC, right_id) AS k FROM q WHERE iou >= 0.2) WHERE k = 1
"""
)
def adapt_iou_match(spark, sf_dir):
    """Best box match by IoU among boxes made from event numbers."""
    b = _boxes(spark, sf_dir)
    return spatial.best_match(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.2).withColumn("iou", F.round("iou", 9))


@query(
    _BOXES
    + """, p AS (SELECT id, image_id, x0 + 3 AS x, y0 + 3 AS y FROM b), h AS (
  SELECT b.image_id, b.id AS box_id, string_agg(CAST(p.id AS VARCHAR), '' ORDER BY p.x, p.id) AS read FROM b JOIN p ON b.image_id = p.image_id
     AND p.x BETWEEN b.x0 - ((b.x1 - b.x0) * 0.25 + 2) AND b.x1 + ((b.x1 - b.x0) * 0.25 + 2) AND p.y BETWEEN b.y0 - ((b.y1 - b.y0) * 0.25 + 2) AND b.y1 + ((b.y1 - b.y0) * 0.25 + 2)
  GROUP BY ALL
)
SELECT b.image_id, b.id AS box_id, coalesce(read, '') AS read FROM b LEFT JOIN h ON h.image_id = b.image_id AND h.box_id = b.id
"""
)
def adapt_point_in_box(spark, sf_dir):
    """The text read in each grown box, from left to right."""
    b = _boxes(spark, sf_dir)
    d = b.select("image_id", "id", (F.col("x0") + 3).alias("x"), (F.col("y0") + 3).alias("y"), F.col("id").alias("ord"), F.col("id").cast("string").alias("text"))
    return spatial.read_at(b, d).select("image_id", "box_id", "read")


@query(
    _BOXES
    + """SELECT a.image_id, a.id, count(*) AS near FROM b a JOIN b c ON a.image_id = c.image_id AND a.id <> c.id AND abs(a.x0 - c.x0) <= 40 AND sqrt((a.x0 - c.x0) ** 2 + (a.y0 - c.y0) ** 2) <= 40
GROUP BY ALL HAVING count(*) >= 3"""
)
def adapt_density(spark, sf_dir):
    """Points with three neighbours or more within 40."""
    return spatial.dense_points(_boxes(spark, sf_dir).select("image_id", "id", F.col("x0").alias("x"), F.col("y0").alias("y")), 40.0)


@query(
    """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (
  SELECT label, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e
), c AS (
  SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL) GROUP BY label
), d AS (SELECT vec_id, c.label, round(list_distance(v, m), 9) AS d FROM e, c)
SELECT vec_id, arg_min(label, (d, label)) AS nearest, min(d) AS distance FROM d GROUP BY vec_id
"""
)
def adapt_nearest_centroid(spark, sf_dir):
    """The nearest of the labels' mean vectors; the palette is one value, as the labels are few."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    palette = means.select(F.struct(F.col("label").alias("id"), F.transform("m", lambda s: s["m"]).alias("c")).alias("e")).agg(F.array_sort(F.collect_list("e"))).scalar()
    found = e.select("vec_id", palette.alias("palette"), "v").select("vec_id", colour.nearest(F.col("v"), F.col("palette"), places=9).alias("n"))
    return found.select("vec_id", F.col("n.id").alias("nearest"), F.col("n.d").alias("distance"))


@query(
    """
WITH g AS (
  SELECT doc_id % 12 AS cell, sum(quality) AS ref, sum(toxic) AS cand, sum(quality * toxic) AS hit FROM labels GROUP BY 1
), r AS (
  SELECT *, CASE WHEN ref > 0 THEN hit / ref ELSE 0 END AS rc, CASE WHEN cand > 0 THEN hit / cand ELSE 0 END AS pr FROM g
)
SELECT cell, CAST(ref AS BIGINT) AS ref, CAST(cand AS BIGINT) AS cand, round_even(rc, 4) AS recall, round_even(pr, 4) AS precision, round_even(CASE WHEN rc + pr > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 4) AS f1 FROM r
"""
)
def adapt_prf_grid(spark, sf_dir):
    """Precision, recall and F1 by cell: quality stands for the reference mask, toxic for the candidate's."""
    g = _t(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 12).alias("cell")).agg(F.sum("quality").alias("ref"), F.sum("toxic").alias("cand"), F.sum(F.col("quality") * F.col("toxic")).alias("both"))
    return g.select("cell", "ref", "cand", *metrics.prf(F.col("ref"), F.col("cand"), F.col("both"), F.col("both")))


@query(
    """
WITH c AS (
  SELECT l_linestatus AS s, l_returnflag AS f, count(*) FILTER (WHERE l_quantity <= 30) AS src, count(*) FILTER (WHERE l_quantity > 20) AS res, count(*) FILTER (WHERE l_quantity > 20 AND l_quantity <= 30) AS hit FROM lineitem GROUP BY ALL
)
SELECT s AS l_linestatus, round_even(sum(hit / (src + res - hit) * src) / sum(src), 3) AS region_iou, count(*) AS regions FROM c WHERE src >= 200 GROUP BY s
"""
)
def adapt_weighted_iou(spark, sf_dir):
    """Source-weighted region IoU; return flags are colours."""
    q = F.col("l_quantity")
    c = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count_if(q <= 30).alias("src"), F.count_if(q > 20).alias("res"), F.count_if((q > 20) & (q <= 30)).alias("both"))
    return metrics.region_iou(c, ["l_linestatus"])


@query(
    """
WITH q AS (SELECT user_id, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.25) AS cut FROM events GROUP BY user_id)
SELECT user_id, p50, p75, avg(value) AS low_mean FROM q JOIN events USING (user_id) WHERE value <= cut GROUP BY ALL
"""
)
def adapt_percentiles(spark, sf_dir):
    """Exact percentiles of each user's values, and the mean of the lowest quarter."""
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.75).alias("p75")).join(colour.darkest_mean(e, ["user_id"], "value", 0.25).withColumnRenamed("mean", "low_mean"), "user_id")


@query("SELECT l_suppkey, arg_min(l_linenumber, (-n, l_linenumber)) AS l_linenumber, max(n) AS n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def adapt_dominant(spark, sf_dir):
    """The most frequent line number of each supplier."""
    return metrics.dominant(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber")


@query(
    """
WITH c AS (SELECT n_regionkey, n_nationkey, 1 + n_nationkey % 4 AS w FROM nation), e AS (SELECT *, 17.0::DOUBLE * w / sum(w) OVER (PARTITION BY n_regionkey) AS x FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY x - floor(x) DESC, n_nationkey) AS k, 17 - sum(floor(x)) OVER (PARTITION BY n_regionkey) AS l FROM e)
SELECT n_nationkey, CAST(floor(x) + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM r
"""
)
def adapt_largest_remainder(spark, sf_dir):
    """Seventeen places shared among each region's nations."""
    n = _t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (1 + F.col("n_nationkey") % 4).alias("w"))
    return metrics.apportion(n, ["n_regionkey"], "w", F.lit(17.0), "n_nationkey").select("n_nationkey", "share")


@query(
    """
WITH r AS (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn FROM events), k AS (SELECT key, CAST(floor(count(*) * 0.8) AS BIGINT) AS k FROM r GROUP BY key)
SELECT a.key, min(b.v - a.v) AS width FROM r a JOIN k USING (key) JOIN r b ON b.key = a.key AND b.rn = a.rn + k.k GROUP BY a.key
"""
)
def adapt_narrowest_interval(spark, sf_dir):
    """The narrowest range that holds four fifths of each user's values."""
    return sequence.narrowest_interval(_t(spark, sf_dir, "events"), "user_id", "value")


_REGRESSION = """
WITH m AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS case_id, avg(o_totalprice) / 1e5 AS color_f1, stddev_pop(o_totalprice) / 1e4 AS "color_dE", count(*) / 100 AS extra_ink_blobs FROM orders GROUP BY ALL
), l AS (UNPIVOT m ON color_f1, "color_dE", extra_ink_blobs INTO NAME metric VALUE value)
SELECT b.case_id, b.metric, CASE WHEN s * (b.value - a.value) < -t THEN 'regression' WHEN s * (b.value - a.value) > t THEN 'better' ELSE 'same' END AS flag
FROM l b JOIN l a ON a.y = 1996 AND b.y = 1997 AND a.case_id = b.case_id AND a.metric = b.metric
JOIN (VALUES ('color_f1', 1, 0.02), ('color_dE', -1, 1.5), ('extra_ink_blobs', -1, 2.0)) AS tol(metric, s, t) ON tol.metric = b.metric
"""


@query(_REGRESSION)
def adapt_regression_compare(spark, sf_dir):
    """Two years of orders as two runs, order states as cases."""
    o = _t(spark, sf_dir, "orders")
    wide = o.groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("case_id")).agg((F.avg("o_totalprice") / 1e5).alias("color_f1"), (F.stddev_pop("o_totalprice") / 1e4).alias("color_dE"), (F.count("*") / 100).alias("extra_ink_blobs"))
    long = metrics.long_metrics(wide, ["y", "case_id"], ["color_f1", "color_dE", "extra_ink_blobs"])
    tol = spark.createDataFrame(metrics.TOLERANCES, "metric string, sign int, tol double")
    return metrics.compare_runs(long.where("y = 1996").drop("y"), long.where("y = 1997").drop("y"), tol).select("case_id", "metric", "flag")


@query("SELECT l_partkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS rank FROM lineitem) WHERE rank <= 8")
def adapt_topk_regions(spark, sf_dir):
    """The eight largest lines of each part: by price, then keys, falling."""
    return metrics.largest_regions(_t(spark, sf_dir, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")], 8).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS text, n_regionkey AS box FROM nation WHERE n_nationkey NOT IN (0, 1) UNION ALL SELECT 100, 'ADDED', 9")
def adapt_patch_apply(spark, sf_dir):
    """A patch on nations: one emptied, one dropped, one renamed, one unknown, one added."""
    base = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"), F.col("n_regionkey").alias("box"))
    changes = spark.createDataFrame([(0, "", None, None), (1, None, None, True), (3, "RENAMED", None, None), (99, "NOBODY", None, None)], "id int, text string, box int, drop boolean")
    return labels.apply_patch(base, changes, spark.createDataFrame([(100, "ADDED", 9)], "id int, text string, box int"))


@query(
    """
WITH m AS (
  SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS missing_significant, avg(l_discount) * 12 AS mark_recall, avg(l_tax) * 10 AS region_iou, avg(l_quantity) / 5 AS edge_p75_px, sum(l_discount) / 1e3 AS ink_extra_share,
         avg(l_tax) * 22 AS coverage, avg(l_discount) * 18 AS precision, avg(l_tax) * 21 AS colour_recall, count(*) % 3 AS lost, avg(l_discount) * 12 AS width_rel, avg(l_quantity) / 20 AS width_mae, avg(l_tax) / 4 AS ink_missing_share, count(*) AS objects, l_suppkey % 40 + 1 AS src_elements
  FROM lineitem GROUP BY l_suppkey
), r AS (
  SELECT l_suppkey, unnest([
    CASE WHEN coverage < 0.9 THEN 'graphics_missing' END, CASE WHEN coalesce(nullif(lost, 0), 0) > 0 THEN 'lost_elements' END, CASE WHEN precision < 0.9 THEN 'graphics_extra' END, CASE WHEN colour_recall < 0.85 THEN 'colour_mismatch' END,
    CASE WHEN missing_significant >= 3 AND coalesce(nullif(mark_recall, 0), 1) < 0.85 THEN 'elements_missing' END, CASE WHEN coalesce(nullif(width_rel, 0), 0) > 0.6 AND coalesce(nullif(width_mae, 0), 0) > 1 THEN 'line_width' END,
    CASE WHEN coalesce(nullif(ink_extra_share, 0), 0) > 0.01 THEN 'ink_extra' END, CASE WHEN coalesce(nullif(ink_missing_share, 0), 0) > 0.01 THEN 'ink_missing' END, CASE WHEN coalesce(nullif(region_iou, 0), 1) < 0.85 THEN 'regions_shifted' END,
    CASE WHEN coalesce(nullif(edge_p75_px, 0), 0) > 5 AND coalesce(nullif(region_iou, 0), 1) < 0.92 THEN 'boundary_shift' END, CASE WHEN objects > 3 * src_elements THEN 'fragmented' END]) AS type FROM m
)
SELECT l_suppkey, type, 'graphics' AS stage FROM r WHERE type IS NOT NULL
"""
)
def adapt_issue_flags(spark, sf_dir):
    """All issue rules, over metrics derived from each supplier's lines, added in the table's order; one row for each issue."""
    avg, c = F.avg, F.col
    lines = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_discount", "l_tax", "l_quantity", "_metadata.file_path", "_metadata.row_index")
    sums = metrics.added_in_order(lines, ["l_suppkey"], ["file_path", "row_index"], {
        "returned": F.count_if(c("l_returnflag") == "R"), "discount": avg("l_discount"), "discounts": F.sum("l_discount"), "tax": avg("l_tax"), "quantity": avg("l_quantity"), "objects": F.count("*"),
    })
    m = sums.select(
        "l_suppkey", c("returned").alias("missing_significant"), (c("discount") * 12).alias("mark_recall"), (c("tax") * 10).alias("region_iou"), (c("quantity") / 5).alias("edge_p75_px"), (c("discounts") / 1e3).alias("ink_extra_share"),
        (c("tax") * 22).alias("coverage"), (c("discount") * 18).alias("precision"), (c("tax") * 21).alias("colour_recall"), (c("objects") % 3).alias("lost"), (c("discount") * 12).alias("width_rel"), (c("quantity") / 20).alias("width_mae"),
        (c("tax") / 4).alias("ink_missing_share"), "objects",
    )
    return metrics.issue_records(m.withColumn("src_elements", c("l_suppkey") % 40 + 1), ["l_suppkey"]).select("l_suppkey", "type", "stage")


@query(
    """
WITH i AS (SELECT user_id, event_type AS type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL)
SELECT user_id AS image_id, CAST(sum(n) AS BIGINT) AS open, array_to_string(list(type ORDER BY type), ';') AS types FROM i GROUP BY user_id
"""
)
def adapt_issue_summary(spark, sf_dir):
    """Open issues and their kinds: a user's events over 50 as issues."""
    e = _t(spark, sf_dir, "events").where("value > 50").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("type"))
    return metrics.issue_summary(e).select("image_id", "open", F.array_join("types", ";").alias("types"))


@query(
    """
WITH RECURSIVE p AS (SELECT event_id AS id, event_id // 900 * 4 + event_id % 4 AS im, (event_id * 37) % 97 AS x, (event_id * 53) % 89 AS y FROM events),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.im = b.im AND a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT id AS node, id AS seen FROM p UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node AS id, min(seen) AS component FROM r GROUP BY node
"""
)
def adapt_connected_components(spark, sf_dir):
    """8-connected components of pixels made from event numbers, image by image: each 900 events make four images more."""
    from plumbline.operators.raster import components_per_image

    i = F.col("event_id")
    image = F.expr("event_id div 900 * 4 + event_id % 4")
    p = _t(spark, sf_dir, "events").select(i.alias("id"), image.alias("image_id"), ((i * 37) % 97).cast("int").alias("x"), ((i * 53) % 89).cast("int").alias("y"))
    return components_per_image(p).select("id", "component")


@query(
    """
WITH b AS (SELECT l_suppkey, l_partkey % 40 AS v, l_quantity AS w FROM lineitem), c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v RANGE UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY l_suppkey) AS r FROM b)
SELECT l_suppkey, min(v) AS median FROM c WHERE r >= 0.5 GROUP BY l_suppkey
"""
)
def adapt_weighted_median(spark, sf_dir):
    """Weighted median of part numbers by quantity."""
    return metrics.weighted_median(_t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 40).alias("v"), "l_quantity"), ["l_suppkey"], "v", "l_quantity")


@query(
    """
WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS nx FROM n WINDOW w AS (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment))
SELECT c_nationkey, c_mktsegment, n FROM r WHERE k = 1 AND n >= 2 AND n >= 1.5 * coalesce(nx, 0)
"""
)
def adapt_clear_winner(spark, sf_dir):
    """A nation's market segment, where its lead is clear."""
    return metrics.clear_winner(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query(
    """
WITH p AS (SELECT user_id, CAST(floor(abs(value) * 7) AS BIGINT) % 256 AS v FROM events WHERE value IS NOT NULL), n AS (SELECT user_id, v, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT user_id, arg_min(v, (-n, v)) FILTER (WHERE v > 150) AS peak, coalesce(sum(n) FILTER (WHERE v > 150), 0) AS light FROM n GROUP BY user_id),
q AS (SELECT user_id, quantile_cont(v, 0.5) AS near FROM p JOIN m USING (user_id) WHERE abs(v - peak) <= 8 GROUP BY user_id)
SELECT user_id, CASE WHEN light >= 100 THEN near ELSE 255.0 END AS paper FROM m LEFT JOIN q USING (user_id)
"""
)
def adapt_histogram_mode(spark, sf_dir):
    """The paper level of each user's values as light levels."""
    p = _t(spark, sf_dir, "events").where("value is not null").select("user_id", (F.floor(F.abs("value") * 7) % 256).alias("v"))
    return colour.paper_level(p, ["user_id"], "v")


@query(
    """
SELECT p_partkey, CASE WHEN c < 22 AND l < 130 THEN 'ink' WHEN c < 16 AND l >= 130 THEN 'grid' ELSE 'color' END AS kind,
  least(900.0, greatest(240.0, 120 + 30 * (p_size % 20) + 0.5 * p_size + 0.1 * p_partkey)) AS budget, CASE WHEN 4 * p_size * p_partkey * 100 > 6e6 THEN 1 ELSE 2 END AS scale
FROM (SELECT *, (p_partkey * 7) % 255 AS l, (p_partkey * 13) % 60 AS c FROM part)
"""
)
def adapt_scalar_rules(spark, sf_dir):
    """Palette kinds, time budgets and working scales of made-up numbers."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", colour.palette_kind(k * 7 % 255, k * 13 % 60).alias("kind"), S.time_budget(s % 20, s, k, F.lit(0), F.lit(0)).alias("budget"), S.work_scale(s * 100, k).alias("scale"))


_SCORED = """
WITH l AS (
  SELECT p_partkey AS id, CAST(p_partkey // 50 AS VARCHAR) AS image_id, p_name AS text, replace(p_name, ' ', '') AS t, CAST(p_partkey % 10 * 120 AS DOUBLE) AS x0, CAST(p_partkey // 10 % 5 * 40 AS DOUBLE) AS y0 FROM part
), r AS (
  SELECT *, t AS source, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(t, 1, length(t) // 2) ELSE t END AS result,
         CASE WHEN id % 5 IN (1, 3, 4) THEN round_even((20 + id % 3) / 20, 2) END AS size_ratio FROM l
), c AS (
  SELECT *, round_even(levenshtein(result, t) / length(t), 2) AS out_cer FROM r WHERE length(t) > 0
), a AS (
  SELECT image_id, count(*) AS text_readable, round_even(count(*) FILTER (WHERE out_cer <= 0.34) / count(*), 3) AS text_ok, round_even(quantile_cont(abs(size_ratio - 1), 0.5), 2) AS size_err_median FROM c GROUP BY image_id
)
SELECT image_id, text_readable, text_ok, size_err_median, CASE WHEN text_ok - 1.0 < -0.03 THEN 'regression' ELSE 'same' END AS flag FROM a
"""


@query(_SCORED)
def adapt_score_flow(spark, sf_dir):
    """The scorer's text half from labels and detections to flags against a clean run: parts' names as labels, of which a
    fifth is lost, one cut short, one read in two pieces and the others drawn in other sizes."""
    k = F.col("p_partkey")
    own = _t(spark, sf_dir, "part").where(F.length(F.replace("p_name", F.lit(" "), F.lit(""))) > 0).select(
        F.expr("p_partkey div 50").cast("string").alias("image_id"), k.alias("id"), F.col("p_name").alias("text"), (k % 10 * 120).cast("double").alias("x0"), (F.expr("p_partkey div 10") % 5 * 40).cast("double").alias("y0")
    )
    box = own.withColumns({"x1": F.col("x0") + 100, "y1": F.col("y0") + 20, "angle": F.lit(0.0)})
    det = box.withColumn("ord", F.lit(0)).drop("angle")
    i, t = F.col("id"), F.replace("text", F.lit(" "), F.lit(""))
    half = (F.length(t) / 2).cast("int")
    cut = det.where(i % 5 == 1).withColumn("text", F.substr(t, F.lit(1), half))
    left = det.where(i % 5 == 2).withColumns({"text": F.substr(t, F.lit(1), half), "x1": F.col("x0") + 40})
    right = det.where(i % 5 == 2).withColumns({"text": F.substr(t, half + 1, F.length(t)), "x0": F.col("x0") + 60, "id": -i})
    drawn = cut.unionByName(det.where(i % 5 > 2)).withColumn("y1", F.col("y1") + i % 3).unionByName(left).unionByName(right)
    seen = det.withColumn("role", F.lit("source"))
    after = score.text_metrics(box, seen.unionByName(drawn.withColumn("role", F.lit("result"))))
    before = score.text_metrics(box, seen.unionByName(det.withColumn("role", F.lit("result"))))
    flags = score.compare(before, after).where("metric = 'text_ok'").select(F.col("case_id").alias("image_id"), "flag")
    return after.join(flags, "image_id")


@query(
    """
WITH m AS (SELECT event_id AS id, event_id // 600 AS image_id, event_id * 37 % 97 AS x, event_id * 53 % 89 AS y, event_id * 7 % 90 + 10 AS area, CAST(event_id % 8 AS DOUBLE) + 0.5 AS width FROM events), e AS (SELECT * FROM m WHERE id % 2 = 0 AND width <= 6), r AS (SELECT * FROM m WHERE id % 2 = 1),
p AS (SELECT e.image_id, e.id, e.width, e.area, r.width AS drawn, r.area AS rarea, row_number() OVER (PARTITION BY e.image_id, e.id ORDER BY abs(e.area - r.area), r.id) AS k FROM e JOIN r ON e.image_id = r.image_id AND abs(e.x - r.x) < 10 AND abs(e.y - r.y) < 10)
SELECT image_id, id, width, drawn FROM p WHERE k = 1 AND rarea / greatest(area, 1) BETWEEN 0.3 AND 3.5
"""
)
def adapt_width_match(spark, sf_dir):
    """Widths of marks against those of the result's mark of like area beside them."""
    i = F.col("event_id")
    m = _t(spark, sf_dir, "events").select(i.alias("id"), F.expr("event_id div 600").alias("image_id"), (i * 37 % 97).alias("x"), (i * 53 % 89).alias("y"), (i * 7 % 90 + 10).alias("area"), ((i % 8).cast("double") + 0.5).alias("width"))
    return spatial.matched_widths(m.where("id % 2 = 0"), m.where("id % 2 = 1"))


@query(
    """
WITH i AS (SELECT DISTINCT event_id // 500 AS image_id FROM events), c AS (SELECT image_id, r.row, k.col FROM i, (SELECT unnest(generate_series(0, 8)) AS row) r, (SELECT unnest(generate_series(0, 11)) AS col) k),
p AS (SELECT event_id // 500 AS image_id, (event_id * 37) % 97 // 8 AS col, (event_id * 53) % 89 // 9 AS row, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS ref, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS cand, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS hit FROM events),
s AS (SELECT image_id, row, col, sum(ref) AS ref, sum(cand) AS cand, sum(hit) AS hit FROM p GROUP BY ALL)
SELECT c.image_id, CAST(c.row AS INTEGER) AS row, CAST(c.col AS INTEGER) AS col, CAST(coalesce(ref, 0) AS BIGINT) AS ref_px, CAST(coalesce(cand, 0) AS BIGINT) AS cand_px, CASE WHEN ref > 0 THEN round_even(hit / ref, 3) END AS recall, CASE WHEN cand > 0 THEN round_even(hit / cand, 3) END AS precision
FROM c LEFT JOIN s ON s.image_id = c.image_id AND s.row = c.row AND s.col = c.col
"""
)
def adapt_grid(spark, sf_dir):
    """Recall and precision in each of 12 by 9 cells; what is left over at the edges is in none."""
    i, image = F.col("event_id"), F.expr("event_id div 500")
    one = lambda n: (i % n == 0).cast("int")
    p = _t(spark, sf_dir, "events").select(image.alias("image_id"), (i * 37 % 97).alias("x"), (i * 53 % 89).alias("y"), one(2).alias("ref"), one(3).alias("cand"), one(6).alias("ref_hit"), one(6).alias("cand_hit"))
    return metrics.grid_ratios(p, p.select("image_id").distinct().select("image_id", F.lit(97).alias("width"), F.lit(89).alias("height")))


@query(
    """
WITH m AS (SELECT n_nationkey, n_regionkey, n_name AS own, coalesce(lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '') AS next FROM nation),
o AS (SELECT n_regionkey, list(n_name ORDER BY -length(n_name), n_name) AS others FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY n_regionkey)
SELECT n_nationkey, list_reduce(list_prepend(own || next || own, others), lambda acc, x: CASE WHEN x = '' OR contains(own, x) OR NOT contains(acc, x) THEN acc ELSE substr(acc, 1, instr(acc, x) - 1) || substr(acc, instr(acc, x) + length(x)) END) AS left_over FROM m JOIN o USING (n_regionkey)
"""
)
def adapt_own_text(spark, sf_dir):
    """What is left of a read of several labels when the others' texts are taken out: nations, beside the next one."""
    from pyspark.sql.window import Window

    n = _t(spark, sf_dir, "nation")
    others = n.groupBy("n_regionkey").agg(metrics.longest_first(F.collect_set("n_name")).alias("others"))
    following = F.coalesce(F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")), F.lit(""))
    read = n.withColumn("read", F.concat("n_name", following, "n_name")).join(others, "n_regionkey")
    return read.select("n_nationkey", metrics.own_text(F.col("read"), F.col("n_name"), F.col("others")).alias("left_over"))


@query(
    """
WITH p AS (SELECT p_partkey, p_partkey * 7 % 101 AS l, p_partkey * 13 % 41 AS c, p_partkey * 11 % 256 AS m, p_size % 4 AS n, [CAST(p_partkey * 3 % 256 AS DOUBLE), CAST(p_partkey * 5 % 256 AS DOUBLE), CAST(p_size AS DOUBLE)] AS v FROM part),
b AS (SELECT *, ((v[1] - 10.0) * 190.0 + (v[2] - 20.0) * 180.0 + (v[3] - 30.0) * 20.0) / 68900.0 AS t FROM p)
SELECT p_partkey, CAST(CASE WHEN c >= 18 AND m < 240 THEN 10 + n WHEN c < 12 AND l >= 72 AND m < 238 THEN 2 WHEN c < 12 AND l < 55 THEN 1 WHEN m >= 238 THEN 0 ELSE -1 END AS BIGINT) AS class, round(t, 9) AS t,
  round(sqrt((10.0 + t * 190.0 - v[1]) ** 2 + (20.0 + t * 180.0 - v[2]) ** 2 + (30.0 + t * 20.0 - v[3]) ** 2), 9) AS d FROM b
"""
)
def adapt_colour_rules(spark, sf_dir):
    """Pixel classes of the scorer, and where a colour lies between two others, of made-up numbers."""
    k, z = F.col("p_partkey"), F.col("p_size")
    three = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    found = colour.blend_of(F.array((k * 3 % 256).cast("double"), (k * 5 % 256).cast("double"), z.cast("double")), three(10, 20, 30), three(200, 200, 50))
    p = _t(spark, sf_dir, "part").select("p_partkey", colour.score_class(k * 7 % 101, k * 13 % 41, k * 11 % 256, z % 4).cast("long").alias("class"), found.alias("b"))
    return p.select("p_partkey", "class", F.round("b.t", 9).alias("t"), F.round("b.d", 9).alias("d"))


@query(
    """
WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey AS area, CASE l_linenumber % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'grid' WHEN 2 THEN 'ink_faint' ELSE 'ink' END AS kind, l_quantity > 25 AS core FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE kind WHEN 'grid' THEN 1 WHEN 'ink_faint' THEN 2 WHEN 'ink' THEN 3 ELSE 0 END, area DESC, l_orderkey, l_linenumber) AS INTEGER) AS place
FROM l WHERE area >= 20 AND (area >= 0.0004 * 3e6 OR core)
"""
)
def adapt_layer_order(spark, sf_dir):
    """Which layers are kept and in which order they are painted: a supplier's lines as layers."""
    c = F.col
    kind = F.coalesce(*(F.when(c("l_linenumber") % 4 == i, F.lit(k)) for i, k in enumerate(("color", "grid", "ink_faint", "ink"))))
    rows = _t(spark, sf_dir, "lineitem").where(colour.layer_kept(c("l_partkey"), F.lit(3e6), c("l_quantity") > 25)).withColumn("kind", kind)
    return metrics.largest_regions(rows, ["l_suppkey"], [*colour.layer_order(c("kind"), c("l_partkey")), "l_orderkey", "l_linenumber"], 1 << 30).select("l_suppkey", "l_orderkey", "l_linenumber", c("rank").alias("place"))


@query(
    """
WITH g AS (
  SELECT l_orderkey // 40 AS image_id, l_orderkey * 10 + l_linenumber AS id, 6 + l_partkey % 150 AS w, 5 + l_suppkey % 25 AS h, 12.0 AS gh, l_discount * 3 AS covered, l_tax AS coloured, l_quantity / 60 AS fill, l_linenumber AS pieces, l_partkey % 60 AS holes, l_suppkey % 40 AS bars, 40 + l_orderkey % 41 AS ink FROM lineitem
), f AS (
  SELECT *, round_even((ink - bars) / ink, 2) AS textness FROM g WHERE h BETWEEN 0.6 * gh AND 1.8 * gh AND w BETWEEN 0.6 * gh AND 10 * gh AND covered <= 0.2 AND coloured <= 0.05 AND fill BETWEEN 0.08 AND 0.55 AND pieces >= 2 AND holes < 0.08 * (w * h) AND bars < 0.5 * ink
)
SELECT image_id, id, textness, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY textness DESC, id) AS rank FROM f) WHERE rank <= 8
"""
)
def adapt_unlabeled_text(spark, sf_dir):
    """The groups of an image that look like unread text, eight at most: lines of orders as groups of pieces."""
    c = F.col
    g = _t(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 40").alias("image_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (6 + c("l_partkey") % 150).alias("w"), (5 + c("l_suppkey") % 25).alias("h"), F.lit(12.0).alias("glyph_h"), (c("l_discount") * 3).alias("covered"),
        c("l_tax").alias("coloured"), (c("l_quantity") / 60).alias("fill"), c("l_linenumber").alias("pieces"), (c("l_partkey") % 60).alias("holes"), (c("l_suppkey") % 40).alias("bars"), (40 + c("l_orderkey") % 41).alias("ink"),
    )
    return labels.unlabeled_text(g).select("image_id", "id", "textness", "rank")


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey % 300 >= 12 AND l_partkey % 300 <= 0.02 * 10000 AND greatest(1 + l_suppkey % 40, l_linenumber) <= 8 * least(1 + l_suppkey % 40, l_linenumber) AND l_discount * 5 < 0.4 AS lost,
  l_partkey % 300 >= 12 AND (l_quantity % 8 >= 4 OR l_linenumber * 3 >= 10) AS kept, l_extendedprice > 0 AND l_quantity * 3 >= greatest(60.0, 0.002 * l_extendedprice) AS spill FROM lineitem
"""
)
def adapt_element_rules(spark, sf_dir):
    """Lost elements, kept elements and reported spills, of made-up measures."""
    c = F.col
    area, side = c("l_partkey") % 300, 1 + c("l_suppkey") % 40
    rules = metrics.lost_element(area, F.lit(10000), side, c("l_linenumber"), c("l_discount") * 5), metrics.element_kept(area, c("l_quantity") % 8, c("l_linenumber") * 3), metrics.spill_reported(c("l_quantity") * 3, c("l_extendedprice"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(r.alias(n) for r, n in zip(rules, ("lost", "kept", "spill"))))


@query(
    """
WITH e AS (SELECT event_id AS id, event_id // 2 AS line, event_id // 800 AS image_id, event_id * 37 % 997 AS x, event_id * 53 % 991 AS y, CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.0 ELSE 0.0 END AS ux, CASE event_id % 4 WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN -1.0 ELSE 0.0 END AS uy FROM events)
SELECT a.image_id, a.id AS a, b.id AS b, -(a.ux * b.ux + a.uy * b.uy) AS straight FROM e a JOIN e b ON a.image_id = b.image_id AND a.id < b.id AND a.line <> b.line AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25 AND -(a.ux * b.ux + a.uy * b.uy) > 0.5
"""
)
def adapt_endpoints(spark, sf_dir):
    """Line ends that may be joined: near each other and continuing each other."""
    i = F.col("event_id")
    unit = lambda plus, minus: F.when(i % 4 == plus, 1.0).when(i % 4 == minus, -1.0).otherwise(0.0)
    e = _t(spark, sf_dir, "events").select(i.alias("end"), F.expr("event_id div 2").alias("line"), F.expr("event_id div 800").alias("image_id"), (i * 37 % 997).alias("x"), (i * 53 % 991).alias("y"), unit(0, 1).alias("ux"), unit(2, 3).alias("uy"))
    return spatial.ends_near(e, 25.0)


@query(
    """
WITH s AS (SELECT event_id AS id, event_id // 1000 AS image_id, event_id // 20 AS box, event_id * 37 % 197 AS x, event_id * 53 % 191 AS y, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.6 END AS ux, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.8 END AS uy FROM events),
p AS (SELECT a.image_id, a.box, a.id AS a, b.id AS b, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap, a.ux AS aux, a.uy AS auy, b.ux AS bux, b.uy AS buy FROM s a JOIN s b ON a.image_id = b.image_id AND a.box = b.box AND a.id < b.id)
SELECT image_id, box, a, b, round(gap, 9) AS gap FROM p WHERE gap BETWEEN 4 AND 116 AND abs(dx * aux + dy * auy) / gap >= 0.9 AND abs(dx * bux + dy * buy) / gap >= 0.9
"""
)
def adapt_stub_pairs(spark, sf_dir):
    """Pairs of line stubs at a label that may be one line: twenty events are a label's stubs."""
    i = F.col("event_id")
    s = _t(spark, sf_dir, "events").select(
        i.alias("id"), F.expr("event_id div 1000").alias("image_id"), F.expr("event_id div 20").alias("box"), (i * 37 % 197).alias("x"), (i * 53 % 191).alias("y"),
        F.when(i % 2 == 0, 1.0).otherwise(0.6).alias("ux"), F.when(i % 2 == 0, 0.0).otherwise(0.8).alias("uy"), F.lit(100.0).alias("reach"),
    )
    return spatial.stub_pairs(s).withColumn("gap", F.round("gap", 9))


_PIXELS = """
WITH p AS (SELECT event_id AS id, event_id // 600 AS image_id, event_id // 5 AS component, event_id % 7 AS region, event_id * 37 % 97 AS x, event_id * 53 % 89 AS y FROM events)
"""


def _pixels(spark, sf_dir):
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").select(i.alias("id"), F.expr("event_id div 600").alias("image_id"), F.expr("event_id div 5").alias("component"), (i % 7).alias("region"), (i * 37 % 97).alias("x"), (i * 53 % 89).alias("y"))


@query(
    _PIXELS
    + """, z AS (SELECT image_id, x AS x0, y AS y0, x + 20 AS x1, y + 15 AS y1 FROM p WHERE id % 40 = 0)
SELECT image_id, component, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM z WHERE z.image_id = p.image_id AND p.x BETWEEN z.x0 AND z.x1 AND p.y BETWEEN z.y0 AND z.y1)) AS inside, count(*) AS pixels FROM p GROUP BY image_id, component
"""
)
def adapt_zone_components(spark, sf_dir):
    """How much of each component lies in label zones."""
    p = _pixels(spark, sf_dir)
    zones = p.where("id % 40 = 0").select("image_id", "id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") + 15).alias("y1"))
    return spatial.zone_of_components(p.select("image_id", "component", "x", "y"), zones)


@query(_PIXELS + "SELECT DISTINCT a.image_id, a.region AS a, b.region AS b FROM p a JOIN p b ON a.image_id = b.image_id AND a.region < b.region AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2")
def adapt_touching_regions(spark, sf_dir):
    """Pairs of regions that come within two pixels of each other."""
    return spatial.touching_regions(_pixels(spark, sf_dir).select("image_id", "region", "x", "y"))
