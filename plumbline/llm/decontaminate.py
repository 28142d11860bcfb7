"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Index: one scan stores the postings (document row, position, term) of every training token that is a
term of the benchmark, and one end posting a document, whose position is its number of words.  Terms
and test windows come from the benchmark alone.  Terms are broadcast only where their counted bytes are
within ``BROADCAST_BYTES``, rows of numbers where they are within ``BROADCAST_ROWS``; beyond that the planner
joins them by a shuffle of stored tables, whose skewed keys it can split.

Search: a test window's terms are ordered by their number of postings.  The list of its rarest term,
moved back by the term's offset, gives candidate (document, start); the list of the next rarest term
thins them; what is left must be met by every term's list at its offset (exact phrase).
``proximity`` takes the same lists in the same order and asks for all different terms of a window within a
span of words, in any order; it returns the minimal such places, all of them.

Rows: null text has no words.  An item without words has no window; one with fewer words than a window
is a window of its own length.  Repeated rows, ids and items each count, an item_id once.  Null item ids
are not items.  Empty tables give no hits.  Columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, stored, table

WINDOW, SPAN = 10, 20
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Not a word, as every byte of it separates words.
_LAST = "\n"


def words(text: Column) -> Column:
    """The array of a text's words; null and wordless texts have none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct test windows (window, words) and whose they are (window, item_id), one row each; both stored."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = stored(items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct(), "item_windows")
    tests = stored(each.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return tests, stored(each.join(tests, "words").select("window", "item_id"), "items")


def _fits(terms: DataFrame) -> bool:
    return (terms.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0) <= BROADCAST_BYTES


def postings(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, terms): the stored index of ``docs`` (row, doc_id, pos, term) and the terms (word, term) of ``tests``."""
    terms = tests.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    terms = stored(terms.unionByName(tests.sparkSession.range(1).select(F.lit(_LAST).alias("word"), F.lit(-1).cast("long").alias("term"))), "terms")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.concat(words(F.col(text_col)), F.array(F.lit(_LAST))).alias("w"))
    each = rows.select("row", "doc_id", F.posexplode("w").alias("pos", "word"))
    return stored(each.join(F.broadcast(terms) if _fits(terms) else terms, "word").select("row", "doc_id", "pos", "term"), "postings"), terms


def ordered_terms(tests: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """(window, size, term, offset, rank): each window's terms, the rarest first; stored."""
    df = index.where("term >= 0").groupBy("term").count()
    counted = stored(terms.where("term >= 0").join(df, "term", "left").select("word", "term", F.coalesce("count", F.lit(0)).alias("count")), "counts")
    own = tests.select("window", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    own = own.join(F.broadcast(counted) if _fits(terms) else counted, "word")
    rank = F.row_number().over(Window.partitionBy("window").orderBy("count", "term", "offset"))
    return stored(own.select("window", "size", "term", "offset", rank.alias("rank")), "test_terms")


def _extended(found: DataFrame, index: DataFrame, lists: DataFrame) -> DataFrame:
    """The (row, window, start) of ``found`` at which every (window, term, offset) of ``lists`` has a posting."""
    need = lists.groupBy("window").agg(F.count("*").alias("need"))
    own = broadcast_if_small(lists.select("window", "term", "offset"), lists.count(), BROADCAST_ROWS)
    wanted = found.join(own, "window").select("window", "row", "start", (F.col("start") + F.col("offset")).alias("pos"), "term")
    # Only documents and terms that are still wanted are shuffled; a filter built from them goes to the scan.
    met = wanted.join(index.select("row", "pos", "term"), ["row", "pos", "term"])
    counted = met.groupBy("row", "window", "start").agg(F.count("*").alias("met"))
    return counted.join(broadcast_if_small(need, need.count(), BROADCAST_ROWS), "window").where("met = need").select("row", "window", "start")


def phrases(index: DataFrame, test_terms: DataFrame) -> DataFrame:
    """(row, window, start) of every occurrence of every window; stored."""
    real = index.where("term >= 0")
    rarest = test_terms.where("rank = 1").select("window", "term", "offset", "size")
    n = rarest.count()
    found = real.join(broadcast_if_small(rarest, n, BROADCAST_ROWS), "term").select("row", "window", (F.col("pos") - F.col("offset")).alias("start"), "size").where("start >= 0")
    second = test_terms.where("rank = 2").select("window", "term", "offset")
    single = found.where("size = 1").select("row", "window", "start")
    some = second.select("term").distinct()
    thin = real.join(broadcast_if_small(some, some.count(), BROADCAST_ROWS), "term", "left_semi")
    found = stored(_extended(found.where("size > 1").select("row", "window", "start"), thin, second), "thinned")
    # The documents that are left bound the last join's postings.
    kept = found.select("row").distinct()
    rest = real.join(broadcast_if_small(kept, kept.count(), BROADCAST_ROWS), "row", "left_semi")
    return stored(_extended(found, rest, test_terms.where("rank > 2 or (rank = 2 and size = 2)")).unionByName(single), "phrases")


def _near(found: DataFrame, index: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """(row, window, at, pos, term): postings of the windows' ``terms`` (window, term) less than ``span`` from ``at``.

    Near positions share a bucket or stand in neighbouring ones: an equi-join with three copies.
    """
    bucket = lambda c: F.floor(c / span)
    wanted = found.join(broadcast_if_small(terms, terms.count(), BROADCAST_ROWS), "window").withColumn("b", F.explode(F.array(*(bucket(F.col("at")) + i for i in (-1, 0, 1)))))
    met = wanted.join(index.select("row", "pos", "term", bucket(F.col("pos")).alias("b")), ["row", "term", "b"])
    return met.where(F.abs(F.col("pos") - F.col("at")) < span).select("row", "window", "at", "pos", "term")


def proximity(index: DataFrame, test_terms: DataFrame, span: int = SPAN) -> DataFrame:
    """(row, window, first, last): the minimal places, less than ``span`` words from the first to the last, that hold
    all different terms of a window; stored.

    Every such place holds a posting of the window's rarest term.  From each of them, the next rarest term's
    postings near it thin the candidates; around those that are left, all terms' postings less than ``span`` away
    (one for each position, so at most 2 ``span`` - 1) are gathered and each is tried as the first.
    """
    real = index.where("term >= 0").select("row", "pos", "term")
    different = test_terms.groupBy("window", "term").agg(F.min("rank").alias("best"))
    order = F.row_number().over(Window.partitionBy("window").orderBy("best"))
    different = stored(different.withColumn("place", order), "different")
    need = different.groupBy("window").agg(F.count("*").cast("int").alias("need"))
    rarest = different.where("place = 1").select("window", "term")
    start = real.join(broadcast_if_small(rarest, rarest.count(), BROADCAST_ROWS), "term").select("row", "window", F.col("pos").alias("at"))
    second = different.where("place = 2").select("window", "term")
    some = second.select("term").distinct()
    thin = real.join(broadcast_if_small(some, some.count(), BROADCAST_ROWS), "term", "left_semi")
    both = stored(_near(start, thin, second, span).select("row", "window", "at").distinct(), "near")
    kept = both.select("row").distinct()
    rest = real.join(broadcast_if_small(kept, kept.count(), BROADCAST_ROWS), "row", "left_semi")
    around = _near(both, rest, different.select("window", "term"), span).groupBy("row", "window", "at").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("all"))
    around = around.join(broadcast_if_small(need, need.count(), BROADCAST_ROWS), "window").where(F.size(F.array_distinct(F.transform("all", lambda x: x["term"]))) == F.col("need"))

    def place(first: Column) -> Column:
        own = F.filter("all", lambda x: (x["pos"] >= first["pos"]) & (x["pos"] < first["pos"] + span))
        met = F.array_distinct(F.transform(own, lambda x: x["term"]))
        last = F.array_max(F.transform(met, lambda t: F.array_min(F.transform(F.filter(own, lambda x: x["term"] == t), lambda x: x["pos"]))))
        return F.struct(first["pos"].alias("first"), F.when(F.size(met) == F.col("need"), last).alias("last"))

    places = around.select("row", "window", F.explode(F.transform(F.filter("all", lambda x: x["pos"] <= F.col("at")), place)).alias("p")).where("p.last is not null")
    minimal = places.groupBy("row", "window", F.col("p.last").alias("last")).agg(F.max("p.first").alias("first"))
    single = need.where("need = 1").select("window")
    alone = start.join(broadcast_if_small(single, single.count(), BROADCAST_ROWS), "window", "left_semi").select("row", "window", F.col("at").alias("first"), F.col("at").alias("last"))
    return stored(minimal.select("row", "window", "first", "last").unionByName(alone), "proximity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, span: int | None = None) -> DataFrame:
    """For every row of ``docs``: row, doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    With ``span``, also n_near: how many test windows have all their different words within so many words.
    """
    tests, owners = windows(benchmark, text_col="text", size=size)
    index, terms = postings(docs, tests, id_col, text_col)
    test_terms = ordered_terms(tests, index, terms)
    found = phrases(index, test_terms)
    sizes = tests.select("window", F.size("words").alias("size"))
    n = sizes.count()
    hits = found.join(broadcast_if_small(sizes, n, BROADCAST_ROWS), "window")
    covered = hits.groupBy("row", "start").agg(F.max("size").alias("size")).select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    items = found.select("row", "window").distinct().join(owners, "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    every = index.where("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = every.join(n_hit, "row", "left").join(items, "row", "left")
    more = []
    if span:
        near = proximity(index, test_terms, span).groupBy("row").agg(F.count_distinct("window").alias("n_near"))
        out, more = out.join(near, "row", "left"), [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), *more)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=SPAN)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


OP8_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), bw AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0 AND item_id IS NOT NULL)
), sizes AS (
  SELECT DISTINCT n FROM win
), dg AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)
), hit AS (
  SELECT dg.r, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g
), cov AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r
), dp AS (
  SELECT r, unnest(w) AS t, unnest(generate_series(1, len(w))) AS p FROM dw
), uw AS (
  SELECT row_number() OVER () AS k, g, len(list_distinct(g)) AS need FROM (SELECT DISTINCT g FROM win)
), ut AS (
  SELECT DISTINCT k, unnest(g) AS t FROM uw
), rare AS (
  SELECT k, t FROM (
    SELECT k, ut.t, row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), ut.t) AS rk FROM ut LEFT JOIN (SELECT t, count(*) AS n FROM dp GROUP BY t) df USING (t)
  ) WHERE rk = 1
), close AS (
  SELECT DISTINCT a.r, a.k, dp.p, dp.t FROM (SELECT r, k, p AS at FROM rare JOIN dp USING (t)) a JOIN ut USING (k) JOIN dp ON dp.r = a.r AND dp.t = ut.t AND dp.p BETWEEN a.at - 19 AND a.at + 19
), place AS (
  SELECT a.r, a.k FROM close a JOIN close b ON a.r = b.r AND a.k = b.k AND b.p BETWEEN a.p AND a.p + 19 JOIN uw ON uw.k = a.k GROUP BY a.r, a.k, a.p, uw.need HAVING count(DISTINCT b.t) = uw.need
), nn AS (
  SELECT r, count(DISTINCT k) AS n_near FROM place GROUP BY r
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN cov ON cov.r = dw.r LEFT JOIN it ON it.r = dw.r LEFT JOIN nn ON nn.r = dw.r
"""
