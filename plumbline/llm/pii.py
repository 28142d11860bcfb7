"""Personal data: base patterns, and identifiers found by bootstrapped contexts, in DataFrame operations only.

Base: e-mail addresses, IPv4 addresses, card numbers (16 to 19 digits, Luhn) and phone numbers (+, 8 to
15 digits), leftmost and without overlap within a kind; a match that fails its check is dropped, and the
search goes on after it.

Identifiers: a run without white space that holds a digit, an at sign or an underscore, or groups of digits and the
signs of numbers with single blanks between them.  Marks around it, and keys before it (``token=``), are its context and not
part of it.  What base patterns match is blanked out before.

Seeds: the base spans, each for its kind, and for the kind ``secret`` identifiers of at least ``SECRET`` letters and
digits with both among them (keys, tokens).  A seed's lexical patterns are what stands before it, from the last run
with a letter on (``or``, ``password=``, ``token = "``), and the run after it.

Bootstrap: patterns and identifiers score each other for ``ROUNDS`` rounds.  A pattern's score for a kind is the
summed score of the identifiers in its slots over all occurrences of its word in the corpus, so a common word is
worth little.  It is confident from ``CONFIDENT`` on, if ``SUPPORT`` different seeds or identifiers accepted by then
are in its slots.  Confident patterns extract whatever identifier stands in their slots, of any shape: its score
joins theirs as 1 - prod(1 - p).  From ``ACCEPT`` on, and if half of its occurrences stand in such slots, all its
occurrences join the spans, as the kind of its highest score, and induce patterns for the next round.

Offsets are in code points, ends exclusive.  Rows: a null text is an empty one; no spans give empty
strings' digests.  Repeated rows and ids each have their own spans.  A span found twice counts once.  An
empty table gives no rows.  Columns beyond id and text are ignored by ``detect`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, every_column, fresh, or_empty, scanned, stored, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
ROUNDS, CONFIDENT, ACCEPT, SUPPORT, SECRET = 3, 0.5, 0.6, 3, 16
BROADCAST_ROWS = 500_000
#: Possessive forms of the patterns, which neither recurse nor rescan: a start lies at a run's head or a match's end.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PATTERN = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: A text without a match of this has no match of the pattern.
_NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Every span holds one of these; most texts hold none and are read once.
_ANY = "[0-9@_]"
_RUN = r"(?<!\S)(?:(?=[0-9(+])[0-9().+/-]++(?!\S)(?: (?=[0-9(+])[0-9().+/-]++(?!\S))*+|(?=\S*[0-9@_])\S++)"
_KEY = r"""^((?:[("'<\[{|]|[\p{L}_][\p{L}_.-]*+[=:])*+)"""
_TAIL = r"""(?<![.,;:!?)"'>\]}|])[.,;:!?)"'>\]}|]++$"""
_BEFORE = r"(?<!\S)(\S*\p{L}\S*+(?:\s++[^\s\p{L}]++){0,2}+\s*+)$"
_AFTER = r"^\S*+\s++(\S++)"
_MENTION = "array<struct<kind:int,start:int,end:int,value:string,instance:bigint,before:bigint,anchor:bigint,after:bigint>>"
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: F.ltrim(p, F.lit("0")).try_cast("decimal(38,0)").between(0, 255) | (F.ltrim(p, F.lit("0")) == ""))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda m: _sound(kind, m["value"])


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def _let(value: Column, body) -> Column:
    """``body`` of a lambda's variable, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def _block_ends(lengths: Column) -> Column:
    """Running sums of whole blocks of ``lengths``, from 0 on."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_BLOCK))
    sums = F.transform(starts, lambda s: _total(F.slice(lengths, s + 1, _BLOCK)))
    return F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def _hash(text: Column) -> Column:
    """Of the text in lower case with single blanks; null where there is none."""
    return F.when(text != "", F.xxhash64(F.regexp_replace(F.lower(text), r"\s+", " ")))


def _split(text: Column, pattern: str) -> Column:
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))


def _mentions(text: Column, pattern: str, needs: str, kind: int | None) -> Column:
    """Each match's place, text, hash and context, from the matches and what lies between them.

    Offsets are summed in blocks, so that the work stays near the number of matches.  Without a kind a match is a
    run, whose key and marks are cut off, and the kind is that of a secret or -1.
    """

    def measured(v: Column) -> Column:
        both = F.zip_with(F.slice(v["gaps"], 1, F.size(v["matches"])), v["matches"], lambda g, m: F.length(g) + F.length(m))
        return F.struct(v["gaps"], v["matches"], both.alias("lengths"))

    def one(v: Column):
        def mention(m: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            upto = F.get(v["ends"], block) + _total(F.slice(v["lengths"], block * _BLOCK + 1, i - block * _BLOCK))
            gap, rest = F.get(v["gaps"], i), F.get(v["gaps"], i + 1)
            if kind is not None:
                return _mention(F.lit(kind), upto + F.length(gap), m, gap, rest)
            bare = F.regexp_replace(m, _TAIL, "")
            key = F.regexp_extract(bare, _KEY, 1)
            return _let(F.struct(key.alias("key"), F.substr(bare, F.length(key) + 1, F.length(bare)).alias("core")), lambda r: _mention(_shape(r["core"]), upto + F.length(gap) + F.length(r["key"]), r["core"], F.concat(gap, r["key"]), rest))

        return mention

    def each(v: Column) -> Column:
        return _let(F.struct(v["gaps"], v["matches"], v["lengths"], _block_ends(v["lengths"]).alias("ends")), lambda w: F.transform(w["matches"], one(w)))

    found = _let(_split(text, pattern), lambda v: _let(measured(v), each))
    return F.when(F.rlike(text, F.lit(needs)), found).otherwise(F.array()).cast(_MENTION)


def _shape(core: Column) -> Column:
    secret = F.rlike(core, F.lit(rf"^(?=.*[A-Za-z])(?=(?:[^0-9]*[0-9]){{4}})[A-Za-z0-9]{{{SECRET},}}$"))
    return F.when(secret, KINDS.index("secret")).otherwise(-1)


def _mention(kind: Column, start: Column, value: Column, gap: Column, rest: Column) -> Column:
    before, after = F.regexp_extract(gap, _BEFORE, 1), F.regexp_extract(rest, _AFTER, 1)
    return F.struct(
        kind.alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), _hash(value).alias("instance"),
        _hash(before).alias("before"), _hash(F.regexp_extract(before, r"^\S+", 0)).alias("anchor"), _hash(after).alias("after"),
    )


def _blanked(text: Column, kind: str) -> Column:
    """``text`` with blanks in place of the kind's spans."""

    def fill(m: Column) -> Column:
        return F.when(_sound(kind, m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)

    whole = _let(_split(text, _PATTERN[kind]), lambda v: F.array_join(F.transform(v["gaps"], lambda g, i: F.concat(g, F.coalesce(fill(F.get(v["matches"], i)), F.lit("")))), ""))
    return F.when(F.rlike(text, F.lit(_NEEDS[kind])), whole).otherwise(text)


def _others(text: Column) -> Column:
    """The identifiers in what base spans leave of a text."""

    def step(i: int):
        return lambda t: _let(_blanked(t, BASE[i]), step(i + 1)) if i < len(BASE) else _mentions(t, _RUN, _ANY, None)

    return F.filter(step(0)(text), lambda m: F.rlike(m["value"], F.lit(_ANY)))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, base and other (arrays of mentions) of every row of ``docs``; stored, without the values."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), or_empty(F.col(text_col).cast("string")).alias("text"))
    some, none = F.rlike(text, F.lit(_ANY)), F.array().cast(_MENTION)
    base = F.when(some, F.concat(*(F.filter(_mentions(text, _PATTERN[k], _NEEDS[k], i), _test(k)) for i, k in enumerate(BASE)))).otherwise(none)
    other = F.when(some, _others(text)).otherwise(none)
    slim = lambda c: F.transform(c, lambda m: m.dropFields("value"))
    return stored(rows.select("row", "doc_id", slim(base).alias("base"), slim(other).alias("other")), "mentions")


def bootstrap(found: DataFrame, docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, confident: float = CONFIDENT, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """(row, kind, start, end) of the identifiers of no seed's shape that the pattern-instance graph accepts."""
    every = stored(found.select("row", F.explode(F.concat("base", "other")).alias("m")).select("row", "m.*"), "instances")
    nothing = every.where("false").select("row", "kind", "start", "end")
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("before").alias("context"), F.col("anchor").alias("anchor")), F.struct(F.lit("R").alias("side"), F.col("after").alias("context"), F.col("after").alias("anchor")))
    edges = every.select("kind", "instance", F.explode(sides).alias("s")).select("kind", "instance", "s.*").where("context is not null")
    edges = edges.groupBy("side", "context", "anchor", "instance").agg(F.max("kind").alias("seed"), F.count("*").alias("n"))
    slots = ["side", "context", "anchor"]
    useful = stored(edges.groupBy(*slots).agg(F.count("*").alias("instances"), F.count_if(F.col("seed") < 0).alias("others")).where((F.col("instances") >= support) & (F.col("others") > 0)).select(*slots), "patterns")
    edges = stored(edges.join(useful, slots, "left_semi"), "edges")
    if edges.where("seed >= 0").groupBy("seed", *slots).count().where(F.col("count") >= support).isEmpty():
        return nothing  # no pattern can be confident in the first round, so none in any
    anchors = edges.select("anchor").distinct()
    run = F.explode(F.split(or_empty(F.col(text_col).cast("string")), r"\s+"))
    key = F.when(F.rlike("run", F.lit("[=:]")), F.regexp_extract("run", _KEY, 1)).otherwise("")
    words = docs.select(run.alias("run")).select(_hash(F.when(F.rlike(key, F.lit(r"\p{L}")), key).otherwise(F.col("run"))).alias("anchor"))
    total = stored(words.join(broadcast_if_small(anchors, anchors.count(), BROADCAST_ROWS), "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("total")), "totals")
    graph = stored(edges.join(total, "anchor", "left").select("side", "context", "instance", "seed", "n", F.greatest(F.coalesce("total", F.lit(0)), "n").alias("total")), "graph")
    seeds = graph.where("seed >= 0").select(F.col("seed").alias("kind"), "instance", F.lit(1.0).alias("score")).distinct()
    occurrences = graph.groupBy("instance", "side").agg(F.sum("n").alias("all"))
    score = seeds
    for _ in range(rounds):
        held = graph.drop("seed").join(score, "instance")
        patterns = held.groupBy("kind", "side", "context").agg(F.least(F.sum(F.col("score") * F.col("n")) / F.max("total"), F.lit(1.0)).alias("p"), F.count_if(F.col("score") >= accept).alias("held"))
        patterns = stored(patterns.where((F.col("held") >= support) & (F.col("p") >= confident)).select("kind", "side", "context", "p"), "confident")
        met = graph.where("seed < 0").join(patterns, ["side", "context"])
        joint = met.groupBy("kind", "instance", "side").agg(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))).alias("left_over"), F.sum("n").alias("inside")).join(occurrences, ["instance", "side"])
        joint = joint.groupBy("kind", "instance").agg((1 - F.exp(F.sum("left_over"))).alias("score"), F.max(F.col("inside") / F.col("all")).alias("share"))
        score = stored(seeds.unionByName(joint.where((F.col("score") >= accept) & (F.col("share") >= 0.5)).select("kind", "instance", "score")), "scores")
    best = F.max_by("kind", F.struct("score", -F.col("kind"))).alias("as_kind")
    chosen = score.join(seeds.select("instance").distinct(), "instance", "left_anti").groupBy("instance").agg(best)
    return every.where("kind < 0").join(chosen, "instance").select("row", F.col("as_kind").alias("kind"), "start", "end").distinct()


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, base and spans of every row: sorted arrays of (kind, start, end), spans holding base."""
    docs = scanned(docs)
    found = mentions(docs, id_col, text_col)
    added = bootstrap(found, docs, text_col).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    plain = lambda c: F.transform(c, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    secrets = plain(F.filter("other", lambda m: m["kind"] >= 0))
    spans = F.array_sort(F.array_distinct(F.concat(plain(F.col("base")), secrets, F.coalesce("added", F.array().cast(_SPANS)))))
    return found.join(added, "row", "left").select("row", "doc_id", F.array_sort(plain(F.col("base"))).alias("base"), spans.alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans become one."""
    docs = scanned(docs)
    row, own = fresh(docs, "row"), fresh(docs, "spans")
    found = detect(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(own))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).join(found, row, "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)
    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        name = F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(F.concat(gap, name))).alias("out"))

    made = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.col(own).isNotNull(), made).otherwise(text)).select(*every_column(docs))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
