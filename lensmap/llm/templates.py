"""Benchmark decontamination by template canonicalisation (native: SQL functions only).

Words become template tokens: a number is ``<num>``, a unit of measure is
``<unit>``, a capitalised word that does not open a sentence is ``<name>``,
anything else its lower-cased letters.  Windows of ``width`` template tokens of
the documents are hash-joined with those of the benchmark.  Matches of one
document and item lie on diagonals (document position - item position); on a
diagonal the slots are checked: an item's value must be filled by one document
value wherever it stands, and the other way round.  A diagonal counts when
its windows cover ``min_cover`` of the item's windows (or ``min_windows`` of
them, for a part of a long item) and its slots are consistent, so a question
whose numbers, names or units were exchanged throughout is caught, and a chance
meeting of stock phrases is not.

Every window of an item is used.  One that is slots for more than a half would
match anything of the same shape, so it is compared by its plain words instead,
in items and documents alike: verbatim copies always match.  Whether an item's
first word counts as a name depends on what stands before it, so its first
window is searched both ways.  Items under ``SHORTEST`` words, which any prose
may contain, are found where a line of a document has just their words.

At scale: the documents are scanned once in the JVM; every window becomes a row
that meets the benchmark's windows in a join, broadcast only when their counted
number stays under ``BROADCAST_WINDOWS``; beyond that an equi-join on the hash.
A hit needs several windows of an item, so texts and items are paired only over
the item's rarest windows, as many as leave too few others for a hit (a stock
phrase of many items pairs nothing); the diagonals found so are counted from
positions alone, and words are read for those that pass.  The hashes of texts
with a match are counted, and broadcast to the texts while they take a few MB,
so that texts are not shuffled.

Defined cases: null text has no windows, and stays; items shorter than
``width`` words give one window of their whole length; repeated rows are judged
alike; null ids are kept (rows are matched by text); items without words are
never found; empty tables give no hits.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmap.operators.partitioning import broadcast_if_small
from lensmap.session import materialize, release

WIDTH = 8
BROADCAST_WINDOWS = 500_000  # benchmark windows: under 100 MB with their slots

# Units of measure recognised as slots (no one-letter units, and
# none that are common words of some language, as "in", "mi" or "pa").
UNITS = ("mm", "cm", "km", "ft", "yd", "mg", "kg", "oz", "lb", "lbs", "ml", "sec", "min", "hr", "hrs", "hz", "khz",
         "mhz", "ghz", "kb", "mb", "gb", "tb", "kw", "kwh", "kj", "kcal", "mph", "kmh",
         "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "foot", "feet",
         "inch", "inches", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "liter", "liters",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents",
         "percent", "degree", "degrees")


NAME = r"([\p{Ll}\p{N},;] )(?=\p{Lu})"  # only what stands before a name, so one pass marks a name that follows a name, too
DROP = r"[^\p{L}\p{N}\x01\x20\x09-\x0D]+"
SPLIT = r"[\x20\x09-\x0D]+"
SHORTEST = 5      # items with fewer words are searched for as whole lines


def marked_words(text: Column) -> Column:
    """Words without punctuation; names carry a leading \x01.  Null and empty texts: none."""
    return F.array_remove(F.split(_clean(text), SPLIT), "")


def _clean(text: Column) -> Column:
    """The text without punctuation, names marked."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), NAME, "$1\x01"), DROP, "")


def template(words: Column) -> Column:
    """Template token of each marked word."""
    return F.transform(words, lambda x: _token(x, F.lower(x)))


def _token(x: Column, low: Column) -> Column:
    """Template token of a marked word; ``low`` is it in lower case.  What begins with a to z is no number."""
    return (F.when(x.startswith("\x01"), F.lit("<name>")).when(~low.between("a", "{") & x.rlike(r"^\p{N}"), F.lit("<num>"))
            .when(low.isin(*UNITS), F.lit("<unit>")).otherwise(low))


def plain(words: Column) -> Column:
    """Lower-cased words without marks, as they stand in windows compared word by word."""
    return F.transform(words, lambda x: _plain(F.lower(x)))


def _plain(low: Column) -> Column:
    return F.concat(F.lit("="), F.replace(low, F.lit("\x01"), F.lit("")))


def _window(t: Column, p: Column, i: Column, width) -> Column:
    """Tokens of a window: template tokens, or plain words if more than a half are slots."""
    w = F.slice(t, i, width)
    return F.when(F.size(F.filter(w, lambda x: x.startswith("<"))) * 2 > width, F.slice(p, i, width)).otherwise(w)


def _rolled(df: DataFrame, hashes: str, lengths: list[int], name: str, combine) -> DataFrame:
    """``df`` with an array ``name{k}`` for every length k: the tokens' values of each window of k
    combined, at its start.  Windows double, so a token is combined some log2(k) times."""
    one = lambda x: F.col(f"{name}{x}")
    ahead = lambda x, k: F.slice(one(x), k + 1, F.size(one(x)))
    df, k = df.withColumn(f"{name}1", F.col(hashes)), 1
    while 2 * k <= max(lengths):
        df, k = df.withColumn(f"{name}{2 * k}", F.zip_with(one(k), ahead(k, k), combine)), 2 * k
    for n in lengths:
        k = 1 << (n.bit_length() - 1)
        whole = one(k)
        at = k
        while at < n:
            k = 1 << ((n - at).bit_length() - 1)
            whole, at = F.zip_with(whole, ahead(k, at), combine), at + k
        if f"{name}{n}" not in df.columns:
            df = df.withColumn(f"{name}{n}", whole)
    return df


def window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (with ``c``, a clean text) and an array ``hash{k}`` for each length k: the hashes of all windows of k tokens.

    A word is hashed once as a template token and counted as a slot or not;
    windows combine the hashes of their words.  Plain words are hashed only in
    texts with a window that is slots for more than a half."""
    df = df.withColumn("w", F.array_remove(F.split(F.lower("c"), SPLIT), ""))
    slots = F.array(*(F.xxhash64(F.lit(x)) for x in ("<name>", "<num>", "<unit>")))
    df = df.withColumn("ht", F.transform("w", lambda x: F.xxhash64(_token(x, x)))).withColumn("n", F.size("w"))
    df = df.withColumn("s", F.transform("ht", lambda x: F.when(F.array_contains(slots, x), F.lit(1)).otherwise(F.lit(0))))
    df = _rolled(df, "ht", lengths, "t", lambda x, y: F.xxhash64(x, y))
    df = _rolled(df, "s", lengths, "s", lambda x, y: x + y)
    many = lambda k: F.exists(f"s{k}", lambda x: F.coalesce(x, F.lit(0)) * 2 > k)
    df = df.withColumn("hp", F.when(reduce(or_, [many(k) for k in lengths]), F.transform("w", lambda x: F.xxhash64(_plain(x)))))
    df = _rolled(df, "hp", lengths, "p", lambda x, y: F.xxhash64(x, y))
    for k in lengths:
        heavy = F.zip_with(f"s{k}", f"p{k}", lambda x, y: F.when(x * 2 > k, y))
        every = F.when(F.col("hp").isNull(), F.col(f"t{k}")).otherwise(F.zip_with(f"t{k}", heavy, lambda x, y: F.coalesce(y, x)))
        df = df.withColumn(f"hash{k}", F.slice(every, 1, F.greatest(F.col("n") - (k - 1), F.lit(0))))
    return df


def token_hash(tokens: Column, length: Column, lengths: list[int]) -> Column:
    """The hash that a window of these tokens has in ``window_hashes``; ``length`` is one of ``lengths``."""
    def fold(lo: int, n: int) -> Column:
        if n == 1:
            return F.xxhash64(F.get(tokens, F.lit(lo)))
        k = 1 << (n.bit_length() - 1)
        if k == n:
            return F.xxhash64(fold(lo, n // 2), fold(lo + n // 2, n // 2))
        whole, at = fold(lo, k), k
        while at < n:
            k = 1 << ((n - at).bit_length() - 1)
            whole, at = F.xxhash64(whole, fold(lo + at, k)), at + k
        return whole
    out = F.lit(None).cast("long")
    for n in lengths:
        out = F.when(length == n, fold(0, n)).otherwise(out)
    return out


def _items(bench: DataFrame, width: int, min_cover: float, min_windows: int) -> DataFrame:
    """One row per window of an item (two for a first window whose first word may be a name):
    item_id, len, n (windows of the item), need (windows of a hit), ipos, tw (tokens), iw (words), hash."""
    b = bench.select("item_id", marked_words(F.col("text")).alias("w")).filter(F.size("w") >= SHORTEST)
    b = b.withColumn("len", F.least(F.size("w"), F.lit(width))).withColumn("n", F.size("w") - F.col("len") + 1)
    named = b.filter(F.col("w")[0].rlike(r"^\p{Lu}\p{L}*$")).withColumn(
        "w", F.concat(F.array(F.concat(F.lit("\x01"), F.col("w")[0])), F.slice("w", 2, F.size("w")))).withColumn("ipos", F.lit(1))
    b = b.withColumn("ipos", F.explode(F.sequence(F.lit(1), F.col("n")))).unionByName(named)
    b = b.withColumn("t", template(F.col("w"))).withColumn("p", plain(F.col("w")))
    need = F.least(F.lit(min_windows), F.greatest(F.lit(1), F.ceil(F.col("n") * min_cover))).cast("int")
    return (b.withColumn("tw", _window(F.col("t"), F.col("p"), F.col("ipos"), F.col("len")))
            .select("item_id", "len", "n", need.alias("need"), "ipos", "tw", F.slice("w", F.col("ipos"), F.col("len")).alias("iw"),
                    token_hash(F.col("tw"), F.col("len"), list(range(1, width + 1))).alias("hash")).distinct())


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Written table of the texts' windows that some item has: h, hash, pos."""
    n, lengths = items.count(), sorted(r[0] for r in items.select("len").distinct().collect())      # at most ``width`` lengths
    keys = items.select("hash").distinct()
    if n <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    lengths = lengths or [WIDTH]
    t = window_hashes(docs.select(text_hash(F.col("text")).alias("h"), _clean(F.col("text")).alias("c")), lengths)
    # one element per window: its position follows from the index in the concatenated arrays
    # (outer: else Spark filters by the arrays' size first, and computes them twice)
    t = t.select("h", "n", F.posexplode_outer(F.concat(*[F.col(f"hash{k}") for k in lengths])).alias("i", "hash"))
    pos, before = F.col("i") + 1, F.lit(0)
    for k in lengths[:-1]:
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
        pos = F.when(F.col("i") >= before, F.col("i") + 1 - before).otherwise(pos)
    found = t.select("h", "hash", pos.alias("pos")).join(keys, "hash", "left_semi").distinct()
    return materialize(found, "template-found")


def _diagonals(found: DataFrame, items: DataFrame) -> DataFrame:
    """Written table of the diagonals with enough windows: h, item_id, diag, n_windows.

    Of an item's n windows a hit has ``need``, hence one of any n - need + 1; the
    windows in the fewest texts (and items) are taken."""
    places = found.groupBy("hash").agg(F.count("*").alias("texts"))
    owners = items.groupBy("hash").agg(F.countDistinct("item_id").alias("owners"))
    cost = (items.select("item_id", "ipos", "n", "need", "hash").join(places.join(owners, "hash"), "hash", "left")
            .groupBy("item_id", "ipos", "n", "need").agg(F.sum(F.coalesce("owners", F.lit(0)) * F.coalesce("texts", F.lit(0))).alias("c")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("c", "ipos"))
    anchors = cost.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.col("need") + 1).select("item_id", "ipos")
    anchors = items.join(anchors, ["item_id", "ipos"]).select("item_id", "ipos", "hash")
    key = ["h", "item_id", "diag"]
    some = materialize(found.join(anchors, "hash").select("h", "item_id", (F.col("pos") - F.col("ipos")).alias("diag")).distinct(),
                       "template-anchored")
    run = (some.join(items.select("item_id", "ipos", "need", "hash"), "item_id")
           .withColumn("pos", F.col("diag") + F.col("ipos")).join(found, ["h", "hash", "pos"])
           .groupBy(*key, "need").agg(F.countDistinct("ipos").alias("n_windows")).filter(F.col("n_windows") >= F.col("need")))
    out = materialize(run.drop("need"), "template-diagonals")
    release(some)
    return out


def _short_hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Texts with a line that has just the words of an item under SHORTEST words: h, item_id, n_windows, n_slots."""
    words = lambda text: F.array_join(plain(marked_words(text)), " ")
    items = (bench.select("item_id", marked_words(F.col("text")).alias("w"), words(F.col("text")).alias("key"))
             .filter((F.size("w") > 0) & (F.size("w") < SHORTEST)).select("item_id", "key"))
    items = materialize(items, "template-short")
    none = docs.sparkSession.createDataFrame([], items.schema).select(
        F.lit(0).cast("long").alias("h"), "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_slots"))
    if items.isEmpty():
        return none
    lines = docs.select(text_hash(F.col("text")).alias("h"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("h", words(F.col("line")).alias("key")).filter("key <> ''")
    keys = broadcast_if_small(items, 128)
    return lines.join(keys, "key").select("h", "item_id").distinct().withColumn("n_windows", F.lit(1).cast("long")) \
        .withColumn("n_slots", F.lit(0).cast("long"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def template_hits(docs: DataFrame, bench: DataFrame, width: int = WIDTH, min_cover: float = 0.5,
                  min_windows: int = 6, min_consistent: float = 0.8) -> DataFrame:
    """Contaminated texts: h (xxhash64 of the text), item_id, n_windows, n_slots (best diagonal)."""
    items = materialize(_items(bench, width, min_cover, min_windows), "template-items")
    found = _found(docs, items)
    runs = _diagonals(found, items)
    # the words of the texts that are left, to compare tokens and slots
    hit = broadcast_if_small(materialize(runs.select("h").distinct(), "template-texts"), 16)
    texts = (docs.select(text_hash(F.col("text")).alias("h"), "text").join(hit, "h", "left_semi")
             .groupBy("h").agg(F.first("text").alias("text"))
             .select("h", marked_words(F.col("text")).alias("w"))
             .withColumn("t", template(F.col("w"))).withColumn("p", plain(F.col("w"))))
    pairs = (runs.select("h", "item_id", "diag").join(items.select("item_id", "len", "n", "ipos", "tw", "iw", "hash"), "item_id")
             .withColumn("pos", F.col("diag") + F.col("ipos")).join(found, ["h", "hash", "pos"]).join(texts, "h"))
    pairs = (pairs.filter(_window(F.col("t"), F.col("p"), F.col("pos"), F.col("len")) == F.col("tw"))
             .withColumn("dw", F.slice("w", F.col("pos"), F.col("len")))
             .select("h", "item_id", "diag", "n", "len", "ipos", "tw", "iw", "dw"))
    pairs = materialize(pairs, "template-pairs")
    key = ["h", "item_id", "diag"]
    run = pairs.groupBy(*key).agg(F.first("n").alias("n"), F.countDistinct("ipos").alias("n_windows"))
    slot = (pairs.select(*key, "ipos", F.posexplode(F.arrays_zip("tw", "iw", "dw")).alias("k", "s"))
            .filter(F.col("s.tw").startswith("<"))
            .select(*key, (F.col("ipos") + F.col("k")).alias("q"), F.col("s.tw").alias("kind"),
                    F.lower("s.iw").alias("iv"), F.lower("s.dw").alias("dv")).distinct())
    counted = slot.groupBy(*key, "kind", "iv", "dv").agg(F.count("*").alias("c"))
    # share of an item's (document's) values that keep to one value on the other side
    by_item = counted.groupBy(*key, "kind", "iv").agg(
        F.max("c").alias("top"), F.sum("c").alias("all"))
    by_doc = counted.groupBy(*key, "kind", "dv").agg(
        F.max("c").alias("top"), F.sum("c").alias("all"))
    a = by_item.groupBy(*key).agg(F.sum("top").alias("a_top"), F.sum("all").alias("n_slots"))
    b = by_doc.groupBy(*key).agg(F.sum("top").alias("b_top"))
    j = run.join(a, key, "left").join(b, key, "left").na.fill(0, ["a_top", "b_top", "n_slots"])
    good = j.filter((F.least("a_top", "b_top") >= F.col("n_slots") * min_consistent)
                    & ((F.col("n_windows") >= min_windows) | (F.col("n_windows") >= F.col("n") * min_cover)))
    best = F.max(F.struct("n_windows", "n_slots"))
    return (good.groupBy("h", "item_id").agg(best.alias("b")).select("h", "item_id", "b.n_windows", "b.n_slots")
            .unionByName(_short_hits(docs, bench)))


def contaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """One row per document and benchmark item it contains: doc_id, item_id, n_windows, n_slots."""
    hits = template_hits(docs, bench, **how)
    return docs.select("doc_id", text_hash(F.col("text")).alias("h")).join(hits, "h").select("doc_id", "item_id", "n_windows", "n_slots")


def decontaminate(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their columns."""
    bad = broadcast_if_small(materialize(template_hits(docs, bench, **how).select("h").distinct(), "template-bad"), 16)
    x = docs.select(F.struct("*").alias("d")).withColumn("h", text_hash(F.col("d.text")))
    return x.join(bad, "h", "left_anti").select("d.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
           '([\p{Ll}\p{N},;] )(\p{Lu}\p{L}*)', '\1' || chr(1) || '\2', 'g'),
           '([\p{Ll}\p{N},;] )(\p{Lu}\p{L}*)', '\1' || chr(1) || '\2', 'g'),
           '[^\p{L}\p{N}\x01\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents
        UNION ALL SELECT 'item', item_id, text FROM benchmark)),
marked AS (
  SELECT kind, id, w, 0 AS variant FROM words
  UNION ALL
  SELECT kind, id, list_concat([chr(1) || w[1]], w[2:]), 1 FROM words WHERE kind = 'item' AND regexp_full_match(w[1], '\p{Lu}\p{L}*')),
tok AS (
  SELECT kind, id, w, variant, list_transform(w, lambda x: CASE WHEN starts_with(x, chr(1)) THEN '<name>'
           WHEN regexp_matches(x, '^\p{N}') THEN '<num>'
           WHEN lower(x) IN (@UNITS@) THEN '<unit>' ELSE lower(x) END) AS t,
         list_transform(w, lambda x: '=' || lower(replace(x, chr(1), ''))) AS p FROM marked),
iw AS (
  SELECT id AS item_id, variant, least(len(t), @W@) AS l, len(t) - least(len(t), @W@) + 1 AS n,
         unnest(range(1, len(t) - least(len(t), @W@) + 2)) AS ipos, w, t, p FROM tok WHERE kind = 'item' AND len(t) >= 5),
items AS (
  SELECT DISTINCT item_id, l, n, ipos, CASE WHEN len(list_filter(t[ipos:ipos + l - 1], lambda x: starts_with(x, '<'))) * 2 > l
           THEN p[ipos:ipos + l - 1] ELSE t[ipos:ipos + l - 1] END AS tw, w[ipos:ipos + l - 1] AS ws FROM iw
  WHERE variant = 0 OR ipos = 1),
dw AS (
  SELECT id AS doc_id, l, pos, w, CASE WHEN len(list_filter(t[pos:pos + l - 1], lambda x: starts_with(x, '<'))) * 2 > l
           THEN p[pos:pos + l - 1] ELSE t[pos:pos + l - 1] END AS tw
  FROM (SELECT id, l, unnest(range(1, len(t) - l + 2)) AS pos, w, t, p
        FROM tok, (SELECT DISTINCT l FROM items) WHERE kind = 'doc' AND len(t) >= l)),
pairs AS (
  SELECT d.doc_id, i.item_id, d.pos - i.ipos AS diag, i.n, i.ipos, i.tw, i.ws, d.w[d.pos:d.pos + d.l - 1] AS ds
  FROM dw d JOIN items i ON d.l = i.l AND d.tw = i.tw),
run AS (SELECT doc_id, item_id, diag, any_value(n) AS n, count(DISTINCT ipos) AS n_windows FROM pairs GROUP BY ALL),
slot AS (
  SELECT DISTINCT doc_id, item_id, diag, ipos + k AS q, tw[k] AS kind, lower(ws[k]) AS iv, lower(ds[k]) AS dv
  FROM (SELECT *, unnest(range(1, len(tw) + 1)) AS k FROM pairs) WHERE starts_with(tw[k], '<')),
c AS (SELECT doc_id, item_id, diag, kind, iv, dv, count(*) AS c FROM slot GROUP BY ALL),
a AS (SELECT doc_id, item_id, diag, sum(top) AS a_top, sum(n) AS n_slots
      FROM (SELECT doc_id, item_id, diag, kind, iv, max(c) AS top, sum(c) AS n FROM c GROUP BY ALL) GROUP BY ALL),
b AS (SELECT doc_id, item_id, diag, sum(top) AS b_top
      FROM (SELECT doc_id, item_id, diag, kind, dv, max(c) AS top FROM c GROUP BY ALL) GROUP BY ALL),
good AS (
  SELECT r.doc_id, r.item_id, r.n_windows, coalesce(n_slots, 0) AS n_slots
  FROM run r LEFT JOIN a USING (doc_id, item_id, diag) LEFT JOIN b USING (doc_id, item_id, diag)
  WHERE least(coalesce(a_top, 0), coalesce(b_top, 0)) >= coalesce(n_slots, 0) * 0.8
    AND (r.n_windows >= 6 OR r.n_windows >= r.n * 0.5)),
short_items AS (SELECT id AS item_id, array_to_string(p, ' ') AS key FROM tok
          WHERE kind = 'item' AND variant = 0 AND len(p) BETWEEN 1 AND 4),
lines AS (
  SELECT DISTINCT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(line,
           '[^\p{L}\p{N}\x01\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> ''),
           lambda x: '=' || lower(replace(x, chr(1), ''))), ' ') AS key
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, item_id, max(struct_pack(a := n_windows, b := n_slots)).a::BIGINT AS n_windows,
       max(struct_pack(a := n_windows, b := n_slots)).b::BIGINT AS n_slots
FROM good GROUP BY ALL
UNION ALL SELECT DISTINCT doc_id, item_id, 1::BIGINT, 0::BIGINT FROM lines JOIN short_items USING (key)
""".replace("@UNITS@", ", ".join(f"'{u}'" for u in UNITS)).replace("@W@", str(WIDTH))
