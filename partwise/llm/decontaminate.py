"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, quantities and names give way to typed placeholders, so a question with other
numbers or names has the same template.  Windows of five template words meet in a hash
join; an item is found in a document that holds at least the given share of its windows
and whose slot values map consistently from the item's.

Defined results: a missing or empty text has no windows, so it is never found; an item of
fewer than five words is found by all of its lower-cased words in a row; items that are equal are found together; rows of the same key
and text count once; rows without a key are compared like others; an empty table gives no
pairs; only keys and texts are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.llm.common import stored

#: What counts as a name, a quantity, a number and a word.
NAME = r"([^.!?\s][ \t]+)(\p{Lu}\p{Ll}+(?:[ \t]+\p{Lu}\p{Ll}+)*)"
UNITS = ("km|cm|mm|kg|mg|ml|min|hours|hour|days|day|weeks|week|years|year|percent|dollars|dollar|euros|euro|"
         "miles|mile|m|g|l|h|s|%|€")
QUANTITY = rf"(\p{{N}}+(?:[.,]\p{{N}}+)*[ \t]?(?:{UNITS}))([^\p{{L}}]|\z)"
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
WORD = r"[\p{L}\p{N}⟨⟩]+"

# The same three for the JVM.  It calls itself once more for each round of a repeated group unless the repeat never
# gives back, and it would read a long number again from each of its digits; nothing that these repeats could give
# back would match, so the forms find the same.
JVM_NAME = NAME.replace("]+)(", "]++)(").replace("Ll}+", "Ll}++").replace(r"[ \t]+\p", r"[ \t]++\p").replace(")*)", ")*+)")
JVM_NUMBER = NUMBER.replace("N}+", "N}++").replace(")*", ")*+")
JVM_QUANTITY = r"(?:\G|(?<=\G[.,])|(?<!\p{N})(?<!\p{N}[.,]))" + QUANTITY.replace(NUMBER, JVM_NUMBER)
SLOTS = ("⟨name⟩", "⟨qty⟩", "⟨num⟩")
WIDTH = 5
FOUND = ("dk", "tk", "ik", "n_windows", "n_found", "n_slots", "n_consistent", "n_changed")
#: A table of item windows with at most so many rows is sent to every executor (24 bytes a row); a larger one is joined by shuffle.
MOST_BROADCAST_ROWS = 2_000_000


def canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``words`` (template words) and ``values`` (per slot type, the texts replaced, in order)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t0", raw).withColumn("_t1", F.regexp_replace("_t0", JVM_NAME, "$1⟨name⟩"))
    df = df.withColumn("_t2", F.regexp_replace("_t1", JVM_QUANTITY, " ⟨qty⟩ $2"))
    return df.select(
        *[c for c in df.columns if not c.startswith("_t")],
        F.regexp_extract_all(F.lower(F.regexp_replace("_t2", JVM_NUMBER, " ⟨num⟩ ")), F.lit(WORD), 0).alias("words"),
        F.struct(F.regexp_extract_all("_t0", F.lit(JVM_NAME), 2).alias("v0"), F.regexp_extract_all("_t1", F.lit(JVM_QUANTITY), 1).alias("v1"),
                 F.regexp_extract_all("_t2", F.lit(JVM_NUMBER), 0).alias("v2")).alias("values"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, ik, ipos, h).  The first word opens a sentence in the item, but may look like a name where
    it is quoted, so the first window has a second form with a name in that place."""
    rows = template_words(items, "item", "ik")
    quoted = F.concat(F.array(F.lit(SLOTS[0])), F.slice("words", 2, WIDTH - 1))
    return rows.select("item", "ik", F.posexplode(window_hashes(F.col("words"))).alias("ipos", "h")).union(
        rows.where(F.size("words") >= WIDTH).select("item", "ik", quoted.alias("words")).select(
            "item", "ik", F.posexplode(window_hashes(F.col("words"))).alias("ipos", "h"))).distinct()


def template_words(df: DataFrame, *keep: str) -> DataFrame:
    return canonical(df).select(*keep, "words")


def window_hashes(words: Column) -> Column:
    """One 64-bit hash per window of five words; none for shorter sequences."""
    last = F.size(words) - WIDTH
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WIDTH)])))


def _slot_values(df: DataFrame, *key: str) -> DataFrame:
    """(key.., at, value): every slot of a text with its word position; a window over one text's slots alone."""
    rows = canonical(df).select(*key, "values", F.posexplode("words").alias("at", "_w")).where(F.col("_w").isin(*SLOTS))
    order = Window.partitionBy(*key, "_w").orderBy("at")
    rows = rows.withColumn("_n", F.row_number().over(order))
    value = F.coalesce(*[F.when(F.col("_w") == s, F.get(F.col(f"values.v{i}"), F.col("_n") - 1)) for i, s in enumerate(SLOTS)])
    return rows.select(*key, "at", F.lower(value).alias("value"))


def _alike(found: DataFrame, docs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """(dk, tk, ik, n_slots, n_consistent, n_changed) of candidate pairs.

    Alignments of a passage share the difference of the positions; the one with the most
    windows counts.  A slot value of the item is consistent if all its places hold one and
    the same value of the document.
    """
    pair = ["dk", "tk", "ik"]
    hits = hits.join(found.select(*pair), pair, "left_semi").withColumn("shift", F.col("dpos") - F.col("ipos"))
    theirs = stored(_slot_values(items, "ik"), "item-slots").withColumnRenamed("value", "theirs")
    cover = hits.join(theirs.select("ik").distinct(), "ik", "left_semi").groupBy(*pair, "shift").agg(
        F.countDistinct("ipos").alias("_c"), F.collect_set("ipos").alias("_at"))
    best = cover.groupBy(*pair).agg(F.max(F.struct("_c", (-F.abs("shift")).alias("_s"), "shift", "_at")).alias("_b"))
    best = stored(best.select(*pair, "_b.shift", F.explode("_b._at").alias("ipos")).select(
        *pair, "shift", F.explode(F.array(*[F.col("ipos") + j for j in range(WIDTH)])).alias("at")).distinct(), "aligned")
    ours = _slot_values(docs.join(best.select("dk", "tk").distinct(), ["dk", "tk"], "left_semi").dropDuplicates(["dk", "tk"]), "dk", "tk")
    met = best.join(theirs, ["ik", "at"]).withColumn("at", F.col("at") + F.col("shift")).join(
        ours.withColumnRenamed("value", "ours"), ["dk", "tk", "at"])
    per_value = met.groupBy(*pair, "theirs").agg(
        F.count("*").alias("_n"), (F.min("ours") == F.max("ours")).cast("int").alias("_same"),
        F.sum((F.col("ours") != F.col("theirs")).cast("int")).alias("_new"))
    return per_value.groupBy(*pair).agg(F.sum("_n").alias("n_slots"), F.sum(F.col("_n") * F.col("_same")).alias("n_consistent"),
                                        F.sum("_new").alias("n_changed"))


def _key_hash(key: Column) -> Column:
    return F.xxhash64(key.isNull(), key.cast("string"))


def plain_words(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``words``, lower-cased, without placeholders."""
    return df.select(*keep, F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0).alias("words"))


def plain_hashes(words: Column, width: int) -> Column:
    """One 64-bit hash per run of ``width`` words, seeded by the width."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        F.lit(width), *[F.get(words, i + j) for j in range(width)])))


def _plain(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """(doc, item, dk, tk, ik, n_windows, n_found) of pairs found by lower-cased words alone."""
    words = plain_words(items, "item", "ik")
    own = F.lit(None)
    for width in range(1, WIDTH + 1):
        here = F.size("words") >= width if width == WIDTH else F.size("words") == width
        own = F.when(here, plain_hashes(F.col("words"), width)).otherwise(own)
    theirs = stored(words.select("item", "ik", F.least(F.size("words"), F.lit(WIDTH)).alias("width"), F.posexplode(own).alias("ipos", "h")), "plain-windows")
    totals = theirs.groupBy("ik").agg(F.countDistinct("ipos").alias("n_windows"))
    widths = sorted(r["width"] for r in theirs.select("width").distinct().collect())
    if not widths:
        return docs.join(totals, F.lit(False)).join(items.select("item", F.col("ik").alias("_i")), F.lit(False)).select(
            "doc", "item", "dk", "tk", "ik", "n_windows", F.lit(0).cast("long").alias("n_found"))
    every = F.concat(*[F.coalesce(plain_hashes(F.col("words"), w), F.array().cast("array<bigint>")) for w in widths])
    ours = plain_words(docs, "doc", "dk", "tk").select("doc", "dk", "tk", F.explode(every).alias("g"))
    small = theirs.count() <= MOST_BROADCAST_ROWS
    hits = ours.join(F.broadcast(theirs) if small else theirs, F.col("g") == F.col("h"))
    found = hits.groupBy("doc", "item", "dk", "tk", "ik").agg(F.countDistinct("ipos").alias("n_found"))
    return found.join(totals, "ik").where(F.col("n_found") >= share * F.col("n_windows")).select(
        "doc", "item", "dk", "tk", "ik", "n_windows", "n_found")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", share: float = 0.8) -> DataFrame:
    """(doc, item, dk, tk, ik, n_windows, n_found, n_slots, n_consistent, n_changed), one row per pair found.

    A pair found by its template is told by that; one found by its plain form alone has that form's windows and no slots.
    dk is a hash of the document's key, tk of its text, ik of the item's key and text: they have no nulls to join on.
    """
    docs = docs.select(F.col(key).alias("doc"), _key_hash(F.col(key)).alias("dk"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")
    items = items.select(F.col(item_key).alias("item"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "ik", F.xxhash64(_key_hash(F.col("item")), "text")).dropDuplicates(["ik"])
    theirs = stored(item_windows(items), "item-windows")
    totals = theirs.groupBy("ik").agg(F.countDistinct("ipos").alias("n_windows"))
    ours = template_words(docs, "doc", "dk", "tk").select(
        "doc", "dk", "tk", F.posexplode(window_hashes(F.col("words"))).alias("dpos", "g"))
    small = theirs.count() <= MOST_BROADCAST_ROWS
    hits = stored(ours.join(F.broadcast(theirs) if small else theirs, F.col("g") == F.col("h")).select(
        "doc", "item", "dk", "tk", "ik", "dpos", "ipos"), "hits")
    found = hits.groupBy("doc", "item", "dk", "tk", "ik").agg(F.countDistinct("ipos").alias("n_found"))
    found = stored(found.join(totals, "ik").where(F.col("n_found") >= share * F.col("n_windows")), "found")
    out = found.join(_alike(found, docs, items, hits), ["dk", "tk", "ik"], "left").fillna(0, ["n_slots", "n_consistent", "n_changed"])
    out = stored(out.where(F.col("n_consistent") >= share * F.col("n_slots")).select("doc", "item", *FOUND), "by-template")
    more = _plain(docs, items, share).join(out.select("dk", "tk", "ik"), ["dk", "tk", "ik"], "left_anti")
    zero = F.lit(0).cast("long")
    return out.unionByName(more.select("*", zero.alias("n_slots"), zero.alias("n_consistent"), zero.alias("n_changed")))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", share: float = 0.8) -> DataFrame:
    """Pairs of document and item keys with the counts behind the verdict."""
    found = contaminated(docs, items, key, item_key, share)
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_windows", "n_found", "n_slots", "n_consistent",
                        "n_changed").distinct()


def drop_leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", share: float = 0.8) -> DataFrame:
    """The documents in which no item is found; rows and columns stay as they are."""
    bad = stored(contaminated(docs, items, key, item_key, share).select(
        F.col("dk").alias("_d"), F.col("tk").alias("_k")).distinct(), "leaked")
    return docs.join(bad, (_key_hash(docs[key]) == bad["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_k"]), "left_anti")


def sql(docs: str, items: str, key: str, item_key: str, share: float = 0.8) -> str:
    """The same pairs in SQL, over subqueries with a key and a text."""
    return rf"""
WITH src AS (
  SELECT row_number() OVER () AS uid, * FROM (
    SELECT DISTINCT 'd' AS kind, {key} AS id, coalesce(text, '') AS t0 FROM ({docs})
    UNION ALL SELECT DISTINCT 'i', {item_key}, coalesce(text, '') FROM ({items}))),
s1 AS (SELECT *, regexp_replace(t0, '{NAME}', '\1⟨name⟩', 'g') AS t1 FROM src),
s2 AS (SELECT *, regexp_replace(t1, '{QUANTITY}', ' ⟨qty⟩ \2', 'g') AS t2 FROM s1),
s3 AS (
  SELECT uid, kind, id, regexp_extract_all(lower(regexp_replace(t2, '{NUMBER}', ' ⟨num⟩ ', 'g')), '{WORD}') AS words,
    regexp_extract_all(t0, '{NAME}', 2) AS v0, regexp_extract_all(t1, '{QUANTITY}', 1) AS v1, regexp_extract_all(t2, '{NUMBER}') AS v2
  FROM s2),
w AS (
  SELECT uid, kind, id, i, array_to_string(words[i + 1:i + 5], ' ') AS win, array_to_string(words[i + 2:i + 5], ' ') AS tail
  FROM (SELECT *, unnest(range(len(words) - 4)) AS i FROM s3 WHERE len(words) >= 5)),
theirs AS (
  SELECT uid AS iu, id AS item, i AS ipos, win FROM w WHERE kind = 'i'
  UNION SELECT uid, id, 0, '⟨name⟩ ' || tail FROM w WHERE kind = 'i' AND i = 0),
totals AS (SELECT iu, count(DISTINCT ipos) AS n_windows FROM theirs GROUP BY iu),
hits AS (SELECT uid, id AS doc, iu, item, i AS dpos, ipos FROM w JOIN theirs USING (win) WHERE kind = 'd'),
found AS (
  SELECT uid, doc, iu, item, n_windows, count(DISTINCT ipos) AS n_found FROM hits JOIN totals USING (iu)
  GROUP BY ALL HAVING count(DISTINCT ipos) >= {share} * n_windows),
slots AS (
  SELECT uid, kind, id, spot, lower(CASE word WHEN '⟨name⟩' THEN v0[n] WHEN '⟨qty⟩' THEN v1[n] ELSE v2[n] END) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY uid, word ORDER BY spot) AS n
        FROM (SELECT uid, kind, id, v0, v1, v2, unnest(range(len(words))) AS spot, unnest(words) AS word FROM s3)
        WHERE word IN ('⟨name⟩', '⟨qty⟩', '⟨num⟩'))),
aligned AS (
  SELECT uid, iu, shift FROM (
    SELECT h.uid, h.iu, dpos - ipos AS shift, count(DISTINCT ipos) AS c
    FROM hits h JOIN found f ON h.uid = f.uid AND h.iu = f.iu GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY uid, iu ORDER BY c DESC, abs(shift), shift DESC) = 1),
cover AS (
  SELECT DISTINCT h.uid, h.iu, a.shift, unnest(range(ipos, ipos + 5)) AS spot
  FROM hits h JOIN aligned a ON h.uid = a.uid AND h.iu = a.iu AND h.dpos - h.ipos = a.shift),
met AS (
  SELECT c.uid, c.iu, a.value AS theirs, b.value AS ours
  FROM cover c JOIN slots a ON a.uid = c.iu AND a.spot = c.spot
    JOIN slots b ON b.uid = c.uid AND b.spot = c.spot + shift),
per_value AS (
  SELECT uid, iu, theirs, count(*) AS n, (min(ours) = max(ours))::INT AS same, sum((ours <> theirs)::INT) AS new
  FROM met GROUP BY ALL),
alike AS (
  SELECT uid, iu, sum(n) AS n_slots, sum(n * same) AS n_consistent, sum(new) AS n_changed FROM per_value GROUP BY ALL)
SELECT DISTINCT doc AS {key}, item AS {item_key}, n_windows, n_found, coalesce(n_slots, 0)::BIGINT AS n_slots,
  coalesce(n_consistent, 0)::BIGINT AS n_consistent, coalesce(n_changed, 0)::BIGINT AS n_changed
FROM found LEFT JOIN alike USING (uid, iu)
WHERE coalesce(n_consistent, 0) >= {share} * coalesce(n_slots, 0)
"""
