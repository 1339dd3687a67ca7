"""The numbered operators as registered queries over their whole tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm import (bpe, classifiers, decontaminate, licenses, line_dedup, quality_rules, secret_scan, simhash, substrings, vector_codes,
                          whitening, wordpieces)
from partwise.llm.common import table


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = F.concat(*[x for c in ("source", "lang", "doc_id") for x in (F.lit("/"), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id")


def op2_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpieces.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return classifiers.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifiers.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(table(spark, folder, "embeddings"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digests(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


OP5_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
grams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
repeated AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT docs.rid, doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN w USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
f AS (
  SELECT source, unnest([
    {'rule': 'short', 'failed': (n_words < 50)::INT}, {'rule': 'repeats', 'failed': (100 * n_repeat_words > 50 * n_words)::INT},
    {'rule': 'symbols', 'failed': (10 * n_symbols > word_chars)::INT}, {'rule': 'lines', 'failed': (2 * n_dup_lines > n_words)::INT}
  ]) AS x FROM m WHERE source IS NOT NULL),
h AS (SELECT source, x.rule AS rule, count(*) AS n, sum(x.failed) AS failed FROM f GROUP BY ALL),
prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS s
  FROM (SELECT rule, sum(failed) / sum(n) AS m, var_pop(failed / n) AS v FROM h GROUP BY rule)),
hosts AS (
  SELECT source, max((failed + m * s) / (n + s)) AS host_rate FROM h JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(host_rate, 0) <= 0.8 AS kept
FROM m LEFT JOIN hosts USING (source)
"""

OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spots AS (
  SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY win) AS n FROM spots) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM hit),
words AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM docs),
kept AS (
  SELECT rid, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM docs)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS home FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT k.*, home IS NOT NULL AND doc_id <> home AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


def _op13_sql() -> str:
    """The codebooks round by round; a vector is (part, v) rows, ties go to the lower entry."""
    def assigned(books: str) -> str:
        return f"""SELECT r.rid, r.part, any_value(r.v) AS v, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
          FROM r JOIN {books} b USING (part), LATERAL (SELECT list_sum(list_transform(list_zip(r.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d)
          GROUP BY r.rid, r.part"""

    def averaged(books: str, marks: str) -> str:
        return f"""SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
          SELECT part, entry, list(floor_mean ORDER BY p) AS v FROM (
            SELECT part, entry, p, (s - (s % n + n) % n) // n AS floor_mean FROM (
              SELECT part, entry, p, sum(x)::BIGINT AS s, count(*) AS n
              FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM {marks}) GROUP BY ALL))
          GROUP BY part, entry) m USING (part, entry)"""

    return f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS (SELECT rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM kept),
r AS (SELECT rid, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v FROM (SELECT rid, v, unnest(range(0, 16)) AS part FROM x)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM r WHERE rid <= 64),
a0 AS MATERIALIZED ({assigned("b0")}),
b1 AS MATERIALIZED ({averaged("b0", "a0")}),
a1 AS MATERIALIZED ({assigned("b1")}),
b2 AS MATERIALIZED ({averaged("b1", "a1")}),
a2 AS MATERIALIZED ({assigned("b2")}),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN c USING (rid) CROSS JOIN books"""


QUERIES = {
    f.__name__: f for f in (
        op1_license_scan, op2_simhash_near_duplicates, op3_substring_dedup, op4_byte_bpe, op5_quality_rules, op6_token_counts, op7_secret_scan, op8_decontamination,
        op9_toxicity, op10_quality_classifier, op11_embedding_whitening, op12_line_dedup, op13_vector_codes)
}
OP1_SQL = licenses.sql("""SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' ||
  coalesce(doc_id::VARCHAR, '') AS path, text FROM documents""", "doc_id")
OP8_SQL = decontaminate.sql("SELECT doc_id, text FROM documents", "SELECT item_id, text FROM benchmark", "doc_id", "item_id")
ORACLES = {
    "op1_license_scan": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_vector_codes": _op13_sql(),
}
