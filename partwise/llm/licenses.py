"""Licence scans in DataFrame functions alone: TF-IDF cosine to templates, then inheritance along paths.

Every line of every file (a header) and every whole file is compared with the templates.
A file that is a licence as a whole states the licence of its folder; a file without an own
licence takes that of its nearest folder upwards that has one.

Defined results: a missing or empty text has no own licence but may inherit one; of equal
cosines the smallest licence name wins, of lines the earliest; files of one path and text
are one file; rows of one path with different texts are judged each by its own text; an
empty table gives an empty table; only key, path and text are read.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import stored

#: The words by which licences are stated.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
TOKEN = r"[\p{L}\p{N}]+"
#: Templates are held by the driver; more of them are an error.
MOST_TEMPLATES = 10_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", "tk", F.posexplode(F.split("text", "\n")).alias("line", "_text")).select(
        "path", "tk", "line", tokens(F.col("_text")).alias("terms")).where(F.size("terms") > 0)


def _vectors(templates: list[tuple[str, str]], rows: dict[str, list[str]], idf: dict[str, float], at: float):
    """Unit vectors of the templates, and the terms of which a text needs one to reach the cosine ``at``.

    If a text holds none of a template's heaviest terms, its cosine is at most the norm of
    the rest; terms are added until that norm is below ``at``.
    """
    vectors, needed = [], set()
    for number, (name, text) in enumerate(templates):
        tf: dict[str, int] = {}
        for t in rows[text]:
            tf[t] = tf.get(t, 0) + 1
        weights = {t: n * idf[t] for t, n in tf.items()}
        norm = sqrt(sum(w * w for w in weights.values()))
        unit = sorted(((w / norm, t) for t, w in weights.items()), reverse=True)
        vectors += [(number, name, t, w) for w, t in unit]
        rest = 1.0
        for w, t in unit:
            if rest < (at - 1e-6) ** 2:
                break
            needed.add(t)
            rest -= w * w
    return vectors, sorted(needed)


def _cosines(units: DataFrame, key: list[str], idf: DataFrame, vectors: DataFrame, unseen: float, at: float) -> DataFrame:
    """(key.., license, cosine): the best template of each unit that reaches ``at``."""
    tf = units.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy(*key, "number", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= at)
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("b"))
    return best.select(*key, F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(files: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, inherited_license, inherited_from) of every folder of ``files`` below a licensed folder, itself included.

    ``licensed`` is (path, license, cosine) of licence files.
    """
    stated = licensed.groupBy(folder(F.col("path")).alias("inherited_from")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("b")).select(
        "inherited_from", F.col("b.license").alias("inherited_license"))
    parts = F.split("dir", "/")
    ways = files.select(folder(F.col("path")).alias("dir")).distinct().select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
            i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))).alias("_w")).select("dir", "_w.*")
    met = ways.join(stated, F.col("up") == F.col("inherited_from"))
    return met.groupBy("dir").agg(F.max(F.struct("depth", "inherited_license", "inherited_from")).alias("b")).select(
        "dir", "b.inherited_license", "b.inherited_from")


def scan(files: DataFrame, key: str, templates: list[tuple[str, str]] = TEMPLATES, header_at: float = 0.8,
         file_at: float = 0.8) -> DataFrame:
    """One row per row of ``files`` (key, path, text): own, whole-file and inherited licences with their cosines."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    spark = files.sparkSession
    files = files.select(F.col(key).alias("_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    files = files.withColumn("tk", F.xxhash64("text"))
    split = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for _, t in templates], "t string").select(
        "t", tokens(F.col("t")).alias("x")).collect()}
    vocabulary = sorted({t for x in split.values() for t in x})

    own = F.array_distinct(F.array_intersect("terms", F.lit(vocabulary)))
    counts = _lines(files).select(F.explode(F.concat(F.array(F.lit("")), own)).alias("term")).groupBy("term").agg(
        F.count("*").alias("n")).collect()
    seen = {r["term"]: r["n"] for r in counts}
    lines = seen.pop("", 0)
    idf = {t: log((1 + lines) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    vectors, needed = _vectors(templates, split, idf, min(header_at, file_at))
    idf_table = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    vector_table = spark.createDataFrame(vectors, "number int, license string, term string, unit double")
    unseen = log(1 + lines) + 1

    some = stored(_lines(files).where(F.arrays_overlap("terms", F.lit(needed))).distinct(), "lines")
    per_line = _cosines(some, ["path", "tk", "line"], idf_table, vector_table, unseen, header_at)
    headers = per_line.groupBy("path", "tk").agg(F.min(F.struct(
        (-F.col("cosine")).alias("c"), F.col("license"), F.col("line"))).alias("b")).select(
        F.col("path").alias("_hp"), F.col("tk").alias("_ht"), F.col("b.license").alias("header_license"), (-F.col("b.c")).alias("header_cosine"))
    # A file holds a needed term exactly if one of its lines does, so no join is needed to find the files to weigh.
    whole = files.select("path", "tk", tokens(F.col("text")).alias("terms")).where(
        F.arrays_overlap("terms", F.lit(needed))).dropDuplicates(["path", "tk"])
    per_file = stored(_cosines(whole, ["path", "tk"], idf_table, vector_table, unseen, file_at), "licence-files")
    folders = stored(inherited(files, per_file), "folders")

    per_file = per_file.toDF("_fp", "_ft", "file_license", "file_cosine")
    own_ones = stored(headers.join(per_file, (F.col("_hp") == F.col("_fp")) & (F.col("_ht") == F.col("_ft")), "full").select(
        F.coalesce("_hp", "_fp").alias("_op"), F.coalesce("_ht", "_ft").alias("_ot"),
        "header_license", "header_cosine", "file_license", "file_cosine"), "own")
    rows = files.select("_id", "path", "tk")
    out = rows.join(own_ones, (F.col("path") == F.col("_op")) & (F.col("tk") == F.col("_ot")), "left")
    out = out.join(folders, folder(F.col("path")) == F.col("dir"), "left")
    return out.select(
        F.col("_id").alias(key), "path", "header_license", "header_cosine", "file_license", "file_cosine", "inherited_license",
        "inherited_from", F.coalesce("file_license", "header_license", "inherited_license").alias("license"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(files: str, key: str, header_at: float = 0.8, file_at: float = 0.8) -> str:
    """The same result in SQL, over a subquery ``files`` with the columns key, path and text."""
    values = ", ".join(f"({i}, {_sql_text(n)}, {_sql_text(t)})" for i, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH files AS (SELECT {key}, coalesce(path, '') AS path, coalesce(text, '') AS text FROM ({files})),
uniq AS (SELECT DISTINCT path, text FROM files),
templates(number, license, text) AS (VALUES {values}),
lines AS (
  SELECT path, text, line, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS terms
  FROM (SELECT path, text, unnest(xs) AS x, unnest(range(len(xs))) AS line
        FROM (SELECT path, text, string_split(text, chr(10)) AS xs FROM uniq))),
all_lines AS (
  SELECT regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS terms FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM files)),
total AS (SELECT count(*) AS n FROM all_lines WHERE len(terms) > 0),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM all_lines) GROUP BY term),
tt AS (SELECT number, license, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM templates),
idf AS (SELECT DISTINCT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM tt LEFT JOIN df USING (term), total),
tw AS (SELECT number, license, term, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (term) GROUP BY ALL),
tv AS (SELECT number, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY number)) AS unit FROM tw),
units AS (
  SELECT path, text, line, terms FROM lines WHERE len(terms) > 0
  UNION ALL SELECT path, text, -1, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') FROM uniq),
tf AS (SELECT path, text, line, term, count(*) AS tf FROM (SELECT path, text, line, unnest(terms) AS term FROM units) GROUP BY ALL),
weighed AS (SELECT path, text, line, term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM tf LEFT JOIN idf USING (term), total),
norms AS (SELECT path, text, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT path, text, line, number, license, sum(w * unit) AS dot FROM weighed JOIN tv USING (term) GROUP BY ALL),
scored AS (SELECT path, text, line, license, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (path, text, line)),
h AS (
  SELECT path, text, license AS header_license, cosine AS header_cosine FROM scored WHERE line >= 0 AND cosine >= {header_at}
  QUALIFY row_number() OVER (PARTITION BY path, text ORDER BY cosine DESC, license, line) = 1),
f AS (
  SELECT path, text, license AS file_license, cosine AS file_cosine FROM scored WHERE line < 0 AND cosine >= {file_at}
  QUALIFY row_number() OVER (PARTITION BY path, text ORDER BY cosine DESC, license) = 1),
stated AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS inherited_from, file_license AS inherited_license FROM f
  QUALIFY row_number() OVER (PARTITION BY inherited_from ORDER BY file_cosine DESC, file_license) = 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
ways AS (
  SELECT dir, i AS depth, array_to_string(list_slice(string_split(dir, '/'), 1, i), '/') AS up
  FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS i FROM dirs)),
near AS (
  SELECT dir, inherited_license, inherited_from FROM ways JOIN stated ON up = inherited_from
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT {key}, path, header_license, header_cosine, file_license, file_cosine, inherited_license, inherited_from,
  coalesce(file_license, header_license, inherited_license) AS license
FROM files LEFT JOIN h USING (path, text) LEFT JOIN f USING (path, text)
  LEFT JOIN near ON regexp_extract(path, '^(.*)/[^/]*$', 1) = dir
"""
