"""Readers: wide text matrices, typed reloads, triplets, annotations, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.guards import clean


def csv_matrix(spark: SparkSession, path: str, feature: str = "feature", sep: str = ",", max_columns: int = 2_000_000) -> DataFrame:
    """Wide matrix file (first column = feature, one column per sample) to long rows.

    ``max_columns`` replaces the reader's own limit; a wider file is the reader's error.
    """
    wide = spark.read.csv(path, header=True, sep=sep, maxColumns=max_columns)
    first, *samples = wide.columns
    longer = wide.withColumnRenamed(first, feature).unpivot([feature], samples, "sample", "_raw")
    return longer.select(feature, "sample", clean(F.expr("try_cast(_raw AS double)")).alias("value"))


def typed_reload(spark: SparkSession, path: str, ids: Sequence[str], numbers: Sequence[str],
                 sep: str = "\t") -> DataFrame:
    """Re-read a processed table with ids as trimmed text and bad numbers as missing."""
    raw = spark.read.csv(path, header=True, sep=sep)
    return raw.select(
        *[F.trim(F.col(c)).alias(c) for c in ids],
        *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in numbers],
    )


def plain_or_gz(spark: SparkSession, paths: Sequence[str], sep: str = ",", pieces: int | None = None) -> DataFrame:
    """Read plain and gzip text together; gzip does not split, so spread the rows after."""
    df = spark.read.csv(list(paths), header=True, sep=sep)
    return df.repartition(pieces) if pieces else df


def many_files(spark: SparkSession, path: str, name_pattern: str, columns: str, sep: str = "\t",
               summary_prefix: str = "N_") -> DataFrame:
    """One file per sample: tag rows with the id in the file name, drop summary rows."""
    df = spark.read.csv(path, schema=columns, sep=sep, header=True)
    first = df.columns[0]
    return df.withColumn("sample", F.regexp_extract(F.input_file_name(), name_pattern, 1)).where(
        ~F.col(first).startswith(summary_prefix)
    )


def triplets(spark: SparkSession, path: str, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """MatrixMarket coordinates to (feature, cell, value).

    ``rows``/``cols`` are (index, name) tables with 1-based indices.  The size
    line says how many entries the file must hold; a short file is an error.
    """
    size_line = spark.read.text(path).where(~F.col("value").startswith("%")).first()[0]
    expected = int(size_line.split()[2])
    body = spark.read.csv(path, schema="i BIGINT, j BIGINT, value DOUBLE", sep=" ", comment="%", header=True)
    found = body.count()
    if found != expected:
        raise ValueError(f"{path}: {found} entries, header says {expected}")
    named = body.join(rows.select(F.col("index").alias("i"), F.col("name").alias("feature")), "i")
    named = named.join(cols.select(F.col("index").alias("j"), F.col("name").alias("cell")), "j")
    return named.select("feature", "cell", "value")


def annotation_attributes(spark: SparkSession, path: str, keep: str = "gene") -> DataFrame:
    """Attribute pairs of the ``keep`` rows of a nine-column annotation file."""
    f = F.split(F.col("value"), "\t")
    attrs = F.get(f, F.lit(8))
    pick = lambda key: F.nullif(F.regexp_extract(attrs, key + ' "([^"]+)"', 1), F.lit(""))
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("#") & (F.get(f, F.lit(2)) == keep))
        .select(pick("gene_id").alias("gene_id"), pick("gene_name").alias("gene_name"))
        .where(F.col("gene_id").isNotNull())
    )


def symbol_lookup(ids: DataFrame, attrs: DataFrame, ident: str) -> DataFrame:
    """Name of an id, falling back to the id without its version suffix."""
    exact = attrs.select(F.col("gene_id").alias(ident), F.col("gene_name").alias("_exact"))
    bare = attrs.groupBy(F.split("gene_id", r"\.")[0].alias("_bare")).agg(F.min("gene_name").alias("_loose"))
    out = ids.withColumn("_bare", F.split(ident, r"\.")[0]).join(exact, ident, "left").join(bare, "_bare", "left")
    return out.withColumn("symbol", F.coalesce("_exact", "_loose")).drop("_bare", "_exact", "_loose")


def headerless(spark: SparkSession, path: str, schema: str, junk: str | None = None,
               number: str | None = None, sep: str = "\t") -> DataFrame:
    """No header: names come from ``schema``; drop a junk row; coerce one column to a number."""
    df = spark.read.csv(path, schema=schema, sep=sep)
    if junk is not None:
        df = df.where(F.col(df.columns[0]) != junk)
    if number is not None:
        df = df.withColumn(number, F.expr(f"try_cast(`{number}` AS double)"))
    return df


def json_leaves(df: DataFrame, ident: str, text: str, at_once: int = 4) -> DataFrame:
    """(ident, path, scalar) for every leaf of nested JSON text, arrays by position.

    Each pass opens ``at_once`` levels of objects and arrays in place and passes leaves
    on; passes go on, over what is still nested, until nothing is.
    """
    tvf = df.sparkSession.tvf
    done, level = None, df.select(ident, F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("_v"))
    kind = F.schema_of_variant("_v")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    while True:
        for _ in range(at_once):
            x = tvf.variant_explode_outer(F.col("_v").outer())
            step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
            level = level.lateralJoin(x).select(
                ident,
                F.when(step.isNull(), F.col("path")).when(F.col("path") == "", step)
                .otherwise(F.concat_ws(".", "path", step)).alias("path"),
                F.coalesce(F.col("value"), F.col("_v")).alias("_v"),
            )
        level = level.where(~kind.isin("OBJECT<>", "ARRAY<VOID>") & F.col("_v").isNotNull())
        leaves = level.where(~nested).select(ident, "path", F.col("_v").cast("string").alias("scalar"))
        done = leaves if done is None else done.unionByName(leaves)
        deeper = level.where(nested)
        if deeper.isEmpty():
            return done
        level = deeper


def pick_rows(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of a very large table whose key is in a small set."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def pick_summary(df: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Rows seen, rows kept, wanted keys found, kept rows with a missing value: one pass."""
    flags = wanted.select(key).distinct().withColumn("_keep", F.lit(True))
    tagged = df.join(flags, key, "left")
    kept = F.coalesce(F.col("_keep"), F.lit(False))
    return tagged.groupBy(key, kept.alias("_kept")).agg(
        F.count("*").alias("_n"), F.count_if(F.col(value).isNull()).alias("_missing")
    ).agg(
        F.sum("_n").alias("rows_seen"),
        F.coalesce(F.sum(F.when(F.col("_kept"), F.col("_n"))), F.lit(0)).alias("rows_kept"),
        F.count_if("_kept").alias("keys_found"),
        F.coalesce(F.sum(F.when(F.col("_kept"), F.col("_missing"))), F.lit(0)).alias("cells_missing"),
    )
