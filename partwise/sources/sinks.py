"""Writers and content checks."""

from __future__ import annotations

import gzip
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write a result as parquet, csv or json."""
    df.write.format(fmt).options(**options).mode("overwrite").save(path)
    return path


def nested_report(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "report") -> DataFrame:
    """One JSON document per key."""
    return df.select(*keys, F.to_json(F.struct(*fields)).alias(name))


def feature_subset(expr: DataFrame, cells: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the wanted features; cells that are all zero there vanish from both tables."""
    part = expr.join(wanted.select("feature").distinct(), "feature", "left_semi")
    alive = part.groupBy("cell").agg(F.sum("value").alias("_s")).where("_s > 0").select("cell")
    return part.join(alive, "cell", "left_semi"), cells.join(alive, "cell", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace every old row with the same key."""
    keep = old.join(new.select(key).distinct(), key, "left_anti")
    return keep.unionByName(new, allowMissingColumns=True)


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else gzip.compress(s.encode()))


@F.pandas_udf(T.BinaryType())
def gunzipped(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else gzip.decompress(b))


def file_hashes(spark: SparkSession, path: str, decode_gzip: bool = False) -> DataFrame:
    """(path, bytes, sha256) of a file tree, one task per group of files.

    A file is hashed as one value; one of two gigabytes or more cannot be one and is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") >= (1 << 31) - 1024).select("path").first()
    if large is not None:
        raise ValueError(f"{large[0]} has two gigabytes or more")
    if decode_gzip:
        packed = F.col("path").endswith(".gz")
        files = files.withColumn("content", F.when(packed, gunzipped(F.when(packed, F.col("content")))).otherwise(F.col("content")))
    return files.select(
        F.col("path"), F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def identical_files(hashes: DataFrame) -> DataFrame:
    """Content that occurs in more than one file."""
    return hashes.groupBy("sha256", "bytes").agg(F.count("*").alias("copies")).where("copies > 1")
