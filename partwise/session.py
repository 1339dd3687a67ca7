"""Session settings and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "partwise", memory: str = "16g") -> SparkSession:
    """A session for tests and for the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that jobs run from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_partwise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._partwise_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the session names.

    The folder comes from ``spark.checkpoint.dir`` (or one already set on the
    context); a temporary folder is used only on a local master.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """How many pieces a big group is split into: follows the shuffle width."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, shared on a cluster."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to compressed files in the shared folder and reads it back.

    A large table takes a fraction of a checkpoint's room there.  At the end of the block the files
    go, and so do those of shuffles that nothing reads any more; what comes from them must be stored by then.
    """
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(scratch_dir(spark, "kept"))
        df.write.parquet(made[-1], compression="zstd")
        _collect(spark)
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield keep
    finally:
        jvm = spark.sparkContext._jvm
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _collect(spark)


def _collect(spark: SparkSession) -> None:
    """Spark drops the files of a shuffle once its table is collected as garbage; a large heap is seldom searched unasked."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
