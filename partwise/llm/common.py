"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.session import scratch_dir


#: Texts that a Python function gets at once.
SLICE = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    This cuts lineage like a checkpoint and, unlike one, gives Spark the size, so
    that it alone decides about broadcasting.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the whole text, a missing one as the empty text."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most SLICE rows; unused memory is given back between batches."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)
        del batch
        pa.default_memory_pool().release_unused()


def per_text(df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str) -> DataFrame:
    """Replace the last column, ``text``, by the columns of ``schema``; the other columns stay.

    ``fn`` gets at most SLICE texts and returns one list per new column.  Memory that Arrow has
    done with goes back to the system after each batch, as a worker lives on for later stages.
    """
    from pyspark.sql.types import StructType

    keep = [f for f in df.schema.fields if f.name != "text"]
    made = StructType.fromDDL(schema)
    names = [f.name for f in made.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            out = fn(batch.column(at).to_pylist())
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*cols, *[pa.array(out[n], type=kinds[n]) for n in names]],
                names=[*[n for i, n in enumerate(batch.schema.names) if i != at], *names])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in made.fields}
    return df.mapInArrow(work, StructType([*keep, *made.fields]))


class Memo(dict):
    """A table filled on demand, of at most ``most`` entries.

    When half of them are used, the table starts anew and the former one serves only to
    refill it, so what is in steady use stays and the rest goes.  With ``longest``, longer
    keys are made anew each time, which bounds the table in bytes as well.
    """

    def __init__(self, make: Callable, most: int = 400_000, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.former = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if 2 * len(self) >= self.most:
            self.former = dict(self)
            self.clear()
        value = self.former.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
